import random
import re
from collections import Counter, defaultdict

import duckdb

from sievework.llm import collocations

DATA = "/root/testdata/sf0.01"


def by_hand(rows, min_count, best, share=100):
    """All runs of one to five words of each piece, in dictionaries; a shorter phrase against each longer one."""
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            counts[lang].update(tuple(words[i : i + k]) for k in range(1, 6) for i in range(len(words) - k + 1))
    out = []
    for lang, count in counts.items():
        often = {p: n for p, n in count.items() if n >= min_count and len(p) > 1}
        longer = {p[i : i + k]: 0 for p in often for k in range(2, len(p)) for i in range(len(p) - k + 1)}
        for p, n in often.items():
            for part in {p[i : i + k] for k in range(2, len(p)) for i in range(len(p) - k + 1)}:
                longer[part] = max(longer[part], n)
        found = []
        for p, a in often.items():
            if 100 * longer.get(p, 0) < share * a:
                cuts = [(1000 * a * total[lang] // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p))]
                score, k = min(cuts)
                found.append((-score, -a, " ".join(p).encode(), " ".join(p), count[p[:k]], count[p[k:]]))
        out += [(lang, i, phrase, -a, l, r, total[lang], -score) for i, (score, a, _, phrase, l, r) in enumerate(sorted(found)[:best], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()))


def some_rows():
    rng = random.Random(5)
    words = ["the", "The", "cat", "sat", "é", "É", "a\x00b", "\x01", "a", "日本", "on"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", "  ", ". ", "\n", "\x0b", "!? "]) for _ in range(rng.randrange(40)))
    rows = [(text(), rng.choice(["en", "en", "de", None, "und"])) for _ in range(60)]
    copy = "this passage of many words stands in all copies, the same passage"
    return rows + [(copy, "en")] * 9 + [(None, "en"), ("", "fr"), ("... !", "fr"), ("word " * 500, "long"), ("one two three four five six seven\n" * 4, "path"), ("same same same same same same", None)]


def test_against_dictionaries(spark, documents, monkeypatch):
    monkeypatch.setattr(collocations, "BLOCK", 64)
    rows = some_rows()
    df = documents([(i, *r) for i, r in enumerate(rows)])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        for min_count, best, share, words, places in ((3, 2000, 100, 1000, 11), (4, 3, 100, 0, 1 << 20), (2, 2000, 60, 0, 16)):
            got = rows_of(collocations.collocations(df.repartition(3), min_count, best, share, words, places))
            assert got == by_hand(rows, min_count, best, share)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got


def test_nothing_frequent(spark, documents):
    assert collocations.collocations(documents([(1, "a b c", "en")])).count() == 0
    assert collocations.collocations(documents([(1, None, "en")]).limit(0)).count() == 0


def test_scores_beyond_64_bits(spark):
    big = 9_000_000_000_000_000
    phrases = spark.createDataFrame([(1, 2, 0, 0, 0, big, big)], "w1 long, w2 long, w3 long, w4 long, w5 long, a long, total long")
    counts = spark.createDataFrame([(1, 0, 0, 0, 0, big), (2, 0, 0, 0, 0, big - 1)], "w1 long, w2 long, w3 long, w4 long, w5 long, n long")
    assert collocations.scored(phrases, counts).first().score == 1000 * big * big // (big * (big - 1))


def test_sql_agrees(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    con.execute(f"CREATE TEMP TABLE found AS {collocations.DE_BRUIJN_SQL}")
    assert rows_of(collocations.op12_de_bruijn(spark, DATA)) == sorted(con.execute("SELECT lang, rank, phrase, a, l, r, n, score FROM found").fetchall())
