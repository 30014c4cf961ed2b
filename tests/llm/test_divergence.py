import re
from collections import Counter, defaultdict

import duckdb

from sievework.llm import divergence

DATA = "/root/testdata/sf0.01"


def by_hand(rows, min_docs, best):
    """Dictionaries over (text, lang, source); a term counts once a document for ``min_docs``."""
    docs, counts, groups = Counter(), Counter(), defaultdict(set)
    for text, lang, source in ((a or "", b or "", c or "") for a, b, c in rows):
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        docs.update((lang, t) for t in set(terms))
        counts.update((lang, source, t) for t in terms)
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for (of, t), n in docs.items() if of == lang and n >= min_docs]
        share = lambda of, t: 1 + 10**9 * (sum(counts[lang, s, t] for s in of) + 5) // (sum(counts[lang, s, x] for s in of for x in kept) + 5 * len(kept))  # noqa: B023, E731
        for s in sources:
            pairs = [(-sum(abs(share([s], t) - share([o], t)) for t in kept), o.encode(), o) for o in sources - {s}]
            terms = [(share(sources, t) - share([s], t), t.encode(), t) for t in kept if counts[lang, s, t] and share([s], t) > share(sources, t)]
            out += [(lang, s, "pair", o, -v, i) for i, (v, _, o) in enumerate(sorted(pairs), 1)]
            out += [(lang, s, "term", t, -v, i) for i, (v, _, t) in enumerate(sorted(terms)[:best], 1)]
    return sorted(out)


def rows_of(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


ROWS = [
    ("The cat, the Cat!\x00É é ÉCOLE 12", "en", "a"), ("the the dog_cat", "en", "b"), (None, "en", "c"), ("", "en", None), ("cat cat dog", "en", "b"), ("cat cat dog", "en", "b"),
    ("THE end the END the", None, "a"), ("the end", "", "b"), ("日本 日本 the￿", None, None), ("solo", "fr", "only"), (None, "xx", "p"), ("12 !?", "xx", "q"), ("dog " * 3000 + "cat", "en", "a"),
]


def test_odd_rows(spark, documents, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK", 50)
    df = documents([(i if i % 3 else None, *row) for i, row in enumerate(ROWS)])
    for min_docs, best in ((1, 50), (2, 2), (3, 1)):
        want = by_hand(ROWS, min_docs, best)
        assert rows_of(divergence.source_divergence(df, min_docs, best)) == want
        assert rows_of(divergence.source_divergence(df.repartition(3), min_docs, best, cells=4)) == want
    assert any(r[:5] == ("xx", "p", "pair", "q", 0) for r in want)
    assert divergence.source_divergence(df.limit(0)).count() == 0


def test_term_needs_thirty_documents(spark, documents):
    rows = [("often " + ("rare" if i < 29 else "word" if i > 60 else ""), "en", "ab"[i % 2]) for i in range(100)]
    got = rows_of(divergence.source_divergence(documents([(i, *r) for i, r in enumerate(rows)])))
    assert got == by_hand(rows, 30, 50) and {r[3] for r in got if r[2] == "term"} <= {"often", "word"}


def test_shares_are_exact():
    import numpy as np

    whole = [13, 999_999_937, 123_456_789_012_345_679, 900_000_000_000_000_000]
    for part in (1, 7, 12):
        counts = [w * part // 13 for w in whole]
        got = divergence.shares(np.array(counts, dtype=np.int64), np.array(whole, dtype=np.int64))
        assert got.tolist() == [1 + 10**9 * c // w for c, w in zip(counts, whole, strict=True)]


def test_sql_agrees(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    con.execute(f"CREATE TEMP TABLE found AS {divergence.STRIPES_SQL}")
    assert rows_of(divergence.op11_stripes(spark, DATA)) == sorted(con.execute("SELECT lang, source, part, item, value, rank FROM found").fetchall())
