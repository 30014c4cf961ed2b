import random

import pytest
from pyspark.sql import functions as F

from sievework.llm import lines


def brute(rows, max_edits, min_words):
    """The lines that stay, by comparing each with all earlier ones."""
    seen, out = [], {}
    for doc_id, text in sorted(rows, key=lambda r: r[0]):
        if text is None:
            out[doc_id] = None
            continue
        kept = []
        for line in text.split("\n"):
            words = line.lower().split()
            if not words:
                kept.append(line)
                continue
            gone = any(words == w or max_edits and min(len(words), len(w)) >= min_words and near(words, w) for w in seen)
            seen.append(words)
            if not gone:
                kept.append(line)
        out[doc_id] = "\n".join(kept)
    return out


def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    n = min(len(a), len(b))
    i = next((i for i in range(n) if a[i] != b[i]), n)
    j = next((j for j in range(n) if a[-1 - j] != b[-1 - j]), n)
    return i + j >= max(len(a), len(b)) - 1


@pytest.mark.parametrize("max_edits", [0, 1])
def test_against_brute_force(spark, documents, max_edits):
    rng = random.Random(max_edits)
    base = [[rng.choice("abcdefgh") for _ in range(rng.randint(1, 14))] for _ in range(12)]
    rows = []
    for d in range(60):
        text = []
        for _ in range(rng.randint(0, 5)):
            line = list(rng.choice(base))
            change = rng.random()
            at = rng.randrange(len(line))
            if change < 0.3:
                line[at] = rng.choice("xyz")
            elif change < 0.5:
                line.insert(at, rng.choice("xyz"))
            elif change < 0.7 and len(line) > 1:
                del line[at]
            text.append(" ".join(line).upper() if rng.random() < 0.2 else "  ".join(line))
        rows.append((d, "\n".join(text)))
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "a " * 3000)]
    got = {r.doc_id: r.text for r in lines.dedup_lines(documents(rows), max_edits=max_edits, min_words=5).collect()}
    assert got == brute(rows, max_edits, 5)


def test_rows_and_columns_stay(spark, documents):
    df = documents([(None, "one two"), (1, "one two\nthree"), (1, "one two\nthree"), (2, "three"), (None, None)])
    out = lines.dedup_lines(df)
    assert out.count() == 5 and set(df.columns) <= set(out.columns)
    assert sorted((r.text or "") for r in out.collect()) == ["", "", "", "one two\nthree", "one two\nthree"]
    assert sorted((r.text or "") for r in lines.dedup_lines(df.orderBy(F.desc_nulls_last("doc_id"))).collect()) == ["", "", "", "one two\nthree", "one two\nthree"]
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_counts(spark, documents):
    out = lines.dedup_lines(documents([(1, "a\na\nb")], extra=False)).collect()[0]
    assert (out.n_lines, out.n_dropped, out.text) == (3, 1, "a\nb")


LONG = "one two three four five six seven"


def test_ids_that_repeat_or_are_null(spark, documents):
    """Each text is a document of its own, whatever its id; in any order of rows."""
    rng = random.Random(8)
    pool = [LONG, LONG + " eight", LONG.replace("two", "2"), "alone in the world", "b", *(f"line {i} of its own with some words" for i in range(12))]
    rows = [(rng.choice([None, None, 1, 2, 2, 3, -(1 << 63), (1 << 63) - 1]), "\n".join(rng.sample(pool, rng.randint(1, 4)))) for _ in range(30)]
    rows += [(1, LONG), (2, LONG.replace("six", "6")), (2, "unique line of two"), (None, "first of none"), (None, "second of none"), (5, None), (5, "text beside null")] + rows[:3]
    for some in (rows, rows[::-1]):
        df = documents(some)
        at = {(r.doc_id, r.text): r.n for r in df.select("doc_id", "text", lines.Places(df).doc().alias("n")).collect()}
        want = brute([(at[r], r[1]) for r in set(rows)], 1, 6)
        got = lines.dedup_lines(df).select("doc_id", "text", "n_chars").collect()
        assert sorted(map(str, (r.text for r in got))) == sorted(str(want[at[r]]) for r in rows)
        assert {"unique line of two", "first of none", "second of none", "text beside null"} <= {line for r in got for line in (r.text or "").split("\n")}


def test_hash_that_two_texts_share_is_changed(spark, documents, monkeypatch):
    monkeypatch.setattr(lines, "BITS", 7)
    df = documents([(i % 3, f"text {i}") for i in range(15)])
    places = lines.Places(df)
    assert df.select(places.doc()).distinct().count() == 15 and places.seed > 0
