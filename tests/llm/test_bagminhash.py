import random
import re
from collections import Counter

import numpy as np

from pyspark.sql import functions as F

from sievework.llm import bagminhash as bm
from sievework.llm.common import scratch


def test_signatures_are_unbiased():
    rng = np.random.default_rng(7)
    errors = []
    for _ in range(100):
        keys = rng.integers(0, 2**63, 60).astype(np.uint64)
        a = rng.integers(0, 9, 60)
        b = np.maximum(0, a + rng.integers(-2, 3, 60))
        agree = (bm.signature(keys[a > 0], a[a > 0], 1024) == bm.signature(keys[b > 0], b[b > 0], 1024)).mean()
        errors.append(agree - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.006


def classes(rows, threshold=0.8):
    bag = {}
    for d, t in rows:
        w = re.findall(r"[^\W_]+", t.lower())
        bag[d] = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter({(): 1})
    root = {d: d for d in bag}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in bag:
        for b in bag:
            if a < b:
                both = sum((bag[a] & bag[b]).values())
                if both >= threshold * (sum(bag[a].values()) + sum(bag[b].values()) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {d: find(d) for d in bag}


def test_against_brute_force(spark, documents):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for base in range(8):
        text = [rng.choice(words) for _ in range(rng.randint(60, 200))]
        for copy in range(rng.randint(1, 9)):
            changed = [w if rng.random() > 0.01 * copy else rng.choice(words) for w in text]
            rows.append((len(rows), " ".join(changed)))
            if copy % 3 == 0:
                rows.append((len(rows), ", ".join(changed).upper()))
    rows += [(500, ""), (501, "..."), (502, "one two"), (503, "One, two"), (504, "a b " * 2000), (505, "a b " * 2000)]
    got = {r.doc_id: r.class_id for r in bm.near_classes(documents(rows)).collect()}
    assert got == classes(rows)


def test_rows_stay(spark, documents):
    df = documents([(None, "x"), (1, None), (2, "a b c"), (2, "a b c"), (3, "a b c"), (None, None)])
    assert bm.near_classes(df).count() == 6
    kept = bm.drop_near_copies(df)
    assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == [("1", "None"), ("2", "a b c"), ("None", "None"), ("None", "x")] and kept.columns == df.columns
    assert bm.near_classes(df.limit(0)).count() == 0


def test_ids_that_repeat_or_are_null(spark, documents):
    """A copy costs no other text of its id; what stays doesn't depend on the order of rows."""
    rng = random.Random(4)
    texts = [" ".join(rng.choice("abcdefghijklmnopq") + str(rng.randrange(99)) for _ in range(60)) for _ in range(4)]
    near = [t + " and a word" for t in texts]
    rows = [(None, texts[0]), (None, near[0]), (1, texts[1]), (2, near[1]), (2, texts[2]), (None, "clean"), (3, near[3]), (4, texts[3]), (2, texts[2]), (None, None)]
    for some in (rows, rows[::-1]):
        for high in ((), ((1 << 62, "far beyond"),)):
            df = documents([*some, *high]).withColumn("own", F.lit("mine")).withColumn("of", F.lit("mine"))
            got = sorted((str(r.doc_id), r.text) for r in bm.drop_near_copies(df).collect() if r.text and r.own == r.of == "mine")
            assert len(got) == 5 + len(high) and {("2", texts[2]), ("None", "clean")} <= set(got)
            for a, b in zip(texts[:2] + texts[3:], near[:2] + near[3:]):
                assert sum(t in (a, b) for _, t in got) == 1
            assert high or {("1", texts[1]), ("3", near[3])} <= set(got)


def test_long_chains_meet(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(200, 100), (7, 7)], "x long, y long")
    with scratch(spark) as tables:
        got = {r.id: r.root for r in bm.components(links, tables).collect()}
    assert {got.get(i, i) for i in range(61)} == {0} and got[200] == 100
