import math
import random

from sievework.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score string, rank string"


def brute(rows, k):
    import numpy as np

    usable = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in usable:
        if q % 5 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in usable if i != q and len(a) == len(b))
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([-1.0, 0.5, 0.25, rng.uniform(-1, 1)]) for _ in range(6)], "x", "y") for i in range(120)]
    rows += [(200 + i, [0.5] * 6, "x", "y") for i in range(40)]  # ties
    rows += [(300, None, "x", "y"), (301, [1.0, None, 1.0, 1.0, 1.0, 1.0], "x", "y"), (302, [float("nan")] * 6, "x", "y"), (303, [float("inf")] * 6, "x", "y"), (305, [1.0, 2.0], "x", "y"), (306, [2.0, 2.0], "x", "y"), (310, [], "x", "y"), (None, [1.0] * 6, "x", "y")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for block in (4096, 10):
        got = topk.top_k(df, df.filter("vec_id % 5 = 0"), k=4, block=block)
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got.collect()) == brute(rows, 4)


def test_fewer_candidates_and_huge_values(spark):
    rows = [(0, [1e30, -1e30], "", ""), (1, [1e30, 1.0], "", ""), (2, [3.0, 4.0], "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = topk.top_k(df, df.filter("vec_id = 0"), k=10).collect()
    assert [(r.rank, r.vec_id) for r in sorted(got, key=lambda r: r.rank)] == [(1, 1), (2, 2)]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0


def test_rows_that_share_an_id(spark):
    rows = [(0, [1.0, 0.0], "", ""), (0, [0.0, 1.0], "", ""), (1, [0.5, 0.25], "", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = topk.top_k(df, df.filter("vec_id = 0"), k=10).collect()
    unit = 1024 * 1024
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == [(0, 1, 1, unit // 4), (0, 1, 1, unit // 2), (0, 2, 0, 0), (0, 2, 0, 0)]


def test_rows_that_repeat_meet_each_other(spark):
    import duckdb

    rng = random.Random(3)
    rows = [(rng.choice([0, 0, 100, 1, 2]), [rng.choice([0.5, 1.0]), rng.choice([-0.5, 1.0])], "", "") for _ in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", [r[:2] for r in rows])
    got = topk.top_k(df, df.filter("vec_id % 100 = 0"), k=10).collect()
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == sorted(con.execute(topk.TOPK_SQL).fetchall())
    few = spark.createDataFrame([(0, [1.0], "", ""), (0, [1.0], "", ""), (1, [0.5], "", "")], SCHEMA)
    got = topk.top_k(few, few.filter("vec_id = 0"), k=10).collect()
    assert sorted((r["rank"], r.vec_id) for r in got) == [(1, 0), (1, 0), (2, 1), (2, 1)]
