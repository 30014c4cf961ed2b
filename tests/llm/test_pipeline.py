"""The pipeline's stages on the smallest tables, and the operators' SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from sievework.llm import queries
from tests.llm.test_bagminhash import classes
from tests.llm.test_lines import brute

DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    kept, columns = docs, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = kept
        stage(spark, before, DATA).write.parquet(str(tmp_path / name))
        kept = spark.read.parquet(str(tmp_path / name))
        rows = [(r.doc_id, r.text) for r in before.collect()]
        if name != "tokens":
            assert kept.columns == columns
        if name == "repeated_lines":
            assert {r.doc_id: r.text for r in kept.collect()} == brute(rows, 1, 6)
        if name == "near_copies":
            expected = classes(rows)
            assert {r.doc_id for r in kept.collect()} == {d for d, c in expected.items() if d == c}
        if name == "tokens":
            assert kept.count() == before.count() and kept.filter(F.col("n_tokens") < 0).count() == 0
    run = corpus_pipeline.run(spark, DATA)
    assert {tuple(r) for r in run.collect()} == {tuple(r) for r in kept.collect()}


def test_odd_rows_through_all_stages(spark, tmp_path):
    """Ids that repeat or are null, equal rows, clashing columns, in two orders; then an empty table."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").filter("doc_id < 90")
    leak = spark.read.parquet(f"{DATA}/benchmark.parquet").orderBy("item_id").first().text
    line = "the house by the river is old and its garden is full of trees"
    odd = [(None, line), (None, "the man and the woman went to the house in the evening"), (3, "it was " + leak), (3, "we had a good day at the sea and the children were happy"), (None, "it is said " + leak), (7, line + "\nbut this is only here and nowhere else in the corpus"), (7, None), (8, ""), (8, "..."), (9, line.replace("old", "new"))]
    odd += odd[:4]
    extra = spark.createDataFrame([(*r, "en", "s", 1) for r in odd], docs.schema)
    seen = []
    for order in ("doc_id", F.desc("text")):
        folder = tmp_path / str(len(seen))
        whole = docs.unionByName(extra).orderBy(order).withColumns({c: F.lit("mine") for c in ("d", "own", "of", "t", "bad_id", "score", "n_tokens")})
        whole.repartition(3).write.parquet(f"{folder}/documents.parquet")
        spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(f"{folder}/benchmark.parquet")
        kept = spark.read.parquet(f"{folder}/documents.parquet")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            stage(spark, kept, str(folder)).write.parquet(f"{folder}/{name}")
            assert spark.read.parquet(f"{folder}/{name}").columns == kept.columns
            kept = spark.read.parquet(f"{folder}/{name}")
        texts = [r.text for r in kept.collect()]
        assert not any(leak in t for t in texts) and "the man and the woman went to the house in the evening" in texts and "we had a good day at the sea and the children were happy" in texts
        assert sum("but this is only here" in t for t in texts) == 1 and {r.own for r in kept.collect()} == {"mine"}
        seen.append(sorted((str(r[0]), *map(str, r[1:])) for r in corpus_pipeline.run(spark, str(folder)).collect()))
    assert seen[0] == seen[1] and seen[0]
    kept.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    spark.read.parquet(f"{DATA}/benchmark.parquet").write.parquet(f"{tmp_path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    key = lambda r: tuple(map(str, r))
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key) == sorted((tuple(r[names.index(c)] for c in columns) for r in cursor.fetchall()), key=key)
