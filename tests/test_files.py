"""Readers and writers of files, and rules that no registered query calls."""

import json

from pyspark.sql import functions as F

from sievework.operators import documents, identity, screening
from sievework.sources import corpus, lists, sinks
from sievework.streaming import jobs


def lines_of(spark, path):
    return [r.value for r in spark.read.text(str(path)).collect()]


def test_id_list_file(spark, tmp_path):
    (tmp_path / "ids.txt").write_text("﻿# found\nhttps://doi.org/10.5555/A\narXiv:2101.00001v2\n\nSome title\n---\n", encoding="utf-8")
    got = lists.read_id_list(spark, str(tmp_path / "ids.txt")).collect()
    assert sorted((r.kind, r.key) for r in got) == [("doi", "10.48550/arxiv.2101.00001"), ("doi", "10.5555/a"), ("title", "Some title")]


def test_tagged_file(spark, tmp_path):
    (tmp_path / "x.ris").write_text("TY  - JOUR\nDO  - 10.5555/a\nTI  - One\nER  - \nTY  - JOUR\nTI  - Two\nER  - \n")
    got = lists.read_tagged(spark, str(tmp_path / "x.ris"), "base").collect()
    assert [(r.label, r.has_doi) for r in got] == [("10.5555/a", True), ("Two", False)]


def test_run_event_log(spark, tmp_path):
    (tmp_path / "run.ndjson").write_text(json.dumps({"run": "r", "item": "i", "status": "ok", "ms": 1.5, "pass": 1, "at": "2024-01-01T00:00:00Z"}) + "\n" + json.dumps({"run": "r", "item": "j", "status": "failed", "extra": 1}) + "\n")
    events = corpus.read_run_events(spark, str(tmp_path / "run.ndjson"))
    assert [tuple(r) for r in jobs.run_progress(events).collect()] == [("r", 1, 0, 1, 2)]


def test_search_lists(spark, tmp_path):
    found = spark.createDataFrame([("10.5555/b", "B"), ("10.5555/a", "A"), ("10.5555/a", "A"), (None, "No id"), (None, None)], "doi string, title string")
    sinks.write_search_lists(found, str(tmp_path))
    got = {name: sorted(lines_of(spark, tmp_path / name)) for name in ("ids", "without_id", "combined", "links")}
    assert got == {"ids": ["10.5555/a", "10.5555/b"], "without_id": ["No id"], "combined": ["10.5555/a", "10.5555/b", "No id"], "links": ["https://doi.org/10.5555/a", "https://doi.org/10.5555/b"]}


def test_question_extracts(spark, tmp_path):
    rows = [("Q1", "a", "Sim", ["s"]), ("Q1", "b", " n/a ", []), ("Q2", "a", None, []), ("Q2", "b", "Não", ["t", "u"])]
    sinks.write_question_extracts(spark.createDataFrame(rows, "question string, article string, answer string, snippets array<string>"), str(tmp_path / "q"))
    got = spark.read.json(str(tmp_path / "q"))
    assert sorted((r.question, r.article, r.answer, r.snippets) for r in got.collect()) == [("Q1", "a", "Sim", ["s"]), ("Q2", "b", "Não", ["t", "u"])]


def test_report(spark, tmp_path):
    counts = spark.createDataFrame([("screened", 3), ("included", 1)], "label string, value int")
    sinks.write_report(counts, "Run", str(tmp_path / "report"))
    assert lines_of(spark, tmp_path / "report") == ["# Run", "", "included: 1", "screened: 3"]


def test_change_feed(spark, tmp_path):
    before = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id int, state string")
    batches = [[(1, "a"), (2, "B")], [(4, "d")]]
    write = jobs.change_feed(before, str(tmp_path))
    for n, rows in enumerate(batches):
        write(spark.createDataFrame(rows, "id int, state string"), n)
    assert spark.read.parquet(str(tmp_path / "trail")).count() == 3
    assert sorted((r.batch, r.id, r.change) for r in spark.read.parquet(str(tmp_path / "changes")).collect()) == [(0, 2, "changed"), (1, 4, "added")]


def test_a_suggestion_is_current_for_the_same_record_only(spark):
    record = spark.createDataFrame([("d", "t", "a", "x")], "doi string, title string, authors string, abstract string").withColumn("was", screening.record_hash())
    now = lambda df: df.select(screening.is_current(F.lit(2), F.lit("c"), F.col("was"), 2, "c", screening.record_hash())).first()[0]
    assert now(record) is True and now(record.withColumn("abstract", F.lit("y"))) is False and now(record.withColumn("was", F.lit(None).cast("string"))) is False
    other = record.select(screening.is_current(F.lit(1), F.lit("c"), F.col("was"), 2, "c", screening.record_hash()), screening.is_current(F.lit(2), F.lit("c"), F.col("was"), 2, "c", screening.record_hash(), F.lit(False))).first()
    assert tuple(other) == (False, False)


def test_recovered_works_and_trial_registers(spark):
    rows = [("A long title of work", "A long title of work"), ("Too short", "Too short"), ("A long title of work", "Another thing of ours altogether"), (None, "x")]
    assert [tuple(r) for r in identity.recovered_same_work(spark.createDataFrame(rows, "title string, hit_title string")).collect()] == [rows[0]]
    ids = spark.createDataFrame([("10.1002/CENTRAL/CN-0123",), ("10.1002/abc",)], "doi string").coalesce(1)
    assert [r[0] for r in ids.select(documents.is_trial_register(F.col("doi"))).collect()] == [True, False]
