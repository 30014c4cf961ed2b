"""Costly expressions are computed once a row: plans name them once, and texts are indexed without a shuffle."""

import os

import pytest
from pyspark.sql import functions as F

from sievework.functions import similarity
from sievework.operators import documents
from sievework.plans import queries
from sievework.sources import payloads

DATA = "/root/testdata/sf0.001"


def plan(df, which="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), which)().toString()


def test_dice_cleans_each_title_once(spark):
    df = spark.createDataFrame([("ab ab", "ab  AB!"), ("aaaa", "aa"), ("", "x"), (None, "x")], "a string, b string").coalesce(1)
    scored = df.select(similarity.dice_title_score(F.col("a"), F.col("b")).alias("s"))
    assert plan(scored).count("[^a-z0-9]+") == 2
    # Three pairs against one, of which one is common; the word isn't.
    assert [round(r.s, 6) for r in scored.collect()] == [1.0, round(0.55 * 2 / 4, 6), 0.0, 0.0]


@pytest.mark.parametrize("provider", ["crossref", "openalex", "semanticscholar", "entries"])
def test_answers_are_parsed_once(spark, provider):
    raw = spark.range(3).select(F.concat(F.lit('{"DOI":"10.1/'), F.col("id").cast("string"), F.lit('"}')).alias("payload"))
    for rows in payloads.split_answers(raw, provider):
        assert plan(rows).lower().count("parsejson") + plan(rows).lower().count("parse_json") == 1


def test_texts_are_indexed_within_their_rows(spark):
    df = spark.createDataFrame([(1, "b a  b"), (1, "c"), (2, None), (3, ""), (4, " ")], "doc_id int, text string").coalesce(1)
    made = df.select("doc_id", payloads.inverted_index(F.col("text")).alias("i"))
    assert "Exchange" not in plan(made, "executedPlan")
    assert [r.i for r in made.collect()] == [{"a": [1], "b": [0, 2]}, {"c": [0]}, None, {}, {}]
    assert [r.t for r in made.select(payloads.inverted_abstract(F.col("i")).alias("t")).collect()] == ["b a b", "c", None, "", ""]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_inverted_abstracts_shuffle_nothing(spark):
    assert "Exchange" not in plan(queries.queries()["inverted_abstracts"](spark, DATA), "executedPlan")


def test_abstracts_look_for_each_sort_of_line_once(spark):
    df = documents.abstracts(spark.createDataFrame([("x",)], "text string"))
    assert plan(df).count("revised|published") == 1
