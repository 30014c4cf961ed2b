"""Title pairs by blocks: against all pairs, and with many copies."""

import random

import pytest
from pyspark.sql import functions as F

from sievework.functions import similarity
from sievework.functions.title_cells import Cell
from sievework.operators import linkage


@pytest.fixture(scope="module")
def odd_titles():
    rng = random.Random(5)
    words = ["of", "the", "de", "zelle", "straße", "études", "αβγ", "𝒳x", "a", "cell-line", "x" * 70, "non\u200bspace"]
    made = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 9))) for _ in range(60)]
    return [*made, *(" ".join(["word"] * 3 + [w]) for w in words), "", None, "&", "  "]


@pytest.mark.parametrize("threshold", [0.5, 0.9])
def test_pairs_are_those_of_a_cross_join(spark, odd_titles, threshold):
    asked = spark.createDataFrame(list(enumerate(odd_titles)), "request int, title string")
    hits = spark.createDataFrame([(i, t and t[::-1] if i % 4 == 0 else t) for i, t in enumerate(odd_titles)], "hit int, hit_title string")
    every = asked.crossJoin(hits).withColumn("s", similarity.title_score(F.col("title"), F.col("hit_title"))).filter(F.col("s") >= threshold)
    wanted = {(r.request, r.hit): r.s for r in every.collect()}
    assert len(wanted) > len(odd_titles) / 2
    assert {(r.request, r.hit): r.score for r in linkage.scored_pairs(asked, hits, threshold).collect()} == wanted


def test_blocks_of_any_size_give_the_same_pairs(spark, odd_titles, monkeypatch):
    asked = spark.createDataFrame([(t,) for t in odd_titles], "title string").transform(lambda df: linkage.with_forms(df, "title", "plain"))
    hits = asked.withColumnRenamed("plain", "hit_plain")
    rows = lambda: {tuple(r) for r in linkage.title_pairs(asked, hits, 0.5).collect()}
    one = rows()
    monkeypatch.setattr(linkage, "ASKED_BLOCK", 2)
    monkeypatch.setattr(linkage, "HIT_BLOCK", 7)
    assert one and rows() == one


def test_bounds_stay_above_the_score(odd_titles):
    texts = [t for t in odd_titles if t and t.strip()]
    cell = Cell(texts, texts)
    every = {(a, b): s for a, b, s in zip(*cell.by_score(0.0), strict=True)}
    for threshold in (0.4, 0.55, 0.8, 1.0):
        assert {(a, b): s for a, b, s in zip(*cell.by_score(threshold), strict=True)} == {k: s for k, s in every.items() if s >= threshold - 1e-6}


@pytest.mark.parametrize("match", [lambda a, h: linkage.match_titles(a, h, 0.72, 3), lambda a, h: linkage.match_titles_by_words(a, h, 0.45, 3), lambda a, h: linkage.match_simple(a, h.withColumn("author", F.when(F.col("hit") > 3990, "A B")), 0.5, 3)])
def test_copies_of_a_title_are_compared_once(spark, monkeypatch, match):
    asked = spark.range(4000).select(F.col("id").alias("request"), F.lit("The same title of all").alias("title"))
    hits = spark.range(4000).select(F.col("id").alias("hit"), F.lit("the same  title, of all").alias("hit_title"))
    # A row for each pair of copies would be sixteen million: no join may see them.
    monkeypatch.setattr(linkage, "every_row", None)
    ranked = match(asked, hits)
    found = ranked.groupBy("hit", "n").count().collect()
    first = [3991, 3992, 3993] if "rank_score" in ranked.columns else [0, 1, 2]
    assert sorted(tuple(r) for r in found) == [(hit, n, 4000) for n, hit in enumerate(first, 1)]


def test_copies_of_a_cut_title_all_match(spark):
    asked = spark.range(50).select(F.col("id").alias("request"), F.lit("A title that is long enough to be cut: and more").alias("title"))
    hits = spark.range(80).select(F.col("id").alias("hit"), F.when(F.col("id") % 2 == 0, "A title that is long enough…").otherwise("A title that is long enough to be cut, and more").alias("hit_title"))
    rows = linkage.match_cut_titles(asked, hits).collect()
    assert sorted(tuple(r) for r in rows) == sorted((r, h, "score" if h % 2 else "beginning") for r in range(50) for h in range(80))
