"""Linkage of titles and responses: blocking, ranking, acceptance and cascades."""

from __future__ import annotations

import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions.ids import canonical_id, year_score
from sievework.functions.similarity import coverage, same_surname
from sievework.functions.text import title_ascii, title_words, token_set
from sievework.functions.title_cells import SLACK, Cell

#: Distinct titles in a block of requests and of hits, and the least number of request blocks, so that small inputs are spread too.
ASKED_BLOCK, HIT_BLOCK, LEAST_BLOCKS = 4_096, 32_768, 24
#: Parts into which the rows of one title are dealt, so that two large groups of copies aren't put together by one task.
PARTS = 16


def with_forms(titles: DataFrame, by: str, name: str) -> DataFrame:
    """Rows whose title has a word, with its normal form."""
    return titles.withColumn(name, title_words(F.col(by))).filter(F.col(name) != "")


def title_pairs(asked: DataFrame, hits: DataFrame, threshold: float, words_only: bool = False) -> DataFrame:
    """Every pair (plain, hit_plain, score) of distinct normal forms whose title score, or word score alone, reaches the threshold.

    ``asked``: plain; ``hits``: hit_plain; repeats count once, so pairs don't grow with the square of copies. Blocks of
    requests meet blocks of hits, each pair of blocks in one task of bounded size: pairs are counted and bounded there, and
    only those that reach the threshold are ever rows.
    """
    about = lambda df, c: df.agg(F.approx_count_distinct(c)).first()[0]
    rows, columns = max(LEAST_BLOCKS, math.ceil(about(asked, "plain") / ASKED_BLOCK)), max(1, math.ceil(about(hits, "hit_plain") / HIT_BLOCK))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = asked.select("plain").distinct().select("plain", block("plain", rows).alias("i"), each(columns).alias("j"))
    h = hits.select("hit_plain").distinct().select("hit_plain", block("hit_plain", columns).alias("j"), each(rows).alias("i"))
    dealt = lambda df: df.withColumn("cell", F.col("i") * columns + F.col("j")).drop("i", "j").repartition(rows * columns, "cell").groupBy("cell")

    def scores(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = ([], [], [])
        if len(left) and len(right):
            cell = Cell(left["plain"].tolist(), right["hit_plain"].tolist())
            found = cell.by_words(threshold) if words_only else cell.by_score(threshold)
        return pd.DataFrame({"plain": pd.Series(found[0], dtype=str), "hit_plain": pd.Series(found[1], dtype=str), "score": pd.Series(found[2], dtype=float)})

    scored = dealt(a).cogroup(dealt(h)).applyInPandas(scores, "plain string, hit_plain string, score double")
    return scored.withColumn("score", F.round("score", 6)).filter(F.col("score") >= threshold)


def every_row(pairs: DataFrame, asked: DataFrame, hits: DataFrame) -> DataFrame:
    """Pairs of titles (plain, hit_plain and more) as pairs of all rows of ``asked`` (plain and more) and ``hits`` (hit_plain and more).

    The rows of one title travel in parts, and the pairs of parts are dealt evenly, so copies cost no more than the rows that they make.
    """
    parts = lambda df, key, name: df.groupBy(key, F.pmod(F.xxhash64(*[c for c in df.columns if c != key]), F.lit(PARTS)).alias("part")).agg(F.collect_list(F.struct(*[c for c in df.columns if c != key])).alias(name)).drop("part")
    both = pairs.join(parts(asked, "plain", "a"), "plain").join(parts(hits, "hit_plain", "h"), "hit_plain")
    dealt = both.repartition(int(both.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    kept = [c for c in pairs.columns if c not in ("plain", "hit_plain")]
    return dealt.select(*kept, F.explode("a").alias("a"), "h").select(*kept, "a", F.explode("h").alias("h")).select("a.*", "h.*", *kept)


def scored_pairs(asked: DataFrame, hits: DataFrame, threshold: float) -> DataFrame:
    """Every pair (request, title, hit, hit_title, score) whose title score reaches the threshold."""
    a, h = with_forms(asked.select("request", "title"), "title", "plain"), with_forms(hits.select("hit", "hit_title"), "hit_title", "hit_plain")
    return every_row(title_pairs(a, h, threshold), a, h)


def _first(rows: DataFrame, by: str, most: int, *order: Column | str) -> DataFrame:
    return rows.withColumn("n", F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col("n") <= most)


def _best(asked: DataFrame, hits: DataFrame, threshold: float, top: int, words_only: bool) -> DataFrame:
    """(request, hit, score, n). Of equal titles the first ``top`` by hit can be among a request's best; requests of one title share theirs."""
    a, h = with_forms(asked.select("request", "title"), "title", "plain"), with_forms(hits.select("hit", "hit_title"), "hit_title", "hit_plain")
    pairs = title_pairs(a, h, threshold, words_only)
    candidates = pairs.join(_first(h.select("hit", "hit_plain"), "hit_plain", top, "hit").drop("n"), "hit_plain")
    shared = _first(candidates.select("plain", "hit", "score"), "plain", top, F.desc("score"), "hit").drop("n")
    return _first(a.select("request", "plain").join(shared, "plain"), "request", top, F.desc("score"), "hit").select("request", "hit", "score", "n")


def match_titles(asked: DataFrame, hits: DataFrame, threshold: float = 0.72, top: int = 1) -> DataFrame:
    """(request, hit, score, n): hits whose title matches, best first, at most ``top`` a request."""
    return _best(asked, hits, threshold, top, words_only=False)


def match_titles_by_words(asked: DataFrame, hits: DataFrame, threshold: float = 0.45, top: int = 1) -> DataFrame:
    """As ``match_titles`` by word overlap alone (coverage and Jaccard)."""
    return _best(asked, hits, threshold, top, words_only=True)


def match_simple(asked: DataFrame, hits: DataFrame, threshold: float = 0.5, most: int = 10) -> DataFrame:
    """(request, hit, rank_score, n) as ``rank_simple`` has them over all pairs; ``hits``: hit, hit_title, author.

    Of equal titles, the first ``most`` by its order can be among a request's best.
    """
    a, h = with_forms(asked.select("request", "title"), "title", "plain"), with_forms(hits.select("hit", "hit_title", "author"), "hit_title", "hit_plain")
    pairs = title_pairs(a, h, threshold).withColumnRenamed("score", "similarity")
    candidates = pairs.join(_first(h, "hit_plain", most, F.desc(_author_bonus()), "hit").select("hit", "hit_plain", "author"), "hit_plain")
    shared = rank_simple(candidates.withColumnRenamed("plain", "request"), most).select(F.col("request").alias("plain"), "hit", "rank_score")
    return _first(a.select("request", "plain").join(shared, "plain"), "request", most, F.desc("rank_score"), "hit").select("request", "hit", "rank_score", "n")


def match_cut_titles(asked: DataFrame, hits: DataFrame, least: int = 20, threshold: float = 0.85) -> DataFrame:
    """(request, hit, how): hits ending in an ellipsis match by beginning, the others by score."""
    cut = hits.filter(F.trim("hit_title").rlike(r"(…|\.\.\.)$")).select("hit", title_words(F.regexp_replace("hit_title", r"(…|\.\.\.)\s*$", "")).alias("start")).filter(F.length("start") >= least)
    whole = with_forms(hits.join(cut.select("hit"), "hit", "left_anti"), "hit_title", "hit_plain").select("hit", "hit_plain")
    a = with_forms(asked, "title", "plain").select("request", "plain")
    starts = cut.select("start").distinct()
    # Beginnings of just the lengths that cut titles have are the join keys, so every candidate is a match.
    lengths = starts.select(F.length("start").alias("n")).distinct()
    long_enough = a.select("plain").distinct().filter(F.length("plain") >= least)
    begun = long_enough.select("plain", F.explode(F.sequence(F.lit(least), F.length("plain"))).alias("n")).join(lengths, "n").select("plain", F.left("plain", F.col("n")).alias("start"))
    hashed = lambda df: df.withColumn("k", F.xxhash64("start"))
    by_start = hashed(begun).join(hashed(starts), ["k", "start"]).select("plain", F.col("start").alias("hit_plain"))
    rows = lambda pairs, h, how: every_row(pairs.select("plain", "hit_plain"), a, h).select("request", "hit", F.lit(how).alias("how"))
    return rows(by_start, cut.withColumnRenamed("start", "hit_plain"), "beginning").unionByName(rows(title_pairs(a, whole, threshold), whole, "score"))


def recovery_pairs(asked: DataFrame, hits: DataFrame, threshold: float) -> DataFrame:
    """Pairs for ``rank_recovery``, whose ``request`` is the title: every hit above the threshold counts, equal ones as one row.

    ``asked``: title, requested_year, requested_author, the same for each title; ``hits``: hit_title, doi, resolver, year,
    author, urls. Titles are compared once however many records share them, so pairs don't grow with the square of those.
    """
    titles = asked.select("title", "requested_year", "requested_author").distinct()
    records = hits.groupBy("hit_title", "doi", "resolver", "year", "author").agg(F.array_distinct(F.flatten(F.collect_set("urls"))).alias("urls"))
    named = lambda df, name, by: df.select(F.col(by).alias(name), by).distinct()
    scored = scored_pairs(named(asked, "request", "title"), named(hits, "hit", "hit_title"), threshold)
    return scored.select("request", "title", "hit_title", F.col("score").alias("similarity")).join(titles, "title").join(records, "hit_title")


# Fixed weights: of the base score that chooses a candidate's record, of its rank score, and of further sources.
BASE = {"similarity": 0.50, "coverage": 0.30, "year_score": 0.10, "author_score": 0.10}
RANK = {"similarity": 0.78, "coverage": 0.12, "year_score": 0.06, "author_score": 0.04}
SOURCE, SOURCES = 0.02, 0.08


def _weighed(weights: dict[str, float], of: str = "") -> Column:
    total = F.lit(0.0)
    for name, weight in weights.items():
        total = total + weight * F.col(of + name)
    return total


def first_places(asked: DataFrame, hits: DataFrame, sources: int, bands: tuple[float, ...] = (0.9, 0.75, 0.5), keep: Callable[[DataFrame], DataFrame] = DataFrame.persist) -> DataFrame:
    """The first two candidates of each title, as ``rank_recovery`` has them over ``recovery_pairs`` at the last of ``bands``.

    Thresholds descend: a title whose first two places no pair below the band can change is settled, and only the
    others are joined again at the next threshold, where far more pairs are candidates. What a pair below the band could do:
    bring a new candidate, stand for a known one, or add a source to it; each has a highest score. ``sources`` bounds
    the number of resolvers; ``keep`` holds a band's candidates for the next step.
    """
    open_, out = asked, None
    for band in bands:
        ranked = rank_recovery(recovery_pairs(open_, hits, band), 1 << 30)
        if band != bands[-1]:
            ranked = keep(ranked)
            most = min(SOURCES, SOURCE * max(0, sources - 1))
            new = RANK["similarity"] * band + sum(RANK.values()) - RANK["similarity"] + most
            # Complete: no further source counts, and no record below the band has as good a base score.
            full = F.least(F.lit(SOURCES), SOURCE * (F.col("source_count") - 1)) >= most - 1e-9
            complete = full & (F.col("base") > BASE["similarity"] * band + sum(BASE.values()) - BASE["similarity"] + SLACK)
            could = F.when(complete, F.col("rank_score")).otherwise(F.least(F.lit(1.0), F.greatest(F.col("total") + most, F.lit(new))))
            second = F.max(F.when(F.col("n") == 2, F.col("rank_score")))
            rest = F.coalesce(F.max(F.when(F.col("n") > 2, could)), F.lit(0.0))
            judged = ranked.groupBy("request").agg(second.alias("second"), rest.alias("rest"), F.bool_and(complete | (F.col("n") > 2)).alias("complete"))
            settled = judged.filter(F.col("complete") & (F.col("second") > new + SLACK) & (F.col("second") > F.col("rest") + SLACK)).select(F.col("request").alias("title"))
            ranked = ranked.join(settled.withColumnRenamed("title", "request"), "request", "left_semi")
            open_ = open_.join(settled, "title", "left_anti")
        first = ranked.filter("n <= 2").withColumn("band", F.lit(band))
        out = first if out is None else out.unionByName(first)
    return out


def rank_recovery(pairs: DataFrame, most: int = 30) -> DataFrame:
    """Candidates of each request, corroborated over sources, at most ``most``.

    ``pairs``: request, title, hit_title, doi, resolver, year, requested_year, author, requested_author, similarity, urls.
    The record with the best base score stands for a candidate; each further source adds 0.02, at most 0.08.
    """
    key = F.coalesce(F.concat(F.lit("doi:"), canonical_id(F.col("doi"))), F.concat(F.lit("title:"), title_words(F.col("hit_title"))))
    cover = F.round(coverage(token_set(title_words(F.col("title"))), token_set(title_words(F.col("hit_title")))), 6)
    rows = pairs.filter(F.trim(F.coalesce("hit_title", F.lit(""))) != "").select("*", key.alias("key"), cover.alias("coverage"), year_score(F.col("requested_year"), F.col("year")).alias("year_score"), same_surname(F.col("requested_author"), F.col("author")).cast("double").alias("author_score"))
    base = F.round(_weighed(BASE), 9)
    best = F.max_by(F.struct("hit_title", "doi", "similarity", "coverage", "year_score", "author_score", base.alias("base")), F.struct(base, F.col("resolver")))
    grouped = rows.groupBy("request", "key").agg(best.alias("b"), F.count_distinct(F.nullif(F.lower("resolver"), F.lit(""))).alias("source_count"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("urls")))).alias("urls"))
    total = _weighed(RANK, "b.")
    bonus = F.least(F.lit(SOURCES), SOURCE * F.greatest(F.lit(0), F.col("source_count") - 1))
    ranked = grouped.select("request", "key", F.col("b.hit_title").alias("hit_title"), F.col("b.similarity").alias("similarity"), "source_count", "urls", F.col("b.base").alias("base"), total.alias("total"), F.round(F.least(F.lit(1.0), total + bonus), 6).alias("rank_score"))
    n = F.row_number().over(Window.partitionBy("request").orderBy(F.desc("rank_score"), "key"))
    return ranked.withColumn("n", n).filter(F.col("n") <= most)


def _author_bonus() -> Column:
    return F.when(F.coalesce(F.trim("author"), F.lit("")) != "", 0.03).otherwise(0.0)


def rank_simple(pairs: DataFrame, most: int = 10) -> DataFrame:
    """Candidates by similarity and 0.03 for a known author, at most ``most``."""
    scored = pairs.withColumn("rank_score", F.round(F.col("similarity") + _author_bonus(), 6))
    n = F.row_number().over(Window.partitionBy("request").orderBy(F.desc("rank_score"), "hit"))
    return scored.withColumn("n", n).filter(F.col("n") <= most)


def with_gap(ranked: DataFrame) -> DataFrame:
    """Ranked candidates with the distance to the next one."""
    following = F.lead("rank_score").over(Window.partitionBy("request").orderBy("n"))
    return ranked.withColumn("gap", F.round(F.col("rank_score") - following, 6))


def accept(ranked: DataFrame, strong: float = 0.90, least: float = 0.75, gap: float = 0.02) -> DataFrame:
    """The first candidate of each request with ``accepted`` and ``why`` not: too weak, or ambiguous unless two sources agree."""
    top = with_gap(ranked).filter("n = 1")
    close = F.coalesce(F.col("gap") < gap, F.lit(False)) & (F.col("source_count") < 2)
    why = F.when(F.col("rank_score") < least, "score_below_threshold").when((F.col("rank_score") < strong) & close, "ambiguous_runner_up")
    return top.withColumn("why", why).withColumn("accepted", F.col("why").isNull())


def accept_strict(ranked: DataFrame, least: float = 0.90, gap: float = 0.03, sure: float = 0.98) -> DataFrame:
    """As ``accept`` for candidates that must have an identifier (key ``doi:``)."""
    top = with_gap(ranked).filter("n = 1")
    why = F.when(~F.col("key").startswith("doi:"), "no_identifier").when(F.col("rank_score") < least, "score_below_threshold").when((F.col("rank_score") < sure) & F.coalesce(F.col("gap") < gap, F.lit(False)), "ambiguous_runner_up")
    return top.withColumn("why", why).withColumn("accepted", F.col("why").isNull())


def index_confidence(score: Column, gap: Column) -> Column:
    """Why an index's own best match isn't to be trusted, else null."""
    return F.when(score < 40.0, "score_below_threshold").when(gap < 3.0, "ambiguous_runner_up")


# Other spellings of a title in the order they are tried, as what is replaced and by what.
SPELLINGS = (
    (r"(?s):.*", ""), (r"(?s) — .*", ""), (r"(?s) – .*", ""), (r"(?s) - .*", ""),
    (r"\([^()]{1,100}\)", " "), ("&", "and"), (" and ", " & "), (r"[\[\]{}<>]", " "),
)


def title_variants(titles: DataFrame, most: int = 6, least: int = 10) -> DataFrame:
    """(request, pos, variant): the full title first, then what each of ``SPELLINGS`` makes of it, where that is new.

    At most ``most`` variants of ``least`` characters or more; a null title has none.
    """
    edges = lambda c, first, last: F.trim(F.regexp_replace(F.regexp_replace(c, r"\s+", " "), f"^[{first}]+|[{last}]+$", ""))
    rows = titles.select("request", edges(F.trim("title"), r"\[({\"'‘“", r"\])}\"'’”.").alias("full"))
    every = F.array("full", *[F.regexp_replace("full", pattern, put) for pattern, put in SPELLINGS])
    long_enough = F.filter(F.array_distinct(F.transform(every, lambda v: edges(v, " .,;:", " .,;:"))), lambda v: F.length(v) >= least)
    return rows.select("request", F.posexplode(F.slice(long_enough, 1, most)).alias("pos", "variant"))


def progressive(scored: DataFrame, strong: float = 0.90) -> DataFrame:
    """Records (request, pos, score) up to the first variant with which the best score so far is strong."""
    ahead = F.max("score").over(Window.partitionBy("request").orderBy("pos").rangeBetween(Window.unboundedPreceding, -1))
    return scored.withColumn("ahead", ahead).filter((F.col("ahead") < strong) | F.col("ahead").isNull()).drop("ahead")


def link_responses(items: DataFrame, articles: DataFrame, mapping: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(linked, rejected) of responses to articles, by the first way that applies.

    ``items``: n, article_id, file, doi; ``articles``: id, filename, doi; ``mapping``: n, id. A stated mapping or id decides
    alone; else exact file name, normal form of the name, identifier. A match must be unique, and an article is
    answered once a batch (the first response counts).
    """
    names = articles.select("id", "filename", title_ascii(F.col("filename")).alias("plain"), canonical_id(F.col("doi")).alias("k"))
    told = items.join(mapping.select("n", F.col("id").alias("mapped")), "n", "left")
    ways = told.select("n", "article_id", "file", title_ascii(F.col("file")).alias("plain"), canonical_id(F.col("doi")).alias("k"), "mapped")
    nullable = lambda c: F.nullif(F.trim(c), F.lit(""))
    by = lambda left, right, how, n: left.join(names.select("id", *([right] if right != "id" else [])).withColumnRenamed("id", "hit"), left["key"] == F.col("hit" if right == "id" else right)).select("n", "hit", F.lit(how).alias("how"), F.lit(n).alias("way"))
    manual = by(ways.select("n", F.col("mapped").alias("key")).filter("key IS NOT NULL"), "id", "manual", 0)
    stated = by(ways.filter("mapped IS NULL").select("n", nullable("article_id").alias("key")).filter("key IS NOT NULL"), "id", "identifier", 1)
    open_ = ways.filter(F.col("mapped").isNull() & nullable("article_id").isNull())
    exact = by(open_.select("n", nullable("file").alias("key")).filter("key IS NOT NULL"), "filename", "exact name", 2)
    loose = by(open_.select("n", nullable("plain").alias("key")).filter("key IS NOT NULL"), "plain", "normalised name", 3)
    dois = by(open_.select("n", F.col("k").alias("key")).filter("key IS NOT NULL"), "k", "doi", 4)
    hits = manual.unionByName(stated).unionByName(exact).unionByName(loose).unionByName(dois)
    first = hits.groupBy("n").agg(F.min("way").alias("way"))
    found = hits.join(first, ["n", "way"]).groupBy("n").agg(F.count_distinct("hit").alias("matches"), F.min("hit").alias("article"), F.min("how").alias("how"))
    rows = items.select("n").join(found, "n", "left")
    turn = F.row_number().over(Window.partitionBy("article").orderBy("n"))
    unique = rows.filter("matches = 1").withColumn("turn", turn)
    linked = unique.filter("turn = 1").select("n", "article", "how")
    repeated = unique.filter("turn > 1").select("n", F.lit("article repeated in the batch").alias("why"))
    rest = rows.filter("matches IS NULL OR matches <> 1").select("n", F.when(F.col("matches") > 1, "several articles match").otherwise("no article matches").alias("why"))
    return linked, rest.unionByName(repeated)
