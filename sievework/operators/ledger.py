"""Ledgers: upserts, latest-wins, insert-if-absent, batches and names."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions.ids import fingerprint, join_by_id, same_id
from sievework.functions.text import initials, slug

DECISION = ("decision", "reason", "actor", "version", "source")
SUGGESTION = ("ai_provider", "ai_decision", "ai_version")


def upsert_decisions(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """The ledger with new decisions; a record's suggestion stays."""
    return _merge(ledger, new, DECISION)


def upsert_suggestions(ledger: DataFrame, new: DataFrame) -> DataFrame:
    """The ledger with new suggestions; a record's decision stays."""
    return _merge(ledger, new, SUGGESTION)


def _merge(ledger: DataFrame, new: DataFrame, group: tuple[str, ...]) -> DataFrame:
    rows = join_by_id(ledger.select("doi", *DECISION, *SUGGESTION), new.select("doi", F.struct(*group).alias("n")), "full_outer")
    return rows.select("doi", *[(F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(c)) if c in group else F.col(c)).alias(c) for c in (*DECISION, *SUGGESTION)])


#: A stored ledger's folders are named by this and the number of buckets.
BUCKET = "bucket_of_"


def _bucketed(rows: DataFrame, buckets: int, key: str) -> DataFrame:
    return rows.withColumn(f"{BUCKET}{buckets}", F.pmod(F.xxhash64(F.coalesce(same_id(F.col(key)), F.lit(""))), F.lit(buckets)).cast("int"))


def store_ledger(rows: DataFrame, path: str, buckets: int = 64, key: str = "doi") -> None:
    """Write a ledger in buckets of its ids, each a folder, for ``merge_stored``. Buckets should hold some files' worth of rows each."""
    name = f"{BUCKET}{buckets}"
    _bucketed(rows, buckets, key).repartition(name).write.partitionBy(name).parquet(path)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    stored = spark.read.parquet(path)
    return stored.select(*[c for c in stored.columns if not c.startswith(BUCKET)])


def merge_stored(path: str, new: DataFrame, upsert: Callable[[DataFrame, DataFrame], DataFrame], key: str = "doi") -> int:
    """Merge rows into a stored ledger, and tell how many buckets that touched: only those are read and written.

    ``upsert`` makes of a bucket's rows and the new ones the rows that it shall hold. Files are put in place when the job
    commits; the same merge may run again.
    """
    spark = new.sparkSession
    stored = spark.read.parquet(path)
    name = next(c for c in stored.columns if c.startswith(BUCKET))
    buckets = int(name.removeprefix(BUCKET))
    touched = [r[0] for r in _bucketed(new, buckets, key).select(name).distinct().collect()]  # at most one a bucket
    if touched:
        merged = _bucketed(upsert(stored.filter(F.col(name).isin(touched)).drop(name), new), buckets, key)
        merged.repartition(len(touched), name).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(name).parquet(path)
    return len(touched)


def restore(ledger: DataFrame, saved: DataFrame) -> DataFrame:
    """The ledger with the saved rows whose key it doesn't have."""
    there = ledger.select(same_id(F.col("doi")).alias("k"))
    return ledger.unionByName(saved.join(there, same_id(F.col("doi")) == F.col("k"), "left_anti"))


def insert_absent(batch: DataFrame, new: DataFrame, key: str = "doi") -> DataFrame:
    """The batch with new rows whose identifier it doesn't have, each once."""
    fresh = new.withColumn("k", same_id(F.col(key))).filter("k IS NOT NULL").dropDuplicates(["k"])
    return batch.unionByName(fresh.join(batch.select(same_id(F.col(key)).alias("k")), "k", "left_anti").drop("k"))


def latest(log: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The last row of each key."""
    return log.groupBy(*key).agg(F.max_by(F.struct(*[c for c in log.columns if c not in key]), order).alias("r")).select(*key, "r.*")


def current_verdicts(log: DataFrame) -> DataFrame:
    """The last verdict of each article; a failure has no decision, a success no failure."""
    rows = latest(log, ["article_id"], F.col("seq"))
    failed = F.col("status") == "FAILED"
    return rows.withColumn("decision", F.when(~failed, F.col("decision"))).withColumn("failure_reason", F.when(failed, F.col("failure_reason")))


def new_by_fingerprint(stored: DataFrame, incoming: DataFrame, columns: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """(applied rows, report): incoming rows whose fingerprint isn't stored, each once, and how many were repeats."""
    marked = incoming.withColumn("fingerprint", fingerprint(*columns))
    applied = marked.dropDuplicates(["fingerprint"]).join(stored.select("fingerprint"), "fingerprint", "left_anti")
    counts = marked.agg(F.count("*").alias("received")).join(applied.agg(F.count("*").alias("applied")), F.lit(True))
    return applied, counts.withColumn("duplicates", F.col("received") - F.col("applied"))


def newest(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The newest ``most`` rows of each key."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))
    return rows.withColumn("n", n).filter(F.col("n") <= most).drop("n")


def first_reason(attempts: DataFrame) -> DataFrame:
    """The newest attempt's reason of each article."""
    return attempts.groupBy("article").agg(F.max_by("reason", "seq").alias("reason"))


def batches(rows: DataFrame, key: str, order: str, size: int, stretch: Column | None = None) -> DataFrame:
    """Rows with the number of their batch of ``size`` within the key."""
    return numbered(rows, key, order, stretch).withColumn("batch", F.floor((F.col("ordinal") - 1) / size).cast("int")).drop("ordinal")


def numbered(rows: DataFrame, group: str, order: str, stretch: Column | None = None) -> DataFrame:
    """Rows with their number within the group, gapless from 1, as ``ordinal``.

    ``stretch`` never falls as ``order`` rises, and cuts a group that may hold most of the rows: each stretch is sorted on its
    own and starts after the counted rows of those before. Only one count a stretch is sorted by the whole group.
    """
    if stretch is None:
        return rows.withColumn("ordinal", F.row_number().over(Window.partitionBy(group).orderBy(order)))
    cut = rows.withColumn("__stretch", stretch)
    counts = cut.groupBy(F.col(group).alias("__group"), F.col("__stretch").alias("__at")).agg(F.count("*").alias("__n"))
    before = F.sum("__n").over(Window.partitionBy("__group").orderBy(F.col("__at").asc_nulls_first())) - F.col("__n")
    offsets = counts.select("__group", "__at", before.alias("__before"))
    own = cut.withColumn("__own", F.row_number().over(Window.partitionBy(group, "__stretch").orderBy(order)))
    both = own.join(offsets, F.col(group).eqNullSafe(F.col("__group")) & F.col("__stretch").eqNullSafe(F.col("__at")))
    return both.select(*[F.col(f"`{c}`") for c in rows.columns], (F.col("__own") + F.col("__before")).cast("int").alias("ordinal"))


def output_names(records: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """(doi, name): author_year_journal_title; a known id keeps its name, a name that is taken gets a part of the id."""
    part = lambda c, n: F.nullif(slug(c, n), F.lit(""))
    surname = F.element_at(F.split(F.trim(F.regexp_extract("authors", r"^([^;,]*)", 1)), r"\s+"), -1)
    base = F.concat_ws("_", part(surname, 30), part(F.col("year"), 4), part(initials(F.col("journal")), 8), part(F.col("title"), 60))
    whole = F.when(part(F.col("title"), 60).isNull(), slug(F.col("doi"), 120)).otherwise(base)
    rows = records.select("doi", whole.alias("base"))
    if taken is not None:
        rows = rows.join(taken.select("doi", F.col("name").alias("kept")), "doi", "left").join(taken.select(F.col("name").alias("base"), F.lit(True).alias("used")).distinct(), "base", "left")
    else:
        rows = rows.withColumn("kept", F.lit(None).cast("string")).withColumn("used", F.lit(None).cast("boolean"))
    n = F.row_number().over(Window.partitionBy("base").orderBy(F.col("kept").isNull(), "doi"))
    clash = (n > 1) | F.coalesce("used", F.lit(False))
    return rows.select("doi", F.coalesce("kept", F.when(clash, F.concat_ws("_", "base", F.substring(F.md5("doi"), 1, 8))).otherwise(F.col("base"))).alias("name"))


def agreement(analyses: DataFrame) -> DataFrame:
    """Per article the latest analysis of each provider and model, and whether they agree.

    ``analyses``: article, stage, provider, model, seq, current, decision, package. A blank model counts each analysis apart.
    One analysis out of date makes the article stale.
    """
    model = F.coalesce(F.nullif(F.lower(F.trim("model")), F.lit("")), F.concat(F.lit("#"), F.col("seq").cast("string")))
    runs = analyses.groupBy("article", "stage", F.lower("provider").alias("p"), model.alias("m")).agg(F.max_by(F.struct("current", "decision", "package"), "seq").alias("r")).select("article", "stage", "r.*")
    by = runs.groupBy("article", "stage").agg(F.count("*").alias("runs"), F.count_if("current").alias("current_runs"), F.count_distinct("decision").alias("decisions"), F.count_distinct("package").alias("packages"), F.min("decision").alias("any_decision"))
    status = F.when(F.col("current_runs") != F.col("runs"), "stale").when(F.col("runs") == 1, "single").when(F.col("packages") > 1, "stale").when(F.col("decisions") == 1, "agreement").otherwise("conflict")
    by = by.withColumn("status", status)
    decision = F.when(F.col("status").isin("single", "agreement"), F.col("any_decision")).when(F.col("status") == "conflict", "duvida").otherwise("")
    return by.select("article", "stage", "runs", "status", decision.alias("decision"))


def display_titles(articles: DataFrame, analyses: DataFrame) -> DataFrame:
    """Titles to show: of local files without a confirmed title, the newest one a model gave."""
    given = analyses.filter(F.trim(F.coalesce("title", F.lit(""))) != "").groupBy(F.col("article").alias("id")).agg(F.max_by("title", "seq").alias("given"))
    local = (F.col("source_kind") == "local") & ~F.coalesce("title_confirmed", F.lit(False))
    return articles.join(given, "id", "left").select("id", F.when(local, F.coalesce("given", "title")).otherwise(F.col("title")).alias("title"))


def remove_analyses(analyses: DataFrame, selector: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(what stays, count removed) by a selector table over one analysis, a run, or a provider and model."""
    kept = analyses.join(selector.select(*keys).distinct(), keys, "left_anti")
    removed = analyses.join(selector.select(*keys).distinct(), keys, "left_semi").agg(F.count("*").alias("removed"))
    return kept, removed


def promote(included: DataFrame, results: DataFrame, corpus: DataFrame) -> DataFrame:
    """Included records with a confirmed file that the corpus doesn't have, as articles with their decision."""
    got = results.filter("confirmed").select(same_id(F.col("doi")).alias("k"), "file").dropDuplicates(["k"])
    have = corpus.select(same_id(F.col("doi")).alias("k")).filter("k IS NOT NULL")
    return included.withColumn("k", same_id(F.col("doi"))).join(got, "k").join(have, "k", "left_anti").drop("k")


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """A stable sample of ``n`` rows."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)
