"""Scans of identifier lists and tagged text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.ids import ID_SHAPE, canonical_id, ids_in
from sievework.operators.ledger import numbered


def id_lines(lines: DataFrame, crosswalk: DataFrame | None = None) -> DataFrame:
    """(value, kind, key) of the lines of an identifier list; kind is ``doi`` or ``title``.

    Section headers and rules are dropped; arXiv ids become DOIs; PMID and PMCID lines go through ``crosswalk`` (id, doi).
    """
    line = F.trim(F.regexp_replace("value", "^﻿", ""))
    rows = lines.select(line.alias("value")).filter((F.col("value") != "") & ~F.col("value").rlike(r"^(#|\[.*\]$|[-=_*]{3,}$)"))
    arxiv = F.regexp_extract("value", r"(?i)^(?:arxiv:\s*|https?://arxiv\.org/(?:abs|pdf)/)?(\d{4}\.\d{4,5})(?:v\d+)?(?:\.pdf)?$", 1)
    other = F.upper(F.regexp_replace(F.regexp_extract("value", r"(?i)^(PMC\d+|pmid:?\s*\d+|\d{5,9})$", 1), r"(?i)pmid:?\s*", ""))
    doi = F.coalesce(canonical_id(F.col("value")), F.when(arxiv != "", F.concat(F.lit("10.48550/arxiv."), arxiv)), canonical_id(F.nullif(F.regexp_extract("value", ID_SHAPE, 0), F.lit(""))))
    rows = rows.select("value", doi.alias("doi"), F.nullif(other, F.lit("")).alias("other"))
    if crosswalk is not None:
        known = crosswalk.select(F.upper("id").alias("other"), canonical_id(F.col("doi")).alias("crossed")).filter("crossed IS NOT NULL").dropDuplicates(["other"])
        rows = rows.join(known, "other", "left").withColumn("doi", F.coalesce("doi", "crossed"))
    return rows.select("value", F.when(F.col("doi").isNotNull(), "doi").otherwise("title").alias("kind"), F.coalesce("doi", "value").alias("key"))


def decoded_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): lines of text files, each file read as UTF-8, or as Latin-1 if any of its lines isn't UTF-8.

    The scan keeps the bytes, so files stay splittable; a file's lines vote, and one row a file is joined back.
    """
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    votes = lines.groupBy("file").agg(F.bool_and(F.is_valid_utf8("value")).alias("utf8"))
    return lines.join(votes, "file").select("file", F.when(F.col("utf8"), F.col("value")).otherwise(F.decode(F.col("value").cast("binary"), "ISO-8859-1")).alias("value"))


def read_id_list(spark: SparkSession, path: str, crosswalk: DataFrame | None = None) -> DataFrame:
    return id_lines(decoded_lines(spark, path), crosswalk)


def read_delimited_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct identifiers in any column of delimited files, in either encoding."""
    return free_text_ids(decoded_lines(spark, path), "value")


def ids_in_any_column(table: DataFrame) -> DataFrame:
    """Distinct identifiers found in any column of a table."""
    cells = F.array_join(F.array(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in table.columns]), "\n")
    return table.select(F.explode(ids_in(cells)).alias("doi")).filter("doi <> ''").distinct()


def free_text_ids(texts: DataFrame, column: str = "text") -> DataFrame:
    """Distinct identifiers of pasted text."""
    return texts.select(F.explode(ids_in(F.col(column))).alias("doi")).filter("doi <> ''").distinct()


def batch_report(texts: DataFrame, most: int = 500) -> DataFrame:
    """Per batch (batch_id, text): valid ids in order, invalid line numbers, repeats, lines, and whether it is too long."""
    lines = texts.select("batch_id", F.posexplode(F.split("text", r"\r?\n")).alias("pos", "line")).filter(F.trim("line") != "")
    doi = F.trim(F.regexp_replace(F.regexp_replace(F.trim("line"), r"(?i)^doi:\s*", ""), r"(?i)^https?://(?:dx\.)?doi\.org/", ""))
    lines = lines.withColumn("doi", F.coalesce(F.try_url_decode(doi), doi))
    lines = lines.withColumn("valid", (F.length("doi") <= 500) & F.col("doi").rlike(r"(?i)^10\.\d{4,9}/\S+$"))
    keys = lines.filter("valid").groupBy("batch_id", F.lower("doi").alias("key")).agg(F.min("pos").alias("pos"), F.min_by("doi", "pos").alias("doi"), (F.count("*") - 1).alias("repeats"))
    valid = keys.groupBy("batch_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "doi"))), lambda x: x["doi"]).alias("dois"), F.sum("repeats").alias("duplicates"))
    bad = lines.groupBy("batch_id").agg(F.array_sort(F.collect_list(F.when(~F.col("valid"), F.col("pos") + 1))).alias("invalid"), F.count("*").alias("line_count"))
    out = texts.select("batch_id").join(bad, "batch_id", "left").join(valid, "batch_id", "left")
    empty = lambda t: F.array().cast(t)
    dois = F.coalesce("dois", empty("array<string>"))
    return out.select("batch_id", dois.alias("dois"), F.coalesce("invalid", empty("array<int>")).alias("invalid"), F.coalesce("duplicates", F.lit(0)).alias("duplicates"), F.coalesce("line_count", F.lit(0)).alias("line_count"), (F.size(dois) > most).alias("over_limit"))


def tagged_records(records: DataFrame, base: str) -> DataFrame:
    """(base, label): the id of each tagged record, else its title, else its number. ``records``: n, value."""
    tag = lambda t: F.nullif(F.trim(F.regexp_extract("value", rf"(?m)^{t}\s*-\s*(.+)$", 1)), F.lit(""))
    return records.select(F.lit(base).alias("base"), F.coalesce(tag("DO"), tag("TI"), F.concat(F.lit(f"{base} #"), F.col("n").cast("string"))).alias("label"), tag("DO").isNotNull().alias("has_doi"))


def read_tagged(spark: SparkSession, path: str, base: str) -> DataFrame:
    """A tagged export, a record at each ``ER`` line; numbers count from 1 in each file."""
    records = spark.read.text(path, lineSep="ER  -").select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value", F.monotonically_increasing_id().alias("place"))
    records = records.filter(F.col("value").rlike(r"\S"))
    return tagged_records(numbered(records, "file", "place", F.col("start")).withColumnRenamed("ordinal", "n"), base)


def search_result(pages: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Per base: (total, ids, without id) of search pages (base, rank, doi, title), at most ``most`` results a base.

    Returns the rows kept and their counts.
    """
    from pyspark.sql.window import Window

    kept = pages.withColumn("n", F.row_number().over(Window.partitionBy("base").orderBy("rank"))).filter(F.col("n") <= most)
    kept = kept.select("base", "rank", canonical_id(F.col("doi")).alias("doi"), "title").withColumn("without_id", F.when(F.col("doi").isNull(), F.col("title")))
    counts = kept.groupBy("base").agg(F.count("*").alias("total"), F.count("doi").alias("with_id"), F.count("without_id").alias("without_id"))
    return kept, counts
