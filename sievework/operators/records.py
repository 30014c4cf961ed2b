"""Merging of records from several sources, and refreshes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions.ids import canonical_id, join_by_id, same_id

# The order in which sources are believed, and in which their addresses are tried.
SOURCES = ("crossref", "europepmc", "semanticscholar", "openalex")
URL_ORDER = ("pmc", "openalex", "europepmc", "semanticscholar", "publisher")


def rank_of(source: Column, order: tuple[str, ...]) -> Column:
    out = F.lit(len(order))
    for n, name in enumerate(order):
        out = F.when(F.lower(source) == name, n).otherwise(out)
    return out


def _filled(c: str) -> Column:
    return F.trim(F.coalesce(F.col(c), F.lit(""))) != ""


def merge_records(records: DataFrame, fields: tuple[str, ...] = ("title", "authors", "year", "journal")) -> DataFrame:
    """One record per doi: each field from the first source that has it; a DataCite record stands in for an empty Crossref one."""
    rank = F.when(F.lower("source") == "datacite", 0.5).otherwise(rank_of(F.col("source"), SOURCES))
    rows = records.withColumn("rank", rank)
    firsts = [F.coalesce(F.min_by(F.when(_filled(c), F.col(c)), F.when(_filled(c), F.col("rank"))), F.lit("")).alias(c) for c in fields]
    return rows.groupBy(same_id(F.col("doi")).alias("doi")).agg(*firsts, F.count("*").alias("sources"))


def longest_abstract(records: DataFrame) -> DataFrame:
    """(doi, abstract, abstract_source): the longest one, ties by source order."""
    rows = records.filter(_filled("abstract")).withColumn("rank", rank_of(F.col("source"), SOURCES))
    best = F.max_by(F.struct("abstract", "source"), F.struct(F.length("abstract"), -F.col("rank")))
    return rows.groupBy(same_id(F.col("doi")).alias("doi")).agg(best.alias("b")).select("doi", F.col("b.abstract").alias("abstract"), F.col("b.source").alias("abstract_source"))


def ordered_urls(urls: DataFrame, most: int = 12) -> DataFrame:
    """(doi, n, url) of candidate addresses (doi, source, seq, url) by source, then arrival; an address once."""
    ranked = urls.withColumn("rank", rank_of(F.col("source"), URL_ORDER))
    once = ranked.groupBy(same_id(F.col("doi")).alias("doi"), "url").agg(F.min(F.struct("rank", "seq")).alias("at"))
    n = F.row_number().over(Window.partitionBy("doi").orderBy("at.rank", "at.seq", "url"))
    return once.withColumn("n", n).filter(F.col("n") <= most).select("doi", "n", "url")


def merge_metadata(rows: DataFrame, key: str, column: str = "meta", order: str = "seq") -> DataFrame:
    """Per key a map in which every name has its first non-empty value."""
    pairs = rows.select(key, order, F.explode(column).alias("name", "value")).filter(F.trim("value") != "")
    firsts = pairs.groupBy(key, "name").agg(F.min_by("value", order).alias("value"))
    return firsts.groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias(column))


def refresh(stored: DataFrame, fresh: DataFrame, fields: tuple[str, ...] = ("title", "authors", "year", "journal")) -> DataFrame:
    """Stored records with empty fields filled and an abstract only replaced by a longer one."""
    keyed = stored.withColumn("_id", same_id(F.col("doi"))).alias("s")
    out = keyed.join(fresh.withColumn("_id", same_id(F.col("doi"))).alias("f"), "_id", "left")
    filled = [F.coalesce(F.nullif(F.trim(F.col(f"s.{c}")), F.lit("")), F.col(f"f.{c}"), F.lit("")).alias(c) for c in fields]
    longer = F.length("f.abstract") > F.length(F.coalesce("s.abstract", F.lit("")))
    return out.select("s.doi", *filled, F.when(longer, F.col("f.abstract")).otherwise(F.coalesce("s.abstract", F.lit(""))).alias("abstract"), F.coalesce(longer, F.lit(False)).alias("abstract_changed"))


def linked_by_id(requests: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits whose own identifier equals the requested one."""
    own = hits.withColumn("k", canonical_id(F.col("hit_doi"))).filter("k IS NOT NULL")
    return requests.withColumn("k", canonical_id(F.col("doi"))).filter("k IS NOT NULL").join(own, "k").drop("k")


def enrich(ids: DataFrame, metadata: DataFrame, open_access: DataFrame) -> DataFrame:
    """An id list with saved metadata and open-access links; what is missing is empty."""
    out = join_by_id(join_by_id(ids, metadata), open_access)
    return out.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c != "doi" else F.col(c) for c in out.columns])


def retrieval_summary(results: DataFrame, save: bool) -> DataFrame:
    """Success rows with source, address and text size; failures with code and message; paths only when files are kept."""
    ok = F.col("success")
    text = F.when(ok & (F.coalesce(F.length("text"), F.lit(0)) > 0), F.struct(F.length("text").alias("chars"), F.substring("text", 1, 200).alias("start")))
    return results.select("doi", ok.alias("ok"), F.when(ok, F.col("source")).alias("source"), F.when(ok, F.col("pdf_url")).alias("pdf_url"), F.when(ok & F.lit(save), F.col("file")).alias("file"), F.when(~ok, F.col("code")).alias("code"), F.when(~ok, F.col("message")).alias("message"), text.alias("text"))
