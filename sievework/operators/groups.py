"""Groups of a batch's results. They may overlap or leave a row out, so each is a column of its own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.ids import same_id


def result_groups(items: DataFrame, articles: DataFrame, ready: DataFrame, online: bool) -> DataFrame:
    """Items (doi, status, found, error, has_link) with incorporated, ready, failed, missing, pending and unassigned."""
    filed = ready.select(F.col("article").alias("id")).distinct().withColumn("file", F.lit(True))
    have = articles.join(filed, "id", "left").filter((F.col("source_kind") == "motor") | F.col("file")).select(same_id(F.col("doi")).alias("k")).filter("k IS NOT NULL").distinct().withColumn("incorporated", F.lit(True))
    rows = items.withColumn("k", same_id(F.col("doi"))).join(have, "k", "left").drop("k").withColumn("incorporated", F.coalesce("incorporated", F.lit(False)))
    link = F.coalesce("has_link", F.lit(False)) | (F.lit(online) & F.coalesce("found", F.lit(False)))
    bad, out = F.coalesce(F.trim("error"), F.lit("")) != "", ~F.col("incorporated")
    rows = rows.withColumn("ready", out & ~bad & F.coalesce("found", F.lit(False)) & link).withColumn("failed", out & bad & link)
    rows = rows.withColumn("missing", (F.col("status") == "done") & out & ~link).withColumn("pending", (F.col("status") != "done") & out)
    none = ~F.col("incorporated")
    for c in ("ready", "failed", "missing", "pending"):
        none = none & ~F.col(c)
    return rows.withColumn("unassigned", none)
