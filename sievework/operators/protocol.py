"""Protocols: criteria to questions, declared questions, approval."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions.ids import fingerprint

# The parts of a protocol in their order, and how each is asked for.
PARTS = (("population", "The study addresses the population: "), ("concept", "The study addresses the concept: "), ("context", "The study takes place in the context: "), ("inclusion", "The study meets the inclusion criterion: "), ("exclusion", "The study is free of the exclusion criterion: "))


def questions(protocols: DataFrame, most: int = 30) -> DataFrame:
    """(protocol, q_index, part, text) of the questions that a protocol's parts and criteria lines suggest."""
    rows = None
    for n, (part, lead) in enumerate(PARTS):
        lines = F.filter(F.transform(F.split(F.coalesce(part, F.lit("")), r"\r?\n|;"), lambda x: F.trim(F.regexp_replace(x, r"^\s*(?:[-*•]|\d+[.)])\s*", ""))), lambda x: x != "")
        one = protocols.select("protocol", F.lit(n).alias("part_n"), F.lit(part).alias("part"), F.posexplode(lines).alias("pos", "line")).withColumn("text", F.concat(F.lit(lead), "line"))
        rows = one if rows is None else rows.unionByName(one)
    at = F.row_number().over(Window.partitionBy("protocol").orderBy("part_n", "pos"))
    return rows.withColumn("q_index", at).filter(F.col("q_index") <= most).select("protocol", "q_index", "part", "text")


def declared_questions(protocols: DataFrame, default: int = 15) -> DataFrame:
    """(protocol, question): the Qn that a text declares, in numeric order; Q1 to Q15 if none."""
    found = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(r"\bQ(\d{1,3})\b"), F.lit(1)), lambda x: x.cast("int"))))
    numbers = F.when(F.size(found) > 0, found).otherwise(F.sequence(F.lit(1), F.lit(default)))
    return protocols.select("protocol", F.posexplode(numbers).alias("n", "q")).select("protocol", "n", F.concat(F.lit("Q"), F.col("q").cast("string")).alias("question"))


def approval(items: DataFrame, required: DataFrame) -> DataFrame:
    """(protocol, approved, missing): approved if every item is, with its present hash, and all kinds are there.

    ``items``: protocol, kind, text, status, approved_hash; ``required``: kind.
    """
    good = (F.col("status") == "approved") & (F.col("approved_hash") == fingerprint("kind", "text"))
    have = items.groupBy("protocol").agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("all_good"), F.collect_set("kind").alias("kinds"))
    kinds = required.agg(F.array_sort(F.collect_set("kind")).alias("need"))
    # The list of required kinds is a constant of the method.
    out = have.join(F.broadcast(kinds), F.lit(True))
    missing = F.array_except("need", "kinds")
    return out.select("protocol", (F.col("all_good") & (F.size(missing) == 0)).alias("approved"), missing.alias("missing"))
