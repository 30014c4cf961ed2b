"""Column expressions over identifiers, years, hosts and fingerprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ID_SHAPE = r"10\.\d{4,9}/[^\s,<>\"]+"


def canonical_id(value: Column, strip_chapter: bool = True, decode: bool = True) -> Column:
    """A DOI in its bare lower-case form; null if it isn't one.

    Resolver addresses, a ``doi:`` mark, fragments and surrounding punctuation go; chapter endings and
    percent-escapes by choice.
    """
    bare = F.regexp_replace(F.trim(value), r"(?i)^(?:https?://)?(?:dx\.)?doi\.org/", "")
    bare = F.regexp_replace(bare, r"(?i)^doi:\s*", "")
    if decode:
        bare = F.when(bare.contains("%"), F.coalesce(F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B"))), bare)).otherwise(bare)
    bare = F.regexp_replace(bare, r"#.*$", "")
    bare = F.regexp_replace(bare, r"^[\s.,;:)\]}>\\\"']+|[\s.,;:)\]}>\\\"']+$", "")
    if strip_chapter:
        bare = F.regexp_replace(bare, r"(?i)\.ch\d+$", "")
    bare = F.lower(bare)
    return F.when(bare.rlike(r"^10\.\d{4,9}/\S+$"), bare)


def ids_in(text: Column) -> Column:
    """Every identifier-shaped token of a text, canonical, distinct."""
    split = F.regexp_replace(text, r"(?i);(?=\s*(?:https?://(?:dx\.)?doi\.org/)?10\.)", "\n")
    found = F.regexp_extract_all(split, F.lit(ID_SHAPE), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.lower(F.regexp_replace(x, r"[.;]+$", ""))))


def same_id(doi: Column) -> Column:
    """The join key of an identifier column."""
    return F.nullif(F.lower(F.trim(doi)), F.lit(""))


def join_by_id(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Both joined on ``same_id`` of their ``doi``, which stays as ``left`` writes it, or as ``right`` does where left has no row."""
    keyed = right.withColumnRenamed("doi", "_other").withColumn("_id", same_id(F.col("_other")))
    out = left.withColumn("_id", same_id(F.col("doi"))).join(keyed, "_id", how)
    if how.endswith("outer"):
        out = out.withColumn("doi", F.coalesce("doi", "_other"))
    return out.drop("_id", "_other")


def first_year(text: Column) -> Column:
    return F.regexp_extract(text, r"\b((?:19|20)\d{2})\b", 1).try_cast("int")


def year_number(year: Column) -> Column:
    """The first four characters as a number."""
    return F.substring(year.cast("string"), 1, 4).try_cast("int")


def years_close(a: Column, b: Column, tolerance: int = 1) -> Column:
    return F.coalesce(F.abs(year_number(a) - year_number(b)) <= tolerance, F.lit(False))


def year_score(a: Column, b: Column) -> Column:
    """1 for the same year, one half for neighbours, else 0."""
    gap = F.abs(year_number(a) - year_number(b))
    return F.when(gap == 0, 1.0).when(gap == 1, 0.5).otherwise(0.0)


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def fingerprint(*columns: Column | str) -> Column:
    """A content hash of ordered fields; only equality is meant."""
    return F.sha2(F.to_json(F.struct(*columns)), 256)
