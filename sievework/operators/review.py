"""Full-text review by two people and an adjudicator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = ("r1", "r2", "adjudication")


def by_slot(opinions: DataFrame) -> DataFrame:
    """One row per article with the opinion (reviewer, decision, reason, version) of each slot."""
    value = lambda s: F.max(F.when(F.col("slot") == s, F.struct("seq", "reviewer", "decision", "reason", "version")))
    return opinions.groupBy("article").agg(*[value(s).alias(s) for s in SLOTS])


def resolution(slots: DataFrame, current: int) -> DataFrame:
    """Articles with ``status`` and ``decision`` of their two opinions at the current version.

    Two doubts are a conflict; a later adjudication of the same version settles a conflict.
    """
    now = lambda s: F.coalesce(F.col(f"{s}.version") == current, F.lit(False))
    who = lambda s: F.lower(F.trim(F.col(f"{s}.reviewer")))
    agreed = (F.col("r1.decision") == F.col("r2.decision")) & (F.col("r1.decision") != "duvida")
    judged = now("adjudication") & F.col("adjudication.decision").isin("incluir", "excluir")
    status = F.when(~(now("r1") & now("r2")), "pendente").when(who("r1") == who("r2"), "revisores repetidos").when(agreed, "concordância").when(judged, "adjudicado").otherwise("conflito")
    out = slots.withColumn("status", status)
    return out.withColumn("decision", F.when(F.col("status") == "concordância", F.col("r1.decision")).when(F.col("status") == "adjudicado", F.col("adjudication.decision")).otherwise(""))


def exclusion_reason(resolved: DataFrame) -> DataFrame:
    """Excluded articles with the adjudicator's reason, else the reviewers' reasons joined."""
    given = lambda s: F.nullif(F.trim(F.col(f"{s}.reason")), F.lit(""))
    both = F.array_join(F.filter(F.array(given("r1"), given("r2")), lambda x: x.isNotNull()), " | ")
    why = F.when(F.col("status") == "adjudicado", F.coalesce(given("adjudication"), both)).otherwise(both)
    return resolved.filter("decision = 'excluir'").withColumn("why", why)


def check_opinions(new: DataFrame, slots: DataFrame, current: int) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected with ``why``) of new opinions; an accepted reviewer's opinion voids the article's adjudication."""
    state = resolution(slots, current).select("article", "status", "r1", "r2")
    rows = new.join(state, "article", "left")
    who = F.lower(F.trim("reviewer"))
    other = F.when(F.col("slot") == "r1", F.col("r2.reviewer")).otherwise(F.col("r1.reviewer"))
    third = F.coalesce((who == F.lower(F.trim("r1.reviewer"))) | (who == F.lower(F.trim("r2.reviewer"))), F.lit(False))
    why = (
        F.when(F.coalesce(F.trim("reviewer"), F.lit("")) == "", "name the reviewer")
        .when(~F.coalesce(F.col("decision").isin("incluir", "excluir", "duvida"), F.lit(False)), "invalid decision")
        .when(F.coalesce(F.trim("reason"), F.lit("")) == "", "give a reason")
        .when((F.col("slot") == "adjudication") & (F.coalesce("status", F.lit("pendente")) != "conflito"), "no open conflict")
        .when((F.col("slot") == "adjudication") & third, "a third person adjudicates")
        .when((F.col("slot") != "adjudication") & F.coalesce(who == F.lower(F.trim(other)), F.lit(False)), "reviewers must differ")
    )
    rows = rows.withColumn("why", why).drop("status", "r1", "r2")
    accepted = rows.filter("why IS NULL").drop("why").withColumn("voids_adjudication", F.col("slot") != "adjudication")
    return accepted, rows.filter("why IS NOT NULL")


def fulltext_suggestion(inclusion: Column, exclusion: Column) -> Column:
    """From tri-state answers: anything that speaks against it excludes, everything for it includes, else doubt."""
    out = F.exists(exclusion, lambda x: x == "sim") | F.exists(inclusion, lambda x: x == "nao")
    in_ = F.forall(inclusion, lambda x: x == "sim") & F.forall(exclusion, lambda x: x == "nao")
    return F.when(out, "excluir").when(in_, "incluir").otherwise("duvida")
