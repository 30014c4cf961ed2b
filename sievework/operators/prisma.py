"""PRISMA flow counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.ids import same_id
from sievework.operators.screening import in_force, screenable


def identified(items: DataFrame, ledger: DataFrame, articles: DataFrame, current: int) -> DataFrame:
    """One row per identifier of the batch or the corpus: ``situation`` and whether it is ``in_corpus``.

    The ledger's decision in force counts, else the corpus article's own of the same version.
    """
    batch = screenable(items).select(same_id(F.col("doi")).alias("k")).filter("k IS NOT NULL").distinct().withColumn("b", F.lit(True))
    corpus = articles.withColumn("k", same_id(F.col("doi"))).filter("k IS NOT NULL")
    own = F.max(F.when(F.col("triage_version") == current, F.struct("id", "triage_decision")))
    corpus = corpus.groupBy("k").agg(own.alias("own")).withColumn("c", F.lit(True))
    marks = ledger.select(same_id(F.col("doi")).alias("k"), in_force(F.col("decision"), F.col("version"), current).alias("s"))
    every = batch.join(corpus, "k", "full_outer").join(marks, "k", "left")
    decided = F.when(F.col("s").isin("incluir", "excluir"), F.col("s")).otherwise(F.coalesce("own.triage_decision", F.lit("pendente")))
    return every.select("k", decided.alias("situation"), F.coalesce("c", F.lit(False)).alias("in_corpus"))


def screening_flow(items: DataFrame, ledger: DataFrame, articles: DataFrame, current: int) -> DataFrame:
    """The nine counts from identification to obtained texts, in one row."""
    rows = identified(items, ledger, articles, current)
    local = articles.agg(F.count_if(F.col("source_kind") == "local").alias("locais"))
    is_ = lambda s: F.count_if(F.col("situation") == s)
    got = F.count_if((F.col("situation") == "incluir") & F.col("in_corpus"))
    flow = rows.agg(F.count("*").alias("identificados"), (is_("incluir") + is_("excluir")).alias("triados"), is_("excluir").alias("excluidos_triagem"), is_("incluir").alias("incluidos_triagem"), got.alias("obtidos"))
    flow = flow.select("*", (F.col("identificados") - F.col("triados")).alias("pendentes_triagem"), F.col("incluidos_triagem").alias("buscados"), (F.col("incluidos_triagem") - F.col("obtidos")).alias("nao_obtidos"))
    # Two rows of one count each.
    return flow.join(F.broadcast(local), F.lit(True))


def review_flow(articles: DataFrame, resolved: DataFrame, ready: DataFrame, final: DataFrame, current: int) -> DataFrame:
    """The counters of a full review, in one row.

    ``articles``: id, triage_decision, triage_version; ``resolved``: article, status, decision; ``ready``: article;
    ``final``: article, final_decision, final_version.
    """
    rows = articles.join(resolved.select(F.col("article").alias("id"), "status", "decision"), "id", "left")
    rows = rows.join(ready.select(F.col("article").alias("id")).distinct().withColumn("file", F.lit(True)), "id", "left")
    rows = rows.join(final.select(F.col("article").alias("id"), "final_decision", "final_version"), "id", "left")
    now = F.coalesce(F.col("triage_version") == current, F.lit(False))
    passed = now & F.coalesce(F.col("triage_decision") == "incluir", F.lit(False))
    done = passed & (F.coalesce("decision", F.lit("")) != "")
    eligible = done & (F.col("decision") == "incluir")
    closed = eligible & F.coalesce(F.col("final_version") == current, F.lit(False))
    n = F.count_if
    return rows.agg(
        F.count("*").alias("identified"), n(now).alias("screened"), n(now & ~passed).alias("screening_excluded"), n(~now).alias("screening_pending"),
        n(passed).alias("reports_sought"), n(passed & F.col("file").isNull()).alias("reports_pending"), n(done).alias("reports_assessed"),
        n(done & (F.col("decision") == "excluir")).alias("fulltext_excluded"), n(passed & (F.col("status") == "conflito")).alias("conflicts"), n(passed & ~done).alias("fulltext_pending"),
        n(eligible).alias("eligible"), n(closed & (F.col("final_decision") == "incluir")).alias("final_included"), n(closed & (F.col("final_decision") == "excluir")).alias("final_excluded"), n(eligible & ~closed).alias("final_pending"),
    )


def version_metrics(articles: DataFrame, current: int) -> DataFrame:
    now = F.coalesce(F.col("triage_version") == current, F.lit(False))
    return articles.agg(F.count("*").alias("identified"), F.count_if(now).alias("screened"), F.count_if(now & (F.col("triage_decision") == "excluir")).alias("excluded"), F.count_if(now & (F.col("triage_decision") == "incluir")).alias("fulltext"), F.count_if(~now).alias("pending"))


def figure_counts(items: DataFrame, ledger: DataFrame, articles: DataFrame, resolved: DataFrame, current: int) -> DataFrame:
    """(branch, identified, screened, excluded, included, assessed): records by the ledger, local files by their own triage."""
    rows = identified(items, ledger, articles, current).select(F.lit("records").alias("branch"), "situation", F.lit(False).alias("assessed"))
    local = articles.filter("source_kind = 'local'").join(resolved.select(F.col("article").alias("id"), "decision"), "id", "left")
    own = F.when(F.col("triage_version") == current, F.col("triage_decision")).otherwise("pendente")
    local = local.select(F.lit("local").alias("branch"), own.alias("situation"), (F.coalesce("decision", F.lit("")) != "").alias("assessed"))
    is_ = lambda s: F.count_if(F.col("situation") == s)
    return rows.unionByName(local).groupBy("branch").agg(F.count("*").alias("identified"), (is_("incluir") + is_("excluir")).alias("screened"), is_("excluir").alias("excluded"), is_("incluir").alias("included"), F.count_if("assessed").alias("assessed"))


def statement(search: DataFrame, verdicts: DataFrame) -> DataFrame:
    """The 2020 statement of a run screened in one stage: identification from the search, the rest from the verdicts.

    ``search``: found, other, duplicates (one row); ``verdicts``: status, decision, exclusion_code.
    """
    code = F.coalesce(F.nullif(F.nullif(F.trim("exclusion_code"), F.lit("-")), F.lit("")), F.lit("Não especificado"))
    out = F.col("decision") == "EXCLUIDO"
    reasons = verdicts.filter((F.col("status") == "COMPLETED") & out).groupBy(code.alias("reason")).agg(F.count("*").alias("n"))
    reasons = reasons.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("reason", "n")))).alias("exclusion_reasons"))
    counts = verdicts.agg(F.count_if(F.col("status") == "COMPLETED").alias("assessed"), F.count_if((F.col("status") == "COMPLETED") & out).alias("excluded"), F.count_if((F.col("status") == "COMPLETED") & (F.col("decision") == "INCLUIDO")).alias("included"), F.count_if((F.col("status") == "COMPLETED") & ~out & (F.col("decision") != "INCLUIDO")).alias("manual"))
    sought = F.when(F.col("found") + F.col("other") - F.col("duplicates") > 0, F.col("found") + F.col("other") - F.col("duplicates")).otherwise(F.lit(0))
    # One row each.
    row = search.join(F.broadcast(counts), F.lit(True)).join(F.broadcast(reasons), F.lit(True))
    row = row.withColumn("sought", sought).withColumn("screened", F.col("sought")).withColumn("screening_excluded", F.lit(0).cast("long"))
    return row.withColumn("not_retrieved", F.greatest(F.lit(0), F.col("sought") - F.col("assessed")))
