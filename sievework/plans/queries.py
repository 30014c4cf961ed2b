"""The registered queries over the given tables, each beside its SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.ids import canonical_id, host
from sievework.operators import audit, documents, identity, ledger, linkage, prisma, protocol, records, retrieval, review, screening
from sievework.plans.views import Tables, with_views
from sievework.sources import lists, pages, payloads, sinks
from sievework.streaming import jobs

CURRENT = 2
RULES = [{"yes": "include", "no": "exclude", "unknown": "include"}, {"no": "exclude", "unknown": "exclude"}]

REGISTRY: dict[str, tuple[Callable[[Tables], DataFrame], str | None]] = {}


def query(name: str, sql: str | None = None, *views: str):
    def keep(f: Callable[[Tables], DataFrame]):
        REGISTRY[name] = (f, None if sql is None else with_views(sql, *views) if views else sql)
        return f

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: (lambda spark, sf_dir, f=f: f(Tables(spark, sf_dir))) for name, (f, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql is not None}


# --- screening and PRISMA -------------------------------------------------

_FLOW = """b AS (SELECT DISTINCT lower(trim(doi)) AS k FROM search_items WHERE found AND status IN ('done', 'partial')),
c AS (SELECT lower(trim(doi)) AS k, max(CASE WHEN triage_version = 2 THEN triage_decision END) AS own FROM articles WHERE doi IS NOT NULL GROUP BY 1),
m AS (SELECT lower(trim(doi)) AS k, CASE WHEN version = 2 AND decision IN ('incluir', 'excluir') THEN decision ELSE 'pendente' END AS s FROM screening),
e AS (SELECT coalesce(b.k, c.k) AS k, CASE WHEN m.s IN ('incluir', 'excluir') THEN m.s ELSE coalesce(c.own, 'pendente') END AS situation, c.k IS NOT NULL AS in_corpus
      FROM b FULL OUTER JOIN c ON b.k = c.k LEFT JOIN m ON m.k = coalesce(b.k, c.k))
"""


@query(
    "prisma_screening_flow",
    "SELECT * FROM (WITH " + _FLOW + """ SELECT count(*) AS identificados, count(*) FILTER (situation IN ('incluir', 'excluir')) AS triados, count(*) FILTER (situation = 'excluir') AS excluidos_triagem,
    count(*) FILTER (situation = 'incluir') AS incluidos_triagem, count(*) FILTER (situation = 'incluir' AND in_corpus) AS obtidos, count(*) FILTER (situation NOT IN ('incluir', 'excluir')) AS pendentes_triagem,
    count(*) FILTER (situation = 'incluir') AS buscados, count(*) FILTER (situation = 'incluir' AND NOT in_corpus) AS nao_obtidos, (SELECT count(*) FROM articles WHERE source_kind = 'local') AS locais FROM e)""",
    "search_items", "articles", "screening",
)
def _(t: Tables) -> DataFrame:
    return prisma.screening_flow(t.search_items, t.screening, t.articles, CURRENT)


_WORK = """w AS (SELECT i.*, CASE WHEN s.version = 2 AND s.decision IN ('incluir', 'excluir') THEN s.decision ELSE 'pendente' END AS situation,
    s.decision IS NOT NULL AND s.version <> 2 AS stale,
    CASE WHEN EXISTS (SELECT 1 FROM articles a WHERE lower(trim(a.doi)) = lower(trim(i.doi))) THEN 'no_corpus' WHEN trim(i.error) <> '' THEN 'nao_obtido' ELSE 'aguardando' END AS st
    FROM search_items i LEFT JOIN screening s ON s.doi = i.doi WHERE found AND status IN ('done', 'partial'))"""
_WV = ("search_items", "articles", "screening")


@query("screening_worklist_counts", f"""SELECT * FROM (WITH {_WORK} SELECT count(*) AS todos, count(*) FILTER (situation = 'pendente') AS pendente, count(*) FILTER (situation = 'incluir') AS incluir,
    count(*) FILTER (situation = 'excluir') AS excluir, count(*) FILTER (trim(abstract) = '') AS sem_resumo, count(*) FILTER (situation = 'incluir' AND st = 'nao_obtido') AS nao_obtido FROM w)""", *_WV)  # fmt: skip
def _(t: Tables) -> DataFrame:
    return screening.worklist_counts(screening.worklist(t.search_items, t.screening, t.articles, CURRENT))


@query("screening_worklist_rows", f"SELECT * FROM (WITH {_WORK} SELECT doi, situation, stale, CASE WHEN situation = 'incluir' THEN st END AS state FROM w)", *_WV)
def _(t: Tables) -> DataFrame:
    return screening.worklist(t.search_items, t.screening, t.articles, CURRENT).select("doi", "situation", "stale", "state")


@query("screening_worklist_page", f"SELECT * FROM (WITH {_WORK} SELECT doi, title FROM w WHERE situation = 'pendente' ORDER BY doi LIMIT 50 OFFSET 50)", *_WV)
def _(t: Tables) -> DataFrame:
    rows = screening.worklist(t.search_items, t.screening, t.articles, CURRENT)
    return screening.worklist_page(screening.worklist_filter(rows, "pendente"), "doi", page=2).select("doi", "title")


@query("assessment_workspace", """SELECT item, title, decision, agreement, n FROM (SELECT *, row_number() OVER (ORDER BY title COLLATE pt, item) AS n FROM (
    SELECT user_id AS item, (CASE user_id % 5 WHEN 0 THEN 'Água ' WHEN 1 THEN 'água ' WHEN 2 THEN 'Zebra ' WHEN 3 THEN 'árvore ' ELSE 'École ' END) || user_id AS title,
        CASE WHEN count(*) FILTER (value >= 35) * 2 > count(*) THEN 'incluir' ELSE 'pending' END AS decision, CASE WHEN count(*) = 1 THEN 'single' WHEN count(DISTINCT value >= 35) = 1 THEN 'agreement' ELSE 'conflict' END AS agreement
    FROM events GROUP BY user_id) WHERE decision = 'pending' AND agreement = 'conflict' AND (contains(lower(title), 'a 1') OR contains(lower(title), 'e 1')))
    QUALIFY ceil(n / 10) = least(2, greatest(1, ceil(count(*) OVER () / 10)))""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    n = F.col("user_id")
    words = F.when(n % 5 == 0, "Água ").when(n % 5 == 1, "água ").when(n % 5 == 2, "Zebra ").when(n % 5 == 3, "árvore ").otherwise("École ")
    yes = F.col("value") >= 35
    status = F.when(F.count("*") == 1, "single").when(F.count_distinct(yes) == 1, "agreement").otherwise("conflict")
    items = t.given("events").groupBy("user_id").agg(F.when(F.count_if(yes) * 2 > F.count("*"), "incluir").otherwise("pending").alias("decision"), status.alias("agreement"))
    items = items.select(n.alias("item"), F.concat(words, n.cast("string")).alias("title"), F.lit("").alias("authors"), F.lit("").alias("doi"), F.lit("").alias("filename"), "decision", "agreement")
    both = screening.assessment_filter(items, "pending", "A 1", "conflict").unionByName(screening.assessment_filter(items, "pending", "e 1", "conflict"))
    return screening.assessment_page(both, "title", "item", 2).select("item", "title", "decision", "agreement", F.col("n").cast("long").alias("n"))


@query("screening_worklist_search", f"""SELECT * FROM (WITH {_WORK} SELECT doi, situation FROM w WHERE situation = 'incluir' AND st = 'nao_obtido' AND contains(lower(concat_ws(' ', title, authors, doi, journal, abstract)), 'src1'))""", *_WV)
def _(t: Tables) -> DataFrame:
    rows = screening.worklist(t.search_items, t.screening, t.articles, CURRENT)
    return screening.worklist_filter(rows, "nao_obtido", "SRC1").select("doi", "situation")


@query("included_not_in_corpus", """SELECT doi FROM screening s WHERE version = 2 AND decision = 'incluir' AND NOT EXISTS (SELECT 1 FROM articles a WHERE lower(trim(a.doi)) = lower(trim(s.doi)))""", "screening", "articles")
def _(t: Tables) -> DataFrame:
    included = t.screening.filter(screening.in_force(F.col("decision"), F.col("version"), CURRENT) == "incluir")
    return audit.unlisted(included, t.articles.filter("doi IS NOT NULL"))[0]


@query("triage_rule_decision", """SELECT doc_id, CASE WHEN x AND trim(reason) = '' THEN NULL WHEN x THEN 'excluir' ELSE 'incluir' END AS decision,
    CASE WHEN x AND trim(reason) = '' THEN 'give a reason for the exclusion' END AS reject FROM (SELECT *, a1 = 'Não' OR a2 IN ('Não', 'Indeterminado') AS x FROM answers)""", "answers")  # fmt: skip
def _(t: Tables) -> DataFrame:
    rows = t.answers.select("doc_id", "reason", F.array("a1", "a2").alias("answers"))
    return screening.decide(rows, RULES, 2).select("doc_id", "decision", "reject")


@query("model_suggestion_decision", """SELECT doc_id, CASE WHEN a1 = 'Não' OR a2 IN ('Não', 'Indeterminado') THEN 'excluir' ELSE 'incluir' END AS suggested FROM answers""", "answers")
def _(t: Tables) -> DataFrame:
    rows = t.answers.select("doc_id", F.array(F.upper("a1"), "a2").alias("answers"))
    return screening.suggest(rows, RULES, CURRENT, "c").select("doc_id", "suggested")


@query("bulk_acceptance", """SELECT doi, 'incluir' AS decision, 'ia_accepted' AS source FROM search_items WHERE found AND doc_id // 500 NOT IN (SELECT doc_id // 500 FROM search_items WHERE found AND doc_id % 1250 = 4)""", "search_items")
def _(t: Tables) -> DataFrame:
    work = t.search_items.select("doi", F.lit("pendente").alias("situation"), F.lit("incluir").alias("suggested"), (F.col("doc_id") % 1250 != 4).alias("current"))
    found = t.search_items.filter("found").select("doi", F.floor(F.col("doc_id") / 500).alias("batch"))
    return screening.accept_batches(found, work)[0].select("doi", "decision", "source")


_BATCHED = """c AS (SELECT doi, concat(CAST(doc_id % 4 AS VARCHAR), '/', CAST(doc_id // CASE WHEN doc_id % 4 = 3 THEN 4000 ELSE 2000 END AS VARCHAR)) AS batch,
    CASE WHEN doc_id % 20 = 5 THEN 'already decided' WHEN doc_id % 20 = 10 THEN 'no suggestion' WHEN doc_id % 20 = 6 THEN 'suggestion out of date' END AS why FROM search_items WHERE found),
b AS (SELECT batch, count(*) AS n, count(why) AS bad FROM c GROUP BY batch)"""


@query("bulk_acceptance_batches", f"""SELECT * FROM (WITH {_BATCHED} SELECT c.batch, doi, 'incluir' AS decision, CAST(NULL AS VARCHAR) AS why FROM c JOIN b ON c.batch = b.batch WHERE bad = 0 AND n <= 500
    UNION ALL SELECT batch, doi, NULL, why FROM c WHERE why IS NOT NULL UNION ALL SELECT batch, NULL, NULL, 'too many records' FROM b WHERE n > 500)""", "search_items")  # fmt: skip
def _(t: Tables) -> DataFrame:
    n = F.col("doc_id")
    group = F.floor(n / F.when(n % 4 == 3, 4000).otherwise(2000)).cast("string")
    found = t.search_items.filter("found").select("doi", n, F.concat((n % 4).cast("string"), F.lit("/"), group).alias("batch"))
    work = t.search_items.select("doi", F.when(n % 20 == 5, "incluir").otherwise("pendente").alias("situation"), F.when(n % 20 != 10, "incluir").alias("suggested"), (n % 20 != 6).alias("current"))
    good, bad = screening.accept_batches(found, work)
    return good.select("batch", "doi", "decision", F.lit(None).cast("string").alias("why")).unionByName(bad.withColumn("decision", F.lit(None).cast("string")))


_SLOTS = """o AS (SELECT article, max(CASE WHEN slot = 'r1' THEN reviewer END) AS w1, max(CASE WHEN slot = 'r1' THEN decision END) AS d1, max(CASE WHEN slot = 'r1' THEN version END) AS v1,
    max(CASE WHEN slot = 'r1' THEN reason END) AS m1, max(CASE WHEN slot = 'r2' THEN reason END) AS m2, max(CASE WHEN slot = 'adjudication' THEN reason END) AS m3,
    max(CASE WHEN slot = 'r2' THEN reviewer END) AS w2, max(CASE WHEN slot = 'r2' THEN decision END) AS d2, max(CASE WHEN slot = 'r2' THEN version END) AS v2,
    max(CASE WHEN slot = 'adjudication' THEN decision END) AS d3, max(CASE WHEN slot = 'adjudication' THEN version END) AS v3 FROM opinions GROUP BY article),
f AS (SELECT *, CASE WHEN NOT (coalesce(v1 = 2, false) AND coalesce(v2 = 2, false)) THEN 'pendente' WHEN lower(w1) = lower(w2) THEN 'revisores repetidos' WHEN d1 = d2 AND d1 <> 'duvida' THEN 'concordância'
    WHEN v3 = 2 AND d3 IN ('incluir', 'excluir') THEN 'adjudicado' ELSE 'conflito' END AS status FROM o),
z AS (SELECT *, CASE status WHEN 'concordância' THEN d1 WHEN 'adjudicado' THEN d3 ELSE '' END AS decision FROM f)"""


@query("two_reviewer_resolution", f"SELECT * FROM (WITH {_SLOTS} SELECT article, status, decision FROM z)", "opinions")
def _(t: Tables) -> DataFrame:
    return review.resolution(review.by_slot(t.opinions), CURRENT).select("article", "status", "decision")


@query("exclusion_reasons_fulltext", f"""SELECT * FROM (WITH {_SLOTS} SELECT article, CASE WHEN status = 'adjudicado' THEN coalesce(nullif(m3, ''), concat_ws(' | ', m1, m2)) ELSE concat_ws(' | ', m1, m2) END AS why FROM z WHERE decision = 'excluir')""", "opinions")
def _(t: Tables) -> DataFrame:
    return review.exclusion_reason(review.resolution(review.by_slot(t.opinions), CURRENT)).select("article", "why")


@query("opinion_checks", """SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN doc_id % 5 = 0 THEN 'name the reviewer' WHEN doc_id % 7 = 0 THEN 'invalid decision' WHEN doc_id % 3 = 0 THEN 'give a reason' ELSE 'accepted' END AS outcome FROM labels) GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    new = t.given("labels").select(
        F.col("doc_id").alias("article"), F.lit("r1").alias("slot"), F.when(F.col("doc_id") % 5 == 0, "").otherwise("new person").alias("reviewer"),
        F.when(F.col("doc_id") % 7 == 0, "maybe").otherwise("incluir").alias("decision"), F.when(F.col("doc_id") % 3 == 0, " ").otherwise("because").alias("reason"),
    )
    good, bad = review.check_opinions(new, review.by_slot(t.opinions), CURRENT)
    every = good.select(F.lit("accepted").alias("outcome")).unionByName(bad.select(F.col("why").alias("outcome")))
    return every.groupBy("outcome").agg(F.count("*").alias("n"))


@query("review_prisma", f"""SELECT * FROM (WITH {_SLOTS}, j AS (SELECT a.*, coalesce(triage_version = 2, false) AS cur, coalesce(triage_version = 2, false) AND triage_decision = 'incluir' AS passed, z.status, coalesce(z.decision, '') AS decision,
    EXISTS (SELECT 1 FROM documents_ready d WHERE d.article = a.id) AS file, n.final_decision, coalesce(n.final_version = 2, false) AS fin FROM articles a LEFT JOIN z ON z.article = a.id LEFT JOIN finals n ON n.article = a.id)
    SELECT count(*) AS identified, count(*) FILTER (cur) AS screened, count(*) FILTER (cur AND NOT passed) AS screening_excluded, count(*) FILTER (NOT cur) AS screening_pending, count(*) FILTER (passed) AS reports_sought,
    count(*) FILTER (passed AND NOT file) AS reports_pending, count(*) FILTER (passed AND decision <> '') AS reports_assessed, count(*) FILTER (passed AND decision = 'excluir') AS fulltext_excluded,
    count(*) FILTER (passed AND status = 'conflito') AS conflicts, count(*) FILTER (passed AND decision = '') AS fulltext_pending, count(*) FILTER (passed AND decision = 'incluir') AS eligible,
    count(*) FILTER (passed AND decision = 'incluir' AND fin AND final_decision = 'incluir') AS final_included, count(*) FILTER (passed AND decision = 'incluir' AND fin AND final_decision = 'excluir') AS final_excluded,
    count(*) FILTER (passed AND decision = 'incluir' AND NOT fin) AS final_pending FROM j)""", "opinions", "articles", "documents_ready", "finals")  # fmt: skip
def _(t: Tables) -> DataFrame:
    return prisma.review_flow(t.articles, review.resolution(review.by_slot(t.opinions), CURRENT), t.documents_ready, t.finals, CURRENT)


@query("protocol_version_metrics", """SELECT count(*) AS identified, count(*) FILTER (triage_version = 2) AS screened, count(*) FILTER (triage_version = 2 AND triage_decision = 'excluir') AS excluded,
    count(*) FILTER (triage_version = 2 AND triage_decision = 'incluir') AS fulltext, count(*) FILTER (triage_version <> 2) AS pending FROM articles""", "articles")  # fmt: skip
def _(t: Tables) -> DataFrame:
    return prisma.version_metrics(t.articles, CURRENT)


@query("prisma_figure_branches", f"""SELECT * FROM (WITH {_FLOW.rstrip()}, {_SLOTS}, u AS (SELECT 'records' AS branch, situation, false AS assessed FROM e
    UNION ALL SELECT 'local', CASE WHEN triage_version = 2 THEN triage_decision ELSE 'pendente' END, coalesce(z.decision, '') <> '' FROM articles a LEFT JOIN z ON z.article = a.id WHERE source_kind = 'local')
    SELECT branch, count(*) AS identified, count(*) FILTER (situation IN ('incluir', 'excluir')) AS screened, count(*) FILTER (situation = 'excluir') AS excluded, count(*) FILTER (situation = 'incluir') AS included,
    count(*) FILTER (assessed) AS assessed FROM u GROUP BY branch)""", "search_items", "articles", "screening", "opinions")  # fmt: skip
def _(t: Tables) -> DataFrame:
    return prisma.figure_counts(t.search_items, t.screening, t.articles, review.resolution(review.by_slot(t.opinions), CURRENT), CURRENT)


_LAST = """v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article_id ORDER BY seq DESC) AS rn FROM verdict_log) WHERE rn = 1)"""


@query("prisma_2020_statement", f"""SELECT * FROM (WITH {_LAST}, s AS (SELECT (SELECT count(*) FROM searched) AS found, (SELECT count(*) FROM searched) - (SELECT count(DISTINCT lower(raw)) + count(*) FILTER (raw IS NULL) FROM searched) AS duplicates),
    q AS (SELECT count(*) FILTER (status = 'COMPLETED') AS assessed, count(*) FILTER (status = 'COMPLETED' AND decision = 'EXCLUIDO') AS excluded, count(*) FILTER (status = 'COMPLETED' AND decision = 'INCLUIDO') AS included FROM v)
    SELECT found, duplicates, found - duplicates AS sought, greatest(0, found - duplicates - assessed) AS not_retrieved, assessed, excluded, included FROM s, q)""", "verdict_log", "searched")  # fmt: skip
def _(t: Tables) -> DataFrame:
    found = t.searched.agg(F.count("*").alias("found"), (F.count("*") - F.count_distinct(F.lower("raw")) - F.count_if(F.col("raw").isNull())).alias("duplicates"), F.lit(0).cast("long").alias("other"))
    out = prisma.statement(found, ledger.current_verdicts(t.verdict_log))
    return out.select("found", "duplicates", "sought", "not_retrieved", "assessed", "excluded", "included")


@query("exclusion_code_counts", f"""SELECT * FROM (WITH {_LAST} SELECT coalesce(nullif(exclusion_code, '-'), 'Não especificado') AS reason, count(*) AS n FROM v WHERE status = 'COMPLETED' AND decision = 'EXCLUIDO' GROUP BY 1)""", "verdict_log")
def _(t: Tables) -> DataFrame:
    found = t.searched.agg(F.count("*").alias("found"), F.lit(0).cast("long").alias("duplicates"), F.lit(0).cast("long").alias("other"))
    return prisma.statement(found, ledger.current_verdicts(t.verdict_log)).select(F.explode("exclusion_reasons").alias("reason", "n"))


@query("verdict_distribution", f"""SELECT * FROM (WITH {_LAST} SELECT status, CASE WHEN status <> 'FAILED' THEN decision END AS decision, CASE WHEN status = 'FAILED' THEN failure_reason END AS failure_reason, count(*) AS n FROM v GROUP BY 1, 2, 3)""", "verdict_log")
def _(t: Tables) -> DataFrame:
    return ledger.current_verdicts(t.verdict_log).groupBy("status", "decision", "failure_reason").agg(F.count("*").alias("n"))


_RUNS = """r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY article, stage, lower(provider), coalesce(nullif(lower(trim(model)), ''), concat('#', CAST(seq AS STRING))) ORDER BY seq DESC) AS rn FROM analyses) WHERE rn = 1)"""


@query("model_agreement", f"""SELECT * FROM (WITH {_RUNS}, g AS (SELECT article, stage, count(*) AS runs, count(*) FILTER (current) AS c, count(DISTINCT decision) AS d, count(DISTINCT package) AS p, min(decision) AS a FROM r GROUP BY 1, 2),
    s AS (SELECT *, CASE WHEN c <> runs THEN 'stale' WHEN runs = 1 THEN 'single' WHEN p > 1 THEN 'stale' WHEN d = 1 THEN 'agreement' ELSE 'conflict' END AS status FROM g)
    SELECT article, stage, runs, status, CASE WHEN status IN ('single', 'agreement') THEN a WHEN status = 'conflict' THEN 'duvida' ELSE '' END AS decision FROM s)""", "analyses")  # fmt: skip
def _(t: Tables) -> DataFrame:
    return ledger.agreement(t.analyses)


@query("pending_for_model", """SELECT a.id FROM articles a WHERE NOT EXISTS (SELECT 1 FROM analyses x WHERE x.article = a.id AND x.provider = 'click' AND x.model = 'm1' AND x.current) ORDER BY id LIMIT 25""", "articles", "analyses")
def _(t: Tables) -> DataFrame:
    return screening.pending_for_model(t.articles, t.analyses, "click", "m1", 25)[0].select("id")


@query("bulk_candidates", f"""SELECT * FROM (WITH {_RUNS}, g AS (SELECT article, count(*) AS runs, count(*) FILTER (current) AS c, count(DISTINCT decision) AS d FROM r GROUP BY 1),
    s AS (SELECT article, CASE WHEN c <> runs THEN 'stale' WHEN runs = 1 OR d = 1 THEN 'accept' ELSE 'conflict' END AS grp FROM g)
    SELECT s.article, s.grp AS "group" FROM s JOIN articles a ON a.id = s.article WHERE grp <> 'stale' AND a.triage_version <> 2)""", "analyses", "articles")  # fmt: skip
def _(t: Tables) -> DataFrame:
    rows = t.articles.select(F.col("id").alias("article"), screening.in_force(F.col("triage_decision"), F.col("triage_version"), CURRENT).alias("situation"))
    return screening.bulk_candidates(rows, ledger.agreement(t.analyses)).select("article", "group")


@query("display_titles", """SELECT a.id, CASE WHEN a.source_kind = 'local' THEN coalesce((SELECT arg_max(x.title, x.seq) FROM analyses x WHERE x.article = a.id), a.title) ELSE a.title END AS title FROM articles a""", "articles", "analyses")
def _(t: Tables) -> DataFrame:
    return ledger.display_titles(t.articles.withColumn("title_confirmed", F.lit(False)), t.analyses)


@query("analysis_removal", """SELECT article, count(*) AS left_over FROM analyses WHERE run <> '2' GROUP BY article""", "analyses")
def _(t: Tables) -> DataFrame:
    chosen = t.analyses.filter("run = '2'").select("run").distinct()
    return ledger.remove_analyses(t.analyses, chosen, ["run"])[0].groupBy("article").agg(F.count("*").alias("left_over"))


@query("keyword_screen", r"""SELECT doc_id FROM search_items WHERE regexp_matches(concat_ws(chr(10), title, abstract), '(?i)(?:^|[^\p{L}\p{N}])(the|der)(?:$|[^\p{L}\p{N}])')
    AND regexp_matches(concat_ws(chr(10), title, abstract), '(?i)(?:^|[^\p{L}\p{N}])(and|und)(?:$|[^\p{L}\p{N}])') AND NOT regexp_matches(concat_ws(chr(10), title, abstract), '(?i)(?:^|[^\p{L}\p{N}])was(?:$|[^\p{L}\p{N}])')""", "search_items")  # fmt: skip
def _(t: Tables) -> DataFrame:
    return screening.keyword_screen(t.search_items, [["the", "der"], ["and", "und"]], ["was"]).select("doc_id")


@query("request_packages", """SELECT project, CAST(floor((rn - 1) / 5) AS INTEGER) AS package, count(*) AS n FROM (SELECT source_kind AS project, row_number() OVER (PARTITION BY source_kind ORDER BY id) AS rn FROM articles) GROUP BY 1, 2""", "articles")
def _(t: Tables) -> DataFrame:
    rows = t.articles.select(F.col("source_kind").alias("project"), "id", "title", F.lit("").alias("abstract"))
    return screening.request_packages(rows, 5, F.lit("criteria"), F.floor(F.col("id") / 10_000)).select("project", "package", F.col("n").cast("long").alias("n"))


@query("attach_texts", """SELECT a.id, least(length(d.text), 1000) AS chars, coalesce(length(d.text) > 1000, false) AS truncated FROM articles a LEFT JOIN documents d ON d.doc_id = a.id""", "articles")
def _(t: Tables) -> DataFrame:
    texts = t.given("documents").select(F.col("doc_id").alias("article_id"), "text")
    return screening.attach_texts(t.articles, texts, 1000).select("id", F.length("text").cast("long").alias("chars"), "truncated")


# --- documents ------------------------------------------------------------

# Stated apart from the library's own table, as the patterns that the types go by.
_TYPE_SQL = r"""CASE WHEN regexp_matches(s, '(?i)systematic review|revisão sistemática') THEN 'systematic_review' WHEN regexp_matches(s, '(?i)meta[- ]analysis|metanálise|meta análise') THEN 'meta_analysis'
    WHEN regexp_matches(s, '(?i)scoping review|revisão de escopo') THEN 'scoping_review' WHEN regexp_matches(s, '(?i)narrative review|revisão narrativa|literature review') THEN 'narrative_review'
    WHEN regexp_matches(s, '(?i)clinical practice guideline|practice guideline|consensus statement|diretriz|consenso') THEN 'guideline_consensus'
    WHEN regexp_matches(s, '(?i)\bposter\b|conference abstract|congress abstract|resumo de congresso|anais de congresso') THEN 'poster'
    WHEN regexp_matches(s, '(?i)master''?s dissertation|master''?s thesis|dissertação') THEN 'dissertation' WHEN regexp_matches(s, '(?i)doctoral thesis|phd thesis|tese de doutorado|\bthesis\b') THEN 'thesis'
    WHEN regexp_matches(s, '(?i)\bpatent\b|\bpatente\b|international publication number|inventor\(s\)') THEN 'patent' WHEN regexp_matches(s, '(?i)^editorial\b|\beditorial\b|letter to the editor|commentary|carta ao editor') THEN 'editorial'
    WHEN regexp_matches(s, '(?i)book chapter|chapter in|capítulo de livro|\bisbn\b') THEN 'book' WHEN regexp_matches(s, '(?i)\bpreprint\b|not peer reviewed') THEN 'preprint'
    WHEN regexp_matches(s, '(?i)case report|case series|relato de caso|série de casos') THEN 'case_report' WHEN regexp_matches(s, '(?i)original article|research article|original research') THEN 'original_article' END"""
_CLASSIFIED = rf"""k AS (SELECT *, regexp_replace(concat(trim(regexp_replace(title, '\s+', ' ', 'g')), chr(10), substr(text, 1, 50000)), '\s+', ' ', 'g') AS s FROM typed_documents),
    y AS (SELECT *, CASE WHEN regexp_matches(trim(regexp_replace(title, '\s+', ' ', 'g')), '{documents.PROTOCOL_TITLE}') THEN 'study_protocol' ELSE {_TYPE_SQL} END AS ft, regexp_matches(s, '(?i)\babstract\b|\bintroduction\b|\bmethods?\b|\bresults?\b|\bdiscussion\b') AS shaped FROM k),
    x AS (SELECT *, coalesce(ft, CASE WHEN shaped THEN 'original_article' ELSE 'other' END) AS type FROM y)"""
_POLICY = """CASE WHEN type IN ('systematic_review', 'meta_analysis', 'scoping_review', 'narrative_review', 'guideline_consensus', 'case_report', 'original_article') THEN 'include' WHEN type IN ('patent', 'editorial') THEN 'exclude' ELSE 'review' END"""


@query("document_type_routing", f"SELECT * FROM (WITH {_CLASSIFIED} SELECT doc_id, type, coalesce(human_decision, CASE WHEN type = 'preprint' THEN 'exclude' ELSE {_POLICY} END) AS route FROM x)", "typed_documents")
def _(t: Tables) -> DataFrame:
    own = t.spark.createDataFrame([("preprint", "exclude"), ("poster", "unheard of")], "type string, policy string")
    return documents.route(documents.classify(t.typed_documents), own).select("doc_id", "type", "route")


@query("document_type_confidence", f"""SELECT * FROM (WITH {_CLASSIFIED} SELECT type, CASE WHEN ft IN ('systematic_review', 'meta_analysis', 'scoping_review', 'poster', 'dissertation', 'thesis', 'patent', 'study_protocol') THEN 'high' WHEN ft IS NOT NULL OR shaped THEN 'moderate' ELSE 'low' END AS confidence, count(*) AS n FROM x GROUP BY 1, 2)""", "typed_documents")
def _(t: Tables) -> DataFrame:
    return documents.classify(t.typed_documents).groupBy("type", "confidence").agg(F.count("*").alias("n"))


@query("not_an_article_gate", r"""SELECT doc_id, CASE WHEN length(w) < 200 THEN 'unreadable' WHEN regexp_matches(h, '(?im)^\s*(supplementary|supplemental)\s+(table|figure|material|information|data|note)') THEN 'supplement'
    WHEN regexp_matches(h, '(?i)reporting summary|life sciences reporting') THEN 'editorial_form' WHEN regexp_matches(h, '(?im)^\s*(author index|abstracts?\s+by\s+(number|author)|index of abstracts)') THEN 'abstract_index' END AS gate
    FROM (SELECT doc_id, trim(text) AS w, array_to_string(string_split(trim(text), chr(10))[1:25], chr(10)) AS h FROM typed_documents)""", "typed_documents")  # fmt: skip
def _(t: Tables) -> DataFrame:
    return t.typed_documents.select("doc_id", documents.article_gate(F.col("text")).alias("gate"))


@query("screenable_gate", """SELECT CASE WHEN trim(text) = '' THEN 'sem_texto' WHEN text_quality = 'ERROR' THEN 'extracao_falhou' WHEN length(trim(text)) < 300 THEN 'texto_insuficiente' ELSE 'ok' END AS gate, count(*) AS n FROM typed_documents GROUP BY 1""", "typed_documents")
def _(t: Tables) -> DataFrame:
    return documents.screen_gate(t.typed_documents).groupBy(F.coalesce("gate", F.lit("ok")).alias("gate")).agg(F.count("*").alias("n"))


@query("text_quality_flags", """SELECT CASE WHEN doc_id % 31 = 0 THEN 'ERROR' WHEN length(text) > 1000 THEN 'HIGH' ELSE 'LOW' END AS quality, count(*) AS n FROM documents GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    q = documents.text_quality(F.col("doc_id") % 31 == 0, F.col("text"))
    return t.given("documents").groupBy(q.alias("quality")).agg(F.count("*").alias("n"))


@query("record_kinds", """SELECT kind, count(*) AS n FROM (SELECT CASE WHEN doc_id % 10 = 1 THEN 'dataset' WHEN doc_id % 10 IN (2, 4) THEN 'abstract' WHEN doc_id % 8 = 2 THEN 'editorial' ELSE 'article' END AS kind FROM typed_documents) GROUP BY 1""", "typed_documents")
def _(t: Tables) -> DataFrame:
    m = F.col("doc_id") % 10
    kind = documents.record_kind(F.lit("journal-article"), F.when(m == 1, "Dataset"), F.lit(None).cast("string"), F.when(m == 2, "S267").when(m == 3, "S10-S20").when(m == 4, "S104–S176"), F.col("title"))
    return t.typed_documents.groupBy(F.coalesce(kind, F.lit("article")).alias("kind")).agg(F.count("*").alias("n"))


@query("skip_before_retrieval", "SELECT doc_id FROM documents WHERE doc_id % 10 <> 1")
def _(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    kind = documents.record_kind(F.when(F.col("doc_id") % 10 == 1, "dataset"), none, none, none, none)
    return t.given("documents").filter(~kind.eqNullSafe(F.lit("dataset"))).select("doc_id")


@query("issue_triage_reasons", """SELECT reason, count(*) AS n FROM (SELECT CASE WHEN m = 0 THEN 'pdf_found' WHEN m = 1 THEN 'not_full_article' WHEN b AND NOT c THEN 'publisher_blocked' WHEN m = 2 THEN 'oa_without_pdf' WHEN m = 3 THEN 'publisher_paywall'
    WHEN c THEN 'search_incomplete' WHEN m = 4 THEN 'possibly_paid' WHEN m = 5 THEN 'pdf_not_found' ELSE 'article_not_found' END AS reason
    FROM (SELECT doc_id % 7 AS m, doc_id % 3 = 1 AS b, doc_id % 11 = 2 AS c FROM documents)) GROUP BY 1""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    d, m = F.col("doc_id"), F.col("doc_id") % 7
    issues = F.filter(F.array(F.lit("Semantic Scholar: quota"), F.when(d % 3 == 1, "publisher: bloqueio de acesso automático"), F.when(d % 11 == 2, "Crossref: HTTP 500")), lambda i: i.isNotNull())
    _, blocked, critical = documents.split_issues(issues)
    reason = documents.access_reason(m == 0, m == 2, m == 3, m == 4, m == 5, critical, blocked, F.when(m == 1, "editorial"))
    return t.given("documents").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@query("abstract_coverage")
def _(t: Tables) -> DataFrame:
    lead = F.when(F.col("doc_id") % 3 == 0, F.lit("Abstract\n")).otherwise("")
    end = F.when(F.col("doc_id") % 2 == 0, F.lit("\nKeywords: a, b\n")).otherwise("\n1. Introduction\n")
    rows = t.given("documents").select("doc_id", F.concat(lead, "text", end, "text").alias("text"))
    return documents.abstracts(rows).groupBy("abstract_rule").agg(F.count("*").alias("n"), F.sum(F.length("abstract")).alias("chars"))


@query("title_reconciliation")
def _(t: Tables) -> DataFrame:
    rows = t.typed_documents.select("doc_id", F.when(F.col("doc_id") % 3 == 0, "Microsoft Word - proof").otherwise(F.substring("title", 1, 40)).alias("stated"), "title")
    return rows.select("doc_id", documents.reconciled_title(F.col("stated"), F.col("title")).alias("title"))


@query("identity_evidence", r"""SELECT doc_id, '10.5555/d' || doc_id AS detected_doi, 2000 + CAST(doc_id % 25 AS INTEGER) AS detected_year FROM documents""")
def _(t: Tables) -> DataFrame:
    n = F.col("doc_id").cast("string")
    rows = t.given("documents").select("doc_id", F.concat(F.lit("Published "), (2000 + F.col("doc_id") % 25).cast("string"), F.lit(" at https://doi.org/10.5555/D"), n, F.lit("doi: watermark\n"), "text").alias("text"))
    return documents.identity_evidence(rows).select("doc_id", "detected_doi", "detected_year")


# --- retrieval ------------------------------------------------------------

_CAT = """CASE WHEN success THEN 'ok' WHEN code = 'article_identity_not_confirmed' THEN 'identidade_rejeitada' WHEN code = 'not_found' THEN 'nenhuma_fonte_tem_pdf' WHEN code = 'download_timeout' THEN 'tempo_esgotado'
    WHEN code = 'download_http_403' THEN 'bloqueio_401_403' WHEN code = 'download_not_a_pdf' THEN 'pagina_em_vez_de_pdf' ELSE 'falha_de_download' END"""
_RETRY = "code IN ('download_http_429', 'download_http_503', 'download_timeout', 'download_host_cooldown')"


@query("failure_categories", f"SELECT {_CAT} AS category, count(*) AS n FROM attempts GROUP BY 1", "attempts")
def _(t: Tables) -> DataFrame:
    return t.attempts.groupBy(retrieval.category(F.col("success"), F.col("code")).alias("category")).agg(F.count("*").alias("n"))


@query("second_pass_eligible", f"SELECT seq FROM attempts WHERE NOT success AND {_RETRY}", "attempts")
def _(t: Tables) -> DataFrame:
    return t.attempts.filter(retrieval.worth_retrying(F.col("success"), F.col("code"))).select("seq")


@query("retry_advice", f"""SELECT code, {_RETRY} AS retryable, count(*) AS n, max(epoch(CASE code WHEN 'download_http_429' THEN ts + INTERVAL 1 HOUR WHEN 'download_host_cooldown' THEN ts + INTERVAL 1 HOUR WHEN 'download_timeout' THEN ts + INTERVAL 1 HOUR
    WHEN 'download_http_503' THEN ts + INTERVAL 2 HOUR WHEN 'download_http_403' THEN ts + INTERVAL 24 HOUR WHEN 'not_found' THEN ts + INTERVAL 168 HOUR END)::BIGINT) AS latest FROM (SELECT * REPLACE (date_trunc('second', ts) AS ts) FROM attempts) WHERE NOT success GROUP BY 1, 2""", "attempts")  # fmt: skip
def _(t: Tables) -> DataFrame:
    rows = t.attempts.filter("NOT success").withColumn("at", F.date_trunc("second", F.col("ts").cast("timestamp")))
    return retrieval.retry_advice(rows).groupBy("code", "retryable").agg(F.count("*").alias("n"), F.max(F.unix_timestamp("retry_at")).alias("latest"))


_BEST = "b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY success DESC, pass, seq) AS rn FROM attempts) WHERE rn = 1)"


@query("second_pass_supersede", f"SELECT * FROM (WITH {_BEST} SELECT item, seq, success, pass FROM b)", "attempts")
def _(t: Tables) -> DataFrame:
    return retrieval.supersede(t.attempts).select("item", "seq", "success", "pass")


@query("second_pass_totals", """SELECT count(*) AS items, count(*) FILTER (NOT f AND again) AS retried, count(*) FILTER (NOT f AND l) AS recovered, count(*) FILTER (f OR l) AS ok, count(*) FILTER (NOT (f OR l)) AS failed
    FROM (SELECT item, bool_or(success AND pass = 1) AS f, bool_or(success AND pass > 1) AS l, max(pass) > 1 AS again FROM attempts GROUP BY item)""", "attempts")  # fmt: skip
def _(t: Tables) -> DataFrame:
    return retrieval.second_pass_totals(t.attempts)


@query("source_utilisation", f"""SELECT * FROM (WITH {_BEST}, u AS (SELECT source, count(DISTINCT item) AS attempts FROM attempts GROUP BY 1), o AS (SELECT source, count(DISTINCT item) AS ok FROM b WHERE success GROUP BY 1)
    SELECT u.source, attempts, coalesce(ok, 0) AS ok, round(100 * coalesce(ok, 0) / attempts, 1) AS rate FROM u LEFT JOIN o ON o.source = u.source)""", "attempts")  # fmt: skip
def _(t: Tables) -> DataFrame:
    tried = t.attempts.groupBy("item").agg(F.array_sort(F.collect_set("source")).alias("sources_tried"))
    return retrieval.source_use(retrieval.supersede(t.attempts).join(tried, "item"))


@query("source_telemetry", """SELECT source, count(*) AS attempts, count(*) FILTER (success) AS ok, count(*) FILTER (NOT success) AS failed, round(count(*) FILTER (success) / count(*), 4) AS rate, round(avg(ms) / 1000, 3) AS mean_s,
    arg_max(code, seq) FILTER (NOT success) AS last_error FROM attempts GROUP BY source""", "attempts")  # fmt: skip
def _(t: Tables) -> DataFrame:
    return retrieval.telemetry(t.attempts)


@query("source_telemetry_maps", """SELECT source, count(*) AS attempts, count(*) FILTER (success) AS ok, count(*) FILTER (NOT success) AS failed, round(sum(ms) / count(*) / 1000, 3) AS mean_s FROM attempts GROUP BY source""", "attempts")
def _(t: Tables) -> DataFrame:
    per = t.attempts.groupBy("pass", "source").agg(F.count("*").alias("attempts"), F.count_if("success").alias("ok"), F.count_if(~F.col("success")).alias("failed"), F.sum("ms").alias("ms"), F.max("code").alias("last_error"))
    runs = per.groupBy(F.col("pass").alias("run")).agg(F.map_from_entries(F.collect_list(F.struct("source", F.struct("attempts", "ok", "failed", "ms", "last_error")))).alias("stats"))
    return retrieval.telemetry_of_maps(runs).drop("last_error")


@query("benchmark_summary", f"SELECT * FROM (WITH {_BEST} SELECT count(*) AS total, count(*) FILTER (success) AS ok, round(count(*) FILTER (success) / count(*), 4) AS rate, round(avg(ms / 1000), 1) AS mean_s, round(avg(ms / 1000) FILTER (success), 1) AS mean_ok_s FROM b)", "attempts")
def _(t: Tables) -> DataFrame:
    return retrieval.benchmark_summary(retrieval.supersede(t.attempts).withColumn("seconds", F.col("ms") / 1000))


@query("benchmark_groups", f"SELECT * FROM (WITH {_BEST} SELECT 'source' AS \"grouping\", source AS name, count(*) AS n FROM b WHERE success GROUP BY 2 UNION ALL SELECT 'category', {_CAT}, count(*) FROM b WHERE NOT success GROUP BY 2)", "attempts")
def _(t: Tables) -> DataFrame:
    return retrieval.benchmark_groups(retrieval.supersede(t.attempts))


@query("oa_ceiling", f"""SELECT * FROM (WITH {_BEST}, j AS (SELECT b.*, o.oa_status FROM b LEFT JOIN oa_status o ON o.doi = b.doi) SELECT count(*) FILTER (oa_status <> 'closed') AS open, count(*) FILTER (oa_status = 'closed') AS closed,
    count(*) FILTER (oa_status IS NULL) AS unknown, round(count(*) FILTER (oa_status <> 'closed') / count(*), 4) AS ceiling, count(*) FILTER (oa_status <> 'closed' AND success) AS open_recovered,
    count(*) FILTER (oa_status = 'closed' AND success) AS closed_recovered, count(*) FILTER (oa_status <> 'closed' AND NOT success) AS open_missed FROM j)""", "attempts", "oa_status")  # fmt: skip
def _(t: Tables) -> DataFrame:
    return retrieval.open_access_ceiling(retrieval.supersede(t.attempts), t.oa_status)


@query("oa_missed", f"SELECT * FROM (WITH {_BEST} SELECT b.doi FROM b JOIN oa_status o ON o.doi = b.doi WHERE NOT success AND oa_status <> 'closed')", "attempts", "oa_status")
def _(t: Tables) -> DataFrame:
    return retrieval.missed_open(retrieval.supersede(t.attempts), t.oa_status)


@query("transient_failures_by_host", f"""SELECT regexp_extract(url, '://([^/]+)', 1) AS host, coalesce(nullif(regexp_extract(code, '([0-9]+)$', 1), ''), 'rede/timeout') AS status, count(*) AS n, count(*) FILTER (code = 'download_host_cooldown') AS cooldowns
    FROM attempts WHERE NOT success AND {_RETRY} GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 15""", "attempts")  # fmt: skip
def _(t: Tables) -> DataFrame:
    return retrieval.transient_by_host(t.attempts)


@query("run_comparison", """SELECT change, count(*) AS n FROM (SELECT CASE WHEN b.s IS NULL THEN 'new' WHEN a.s IS NULL THEN 'gone' WHEN NOT b.s AND a.s THEN 'gain' WHEN b.s AND NOT a.s THEN 'loss' ELSE 'same' END AS change
    FROM (SELECT doi, bool_or(success) AS s FROM attempts WHERE pass = 1 GROUP BY 1) b FULL OUTER JOIN (SELECT doi, bool_or(success) AS s FROM attempts WHERE pass = 2 GROUP BY 1) a ON a.doi = b.doi) GROUP BY 1""", "attempts")  # fmt: skip
def _(t: Tables) -> DataFrame:
    run = lambda n: t.attempts.filter(F.col("pass") == n).groupBy("doi").agg(F.bool_or("success").alias("success"))
    return retrieval.run_changes(run(1), run(2)).groupBy("change").agg(F.count("*").alias("n"))


@query("run_exit_status", """SELECT item, CASE WHEN bool_or(NOT success AND code = 'article_identity_not_confirmed') THEN 'validation' WHEN bool_or(NOT success AND code LIKE 'download@_%' ESCAPE '@') THEN 'transport' WHEN bool_or(NOT success) THEN 'unresolved' ELSE 'ok' END AS status FROM attempts GROUP BY item""", "attempts")
def _(t: Tables) -> DataFrame:
    return retrieval.exit_status(t.attempts, "item")


@query("item_states", """SELECT status, count(*) AS n FROM (SELECT CASE WHEN NOT success THEN 'failed' WHEN source = 'view' THEN 'cached' ELSE 'ok' END AS status FROM attempts) GROUP BY 1""", "attempts")
def _(t: Tables) -> DataFrame:
    s = retrieval.item_status(F.col("success"), F.lit(None).cast("boolean"), F.when(F.col("source") == "view", "cache").otherwise(F.col("source")))
    return t.attempts.groupBy(s.alias("status")).agg(F.count("*").alias("n"))


@query("failed_work_list", f"""SELECT * FROM (WITH {_BEST} SELECT item, code, {_CAT} AS category, CASE WHEN {_RETRY} THEN 'retry later' WHEN code = 'download_http_403' THEN 'open the page by hand' WHEN code = 'article_identity_not_confirmed' THEN 'check the identifier' ELSE 'search elsewhere' END AS hint FROM b WHERE NOT success)""", "attempts")
def _(t: Tables) -> DataFrame:
    return retrieval.failed_work(retrieval.supersede(t.attempts))


_COOL = """i AS (SELECT *, regexp_extract(url, '://([^/]+)', 1) AS host, sum(CASE WHEN success THEN 1 ELSE 0 END) OVER (PARTITION BY regexp_extract(url, '://([^/]+)', 1) ORDER BY seq) AS island FROM attempts),
    k AS (SELECT host, seq, ts, CASE WHEN seq % 7 = 3 THEN seq % 200 ELSE 0 END AS asked, row_number() OVER (PARTITION BY host, island ORDER BY seq) AS streak FROM i WHERE NOT success)"""
_COOLED = "SELECT host, seq, streak, CAST(CASE WHEN asked > 0 THEN least(asked, 60) WHEN streak = 4 THEN 30 WHEN streak = 5 THEN 120 ELSE 600 END AS INTEGER) AS seconds FROM k WHERE asked > 0 OR streak >= 4"


@query("host_cooldown_islands", f"SELECT * FROM (WITH {_COOL} {_COOLED})", "attempts")
def _(t: Tables) -> DataFrame:
    return retrieval.cooldowns(t.attempts.select(host(F.col("url")).alias("host"), "seq", "success", F.when(F.col("seq") % 7 == 3, F.col("seq") % 200).alias("retry_after")), stretch=500)


@query("retrieval_summaries", """SELECT doi, success AS ok, CASE WHEN success THEN source END AS source, CASE WHEN NOT success THEN code END AS code FROM attempts WHERE pass = 1""", "attempts")
def _(t: Tables) -> DataFrame:
    rows = t.attempts.filter("pass = 1").select("doi", "success", "source", F.col("url").alias("pdf_url"), F.lit("f").alias("file"), "code", F.lit("m").alias("message"), F.lit("").alias("text"))
    return records.retrieval_summary(rows, save=True).select("doi", "ok", "source", "code")


# --- records and linkage --------------------------------------------------


def _first(c: str) -> str:
    return f"coalesce(min_by({c}, n) FILTER (trim({c}) <> ''), '') AS {c}"


_SOURCES = "r AS (SELECT *, CASE source WHEN 'crossref' THEN 0 WHEN 'europepmc' THEN 1 WHEN 'semanticscholar' THEN 2 ELSE 3 END AS n FROM source_records)"


@query("record_merge_precedence", f"SELECT * FROM (WITH {_SOURCES} SELECT doi, {', '.join(map(_first, ('title', 'authors', 'year', 'journal')))}, count(*) AS sources FROM r GROUP BY doi)", "source_records")
def _(t: Tables) -> DataFrame:
    return records.merge_records(t.source_records)


@query("longest_abstract", f"SELECT * FROM (WITH {_SOURCES}, w AS (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY length(abstract) DESC, n) AS rn FROM r WHERE trim(abstract) <> '') SELECT doi, abstract, source AS abstract_source FROM w WHERE rn = 1)", "source_records")
def _(t: Tables) -> DataFrame:
    return records.longest_abstract(t.source_records)


@query("candidate_url_order", """SELECT doi, CAST(rn AS INTEGER) AS n, url FROM (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY k, seq, url) AS rn FROM (SELECT doi, url, min(k) AS k, arg_min(seq, k * 1000000000000 + seq) AS seq FROM
    (SELECT doi, concat(url, CAST(seq % 3 AS STRING)) AS url, seq, CASE source WHEN 'click' THEN 0 WHEN 'view' THEN 1 ELSE 5 END AS k FROM attempts) GROUP BY doi, url)) WHERE rn <= 12""", "attempts")  # fmt: skip
def _(t: Tables) -> DataFrame:
    source = F.when(F.col("source") == "click", "pmc").when(F.col("source") == "view", "openalex").otherwise(F.col("source"))
    return records.ordered_urls(t.attempts.select("doi", source.alias("source"), "seq", F.concat("url", (F.col("seq") % 3).cast("string")).alias("url")))


@query("metadata_merge", f"SELECT * FROM (WITH {_SOURCES} SELECT doi, {', '.join(map(_first, ('title', 'journal')))} FROM r GROUP BY doi)", "source_records")
def _(t: Tables) -> DataFrame:
    rows = t.source_records.select("doi", records.rank_of(F.col("source"), records.SOURCES).alias("seq"), F.create_map(F.lit("title"), "title", F.lit("journal"), "journal").alias("meta"))
    return records.merge_metadata(rows, "doi").select("doi", F.coalesce(F.try_element_at("meta", F.lit("title")), F.lit("")).alias("title"), F.coalesce(F.try_element_at("meta", F.lit("journal")), F.lit("")).alias("journal"))


@query("refresh_backfill", """SELECT s.doi, coalesce(nullif(trim(s.title), ''), f.title, '') AS title, CASE WHEN length(f.abstract) > length(s.abstract) THEN f.abstract ELSE s.abstract END AS abstract, coalesce(length(f.abstract) > length(s.abstract), false) AS abstract_changed
    FROM source_records s LEFT JOIN source_records f ON f.doi = s.doi AND f.source = 'openalex' WHERE s.source = 'crossref'""", "source_records")  # fmt: skip
def _(t: Tables) -> DataFrame:
    stored, fresh = (t.source_records.filter(F.col("source") == s) for s in ("crossref", "openalex"))
    return records.refresh(stored, fresh).select("doi", "title", "abstract", "abstract_changed")


@query("exact_id_linkage", """SELECT s.doc_id, a.id AS hit FROM search_items s JOIN articles a ON lower(s.doi) = lower(a.doi)""", "search_items", "articles")
def _(t: Tables) -> DataFrame:
    return records.linked_by_id(t.search_items, t.articles.select(F.col("id").alias("hit"), F.concat(F.lit("https://doi.org/"), "doi").alias("hit_doi"))).select("doc_id", "hit")


@query("metadata_enrichment", """SELECT a.doi, coalesce(s.title, '') AS title, coalesce(o.oa_status, '') AS oa_status FROM screening a LEFT JOIN (SELECT doi, title FROM search_items WHERE doc_id % 4 <> 0) s ON s.doi = a.doi LEFT JOIN oa_status o ON o.doi = a.doi""", "screening", "search_items", "oa_status")
def _(t: Tables) -> DataFrame:
    return records.enrich(t.screening.select("doi"), t.search_items.filter("doc_id % 4 <> 0").select("doi", "title"), t.oa_status)


def _titles(t: Tables) -> tuple[DataFrame, DataFrame]:
    rows = t.title_pages.filter("trim(title) <> ''")
    asked = rows.filter("page_id % 3 = 0").select(F.col("page_id").alias("request"), "title")
    return asked, rows.select(F.col("page_id").alias("hit"), F.concat(F.col("title"), F.when(F.col("page_id") % 2 == 0, " - x!").otherwise("")).alias("hit_title"))


_WORDS = r"list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower({0}), '&', ' and ', 'g'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda w: w <> ''))"


@query("title_linkage_tokens", f"""SELECT request, hit, score, CAST(n AS INTEGER) AS n FROM (SELECT *, row_number() OVER (PARTITION BY request ORDER BY score DESC, hit) AS n FROM (SELECT request, hit,
    round(0.34::DOUBLE * len(list_intersect(a, h)) / len(a) + 0.26::DOUBLE * len(list_intersect(a, h)) / len(list_distinct(list_concat(a, h))), 6) AS score
    FROM (SELECT page_id AS request, {_WORDS.format('title')} AS a FROM title_pages WHERE trim(title) <> '' AND page_id % 3 = 0) q, (SELECT page_id AS hit, {_WORDS.format("concat(title, CASE WHEN page_id % 2 = 0 THEN ' - x!' ELSE '' END)")} AS h FROM title_pages WHERE trim(title) <> '') c
    WHERE len(a) > 0 AND len(h) > 0) WHERE score >= 0.45) WHERE n <= 3""", "title_pages")  # fmt: skip
def _(t: Tables) -> DataFrame:
    return linkage.match_titles_by_words(*_titles(t), threshold=0.45, top=3)


@query("title_linkage_full")
def _(t: Tables) -> DataFrame:
    return linkage.match_titles(*_titles(t), threshold=0.72, top=1)


@query("title_linkage_cut")
def _(t: Tables) -> DataFrame:
    asked, hits = _titles(t)
    return linkage.match_cut_titles(asked, hits.withColumn("hit_title", F.when(F.col("hit") % 5 == 0, F.concat(F.substring("hit_title", 1, 40), F.lit("…"))).otherwise(F.col("hit_title"))))


def _recovered(t: Tables, accept: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``accept`` says of each request, ranked over all records above the threshold."""
    asked, hits = _titles(t)
    hit = F.col("hit")
    records = hits.select(
        "hit_title", F.when(hit % 4 != 0, F.concat(F.lit("10.5555/p"), (hit % 40).cast("string"))).alias("doi"), F.concat(F.lit("s"), (hit % 3).cast("string")).alias("resolver"),
        (2000 + hit % 3).alias("year"), F.lit("A B").alias("author"), F.array(F.concat(F.lit("u"), hit.cast("string"))).alias("urls"),
    )
    wanted = asked.select("title", F.lit(2001).alias("requested_year"), F.lit("C B").alias("requested_author"))
    # One threshold: too few of these requests settle above it for a descent to pay.
    best = accept(linkage.first_places(wanted, records, sources=3, bands=(0.5,)))
    return asked.join(best.withColumnRenamed("request", "title"), "title")


@query("title_recovery_ranking")
def _(t: Tables) -> DataFrame:
    return _recovered(t, linkage.accept).select("request", "key", "rank_score", "gap", "accepted", "why")


@query("title_recovery_strict")
def _(t: Tables) -> DataFrame:
    return _recovered(t, linkage.accept_strict).select("request", "key", "rank_score", "accepted", "why")


@query("title_simple_ranking")
def _(t: Tables) -> DataFrame:
    asked, hits = _titles(t)
    # Some records have no author, so a hit of lower similarity may rank higher.
    return linkage.match_simple(asked, hits.withColumn("author", F.when(F.col("hit") % 4 != 0, "A B")), threshold=0.5)


@query("title_variants")
def _(t: Tables) -> DataFrame:
    asked, _ = _titles(t)
    return linkage.title_variants(asked.withColumn("title", F.concat("title", F.lit(": a subtitle (part 2) & more"))))


@query("index_confidence", """SELECT why, count(*) AS n FROM (SELECT CASE WHEN value < 40 THEN 'score_below_threshold' WHEN event_id % 6 < 3 THEN 'ambiguous_runner_up' ELSE 'ok' END AS why FROM events) GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    why = linkage.index_confidence(F.col("value"), F.col("event_id") % 6)
    return t.given("events").groupBy(F.coalesce(why, F.lit("ok")).alias("why")).agg(F.count("*").alias("n"))


@query("progressive_variants", """SELECT item AS request, seq, ms FROM (SELECT *, max(ms) OVER (PARTITION BY item ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead FROM attempts) WHERE ahead IS NULL OR ahead < 900""", "attempts")
def _(t: Tables) -> DataFrame:
    rows = t.attempts.select(F.col("item").alias("request"), F.col("seq").alias("pos"), F.col("ms").alias("score"))
    return linkage.progressive(rows, strong=900).select("request", F.col("pos").alias("seq"), F.col("score").alias("ms"))


@query("response_linkage_cascade", """SELECT doc_id AS n, id AS article, CASE WHEN doc_id % 4 = 0 THEN 'manual' WHEN doc_id % 4 = 1 THEN 'exact name' WHEN doc_id % 4 = 2 THEN 'normalised name' ELSE 'doi' END AS how
    FROM documents JOIN articles ON id = doc_id WHERE doc_id % 4 <> 3 OR source_kind = 'doi'""", "articles")  # fmt: skip
def _(t: Tables) -> DataFrame:
    d, m = F.col("doc_id"), F.col("doc_id") % 4
    local = F.col("source_kind") == "local"
    own = t.articles.select(F.col("id").alias("doc_id"), "filename", "source_kind")
    items = t.given("documents").select("doc_id").join(own, "doc_id", "left").select(
        d.alias("n"), F.lit(None).cast("string").alias("article_id"),
        F.when(m == 1, F.coalesce("filename", F.lit("unknown"))).when(m == 2, F.upper(F.replace(F.coalesce("filename", F.lit("unknown")), F.lit(" "), F.lit("__")))).alias("file"),
        F.when((m == 3) & ~F.coalesce(local, F.lit(False)), F.concat(F.lit("DOI:10.5555/d"), d.cast("string"))).alias("doi"),
    )
    mapping = t.articles.filter("id % 4 = 0").select(F.col("id").alias("n"), "id")
    return linkage.link_responses(items, t.articles, mapping)[0]


# --- identity, pages ------------------------------------------------------


@query("file_identity_verdicts")
def _(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    n = d.cast("string")
    rows = t.typed_documents.select(
        "doc_id", F.when(d % 9 != 0, F.concat(F.lit("10.5555/d"), n)).alias("doi"), "title", F.lit("Ana Silva").alias("author"), F.lit("Journal of Reviews").alias("journal"), (2000 + d % 25).cast("string").alias("year"),
        F.when(d % 4 == 0, F.concat(F.lit("10.5555/"), F.when(d % 8 == 0, "d").otherwise("x"), n)).alias("detected_doi"), F.when(d % 5 == 0, "Another work about something else").otherwise(F.col("title")).alias("detected_title"),
        F.when(d % 3 == 0, "J Silva").otherwise("J Other").alias("detected_author"), F.lit(None).cast("string").alias("detected_journal"), (2001 + d % 25).cast("string").alias("detected_year"), F.substring("text", 1, 8000).alias("text_sample"), (d % 2 == 0).alias("record_matched"),
    )
    return identity.file_verdicts(rows).select("doc_id", "validated", "method", "score", "reason")


_PLAIN = r"trim(regexp_replace(lower(strip_accents({0})), '[^a-z0-9]+', ' ', 'g'))"


@query("page_identity_verdicts", f"""SELECT page_id, method, CAST(round(CASE method WHEN 'doi_na_pagina' THEN 1.0 WHEN 'doi_divergente' THEN 0.0 WHEN 'sem_evidencia' THEN 0.0 WHEN 'titulo' THEN s * 0.9 WHEN 'titulo_e_ano' THEN least(1.0, s + 0.05) ELSE s END, 6) AS DOUBLE) AS score FROM (SELECT *,
    CASE WHEN page_id % 7 = 0 THEN 'doi_na_pagina' WHEN page_id % 7 = 1 THEN 'doi_divergente' WHEN trim(title) = '' OR page_title IS NULL THEN 'sem_evidencia' WHEN s < 0.6 THEN 'titulo_divergente' WHEN s < 0.95 THEN 'titulo_insuficiente'
    WHEN page_id % 4 < 2 THEN 'titulo' WHEN page_id % 4 = 2 THEN 'titulo_e_ano' ELSE 'ano_divergente' END AS method FROM (SELECT *, CASE WHEN x = '' OR y = '' THEN 0 WHEN x = y THEN 1 ELSE least(1.0, 0.45 * len(list_intersect(xw, yw)) / len(list_distinct(xw)) +
        0.55 * 2 * coalesce(list_sum([least(len(list_filter(gx, lambda q: q = p)), len(list_filter(gy, lambda q: q = p))) for p in list_distinct(gx)]), 0) / (len(gx) + len(gy))) END AS s
    FROM (SELECT *, string_split(x, ' ') AS xw, string_split(y, ' ') AS yw, [x[i : i + 1] for i in range(1, length(x))] AS gx, [y[i : i + 1] for i in range(1, length(y))] AS gy FROM (SELECT *, {_PLAIN.format("title")} AS x, {_PLAIN.format("coalesce(page_title, '')")} AS y
    FROM (SELECT page_id, title, CASE page_id % 5 WHEN 0 THEN title || '!!' WHEN 1 THEN title || ' s' WHEN 2 THEN title || ' and some more words of it' WHEN 3 THEN 'something else, of 1999' END AS page_title FROM title_pages)))))""", "title_pages")  # fmt: skip
def _(t: Tables) -> DataFrame:
    p, title = F.col("page_id"), F.col("title")
    own = F.concat(F.lit("10.5555/p"), p.cast("string"))
    shown = F.when(p % 5 == 0, F.concat(title, F.lit("!!"))).when(p % 5 == 1, F.concat(title, F.lit(" s"))).when(p % 5 == 2, F.concat(title, F.lit(" and some more words of it"))).when(p % 5 == 3, "something else, of 1999")
    rows = t.title_pages.select("page_id", own.alias("doi"), "title", F.lit("2010").alias("year"), F.when(p % 7 == 0, F.upper(own)).when(p % 7 == 1, "10.5555/other").alias("page_doi"), shown.alias("page_title"), F.when(p % 4 == 2, "2011").when(p % 4 == 3, "2013").alias("page_year"))
    return identity.page_verdicts(rows).select("page_id", "method", F.round("score", 6).alias("score"))


@query("landing_page_identity", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN '10.5555/page' || page_id WHEN 1 THEN '10.5555/q' || page_id END AS page_doi, page_id % 4 = 0 AS matched, page_id % 4 = 1 AS mismatch FROM landing""", "landing")
def _(t: Tables) -> DataFrame:
    return pages.page_identity(t.landing).select("page_id", "page_doi", "matched", "mismatch")


@query("landing_page_links", """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'https://files.example.org/page' || page_id || '.pdf' ELSE 'https://files.example.org/page' || page_id || 'xyz.pdf' END AS url,
    CASE page_id % 4 WHEN 0 THEN 0 ELSE 4 END AS rank FROM landing WHERE page_id % 4 = 0 OR page_id % 4 = 2""", "landing")  # fmt: skip
def _(t: Tables) -> DataFrame:
    return pages.file_links(t.landing.withColumn("url", F.lit("https://x.example.org/a"))).filter(F.col("url").startswith("https://files.")).select("page_id", "url", "rank")


#: What every page gets before its own text: a block on another article, one that isn't JSON, and one with the article two graphs deep.
_LD = """'<script type="application/ld+json">{"@type":"Article","identifier":"10.5555/other","isAccessibleForFree":false,"abstract":"What another article is about, at some length."}</script>' ||
    '<script type="application/ld+json">{"@type":"Article","isAccessibleForFree":false</script>' ||
    '<script type="application/ld+json">[{"@graph":[{"@type":"WebPage","isAccessibleForFree":false},{"@graph":{"@type":["Thing","ScholarlyArticle"],"sameAs":{"list":["https:\\/\\/doi.org\\/10.5555\\/PAGE' || page_id || '"]},"isAccessibleForFree":' ||
    CASE page_id % 3 WHEN 0 THEN '"true"' WHEN 1 THEN 'false' ELSE 'null' END || ',"abstract":"Summary: \\u201cwhat\\u201d page ' || page_id || ' says of its \\"own\\" article",' ||
    '"encoding":[{"contentUrl":"https:\\/\\/files.example.org\\/ld' || page_id || '.pdf"},{"encodingFormat":"application/pdf","url":"https://files.example.org/get?n=' || page_id || '"},{"url":"https://files.example.org/plain"}]}}]}]</script>'"""


@query("landing_page_structured", """SELECT page_id, page_id % 3 = 0 AS free, page_id % 3 = 1 AS paid, '“what” page ' || page_id || ' says of its "own" article' AS abstract FROM pages""")
def _(t: Tables) -> DataFrame:
    rows = t.given("pages").selectExpr("page_id", "url", "concat('10.5555/page', page_id) AS doi", f"{_LD} || html AS html".replace("\\", "\\\\"))
    return pages.page_identity(rows).select("page_id", "free", "paid", "abstract")


@query("landing_page_structured_links", """SELECT page_id, unnest(['https://files.example.org/ld' || page_id || '.pdf', 'https://files.example.org/get?n=' || page_id]) AS url, unnest([1, 2]) AS n FROM pages""")
def _(t: Tables) -> DataFrame:
    rows = t.given("pages").selectExpr("page_id", "'https://x.example.org/a' AS url", f"{_LD} || html AS html".replace("\\", "\\\\"))
    return pages.file_links(rows).filter(F.col("rank") == pages.JSONLD).select("page_id", "url", "n")


@query("declared_file_urls", """SELECT page_id, 'https://files.example.org/page' || page_id || '.pdf' AS url FROM landing WHERE page_id % 4 = 0""", "landing")
def _(t: Tables) -> DataFrame:
    return pages.declared_files(t.landing).select("page_id", F.explode("pdf_urls").alias("url")).filter(F.col("url").startswith("https://files."))


@query("deep_url_harvest", """SELECT page_id, unnest(['https://a.example/' || page_id || '.pdf', 'https://b.example/é/pdf/' || page_id]) AS url FROM pages""")
def _(t: Tables) -> DataFrame:
    n = F.col("page_id").cast("string")
    rows = t.given("pages").select("page_id", F.concat(F.lit('{"x":{"y":["https:\\/\\/a.example\\/'), n, F.lit('.pdf","https://a.example/'), n, F.lit('.html"],"https://key.example/x.pdf":"say \\"https://no.example/x.pdf\\"","\\\\":"https:\\u002f/b.example/\\u00e9/pdf/'), n, F.lit('"}}')).alias("payload"))
    return pages.deep_urls(rows).select("page_id", F.explode("pdf_urls").alias("url"))


@query("candidate_urls_by_pattern", """SELECT doi, 'https://store.example/' || substr(doi, 9) || '.full.pdf' AS url FROM oa_status WHERE substr(doi, 9, 1) = 'd' UNION ALL SELECT doi, 'https://mirror.example/' || doi FROM oa_status WHERE doi LIKE '10.5555/d1%'""", "oa_status")
def _(t: Tables) -> DataFrame:
    templates = t.spark.createDataFrame([("10.5555/d", "^10\\.5555/", "", "https://store.example/{id}.full.pdf", 0), ("10.5555/d1", "^", "", "https://mirror.example/{doi}", 1), ("10.1101/", "^", "", "https://p.example/{id}", 2)], "prefix string, pattern string, replacement string, template string, n int")
    return pages.candidate_urls(t.oa_status, templates).select("doi", "url")


@query("supplement_filter", """SELECT page_id FROM pages WHERE page_id % 3 <> 0""")
def _(t: Tables) -> DataFrame:
    url = F.concat(F.lit("https://a.example/"), F.when(F.col("page_id") % 3 == 0, "x_MOESM1_ESM.pdf").otherwise("supplemental-title.pdf"))
    return t.given("pages").filter(~pages.is_supplement(url)).select("page_id")


# --- ledgers, audits, lists -----------------------------------------------


@query("upsert_ledger", """SELECT coalesce(s.doi, a.doi) AS doi, CASE WHEN a.doi IS NOT NULL THEN 'excluir' ELSE s.decision END AS decision, CASE WHEN s.doc_id % 2 = 0 THEN 'incluir' END AS ai_decision FROM screening s FULL OUTER JOIN
    (SELECT concat('10.5555/d', CAST(doc_id AS STRING)) AS doi FROM documents WHERE doc_id % 5 = 0) a ON a.doi = s.doi""", "screening")  # fmt: skip
def _(t: Tables) -> DataFrame:
    old = t.screening.select("doi", "decision", "reason", F.lit("x").alias("actor"), "version", F.lit("").alias("source"), F.lit("m").alias("ai_provider"), F.when(F.col("doc_id") % 2 == 0, "incluir").alias("ai_decision"), F.lit(2).alias("ai_version"))
    new = t.given("documents").filter("doc_id % 5 = 0").select(F.concat(F.lit("10.5555/d"), F.col("doc_id").cast("string")).alias("doi"), F.lit("excluir").alias("decision"), F.lit("r").alias("reason"), F.lit("y").alias("actor"), F.lit(2).alias("version"), F.lit("").alias("source"))
    return ledger.upsert_decisions(old, new).select("doi", "decision", "ai_decision")


@query("merge_stored_ledger", "SELECT doi, decision, CASE WHEN doc_id % 2 = 0 THEN 'incluir' END AS ai_decision FROM screening WHERE doc_id % 5 <> 0 UNION ALL SELECT '10.5555/d' || doc_id, CASE WHEN doc_id % 10 = 0 THEN 'incluir' ELSE 'excluir' END, CASE WHEN doc_id IN (SELECT doc_id FROM screening) AND doc_id % 2 = 0 THEN 'incluir' END FROM documents WHERE doc_id % 5 = 0", "screening")
def _(t: Tables) -> DataFrame:
    old = t.screening.select("doi", "decision", "reason", F.lit("x").alias("actor"), "version", F.lit("").alias("source"), F.lit("m").alias("ai_provider"), F.when(F.col("doc_id") % 2 == 0, "incluir").alias("ai_decision"), F.lit(2).alias("ai_version"))
    decided = lambda every, what: t.given("documents").filter(f"doc_id % {every} = 0").select(F.concat(F.lit("10.5555/D"), F.col("doc_id").cast("string")).alias("doi"), F.lit(what).alias("decision"), F.lit("r").alias("reason"), F.lit("y").alias("actor"), F.lit(2).alias("version"), F.lit("").alias("source"))
    folder = jobs.work_folder(t.spark)
    ledger.store_ledger(old, folder, buckets=16)
    for every, what in ((5, "excluir"), (10, "incluir")):
        ledger.merge_stored(folder, decided(every, what), ledger.upsert_decisions)
    return ledger.read_ledger(t.spark, folder).select(F.lower("doi").alias("doi"), "decision", "ai_decision")


@query("ledger_restore", """SELECT doi, decision FROM screening WHERE doc_id % 3 = 0 UNION ALL SELECT doi, 'saved' FROM screening WHERE doc_id % 3 <> 0""", "screening")
def _(t: Tables) -> DataFrame:
    rows = t.screening.select("doi", "decision", "doc_id")
    return ledger.restore(rows.filter("doc_id % 3 = 0").drop("doc_id"), rows.select("doi", F.lit("saved").alias("decision")))


@query("insert_if_absent", """SELECT lower(doi) AS doi FROM articles WHERE doi IS NOT NULL UNION SELECT lower(doi) FROM screening""", "articles", "screening")
def _(t: Tables) -> DataFrame:
    return ledger.insert_absent(t.articles.filter("doi IS NOT NULL").select("doi"), t.screening.select("doi")).select(F.lower("doi").alias("doi"))


@query("idempotent_import", """SELECT count(*) AS received, count(DISTINCT (item, source, code)) - count(DISTINCT CASE WHEN pass = 1 THEN (item, source, code) END) AS applied FROM attempts""", "attempts")
def _(t: Tables) -> DataFrame:
    from sievework.functions.ids import fingerprint

    stored = t.attempts.filter("pass = 1").select(fingerprint("item", "source", "code").alias("fingerprint"))
    return ledger.new_by_fingerprint(stored, t.attempts, ("item", "source", "code"))[1].select("received", "applied")


@query("newest_attempts", """SELECT item, seq FROM (SELECT *, row_number() OVER (PARTITION BY item ORDER BY seq DESC) AS n FROM attempts) WHERE n <= 3""", "attempts")
def _(t: Tables) -> DataFrame:
    return ledger.newest(t.attempts, "item", "seq", 3).select("item", "seq")


@query("first_attempt_reason", """SELECT item AS article, arg_max(coalesce(code, 'ok'), seq) AS reason FROM attempts GROUP BY item""", "attempts")
def _(t: Tables) -> DataFrame:
    return ledger.first_reason(t.attempts.select(F.col("item").alias("article"), F.coalesce("code", F.lit("ok")).alias("reason"), "seq"))


@query("batches_of_n", """SELECT project, CAST(floor((n - 1) / 50) AS INTEGER) AS batch, count(*) AS n FROM (SELECT project, row_number() OVER (PARTITION BY project ORDER BY article) AS n FROM documents_ready) GROUP BY 1, 2""", "documents_ready")
def _(t: Tables) -> DataFrame:
    return ledger.batches(t.documents_ready, "project", "article", 50, F.floor(F.col("article") / 10_000)).groupBy("project", "batch").agg(F.count("*").alias("n"))


@query("report_ordinals", """SELECT id, CAST(row_number() OVER (PARTITION BY source_kind ORDER BY id) AS INTEGER) AS ordinal FROM articles""", "articles")
def _(t: Tables) -> DataFrame:
    return ledger.numbered(t.articles, "source_kind", "id", F.floor(F.col("id") / 10_000)).select("id", "ordinal")


@query("output_names")
def _(t: Tables) -> DataFrame:
    # Titles that many records share, so that names meet.
    return ledger.output_names(t.search_items.withColumn("title", F.concat(F.lit("On "), "authors")))


@query("seeded_sample")
def _(t: Tables) -> DataFrame:
    return ledger.seeded_sample(t.search_items.select("doi"), "doi", 100, seed=42)


@query("promote_to_corpus", """SELECT s.doi, s.decision FROM screening s JOIN documents_ready d ON d.article = s.doc_id WHERE s.version = 2 AND s.decision = 'incluir' AND NOT EXISTS (SELECT 1 FROM articles a WHERE lower(a.doi) = lower(s.doi))""", "screening", "documents_ready", "articles")
def _(t: Tables) -> DataFrame:
    got = t.documents_ready.select(F.concat(F.lit("10.5555/D"), F.col("article").cast("string")).alias("doi"), F.lit("f").alias("file"), F.lit(True).alias("confirmed"))
    return ledger.promote(t.screening.filter("version = 2 AND decision = 'incluir'"), got, t.articles).select("doi", "decision")


@query("corpus_audit_findings", """SELECT finding, count(*) AS n FROM (SELECT 'sem_sidecar' AS finding FROM corpus_files WHERE NOT recorded UNION ALL SELECT 'nao_validado' FROM corpus_files WHERE recorded AND NOT validated
    UNION ALL SELECT 'doi_divergente' FROM corpus_files WHERE recorded AND expected_doi <> detected_doi UNION ALL SELECT 'fora_da_lista' FROM corpus_files WHERE recorded AND expected_doi NOT IN (SELECT doi FROM authorised_ids)
    UNION ALL SELECT 'doi_duplicado' FROM (SELECT *, count(*) OVER (PARTITION BY expected_doi) AS c FROM corpus_files WHERE recorded) WHERE c > 1
    UNION ALL SELECT 'conteudo_duplicado' FROM (SELECT *, count(*) OVER (PARTITION BY sha256) AS c FROM corpus_files WHERE recorded) WHERE c > 1
    UNION ALL SELECT 'conteudo_suspeito' FROM corpus_files WHERE recorded AND length(file) % 2 = 0) GROUP BY finding""", "corpus_files", "authorised_ids")  # fmt: skip
def _(t: Tables) -> DataFrame:
    # The text of every other file (by its name) opens as a supplement.
    texts = t.corpus_files.withColumn("gate", documents.article_gate(F.when(F.length("file") % 2 == 0, F.rpad(F.lit("Supplementary Table 1\n"), 400, "x ")).otherwise(F.rpad(F.lit("An article\n"), 400, "x "))))
    return audit.finding_counts(audit.findings(texts, t.authorised_ids))


@query("corpus_audit_rows", """SELECT 'nao_validado' AS finding, file FROM corpus_files WHERE recorded AND NOT validated UNION ALL SELECT 'doi_divergente', file FROM corpus_files WHERE recorded AND expected_doi <> detected_doi""", "corpus_files")
def _(t: Tables) -> DataFrame:
    return audit.findings(t.corpus_files, None).filter("finding IN ('nao_validado', 'doi_divergente')").select("finding", "file")


@query("validation_methods", "SELECT method, count(*) AS n FROM corpus_files WHERE recorded GROUP BY method", "corpus_files")
def _(t: Tables) -> DataFrame:
    return audit.methods(t.corpus_files)


@query("verdicts_to_recheck", "SELECT file FROM corpus_files WHERE NOT validated OR length(file) % 2 = 0", "corpus_files")
def _(t: Tables) -> DataFrame:
    rows = t.corpus_files.withColumn("validator_version", F.when(F.length("file") % 2 == 0, 1).otherwise(identity.VALIDATOR))
    return rows.filter((F.col("validator_version") < identity.VALIDATOR) | ~F.col("validated")).select("file")


@query("orphan_texts", """SELECT project, count(*) AS texts, CAST(sum(bytes) AS BIGINT) AS bytes FROM stored_texts s WHERE key LIKE 'p1/%' AND NOT EXISTS (SELECT 1 FROM articles a WHERE lower(a.doi) = lower(s.doi)) GROUP BY 1""", "stored_texts", "articles")
def _(t: Tables) -> DataFrame:
    return audit.released(audit.orphan_texts(t.stored_texts, t.articles))


@query("storage_by_project", "SELECT project, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM documents_ready GROUP BY project", "documents_ready")
def _(t: Tables) -> DataFrame:
    return audit.storage(t.documents_ready)


@query("articles_with_document", "SELECT id FROM articles WHERE id IN (SELECT article FROM documents_ready)", "articles", "documents_ready")
def _(t: Tables) -> DataFrame:
    return t.articles.join(t.documents_ready, F.col("id") == F.col("article"), "left_semi").select("id")


@query("corpus_route_counts", f"""SELECT * FROM (WITH {_CLASSIFIED} SELECT coalesce(human_decision, {_POLICY}) AS route, count(*) AS documents, count(*) FILTER (gate IS NOT NULL) AS held FROM (SELECT *, CASE WHEN text_quality = 'ERROR' THEN 1 WHEN length(trim(text)) < 300 THEN 1 END AS gate FROM x) GROUP BY 1)""", "typed_documents")
def _(t: Tables) -> DataFrame:
    rows = documents.screen_gate(documents.route(documents.classify(t.typed_documents)))
    return rows.groupBy("route").agg(F.count("*").alias("documents"), F.count("gate").alias("held"))


@query("project_roles", """SELECT project, CASE WHEN o = 1 THEN 'owner' ELSE 'reviewer' END AS role FROM (SELECT o_orderkey AS project, CASE WHEN o_custkey % 10 = 1 THEN 1 ELSE 0 END AS o, o_orderkey % 4 = 0 AS m FROM orders) WHERE o = 1 OR m""")
def _(t: Tables) -> DataFrame:
    orders = t.given("orders")
    projects = orders.select(F.col("o_orderkey").alias("project"), F.lit("n").alias("name"), F.when(F.col("o_custkey") % 10 == 1, "me").otherwise("x").alias("owner"))
    members = orders.select(F.col("o_orderkey").alias("project"), F.lit("me").alias("email"), F.when(F.col("o_orderkey") % 4 == 0, "accepted").otherwise("pending").alias("status"), F.lit("reviewer").alias("role"))
    return audit.roles(projects, members, "me").select("project", "role")


@query("project_invitations", "SELECT o_orderkey AS project, o_orderpriority AS name FROM orders WHERE o_orderkey % 4 = 1")
def _(t: Tables) -> DataFrame:
    orders = t.given("orders")
    members = orders.select(F.col("o_orderkey").alias("project"), F.lit("me").alias("email"), F.when(F.col("o_orderkey") % 4 == 1, "pending").otherwise("accepted").alias("status"), F.lit("reviewer").alias("role"))
    return audit.invitations(members, orders.select(F.col("o_orderkey").alias("project"), F.col("o_orderpriority").alias("name")), "me").select("project", "name")


@query("team_sizes", "SELECT o_custkey AS project, count(*) FILTER (o_orderkey % 3 = 0) + 1 AS people FROM orders GROUP BY 1")
def _(t: Tables) -> DataFrame:
    members = t.given("orders").select(F.col("o_custkey").alias("project"), F.col("o_orderkey").cast("string").alias("email"), F.when(F.col("o_orderkey") % 3 == 0, "accepted").otherwise("pending").alias("status"))
    return audit.team_sizes(members, members.select("project").distinct())


@query("audit_snapshot_diff", """SELECT change, count(*) AS n FROM (SELECT CASE WHEN doc_id % 5 = 0 THEN 'removed' WHEN doc_id % 7 = 0 THEN 'changed' END AS change FROM documents UNION ALL SELECT 'added' FROM documents WHERE doc_id % 5 = 1) WHERE change IS NOT NULL GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    d = t.given("documents").select(F.col("doc_id").alias("id"), "lang", "n_chars")
    after = d.filter("id % 5 <> 0").withColumn("lang", F.when(F.col("id") % 7 == 0, "??").otherwise(F.col("lang")))
    new = d.filter("id % 5 = 1").withColumn("id", -F.col("id") - 1)
    return audit.snapshot_changes(d, after.unionByName(new)).groupBy("change").agg(F.count("*").alias("n"))


@query("cascade_invalidation", "SELECT count(*) AS opinions FROM opinions WHERE article % 7 <> 0", "opinions")
def _(t: Tables) -> DataFrame:
    changed = t.given("documents").filter("doc_id % 7 = 0").select(F.col("doc_id").alias("id"))
    return audit.invalidated(changed, {"opinions": (t.opinions, "article")})["opinions"].agg(F.count("*").alias("opinions"))


@query("dedup_by_content", "SELECT count(*) AS files, CAST(sum(n) AS BIGINT) AS copies FROM (SELECT count(*) AS n FROM documents GROUP BY sha256(text))")
def _(t: Tables) -> DataFrame:
    files = t.given("documents").select(F.col("doc_id").alias("id"), F.col("text").cast("binary").alias("content"))
    return audit.once_by_content(files).agg(F.count("*").alias("files"), F.sum("copies").alias("copies"))


@query("file_validity", """SELECT problem, count(*) AS n FROM (SELECT CASE WHEN octet_length(encode(text)) + 12 < 1024 THEN 'too small' WHEN doc_id % 3 = 0 THEN 'no header' WHEN doc_id % 2 = 0 THEN 'no end mark' ELSE 'ok' END AS problem FROM documents) GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    content = F.concat(F.when(d % 3 == 0, "PK%-1.").otherwise("%PDF-1"), "text", F.when(d % 2 == 0, "......").otherwise("\n%%EOF")).cast("binary")
    files = t.given("documents").select("doc_id", content.alias("content")).withColumn("length", F.octet_length("content"))
    return audit.file_validity(files).groupBy(F.coalesce("problem", F.lit("ok")).alias("problem")).agg(F.count("*").alias("n"))


@query("corpus_vs_lists", "SELECT DISTINCT expected_doi AS doi FROM corpus_files WHERE expected_doi NOT IN (SELECT doi FROM authorised_ids)", "corpus_files", "authorised_ids")
def _(t: Tables) -> DataFrame:
    return audit.unlisted(t.corpus_files.select(F.col("expected_doi").alias("doi")), t.authorised_ids)[0]


@query("search_summary", """SELECT base, count(*) AS found, count(raw) AS with_id, count(DISTINCT lower(raw)) AS unique_ids FROM searched GROUP BY base""", "searched")
def _(t: Tables) -> DataFrame:
    rows = t.searched.withColumn("doi", canonical_id(F.col("raw")))
    return rows.groupBy("base").agg(F.count("*").alias("found"), F.count("doi").alias("with_id"), F.count_distinct("doi").alias("unique_ids"))


@query("search_pages_capped", """SELECT base, count(*) AS total, count(raw) AS with_id, count(*) FILTER (raw IS NULL) AS without_id FROM (SELECT *, row_number() OVER (PARTITION BY base ORDER BY doc_id) AS n FROM searched) WHERE n <= 200 GROUP BY base""", "searched")
def _(t: Tables) -> DataFrame:
    return lists.search_result(t.searched.select("base", F.col("doc_id").alias("rank"), F.col("raw").alias("doi"), "title"), 200)[1]


@query("canonical_id_union", "SELECT DISTINCT substr(lower(raw), 17) AS doi FROM searched WHERE raw IS NOT NULL", "searched")
def _(t: Tables) -> DataFrame:
    return t.searched.select(canonical_id(F.col("raw")).alias("doi")).filter("doi IS NOT NULL").distinct()


@query("first_occurrence_ids", "SELECT substr(lower(raw), 17) AS doi, min(doc_id) AS pos FROM searched WHERE raw IS NOT NULL GROUP BY 1", "searched")
def _(t: Tables) -> DataFrame:
    return t.searched.select(canonical_id(F.col("raw")).alias("doi"), "doc_id").filter("doi IS NOT NULL").groupBy("doi").agg(F.min("doc_id").alias("pos"))


@query("search_output_lists", "SELECT 'ids' AS list, count(DISTINCT lower(raw)) AS n FROM searched UNION ALL SELECT 'without_id', count(DISTINCT title) FROM searched WHERE raw IS NULL UNION ALL SELECT 'combined', (SELECT count(DISTINCT lower(raw)) FROM searched) + (SELECT count(DISTINCT title) FROM searched WHERE raw IS NULL) UNION ALL SELECT 'links', count(DISTINCT lower(raw)) FROM searched", "searched")
def _(t: Tables) -> DataFrame:
    out = None
    for name, rows in sinks.search_lists(t.searched.select(canonical_id(F.col("raw")).alias("doi"), "title")).items():
        one = rows.agg(F.lit(name).alias("list"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("id_list_lines", "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN raw IS NULL THEN 'title' ELSE 'doi' END AS kind FROM searched WHERE raw IS NOT NULL OR trim(title) <> '') GROUP BY kind", "searched")
def _(t: Tables) -> DataFrame:
    return lists.id_lines(t.searched.select(F.coalesce("raw", F.replace("title", F.lit("\n"), F.lit(" "))).alias("value"))).groupBy("kind").agg(F.count("*").alias("n"))


@query("ids_in_any_column", "SELECT DISTINCT substr(lower(raw), 17) AS doi FROM searched WHERE raw IS NOT NULL", "searched")
def _(t: Tables) -> DataFrame:
    return lists.ids_in_any_column(t.searched.select("base", "raw", "doc_id"))


@query("free_text_ids", "SELECT DISTINCT '10.5555/a' || (doc_id % 500) AS doi FROM documents UNION SELECT DISTINCT '10.5555/b' || (doc_id % 90) FROM documents")
def _(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    text = F.concat(F.lit("see https://doi.org/10.5555/A"), (d % 500).cast("string"), F.lit(";10.5555/b"), (d % 90).cast("string"), F.lit(". end"))
    return lists.free_text_ids(t.given("documents").select(text.alias("text")))


@query("batch_validation_report", """SELECT doc_id // 500 AS batch_id, count(DISTINCT CASE WHEN doc_id % 7 <> 0 THEN doc_id % 60 END) AS valid, count(*) FILTER (doc_id % 7 = 0) AS invalid, count(*) FILTER (doc_id % 7 <> 0) - count(DISTINCT CASE WHEN doc_id % 7 <> 0 THEN doc_id % 60 END) AS duplicates, count(*) AS line_count FROM documents GROUP BY 1""")
def _(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    line = F.when(d % 7 == 0, "not an id").otherwise(F.concat(F.lit("doi: 10.5555/X"), (d % 60).cast("string")))
    texts = t.given("documents").groupBy(F.floor(d / 500).alias("batch_id")).agg(F.array_join(F.collect_list(line), "\n").alias("text"))
    return lists.batch_report(texts).select("batch_id", F.size("dois").cast("long").alias("valid"), F.size("invalid").cast("long").alias("invalid"), "duplicates", "line_count")


@query("tagged_record_scan", "SELECT CASE WHEN doc_id % 3 = 0 THEN '10.5555/t' || doc_id WHEN doc_id % 3 = 1 THEN 'Title ' || doc_id ELSE 'lilacs #' || doc_id END AS label FROM documents")
def _(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    n = d.cast("string")
    value = F.concat(F.lit("TY  - JOUR\n"), F.when(d % 3 != 2, F.concat(F.lit("TI  - Title "), n, F.lit("\n"))).otherwise(""), F.when(d % 3 == 0, F.concat(F.lit("DO  - 10.5555/t"), n, F.lit("\n"))).otherwise(""))
    return lists.tagged_records(t.given("documents").select(d.alias("n"), value.alias("value")), "lilacs").select("label")


@query("result_groups", """SELECT count(*) FILTER (inc) AS incorporated, count(*) FILTER (NOT inc AND error = '' AND found AND link) AS ready, count(*) FILTER (NOT inc AND error <> '' AND link) AS failed, count(*) FILTER (status = 'done' AND NOT inc AND NOT link) AS missing,
    count(*) FILTER (status <> 'done' AND NOT inc) AS pending, count(*) FILTER (NOT inc AND NOT (error = '' AND found AND link) AND NOT (error <> '' AND link) AND NOT (status = 'done' AND NOT link) AND status = 'done') AS unassigned
    FROM (SELECT *, doc_id IN (SELECT id FROM articles a JOIN documents_ready d ON d.article = a.id WHERE source_kind = 'doi') AS inc, doc_id % 2 = 0 AS link FROM search_items)""", "search_items", "articles", "documents_ready")  # fmt: skip
def _(t: Tables) -> DataFrame:
    from sievework.operators.groups import result_groups

    items = t.search_items.withColumn("has_link", F.col("doc_id") % 2 == 0)
    rows = result_groups(items, t.articles, t.documents_ready, online=False)
    names = ("incorporated", "ready", "failed", "missing", "pending", "unassigned")
    return rows.agg(*[F.count_if(c).alias(c) for c in names])


def _indexed(t: Tables) -> DataFrame:
    """(doc_id, index): each whole text as a map of its words to their positions; null stays null."""
    return t.given("documents").select("doc_id", payloads.inverted_index(F.col("text")).alias("index"))


@query("source_payloads", "SELECT 'crossref' AS source, count(*) AS n, count(DISTINCT doi) AS dois FROM oa_status UNION ALL SELECT 'openalex', count(*), count(DISTINCT doi) FROM oa_status UNION ALL SELECT 'semanticscholar', count(*), count(DISTINCT doi) FROM oa_status", "oa_status")
def _(t: Tables) -> DataFrame:
    d = t.given("documents").select(F.col("doc_id").cast("string").alias("n"))
    doi = F.concat(F.lit("10.5555/d"), "n")
    crossref = d.select(F.to_json(F.struct(doi.alias("DOI"), F.array(F.lit("A title")).alias("title"), F.lit("<p>Abstract: something long enough to keep</p>").alias("abstract"))).alias("payload"))
    openalex = _indexed(t).withColumn("n", F.col("doc_id").cast("string")).select(F.to_json(F.struct(F.concat(F.lit("https://doi.org/"), doi).alias("doi"), F.lit("T").alias("title"), F.col("index").alias("abstract_inverted_index"))).alias("payload"))
    s2 = d.select(F.to_json(F.struct(F.create_map(F.lit("DOI"), F.upper(doi)).alias("externalIds"), F.lit("T").alias("title"), F.lit(2001).alias("year"))).alias("payload"))
    rows = payloads.source_records(crossref, "crossref").unionByName(payloads.source_records(openalex, "openalex")).unionByName(payloads.source_records(s2, "semanticscholar"))
    return rows.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("doi").alias("dois"))


#: An answer of each provider for a document, and what its record says; ``{n}`` is the document's number.
_ANSWERS = {
    "crossref": ("""{"status":"ok","message":{"DOI":"10.5555/C{n}","title":["Crossref  title {n}","second"],"author":[{"given":"Ana","family":"Lima {n}"},{"name":"A Consortium"},{}],"issued":{"date-parts":[[2001,5]]},"container-title":["Journal {n}"],"abstract":"<jats:p>Abstract: what document {n} is about</jats:p>","type":"journal-article","page":"1-{n}"}}""",
        ("10.5555/c{n}", "Crossref title {n}", "Ana Lima {n}; A Consortium", "2001", "Journal {n}", "what document {n} is about", "journal-article", "1-{n}")),
    "europepmc": ("""{"resultList":{"result":[{"doi":"10.5555/e{n}","title":"Europe {n}","authorString":"Silva J, Costa M.","pubYear":"2010","journalTitle":"Eur J {n}","abstractText":"<h4>Summary</h4> Europe has document {n}","pubType":"review","pageInfo":"e{n}"},{"title":"Without id {n}","pubYear":2011},7]}}""",
        ("10.5555/e{n}", "Europe {n}", "Silva J, Costa M.", "2010", "Eur J {n}", "Europe has document {n}", "review", "e{n}"), (None, "Without id {n}", "", "2011", "", "", "", "")),
    "semanticscholar": ("""{"externalIds":{"DOI":"10.5555/S{n}","CorpusId":{n}},"title":"Scholar {n}","authors":[{"name":"Wu {n}"},{"name":" "},{"name":"Li"}],"year":1999,"venue":"Venue","abstract":null}""",
        ("10.5555/s{n}", "Scholar {n}", "Wu {n}; Li", "1999", "Venue", "", "", "")),
    "openalex": ("""{"results":[{"doi":"https://doi.org/10.5555/o{n}","title":null,"display_name":"Open {n}","publication_year":2020,"type":"article","authorships":[{"author":{"display_name":"Eva {n}"}}],"primary_location":{"source":{"display_name":"Open J"}},"abstract_inverted_index":{"again":[3],"doc":[0,2],"{n}":[1]}}]}""",
        ("10.5555/o{n}", "Open {n}", "Eva {n}", "2020", "Open J", "doc {n} doc again", "article", "")),
    "datacite": ("""{"data":{"attributes":{"doi":"10.5555/D{n}","titles":[{"title":"Data {n}"}],"creators":[{"name":"Doe, Jo","givenName":"Jo","familyName":"Doe {n}"},{"name":"A Lab"}],"publicationYear":2015,"publisher":"Repo","descriptions":[{"description":"short"},{"description":"A description of data set {n}"}],"types":{"resourceTypeGeneral":"Dataset"}}}}""",
        ("10.5555/d{n}", "Data {n}", "Jo Doe {n}; A Lab", "2015", "Repo", "A description of data set {n}", "Dataset", "")),
    "pubmed": ("""{"result":{"uids":["1{n}","2"],"1{n}":{"uid":"1{n}","title":"PubMed  {n}","authors":[{"name":"Roe R"},{"name":"Poe {n}"}],"pubdate":"Winter 1987","fulljournalname":"Med J","pages":"9-{n}","articleids":[{"idtype":"pubmed","value":"1"},{"idtype":"doi","value":"10.5555/P{n}"}]},"2":{"uid":"2","error":"cannot get document summary"}}}""",
        ("10.5555/p{n}", "PubMed {n}", "Roe R; Poe {n}", "1987", "Med J", "", "", "9-{n}")),
    "lilacs": ("""{"objects":[{"id":{n},"doi_number":"http://dx.doi.org/10.5555/L{n}","title":[{"_i":"pt","text":"Título  {n}"},{"_i":"en","text":"Title"}],"individual_author":[{"text":"Souza, A"},{"text":""},{"text":"Reis {n}"}],"publication_date_normalized":"20180500","title_serial":"Rev {n}"}]}""",
        ("10.5555/l{n}", "Título {n}", "Souza, A; Reis {n}", "2018", "Rev {n}", "", "", "")),
    "entries": ("""{"search-results":{"opensearch:totalResults":"2","entry":[{"dc:title":{"$":"Entry {n}"},"prism:coverDate":"2012-03-01","prism:publicationName":"Ent J","dc:creator":"Kim","itemInfo":{"ids":[{"prism:doi":"none"},{"itemDoi":{"$":"https://doi.org/10.5555/T{n}"}}]}},{"error":"Result set was empty"},{"citationTitle":"Bare {n}","head":{"publicationYear":"2003","source":{"sourceTitle":"Head J"}}}]}}""",
        ("10.5555/t{n}", "Entry {n}", "Kim", "2012", "Ent J", "", "", ""), (None, "Bare {n}", "", "2003", "Head J", "", "", "")),
}
#: What stands in place of some documents' answers, and why it has no records.
_NO_ANSWERS = (("<p>{n} is down for maintenance</p>", "not JSON"), ("", "empty"), ('{"error":"quota {n}"', "not JSON"), ('["{n}"]', "no records"), ("{}", "no records"))


def _said(template: str | None, null: str = "NULL") -> str:
    return null if template is None else "replace('" + template.replace("'", "''") + "', '{n}', CAST(doc_id AS VARCHAR))"


def _answers(t: Tables, provider: str) -> DataFrame:
    n = F.col("doc_id").cast("string")
    fill = lambda text: F.replace(F.lit(text), F.lit("{n}"), n)
    bad = F.element_at(F.array(*[fill(text) for text, _ in _NO_ANSWERS]), (F.floor(F.col("doc_id") / 7) % len(_NO_ANSWERS) + 1).cast("int"))
    return t.given("documents").select(F.when(F.col("doc_id") % 7 == 0, bad).otherwise(fill(_ANSWERS[provider][0])).alias("payload"))


@query("source_payload_records", " UNION ALL ".join(f"SELECT '{p}' AS source, {', '.join(f'{_said(v)} AS {c}' for c, v in zip(payloads.RECORD, record))} FROM documents WHERE doc_id % 7 <> 0" for p, (_, *records_) in _ANSWERS.items() for record in records_))
def _(t: Tables) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, [payloads.source_records(_answers(t, p), p) for p in _ANSWERS])


@query("source_payload_rejects", " UNION ALL ".join(f"SELECT '{p}' AS source, '{reason}' AS reason, {_said(text)} AS payload FROM documents WHERE doc_id % 7 = 0 AND (doc_id // 7) % {len(_NO_ANSWERS)} = {i}" for p in _ANSWERS for i, (text, reason) in enumerate(_NO_ANSWERS)))
def _(t: Tables) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, [payloads.split_answers(_answers(t, p), p)[1] for p in _ANSWERS])


@query("inverted_abstracts", "SELECT doc_id, array_to_string(list_filter(string_split(text, ' '), lambda w: w <> ''), ' ') AS abstract FROM documents")
def _(t: Tables) -> DataFrame:
    return _indexed(t).select("doc_id", payloads.inverted_abstract(F.col("index")).alias("abstract"))


@query("open_access_locations", """SELECT '10.5555/d' || doc_id AS doi, CASE doc_id % 3 WHEN 0 THEN 'https://a.org/' || doc_id || '.pdf https://b.org/' || doc_id WHEN 1 THEN 'https://b.org/' || doc_id ELSE '' END AS pdfs,
    CASE doc_id % 3 WHEN 0 THEN 'https://a.org/' || doc_id || ' https://c.org/' || doc_id WHEN 1 THEN 'https://c.org/' || doc_id ELSE '' END AS pages FROM documents""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    n = d.cast("string")
    of = lambda pdf, page, url: F.struct(*[(F.concat(F.lit(f"https://{x[0]}.org/"), n, F.lit(x[1:])) if x else F.lit(None).cast("string")).alias(c) for c, x in (("url_for_pdf", pdf), ("url_for_landing_page", page), ("url", url))])
    best = F.when(d % 3 == 0, of("a.pdf", "a", None))
    others = F.when(d % 3 < 2, F.array(of("b", None, "c"), of("b", "b", "c"), of("b", None, "b")))
    raw = t.given("documents").select(F.to_json(F.struct(F.concat(F.lit("https://doi.org/10.5555/D"), n).alias("doi"), best.alias("best_oa_location"), others.alias("oa_locations"))).alias("payload"))
    return payloads.open_locations(raw).select("doi", F.array_join("pdf_urls", " ").alias("pdfs"), F.array_join("page_urls", " ").alias("pages"))


@query("object_listing_versions", """SELECT 'PMC' || doc_id AS id, CASE doc_id % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 ELSE 12 END AS version, CASE WHEN doc_id % 4 = 3 THEN NULL ELSE 'oa/PMC' || doc_id || CASE doc_id % 4 WHEN 0 THEN '.1/PMC' || doc_id || '.1.xml' WHEN 1 THEN '.3/PMC' || doc_id || '.3.xml' ELSE '.12/PMC' || doc_id || '.12.xml' END END AS xml,
    CASE doc_id % 4 WHEN 1 THEN 'oa/PMC' || doc_id || '.3/PMC' || doc_id || '.3.pdf' WHEN 3 THEN 'oa/PMC' || doc_id || '.12/PMC' || doc_id || '.12.pdf' END AS pdf FROM documents""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    n = F.concat(F.lit("PMC"), d.cast("string"))
    key = lambda v, form: F.concat(F.lit("oa/"), n, F.lit(f".{v}/"), n, F.lit(f".{v}.{form}"))
    other = lambda v, name: F.concat(F.lit("oa/"), n, F.lit(f".{v}/{name}"))
    always = [key(1, "xml"), other(99, "figure1.pdf"), other(1, "PMC1-s001.pdf")]
    more = F.when(d % 4 == 1, F.array(key(3, "pdf"), key(3, "xml"))).when(d % 4 == 2, F.array(key(3, "pdf"), key(12, "xml"))).when(d % 4 == 3, F.array(key(9, "xml"), key(12, "pdf"))).otherwise(F.array().cast("array<string>"))
    keys = t.given("documents").select(F.explode(F.concat(F.array(*always), more)).alias("key"))
    return payloads.newest_versions(keys).select("id", "version", "xml", "pdf")


@query("id_crosswalk", "SELECT CAST(doc_id AS STRING) AS id, '10.5555/d' || doc_id AS doi FROM documents WHERE doc_id % 5 <> 0 UNION ALL SELECT 'PMC' || doc_id, '10.5555/d' || doc_id FROM documents WHERE doc_id % 5 <> 0")
def _(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    rec = F.struct(d.cast("string").alias("pmid"), F.concat(F.lit("PMC"), d.cast("string")).alias("pmcid"), F.concat(F.lit("10.5555/d"), d.cast("string")).alias("doi"), F.when(d % 5 == 0, "error").alias("status"))
    return payloads.crosswalk(t.given("documents").select(F.to_json(F.struct(F.array(rec).alias("records"))).alias("payload")))


@query("csv_guard", "SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '''=' || doc_id WHEN doc_id % 4 = 1 THEN '''-' || doc_id ELSE 'x' || doc_id END AS cell FROM documents")
def _(t: Tables) -> DataFrame:
    from sievework.functions.text import csv_safe

    d = F.col("doc_id")
    cell = F.concat(F.when(d % 4 == 0, "=").when(d % 4 == 1, "-").otherwise("x"), d.cast("string"))
    return t.given("documents").select("doc_id", csv_safe(cell).alias("cell"))


@query("question_extracts", "SELECT 'Q1' AS question, count(*) AS n FROM answers WHERE a1 <> 'Não' UNION ALL SELECT 'Q2', count(*) FROM answers WHERE a2 <> 'Não'", "answers")
def _(t: Tables) -> DataFrame:
    a = t.answers
    one = lambda q, c: a.select(F.lit(q).alias("question"), F.col("doc_id").alias("article"), F.when(F.col(c) == "Não", "n/a").otherwise(F.col(c)).alias("answer"), F.lit("s").alias("snippets"))
    return sinks.question_extracts(one("Q1", "a1").unionByName(one("Q2", "a2"))).groupBy("question").agg(F.count("*").alias("n"))


@query("bibliography_entries", r"""SELECT doi, '@article{ref_' || regexp_replace(doi, '[^A-Za-z0-9]+', '_', 'g') || ',' || chr(10) || '  doi = {' || doi || '}' || CASE WHEN trim(title) <> '' THEN ',' || chr(10) || '  title = {' || regexp_replace(title, '[{}]', '', 'g') || '}' ELSE '' END ||
    CASE WHEN doc_id % 6 <> 0 THEN ',' || chr(10) || '  author = {' || authors || '}' ELSE '' END || ',' || chr(10) || '  journal = {' || journal || ' J},' || chr(10) || '  year = {' || year || '}' || chr(10) || '}' AS entry FROM search_items WHERE doc_id % 3 = 0""", "search_items")  # fmt: skip
def _(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    rows = t.search_items.withColumn("identity_validated", d % 3 == 0).withColumn("authors", F.when(d % 6 == 0, " ").otherwise(F.col("authors"))).withColumn("journal", F.concat(F.lit("{"), "journal", F.lit("} J")))
    return sinks.bibtex_entries(rows).select("doi", "entry")


_CHECKSUM = "CAST(sum(CAST('0x' || substr(md5(concat_ws(chr(31), {0})), 1, 15) AS BIGINT)) AS STRING)"
_CELL = "coalesce(CAST({0} AS STRING), chr(30))"


@query("bundle_manifest", f"SELECT 'articles' AS name, count(*) AS rows, {_CHECKSUM.format(', '.join(_CELL.format(c) for c in ('doi', 'id', 'title')))} AS checksum FROM articles UNION ALL SELECT 'screening', count(*), {_CHECKSUM.format(', '.join(_CELL.format(c) for c in ('decision', 'doi', 'version')))} FROM screening", "articles", "screening")
def _(t: Tables) -> DataFrame:
    return sinks.bundle_manifest({"articles": t.articles.select("title", "id", "doi"), "screening": t.screening.select("doi", "version", "decision")})


@query("restore_problems", "SELECT 'document without article' AS problem, CAST(article AS STRING) AS key FROM documents_ready WHERE article NOT IN (SELECT id FROM articles)", "documents_ready", "articles")
def _(t: Tables) -> DataFrame:
    return sinks.restore_problems(t.articles.withColumn("has_document", F.lit(False)), t.documents_ready, t.screening)


@query("model_verdicts", """SELECT doc_id, CASE WHEN doc_id % 5 = 4 THEN NULL WHEN doc_id % 5 = 0 THEN 'INCLUIDO' WHEN doc_id % 5 = 1 THEN 'EXCLUIDO' ELSE 'REVISÃO MANUAL' END AS decision, CASE WHEN doc_id % 5 = 4 OR doc_id % 5 = 2 THEN NULL ELSE CAST(least(100, doc_id % 150) AS INTEGER) END AS confidence FROM documents""")
def _(t: Tables) -> DataFrame:
    d = F.col("doc_id")
    said = F.when(d % 5 == 0, "incluir").when(d % 5 == 1, "excluído").otherwise("talvez")
    conf = F.when(d % 5 == 2, "BAIXO").otherwise(F.concat((d % 150).cast("string"), F.lit("%")))
    text = F.concat(F.when(d % 2 == 0, "Claro, segue:\n```json\n").otherwise(""), F.lit('{"parecer_final":"'), said, F.lit('","confianca":"'), conf, F.when(d % 5 == 4, "").otherwise('"}'), F.when(d % 2 == 0, "\n```").otherwise(""))
    rows = screening.parse_response(t.given("documents").select("doc_id", text.alias("response")))
    return screening.verdict(rows, F.lit("x" * 400)).select("doc_id", "decision", "confidence")


@query("response_envelopes", "SELECT doc_id, 2 AS items FROM documents WHERE doc_id % 2 = 0 UNION ALL SELECT doc_id, 1 FROM documents WHERE doc_id % 2 = 1")
def _(t: Tables) -> DataFrame:
    text = F.when(F.col("doc_id") % 2 == 0, '{"items":[{"a":1},{"a":2}]}').otherwise('{"a":3}')
    rows = screening.unify_responses(screening.parse_response(t.given("documents").select("doc_id", text.alias("response"))))
    return rows.groupBy("doc_id").agg(F.count("*").cast("int").alias("items"))


@query("batch_model_scoring", """SELECT status, coalesce(failure_reason, '') AS failure_reason, count(*) AS n FROM (SELECT CASE WHEN trim(text) = '' OR text_quality = 'ERROR' OR length(trim(text)) < 300 OR doc_id % 9 = 2 THEN 'FAILED' ELSE 'COMPLETED' END AS status,
    CASE WHEN trim(text) = '' THEN 'sem_texto' WHEN text_quality = 'ERROR' THEN 'extracao_falhou' WHEN length(trim(text)) < 300 THEN 'texto_insuficiente' WHEN doc_id % 9 = 2 THEN 'resposta_invalida' END AS failure_reason FROM typed_documents) GROUP BY 1, 2""", "typed_documents")  # fmt: skip
def _(t: Tables) -> DataFrame:
    def scorer(batches):
        for batch in batches:
            cut = batch["article_id"].astype(int) % 9 == 2
            yield batch[["article_id"]].assign(response=cut.map({True: '{"parecer_final":"INCL', False: '{"parecer_final":"INCLUIR","confianca":80}'}))

    texts = t.typed_documents.select(F.col("doc_id").cast("string").alias("article_id"), "text", "text_quality")
    done = t.spark.createDataFrame([], "article_id string, task_hash string")
    out = screening.score_with_model(texts, done, scorer, "article_id string, response string", "p")
    return out.groupBy("status", F.coalesce("failure_reason", F.lit("")).alias("failure_reason")).agg(F.count("*").alias("n"))


@query("fulltext_suggestions", """SELECT doc_id, CASE WHEN a1 = 'Não' THEN 'excluir' WHEN a1 = 'Sim' AND a2 = 'Sim' THEN 'incluir' WHEN a2 = 'Não' THEN 'excluir' ELSE 'duvida' END AS decision FROM answers""", "answers")
def _(t: Tables) -> DataFrame:
    plain = lambda c: F.when(F.col(c) == "Sim", "sim").when(F.col(c) == "Não", "nao").otherwise("indeterminado")
    against = F.when(F.col("a2") == "Sim", "nao").otherwise("sim")
    return t.answers.select("doc_id", review.fulltext_suggestion(F.array(plain("a1")), F.array(against)).alias("decision"))


@query("protocol_question_table", """SELECT lang AS protocol, part, count(*) AS n FROM (SELECT DISTINCT lang FROM documents) , (SELECT 'population' AS part UNION ALL SELECT 'concept' UNION ALL SELECT 'inclusion' UNION ALL SELECT 'inclusion') p GROUP BY 1, 2""")
def _(t: Tables) -> DataFrame:
    protocols = t.given("documents").select(F.col("lang").alias("protocol")).distinct().select("protocol", F.concat(F.lit("adults in "), "protocol").alias("population"), F.lit("- care").alias("concept"), F.lit("").alias("context"), F.lit("1. trials\n2. cohorts").alias("inclusion"), F.lit(None).cast("string").alias("exclusion"))
    return protocol.questions(protocols).groupBy("protocol", "part").agg(F.count("*").alias("n"))


@query("declared_questions", """SELECT doc_id AS protocol, 'Q' || CASE k WHEN 0 THEN doc_id % 9 + 1 ELSE 12 END AS question FROM documents, (SELECT 0 AS k UNION ALL SELECT 1) q""")
def _(t: Tables) -> DataFrame:
    text = F.concat(F.lit("answer Q12, then Q"), (F.col("doc_id") % 9 + 1).cast("string"), F.lit(" and Q12 again"))
    return protocol.declared_questions(t.given("documents").select(F.col("doc_id").alias("protocol"), text.alias("text"))).select("protocol", "question")


@query("protocol_approval", """SELECT doc_id AS protocol, doc_id % 4 <> 0 AND doc_id % 3 <> 0 AS approved FROM documents""")
def _(t: Tables) -> DataFrame:
    from sievework.functions.ids import fingerprint

    d = F.col("doc_id")
    kinds = F.when(d % 3 == 0, F.array(F.lit("population"))).otherwise(F.array(F.lit("population"), F.lit("concept")))
    rows = t.given("documents").select(d.alias("protocol"), F.explode(kinds).alias("kind"), F.lit("text").alias("text"), F.lit("approved").alias("status"))
    rows = rows.withColumn("approved_hash", F.when(F.col("protocol") % 4 == 0, "old").otherwise(fingerprint("kind", "text")))
    need = t.spark.createDataFrame([("population",), ("concept",)], "kind string")
    return protocol.approval(rows, need).select("protocol", "approved")


# --- streams --------------------------------------------------------------


def _event_rows(t: Tables) -> DataFrame:
    e = jobs.events_stream(t.spark, t.sf_dir)
    n = F.col("event_id")
    status = F.when(n % 9 == 0, F.when(n % 2 == 0, "cached").otherwise("ok")).otherwise("failed")
    return e.select(
        n.alias("seq"), F.col("user_id").alias("item"), (n % 3).cast("string").alias("run"), status.alias("status"), ((n % 9 == 0) & (F.col("user_id") % 4 != 1)).alias("success"), F.col("event_type").alias("source"), (1 + n % 2).alias("pass"), "at",
        F.concat(F.lit("h"), (n % 5).cast("string")).alias("host"), (n % 9).isin(1, 2, 6, 8).alias("transient"), F.concat_ws(":", F.col("user_id").cast("string"), "event_type").alias("fingerprint"),
    )


@query("stream_run_progress", "SELECT CAST(event_id % 3 AS STRING) AS run, count(*) FILTER (event_id % 9 = 0 AND event_id % 2 = 1) AS ok, count(*) FILTER (event_id % 9 = 0 AND event_id % 2 = 0) AS cached, count(*) FILTER (event_id % 9 <> 0) AS failed, count(*) AS done FROM events GROUP BY 1")
def _(t: Tables) -> DataFrame:
    return jobs.run_available(jobs.run_progress(_event_rows(t)), "complete")


@query("stream_superseded", f"SELECT * FROM (WITH {_BEST} SELECT item, success, pass FROM b)", "attempts")
def _(t: Tables) -> DataFrame:
    return jobs.run_available(jobs.superseded(_event_rows(t)), "update", ["item"]).select("item", "success", "pass")


@query("stream_failure_rate", """SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start_s, 'h' || (event_id % 5) AS host, count(*) AS attempts, count(*) FILTER (event_id % 9 IN (1, 2, 6, 8)) AS failures
    FROM events WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR GROUP BY 1, 2""")  # fmt: skip
def _(t: Tables) -> DataFrame:
    rows = jobs.run_available(jobs.failure_rate(_event_rows(t)), "append")
    return rows.select(F.unix_timestamp("start").alias("start_s"), "host", "attempts", "failures")


@query("stream_once", "SELECT DISTINCT user_id || ':' || event_type AS fingerprint FROM events")
def _(t: Tables) -> DataFrame:
    return jobs.run_available(jobs.once(_event_rows(t), "40 days"), "append").select("fingerprint")


@query("stream_worklist", """SELECT i.doi, CASE WHEN s.version = 2 AND s.decision IN ('incluir', 'excluir') THEN s.decision ELSE 'pendente' END AS situation FROM search_items i LEFT JOIN screening s ON s.doi = i.doi WHERE found AND status IN ('done', 'partial')""", "search_items", "screening")
def _(t: Tables) -> DataFrame:
    schema = t.given("documents").schema
    docs = t.spark.readStream.schema(schema).parquet(f"{t.sf_dir}/document[s].parquet")
    d = F.col("doc_id")
    rows = docs.select(F.concat(F.lit("10.5555/d"), d.cast("string")).alias("doi"), (d % 7 != 3).alias("found"), F.when(d % 10 == 0, "waiting").when(d % 10 == 1, "error").when(d % 10 == 2, "partial").otherwise("done").alias("status"))
    return jobs.run_available(jobs.live_worklist(rows, t.screening, CURRENT), "append").select("doi", "situation")


@query("stream_cooldowns", f"SELECT replace(host, '.example.org', '') AS host, seq, streak, seconds FROM (WITH {_COOL} {_COOLED} AND ts <= (SELECT max(ts) FROM attempts) - INTERVAL 1 HOUR)".replace("asked > 0 OR streak >= 4", "(asked > 0 OR streak >= 4)"), "attempts")
def _(t: Tables) -> DataFrame:
    rows = _event_rows(t).withColumn("retry_after", F.when(F.col("seq") % 7 == 3, F.col("seq") % 200))
    return jobs.run_cooldowns(rows)


@query("expired_leases_batch", "SELECT user_id AS item, count(*) AS n FROM events WHERE event_id % 4 = 1 AND ts < TIMESTAMP '2024-01-10 00:00:00' - INTERVAL 180 SECOND GROUP BY 1")
def _(t: Tables) -> DataFrame:
    rows = t.given("events").select("user_id", F.when(F.col("event_id") % 4 == 1, "running").otherwise("done").alias("status"), F.col("ts").alias("updated"))
    return jobs.claimable(rows, F.lit("2024-01-10 00:00:00").cast("timestamp_ntz")).groupBy(F.col("user_id").alias("item")).agg(F.count("*").alias("n"))
