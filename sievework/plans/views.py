"""The engine's tables as projections of the given ones.

Each is one SELECT that Spark and DuckDB both understand, so that a job and its SQL start from the same rows.
The given tables have no titles: the beginning of a text, which a title is, stands for one beside the whole text.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession

VIEWS: dict[str, str] = {
    "search_items": """SELECT doc_id, concat('10.5555/d', CAST(doc_id AS STRING)) AS doi,
        CASE doc_id % 10 WHEN 0 THEN 'waiting' WHEN 1 THEN 'error' WHEN 2 THEN 'partial' ELSE 'done' END AS status, (doc_id % 7 <> 3) AS found,
        substr(text, 1, 80) AS title, source AS authors, CAST(2000 + doc_id % 25 AS STRING) AS year, lang AS journal,
        CASE WHEN n_chars < 200 THEN '' ELSE text END AS abstract,
        CASE WHEN doc_id % 13 = 5 THEN 'download failed' ELSE '' END AS error, text FROM documents""",
    "articles": """SELECT doc_id AS id, CASE WHEN doc_id % 2 = 0 THEN concat('10.5555/D', CAST(doc_id AS STRING)) ELSE concat('10.5555/d', CAST(doc_id AS STRING)) END AS doi,
        CASE WHEN doc_id % 5 = 0 THEN 1 ELSE 2 END AS triage_version, CASE WHEN doc_id % 4 = 0 THEN 'excluir' ELSE 'incluir' END AS triage_decision,
        'doi' AS source_kind, substr(text, 1, 80) AS title, concat('file ', CAST(doc_id AS STRING), '.pdf') AS filename FROM documents WHERE doc_id % 3 = 0
        UNION ALL SELECT doc_id AS id, CAST(NULL AS STRING) AS doi, 2 AS triage_version, CASE WHEN doc_id % 4 = 0 THEN 'excluir' ELSE 'incluir' END AS triage_decision,
        'local' AS source_kind, substr(text, 1, 80) AS title, concat('local-', CAST(doc_id AS STRING), '.pdf') AS filename FROM documents WHERE doc_id % 50 = 7 AND doc_id % 3 <> 0""",
    "screening": """SELECT concat('10.5555/d', CAST(doc_id AS STRING)) AS doi, CASE WHEN quality = 1 THEN 'incluir' ELSE 'excluir' END AS decision,
        CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 2 END AS version, CASE WHEN quality = 0 THEN 'low quality' ELSE '' END AS reason, doc_id FROM labels""",
    "answers": """SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'Indeterminado' WHEN quality = 1 THEN 'Sim' ELSE 'Não' END AS a1,
        CASE WHEN toxic = 1 THEN 'Não' ELSE 'Sim' END AS a2, CASE WHEN doc_id % 10 = 3 THEN '' ELSE 'stated' END AS reason FROM labels""",
    "opinions": """SELECT doc_id AS article, 'r1' AS slot, doc_id * 3 AS seq, concat('rev', CAST(doc_id % 5 AS STRING)) AS reviewer,
        CASE WHEN doc_id % 11 = 0 THEN 'duvida' WHEN quality = 1 THEN 'incluir' ELSE 'excluir' END AS decision, 'first' AS reason, CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 2 END AS version FROM labels
        UNION ALL SELECT doc_id AS article, 'r2' AS slot, doc_id * 3 + 1 AS seq, CASE WHEN doc_id % 13 = 0 THEN concat('REV', CAST(doc_id % 5 AS STRING)) ELSE concat('rev', CAST((doc_id + 1) % 5 AS STRING)) END AS reviewer,
        CASE WHEN doc_id % 17 = 0 THEN 'duvida' WHEN toxic = 1 THEN 'excluir' ELSE 'incluir' END AS decision, 'second' AS reason, CASE WHEN doc_id % 6 = 0 THEN 1 ELSE 2 END AS version FROM labels
        UNION ALL SELECT doc_id AS article, 'adjudication' AS slot, doc_id * 3 + 2 AS seq, 'judge' AS reviewer, CASE WHEN doc_id % 8 = 1 THEN 'excluir' ELSE 'incluir' END AS decision,
        CASE WHEN doc_id % 3 = 0 THEN '' ELSE 'third' END AS reason, 2 AS version FROM labels WHERE doc_id % 4 = 1""",
    "documents_ready": "SELECT doc_id AS article, n_chars AS size, CASE WHEN doc_id % 10 < 3 THEN 'p1' WHEN doc_id % 10 < 9 THEN 'p2' ELSE 'p3' END AS project FROM documents WHERE doc_id % 4 <> 1",
    "finals": "SELECT doc_id AS article, CASE WHEN doc_id % 7 = 0 THEN 'excluir' ELSE 'incluir' END AS final_decision, CASE WHEN doc_id % 9 = 0 THEN 1 ELSE 2 END AS final_version FROM labels WHERE doc_id % 5 <> 4",
    "analyses": """SELECT user_id AS article, 'triagem' AS stage, event_type AS provider, CASE WHEN event_id % 3 = 0 THEN '' ELSE concat('m', CAST(event_id % 3 AS STRING)) END AS model,
        CASE WHEN value >= 35 THEN 'incluir' ELSE 'excluir' END AS decision, (event_id % 8 <> 0 OR user_id % 3 = 0) AS current, event_id AS seq, 'pk' AS package, concat('t', CAST(event_id % 11 AS STRING)) AS title,
        CAST(event_id % 4 AS STRING) AS run FROM events""",
    "attempts": """SELECT event_id AS seq, user_id AS item, concat('10.5555/d', CAST(user_id AS STRING)) AS doi, event_type AS source, value * 10 AS ms, 1 + event_id % 2 AS pass, (event_id % 9 = 0 AND user_id % 4 <> 1) AS success,
        CASE event_id % 9 WHEN 0 THEN CASE WHEN user_id % 4 = 1 THEN 'not_found' END WHEN 1 THEN 'download_http_429' WHEN 2 THEN 'download_http_503' WHEN 3 THEN 'download_http_403' WHEN 4 THEN 'not_found'
        WHEN 5 THEN 'article_identity_not_confirmed' WHEN 6 THEN 'download_timeout' WHEN 7 THEN 'download_not_a_pdf' ELSE 'download_host_cooldown' END AS code,
        concat('https://h', CAST(event_id % 5 AS STRING), '.example.org/x') AS url, ts FROM events""",
    "oa_status": "SELECT concat('10.5555/d', CAST(doc_id AS STRING)) AS doi, CASE doc_id % 4 WHEN 0 THEN 'closed' WHEN 1 THEN 'gold' WHEN 2 THEN 'green' ELSE CAST(NULL AS STRING) END AS oa_status FROM documents",
    "corpus_files": """SELECT concat('f', CAST(doc_id AS STRING)) AS file, md5(text) AS sha256, concat('10.5555/d', CAST(doc_id % 300 AS STRING)) AS expected_doi,
        CASE WHEN doc_id % 19 = 0 THEN concat('10.5555/x', CAST(doc_id AS STRING)) ELSE concat('10.5555/d', CAST(doc_id % 300 AS STRING)) END AS detected_doi,
        (doc_id % 23 <> 0) AS validated, (doc_id % 29 <> 0) AS recorded, 'mismatch' AS reason, CASE WHEN doc_id % 3 = 0 THEN 'doi_in_pdf' ELSE 'doi_in_record' END AS method FROM documents""",
    "authorised_ids": "SELECT concat('10.5555/d', CAST(item_id AS STRING)) AS doi FROM benchmark",
    "typed_documents": """SELECT doc_id, concat(CASE doc_id % 8 WHEN 0 THEN 'Systematic review: ' WHEN 1 THEN 'Study protocol for a review of ' WHEN 2 THEN 'Editorial: ' WHEN 3 THEN 'Case report: '
        WHEN 4 THEN 'Supplementary Table ' WHEN 5 THEN 'Author index ' WHEN 6 THEN 'Preprint ' ELSE '' END, substr(text, 1, 60)) AS title,
        concat(CASE doc_id % 8 WHEN 4 THEN 'Supplementary Table 1' WHEN 5 THEN 'Author index' ELSE '' END, chr(10), text) AS text,
        CASE WHEN doc_id % 31 = 0 THEN 'ERROR' ELSE 'HIGH' END AS text_quality, CASE WHEN doc_id % 12 = 0 THEN 'include' END AS human_decision, CAST(NULL AS STRING) AS human_type FROM documents""",
    "title_pages": """SELECT page_id, regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1) AS title FROM pages""",
    "source_records": """SELECT concat('10.5555/d', CAST(doc_id AS STRING)) AS doi, s AS source, CASE WHEN (doc_id + n) % 3 = 0 THEN '' ELSE concat('title ', CAST(n AS STRING), ' ', lang) END AS title,
        CASE WHEN (doc_id + n) % 3 = 1 THEN '' ELSE concat('author ', CAST(n AS STRING)) END AS authors, CASE WHEN (doc_id + n) % 3 = 2 THEN '' ELSE CAST(2000 + n AS STRING) END AS year,
        CASE WHEN n = 0 THEN '' ELSE concat('journal ', CAST(n AS STRING)) END AS journal, CASE WHEN (doc_id + n) % 5 = 0 THEN '' ELSE concat(text, repeat('.', CAST((doc_id + 3 * n) % 4 AS INTEGER))) END AS abstract
        FROM documents CROSS JOIN (SELECT 0 AS n, 'crossref' AS s UNION ALL SELECT 1, 'europepmc' UNION ALL SELECT 2, 'semanticscholar' UNION ALL SELECT 3, 'openalex') q""",
    "stored_texts": """SELECT concat(CASE WHEN doc_id % 10 = 9 THEN 'other' ELSE 'p1' END, '/', CAST(doc_id AS STRING)) AS key, 'p1' AS project, concat('10.5555/d', CAST(doc_id AS STRING)) AS doi, n_chars AS bytes FROM documents WHERE doc_id % 2 = 0""",
    "landing": """SELECT page_id, url, concat('10.5555/page', CAST(page_id AS STRING)) AS doi, concat(CASE page_id % 4
        WHEN 0 THEN concat('<meta name="citation_doi" content="10.5555/page', CAST(page_id AS STRING), '"><meta name="citation_pdf_url" content="https://files.example.org/page', CAST(page_id AS STRING), '.pdf">')
        WHEN 1 THEN concat('<meta name="citation_doi" content="doi:10.5555/q', CAST(page_id AS STRING), '"><a href="https://files.example.org/catalog.pdf">x</a>')
        WHEN 2 THEN concat('<a href="https://files.example.org/page', CAST(page_id AS STRING), 'xyz.pdf">f</a><a href="https://files.example.org/a_MOESM1_ESM.pdf">s</a>')
        ELSE '' END, html) AS html FROM pages""",
    "verdict_log": """SELECT event_id AS seq, concat('a', CAST(user_id AS STRING)) AS article_id, CASE WHEN event_id % 6 = 1 THEN 'FAILED' ELSE 'COMPLETED' END AS status,
        CASE event_id % 4 WHEN 0 THEN 'INCLUIDO' WHEN 1 THEN 'EXCLUIDO' WHEN 2 THEN 'EXCLUIDO' ELSE 'REVISÃO MANUAL' END AS decision,
        CASE event_id % 5 WHEN 0 THEN '-' WHEN 1 THEN CAST(NULL AS STRING) WHEN 2 THEN 'population' ELSE 'context' END AS exclusion_code,
        CASE WHEN event_id % 6 = 1 THEN 'sem_texto' END AS failure_reason FROM events""",
    "searched": """SELECT CASE doc_id % 3 WHEN 0 THEN 'openalex' WHEN 1 THEN 'pubmed' ELSE 'core' END AS base,
        CASE WHEN doc_id % 12 = 5 THEN CAST(NULL AS STRING) ELSE concat('https://doi.org/10.5555/D', CAST(doc_id % 400 AS STRING)) END AS raw, substr(text, 1, 40) AS title, doc_id FROM documents""",
}
TABLES = ("documents", "labels", "events", "benchmark", "pages", "orders", "customer", "embeddings", "conversations")


class Tables:
    """The projections over one folder of tables, each made when asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def given(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in VIEWS:
            raise AttributeError(name)
        sql = VIEWS[name]
        used = [t for t in TABLES if f"FROM {t}" in sql]
        for t in used:
            sql = sql.replace(f"FROM {t}", "FROM {" + t + "}")
        return self.spark.sql(sql, **{t: self.given(t) for t in used})


def with_views(body: str, *names: str) -> str:
    """SQL for DuckDB: the body with the named projections before it."""
    return "WITH " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names) + "\n" + body
