"""Single rules on a few rows each."""

import json

import pytest
from pyspark.sql import functions as F

from sievework.functions import ids, similarity, text
from sievework.operators import documents, identity, ledger, linkage, prisma, records, retrieval, review, screening
from sievework.plans import queries
from sievework.plans.views import Tables
from sievework.sources import lists, pages, payloads, sinks
from sievework.streaming import jobs


def values(spark, expression, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(expression).collect()]


def test_canonical_id(spark):
    given = ["https://doi.org/10.1000/ABC.", "doi: 10.1000/x#sec2", "10.1002/9780.ch3", "10.1000%2Fy", "10.1000/a+b", "nothing", None, ""]
    assert values(spark, ids.canonical_id(F.col("x")), [(g,) for g in given]) == ["10.1000/abc", "10.1000/x", "10.1002/9780", "10.1000/y", "10.1000/a+b", None, None, None]
    assert values(spark, ids.canonical_id(F.col("x"), strip_chapter=False), [("10.1002/9780.ch3",)]) == ["10.1002/9780.ch3"]


def test_year_and_host(spark):
    assert values(spark, ids.first_year(F.col("x")), [("in 2019 and 1999",), ("no",)]) == [2019, None]
    assert values(spark, ids.host(F.col("x")), [("https://A.example.org:80/x",)]) == ["a.example.org"]
    got = spark.createDataFrame([("2010", "2011"), ("2010", "2012"), (None, "2012"), ("x", "y")], "a string, b string").coalesce(1)
    assert [tuple(r) for r in got.select(ids.years_close(F.col("a"), F.col("b")), ids.year_score(F.col("a"), F.col("b"))).collect()] == [(True, 0.5), (False, 0.0), (False, 0.0), (False, 0.0)]


@pytest.mark.parametrize(
    ("a", "b", "score"),
    [
        ("Upside-down protein crystallization", "Upside Down Protein Crystallization", 1.0),
        ("", "x", 0.0),
    ],
)
def test_dice(spark, a, b, score):
    assert round(values(spark, similarity.dice_title_score(F.col("a"), F.col("b")), [(a, b)], "a string, b string")[0], 3) == score


def test_title_score(spark):
    rows = [("A study of cats", "a study of CATS!"), ("A study of cats", "Unrelated matter"), (None, "x")]
    got = values(spark, similarity.title_score(F.col("a"), F.col("b")), rows, "a string, b string")
    assert got[0] == 1.0 and got[1] < 0.35 and got[2] == 0.0


def test_clean_abstract(spark):
    given = ["<p>Abstract: A long enough abstract text &amp; more.</p>", "short", "Not available", None]
    assert values(spark, text.clean_abstract(F.col("x")), [(g,) for g in given]) == ["A long enough abstract text & more.", "", "", ""]


def test_csv_guard(spark):
    assert values(spark, text.csv_safe(F.col("x")), [("=1",), ("a=1",), ("@x",), ("",)]) == ["'=1", "a=1", "'@x", ""]


def test_triage_rules(spark):
    rows = [(1, ["Sim", "Não"], ""), (2, ["Sim", "Não"], "why"), (3, ["Sim"], "x"), (4, ["Sim", "Talvez"], "x"), (5, ["Sim", "Indeterminado"], ""), (6, None, "x")]
    df = spark.createDataFrame(rows, "id int, answers array<string>, reason string")
    got = {r.id: (r.decision, r.reject) for r in screening.decide(df, [], 2).collect()}
    assert got[1] == (None, "give a reason for the exclusion") and got[2] == ("excluir", None) and got[5] == ("incluir", None)
    assert all(got[i][1] == "answer every question" for i in (3, 4, 6))


def test_screening_flow_partitions(spark):
    items = spark.createDataFrame([("10.1/a", "done", True), ("10.1/b", "partial", True), ("10.1/c", "done", True), ("10.1/d", "waiting", True), ("10.1/e", "done", False)], "doi string, status string, found boolean")
    marks = spark.createDataFrame([("10.1/a", "incluir", 2), ("10.1/b", "excluir", 1)], "doi string, decision string, version int")
    corpus = spark.createDataFrame([(1, "10.1/A", 2, "excluir", "doi"), (2, "10.1/z", 2, "incluir", "doi"), (3, None, 2, "incluir", "local")], "id int, doi string, triage_version int, triage_decision string, source_kind string")
    row = prisma.screening_flow(items, marks, corpus, 2).collect()[0]
    assert row.identificados == row.triados + row.pendentes_triagem == 4
    assert row.triados == row.incluidos_triagem + row.excluidos_triagem == 2
    assert row.incluidos_triagem == row.obtidos + row.nao_obtidos and row.locais == 1


def test_worklist_pages(spark):
    rows = spark.range(120).select(F.format_string("%03d", "id").alias("doi"))
    assert screening.worklist_page(rows, "doi", 3).count() == 20
    assert [r.doi for r in screening.worklist_page(rows, "doi", 99).orderBy("doi").collect()][0] == "100"


def test_two_doubts_are_a_conflict(spark):
    rows = [(1, s, i, f"p{i}", "duvida", "r", 2) for i, s in enumerate(("r1", "r2"))] + [(2, s, i, "same", "incluir", "r", 2) for i, s in enumerate(("r1", "r2"))]
    df = spark.createDataFrame(rows, "article int, slot string, seq int, reviewer string, decision string, reason string, version int")
    assert {r.article: r.status for r in review.resolution(review.by_slot(df), 2).collect()} == {1: "conflito", 2: "revisores repetidos"}


def test_document_types(spark):
    rows = [("Study protocol for a review of x", "systematic review"), ("A systematic review", ""), ("X", "abstract and methods"), ("X", "")]
    df = spark.createDataFrame(rows, "title string, text string").coalesce(1)
    assert [(r.type, r.confidence) for r in documents.classify(df).collect()] == [("study_protocol", "high"), ("systematic_review", "high"), ("original_article", "moderate"), ("other", "low")]


def test_record_kind(spark):
    rows = [(None, None, "S267", "x"), (None, None, "S10-S20", "x"), (None, None, "S104–S176", "x"), ("dataset", None, None, "x"), (None, "editorial", None, "x"), (None, None, None, "Editorial: a"), (None, None, None, "Editorial board decisions")]
    df = spark.createDataFrame(rows, "cr string, oa string, page string, title string").coalesce(1)
    none = F.lit(None).cast("string")
    assert [r[0] for r in df.select(documents.record_kind(F.col("cr"), F.col("oa"), none, F.col("page"), F.col("title"))).collect()] == ["abstract", None, "abstract", "dataset", "editorial", "editorial", None]


def test_article_gate(spark):
    long = "words " * 100
    given = ["Supplementary Table 1\n" + long, long + "\n" * 30 + "supplementary table 2", "short", long + "table of contents"]
    assert values(spark, documents.article_gate(F.col("x")), [(g,) for g in given]) == ["supplement", None, "unreadable", None]


def test_labelled_abstract(spark):
    body = "This study looks at something in detail and reports what was found in it. " * 3
    row = documents.abstracts(spark.createDataFrame([("Title\nAbstract\n" + body + "\nKeywords: a\nIntroduction\nmore",), (None,), ("",)], "text string").coalesce(1)).collect()
    assert row[0].abstract_rule == "labelled" and row[0].abstract.startswith("This study") and row[1].abstract == "" and row[2].abstract_rule == "none"


FILE = "doi string, title string, author string, journal string, year string, detected_doi string, detected_title string, detected_author string, detected_journal string, detected_year string, text_sample string, record_matched boolean"


def test_file_identity(spark):
    base = ("10.1000/a", "A long enough title of a work", "Ana Silva", "Journal of X", "2010")
    rows = [
        (*base, "10.1000/A", None, None, None, None, "", False),
        (*base, "10.1000/other", base[1], "Ana Silva", None, "2010", "", True),
        (*base, None, None, None, None, None, "Supplementary material of it", True),
        (*base, None, None, None, None, None, "", True),
        (*base, None, "Something else altogether here", "B Other", None, "1990", "text of another work " * 20, True),
        (*base, None, base[1], "A Silva", None, None, "", False),
        (*base, None, base[1], None, None, None, "", False),
    ]
    got = identity.file_verdicts(spark.createDataFrame(rows, FILE).coalesce(1)).collect()
    assert [(r.validated, r.method, r.reason) for r in got] == [
        (True, "doi_in_pdf", None), (False, "doi_in_pdf", "doi_mismatch"), (False, "supplementary_material", "supplementary_material"), (True, "doi_in_record", None),
        (False, "doi_in_record", "pdf_title_contradicts_record"), (True, "title_author_year", None), (False, "article_identity_not_confirmed", "article_identity_not_confirmed"),
    ]


def test_blocking_loses_no_pair(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta".split()
    titles = [" ".join(words[i : i + 4]) for i in range(5)] + ["alpha", "Beta & gamma", "", None]
    asked = spark.createDataFrame(list(enumerate(titles)), "request int, title string")
    hits = spark.createDataFrame(list(enumerate(titles)), "hit int, hit_title string")
    every = asked.crossJoin(hits).withColumn("s", similarity.title_score(F.col("title"), F.col("hit_title"))).filter("s >= 0.72")
    assert {(r.request, r.hit) for r in every.collect()} == {(r.request, r.hit) for r in linkage.match_titles(asked, hits, 0.72, 100).collect()}


def test_recovery_ranks_all_records_of_a_shared_title(spark, tmp_path):
    # More than 50 equal titles of the smallest ids have one source and the wrong year; the right ones come after them.
    ids = [*range(3, 363, 6), 501, 505, 541]
    html = "<h1>alpha beta gamma delta epsilon</h1>"
    spark.createDataFrame([(i, "u", html) for i in ids], "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    tables = Tables(spark, str(tmp_path))
    every = linkage.scored_pairs(*queries._titles(tables), 0.5)
    assert every.count() == sum(i % 3 == 0 for i in ids) * len(ids)
    rows = queries.queries()["title_recovery_ranking"](spark, str(tmp_path)).collect()
    assert sorted(r.request for r in rows) == [i for i in ids if i % 3 == 0]
    # Brute force: key p{i % 40}, year 2000 + i % 3 of 2001 asked, a source for each i % 3.
    by = {}
    for i in ids:
        by.setdefault(f"doi:10.5555/p{i % 40}", set()).add(i % 3)
    right = {k for k, v in by.items() if 1 in v}
    assert right and all(r.key == min(right) and r.rank_score == 1.0 and r.accepted for r in rows)
    strict = queries.queries()["title_recovery_strict"](spark, str(tmp_path)).collect()
    assert sorted((r.request, r.key, r.rank_score) for r in strict) == sorted((r.request, r.key, r.rank_score) for r in rows)


def test_batches_are_accepted_whole_or_not_at_all(spark):
    chosen = [("a", "1"), ("a", "2"), ("a", "2"), ("b", "3"), ("b", "4"), ("c", "1"), ("c", "2"), ("c", "5"), ("d", "6"), ("e", "7"), ("f", "8"), (None, "5")]
    work = [("1", "pendente", "incluir", True), ("2", "pendente", "excluir", True), ("3", "pendente", "incluir", True), ("4", "incluir", "incluir", True), ("5", "pendente", "incluir", True), ("6", "pendente", None, True), ("7", "pendente", "incluir", False)]
    good, bad = screening.accept_batches(spark.createDataFrame(chosen, "batch string, doi string"), spark.createDataFrame(work, "doi string, situation string, suggested string, current boolean"), most=2)
    assert sorted((str(r.batch), r.doi, r.decision) for r in good.collect()) == [("None", "5", "incluir"), ("a", "1", "incluir"), ("a", "2", "excluir")]
    assert {(r.batch, r.doi, r.why) for r in bad.collect()} == {("b", "4", "already decided"), ("c", None, "too many records"), ("d", "6", "no suggestion"), ("e", "7", "suggestion out of date"), ("f", "8", "unknown record")}


def test_progressive_variants(spark):
    df = spark.createDataFrame([(1, 0, 0.5), (1, 1, 0.95), (1, 1, 0.2), (1, 2, 0.99)], "request int, pos int, score double")
    assert sorted((r.pos, r.score) for r in linkage.progressive(df).collect()) == [(0, 0.5), (1, 0.2), (1, 0.95)]


def test_upsert_keeps_the_other_half(spark):
    columns = "doi string, decision string, reason string, actor string, version int, source string, ai_provider string, ai_decision string, ai_version int"
    old = spark.createDataFrame([("a", None, None, None, None, None, "p", "incluir", 1)], columns)
    new = spark.createDataFrame([("a", "excluir", "r", "x", 2, "")], "doi string, decision string, reason string, actor string, version int, source string")
    once = ledger.upsert_decisions(old, new)
    assert once.collect() == ledger.upsert_decisions(once, new).collect()
    assert (once.collect()[0].decision, once.collect()[0].ai_decision) == ("excluir", "incluir")


def test_names_do_not_collide(spark):
    df = spark.createDataFrame([(f"10.1/{i}", "Silva, A", "2010", "Journal of Things", "Same title") for i in range(5)] + [("10.1/x", None, None, None, None)], "doi string, authors string, year string, journal string, title string")
    first = ledger.output_names(df)
    assert first.select("name").distinct().count() == 6
    assert sorted(ledger.output_names(df, first).collect()) == sorted(first.collect())


def test_id_list(spark):
    given = ["﻿# header", "10.1000/A", "arXiv:2101.00001v2", "PMID: 12345", "A plain title", "-----", ""]
    cross = spark.createDataFrame([("12345", "10.5000/q")], "id string, doi string")
    got = lists.id_lines(spark.createDataFrame([(g,) for g in given], "value string"), cross).collect()
    assert sorted((r.kind, r.key) for r in got) == [("doi", "10.1000/a"), ("doi", "10.48550/arxiv.2101.00001"), ("doi", "10.5000/q"), ("title", "A plain title")]


def test_batch_report(spark):
    df = spark.createDataFrame([(1, "10.1000/a\nbad\n\ndoi:10.1000/A\nhttps://doi.org/10.1000/b"), (2, "")], "batch_id int, text string")
    got = {r.batch_id: r for r in lists.batch_report(df).collect()}
    assert got[1].dois == ["10.1000/a", "10.1000/b"] and got[1].invalid == [2] and got[1].duplicates == 1 and got[1].line_count == 4 and got[2].dois == []


def test_malformed_payloads(spark):
    for provider in payloads.PROVIDERS:
        df = spark.createDataFrame([("not json",), ("{}",), (None,)], "payload string")
        assert {c for c, _ in payloads.source_records(df, provider).dtypes} == {"source", *payloads.RECORD}
        payloads.source_records(df, provider).collect()


def test_inverted_abstract(spark):
    df = spark.createDataFrame([({"b": [1, 3], "a": [0], "c": [2]},)], "m map<string,array<int>>")
    assert df.select(payloads.inverted_abstract(F.col("m"))).collect()[0][0] == "a b c b"


def test_links(spark):
    html = '<meta name="citation_pdf_url" content="/files/xyz9.pdf"><a href="/catalog.pdf">c</a><a href="xyz9_MOESM1_ESM.pdf">s</a><a href="/get/xyz9.pdf?x=1">p</a>'
    df = spark.createDataFrame([(1, "https://a.org/art/1", "10.1/xyz9", html), (2, "https://a.org/b", "10.1/q", None)], "page_id int, url string, doi string, html string")
    assert [(r.url, r.rank) for r in pages.file_links(df).orderBy("n").collect()] == [("https://a.org/files/xyz9.pdf", 0), ("https://a.org/get/xyz9.pdf?x=1", 4)]


def test_bundle_round_trip(spark, tmp_path):
    tables = {"a": spark.range(5).withColumn("x", F.lit("y")), "b": spark.range(0)}
    sinks.export_bundle(tables, str(tmp_path / "b"))
    back, broken = sinks.restore_bundle(spark, str(tmp_path / "b"), ["a", "b"])
    assert broken.count() == 0 and back["a"].count() == 5


def test_csv_and_bibliography(spark, tmp_path):
    df = spark.createDataFrame([("10.1/a", "T{x}", "A", "J", "2010", True), ("10.1/a", "T{x}", "A", "J", "2010", True), ("10.1/b", "U", "B", "K", "2011", False)], "doi string, title string, authors string, journal string, year string, identity_validated boolean")
    sinks.write_csv(df, str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("sep", ";").csv(str(tmp_path / "csv")).count() == 3
    sinks.write_bibtex(df, str(tmp_path / "bib"))
    sinks.write_bibtex(df, str(tmp_path / "bib"), df.select("doi").distinct())
    assert sum(r.value.startswith("@article") for r in spark.read.text(str(tmp_path / "bib")).collect()) == 1


def test_article_xml(spark, tmp_path):
    from sievework.sources import corpus

    (tmp_path / "x").mkdir()
    body = "".join(f"<p>{'word ' * 120}</p>" for _ in range(4))
    (tmp_path / "x" / "a.xml").write_text(f"<article><front><article-title>T &amp; U</article-title><surname>Silva</surname><abstract><p>Sum</p></abstract></front><body>{body}</body></article>")
    (tmp_path / "x" / "short.xml").write_text("<article><body><p>few</p></body></article>")
    (tmp_path / "x" / "bad.xml").write_text("<article>")
    rows = corpus.read_fulltext_xml(spark, str(tmp_path / "x")).collect()
    assert [(r.title, r.authors, r.abstract, len(r.paragraphs)) for r in rows] == [("T & U", ["Silva"], "Sum", 4)]
    assert sorted((r.path.rsplit("/", 1)[1], r.problem) for r in corpus.fulltext_problems(spark, str(tmp_path / "x")).collect()) == [("bad.xml", "not XML"), ("short.xml", "short body")]


def test_pubmed_xml(spark, tmp_path):
    one = lambda pmid, year, doi: f'<PubmedArticle><MedlineCitation><PMID Version="1">{pmid}</PMID><Article><Journal><JournalIssue><PubDate>{year}</PubDate></JournalIssue><Title>J</Title></Journal><ArticleTitle>A title</ArticleTitle></Article></MedlineCitation><PubmedData><ArticleIdList><ArticleId IdType="pubmed">{pmid}</ArticleId><ArticleId IdType="doi">{doi}</ArticleId></ArticleIdList></PubmedData></PubmedArticle>'
    (tmp_path / "p.xml").write_text("<PubmedArticleSet>" + one(1, "<Year>2010</Year>", "10.1000/A") + one(2, "<MedlineDate>2011 Jan-Feb</MedlineDate>", "x") + "</PubmedArticleSet>")
    rows = sorted(payloads.read_pubmed_xml(spark, str(tmp_path / "p.xml")).collect())
    assert [(r.pmid, r.year, r.doi, r.journal) for r in rows] == [("1", "2010", "10.1000/a", "J"), ("2", "2011", None, "J")]


def test_corpus_folders_and_logs(spark, tmp_path):
    from sievework.sources import corpus

    for name, text in (("a", "long text"), ("b", None)):
        folder = tmp_path / "c" / name
        folder.mkdir(parents=True)
        (folder / "metadata.json").write_text('{\n"article_id": "%s", "text_quality": "HIGH"\n}' % name)
        if text:
            (folder / "content.md").write_text(text)
    assert sorted((r.article_id, r.text) for r in corpus.read_corpus_text(spark, str(tmp_path / "c")).collect()) == [("a", "long text"), ("b", None)]
    files = tmp_path / "f"
    files.mkdir()
    for name, record in (("x.pdf", '{"identity_validated": true, "expected": {"doi": "10.1/x"}}'), ("y.pdf", "{not json"), ("z.pdf", None)):
        (files / name).write_bytes(b"%PDF")
        if record:
            (files / (name + ".identity.json")).write_text(record)
    assert {r.file: r.record for r in corpus.read_identity_records(spark, str(files)).collect()} == {"x.pdf": "read", "y.pdf": "unreadable", "z.pdf": "missing"}
    (tmp_path / "log.tsv").write_text("2024-01-01T00:00:00\t10.1/x\tok\tcore\tx.pdf\n2024-01-01T00:00:01\t10.1/y\tfailed\t-\t-\n")
    assert [r.source for r in corpus.read_attempt_log(spark, str(tmp_path / "log.tsv")).orderBy("at").collect()] == ["core", None]


def test_expired_leases(spark, tmp_path):

    for n, rows in enumerate((['{"doi":"a","status":"running","at":"2024-01-01T00:00:00Z"}', '{"doi":"b","status":"running","at":"2024-01-01T00:00:00Z"}', '{"doi":"b","status":"done","at":"2024-01-01T00:01:00Z"}'], ['{"doi":"c","status":"done","at":"2024-01-01T02:00:00Z"}'], ['{"doi":"c","status":"done","at":"2024-01-01T03:00:00Z"}'])):
        (tmp_path / f"{n}.json").write_text("\n".join(rows))
    stream = spark.readStream.schema("doi string, status string, at timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "*.json"))
    assert [r.doi for r in jobs.run_available(jobs.expired_leases(stream), conf=jobs.TIMERS).collect()] == ["a"]


def test_leases_out_of_order(spark, tmp_path):
    """An older row that comes in a later micro-batch neither takes nor gives a lease."""
    at = "2024-01-01T00:{}Z".format
    files = [[("a", "running", at("00:30")), ("b", "done", at("00:50")), ("c", "running", at("00:10"))], [("a", "done", at("00:00")), ("b", "running", at("00:40")), ("c", "done", at("00:20"))], [("z", "done", at("30:00"))], [("z", "done", at("59:00"))]]
    for n, rows in enumerate(files):
        (tmp_path / f"{n}.json").write_text("\n".join(json.dumps(dict(zip(("doi", "status", "at"), r))) for r in rows))
    stream = spark.readStream.schema("doi string, status string, at timestamp").option("maxFilesPerTrigger", 1).option("latestFirst", False).json(str(tmp_path / "*.json"))
    got = jobs.run_available(jobs.expired_leases(stream, delay="2 minutes"), conf=jobs.TIMERS).collect()
    assert [(r.doi, r.since.minute, r.since.second) for r in got] == [("a", 0, 30)]


def test_title_ascii_folds_marks_and_ligatures(spark):
    from pyspark.sql import functions as F

    from sievework.functions import text

    df = spark.createDataFrame([("re\u0301sume\u0301 of \ufb01ne",), ("R\u00e9sum\u00e9 of fine",), (None,)], "t string")
    assert [r.a for r in df.select(text.title_ascii(F.col("t")).alias("a")).collect()] == ["resume of fine", "resume of fine", None]


PROSE = "We looked at many sites over several years and found that most of them changed. The change was slow at first and fast later. "


def abstract_of(spark, *texts):
    rows = documents.abstracts(spark.createDataFrame(list(enumerate(texts)), "i int, text string")).orderBy("i").collect()
    return [(r.abstract_rule, r.abstract) for r in rows]


def test_abstract_rules(spark):
    structured = "Title\nBackground: " + PROSE + "\nMethods: we counted.\nResults: it grew.\nKeywords: a"
    editorial = "Title\nReceived 1 May 2001; accepted 3 June 2001\n" + PROSE * 2 + "\nDOI: 10.1/x\nmore"
    keyword = "Title of it\nAna Silva and Bo Li\nDepartment of Things, University of X\n12\nhttps://example.org\n" + PROSE * 3 + "\nKey words: a, b\nIntroduction\n" + PROSE
    narrative = "Title of it\n\nAna Silva1, Bo Li2\n\nAS* BL " + PROSE * 4 + "\n\nResults\n" + PROSE
    got = abstract_of(spark, structured, editorial, keyword, narrative, "Short text", "", None)
    assert [rule for rule, _ in got] == ["structured", "editorial", "pre_keyword", "narrative", "none", "none", "none"]
    assert got[0][1].startswith("Background: We looked") and got[0][1].endswith("it grew.")
    assert got[1][1] == (PROSE * 2).strip() and got[2][1] == (PROSE * 3).strip() and got[3][1] == (PROSE * 4).strip()


def test_abstract_of_a_numbered_manuscript(spark):
    words = (PROSE * 2).split()
    lines = [" ".join(words[i : i + 6]) for i in range(0, len(words), 6)]
    text = "\n".join(f"{n} {line}" for n, line in enumerate(["Abstract", *lines, "Keywords: a"], 1))
    spaced = "Title\nA B S T R A C T\n" + PROSE * 2 + "\n1. Introduction\nmore"
    own_end = "Abstract\nIntroduction: short.\n" + PROSE * 2 + "\nKeywords: a"
    got = abstract_of(spark, text, spaced, own_end)
    assert [rule for rule, _ in got] == ["labelled"] * 3
    assert got[0][1] == got[1][1] == (PROSE * 2).strip() and got[2][1] == "Introduction: short. " + (PROSE * 2).strip()


def test_broken_lines_and_labels(spark):
    given = ["an inter-\n  national well-\nor ill-known\r\n\n\n\n thing", "pré-\névio"]
    assert values(spark, text.join_broken_lines(F.col("x")), [(g,) for g in given]) == ["an international well-or ill-known\n\nthing", "préévio"]
    given = ["<b>Abstract</b>: this is what was found there", "Resumo: Não disponível, não disponível", "Abstract: not available.", "abstracted words of some length"]
    assert values(spark, text.clean_abstract(F.col("x")), [(g,) for g in given]) == ["this is what was found there", "Não disponível, não disponível", "", "abstracted words of some length"]


def test_journal_names(spark):
    given = ["Proceedings of the National Academy of Sciences", "The Lancet", "Nature medicine", "Revista Ação e Saúde", "", None]
    assert values(spark, text.initials(F.col("x")), [(g,) for g in given]) == ["PNAS", "Lancet", "NatureMedicine", "RAES", "", None]


def test_title_variants(spark):
    df = spark.createDataFrame([(1, "“On cells & tissues (a note): what  we know”"), (2, "Short"), (3, None)], "request int, title string").coalesce(1)
    assert [(r.request, r.pos, r.variant) for r in linkage.title_variants(df).collect()] == [
        (1, 0, "On cells & tissues (a note): what we know"), (1, 1, "On cells & tissues (a note)"), (1, 2, "On cells & tissues : what we know"), (1, 3, "On cells and tissues (a note): what we know"),
    ]


def test_reconciled_titles(spark):
    rows = [("Microsoft Word - draft", "A study"), ("A study of cells", "A study of cells and more"), ("A study of cells: a review", "A study of cells"), ("Something else entirely here", "Short one"), (None, "Seen"), ("Told", ""), (None, None)]
    df = spark.createDataFrame(rows, "stated string, visible string").coalesce(1)
    assert [r[0] for r in df.select(documents.reconciled_title(F.col("stated"), F.col("visible"))).collect()] == ["A study", "A study of cells and more", "A study of cells: a review", "Something else entirely here", "Seen", "Told", None]


def test_access_reasons(spark):
    issues = F.array(F.lit("Semantic Scholar: quota"), F.lit("site: bloqueio de acesso automático"), F.lit("Crossref: 500"), F.lit("Crossref: 500"))
    row = spark.range(1).select(*[c.alias(n) for c, n in zip(documents.split_issues(issues), "abc")]).first()
    assert (row.a, row.b, row.c) == (["Semantic Scholar: quota"], ["site: bloqueio de acesso automático"], ["Crossref: 500"] * 2)


def by_hand(rows):
    """Cooldowns by one loop over all rows (host, seq, success, retry_after)."""
    streak, out = {}, set()
    for host, seq, success, asked in sorted(rows, key=lambda r: r[1]):
        streak[host] = 0 if success else streak.get(host, 0) + 1
        if not success and (asked or streak[host] >= 4):
            out.add((host, seq, streak[host], min(60, int(asked)) if asked else (30, 120, 600)[min(streak[host] - 4, 2)]))
    return out


def test_cooldowns_over_stretches(spark):
    import random

    rng = random.Random(2)
    rows = [(rng.choice(["a", "a", "a", "b"]), i, rng.random() < (0.3 if i < 300 else 0.02), rng.choice([None, None, None, None, 0.0, 7.0, 900.0])) for i in range(900)] + [("c", i, False, None) for i in range(900, 940)]
    df = spark.createDataFrame(rows, "host string, seq long, success boolean, retry_after double")
    for stretch in (1, 10, 64, 5000):
        assert {tuple(r) for r in retrieval.cooldowns(df, stretch).collect()} == by_hand(rows)


def test_cooldowns_in_any_order_across_micro_batches(spark, tmp_path):
    """Rows up to the delay out of order give what the batch form gives, as far as the watermark came; later rows stay in the state only that long."""
    import random

    rng, start = random.Random(3), 1_700_000_000
    rows = [(rng.choice("ab"), i, rng.random() < 0.1, rng.choice([None, None, None, 5.0])) for i in range(400)]
    mixed = sorted(rows, key=lambda r: r[1] + rng.random() * 100)  # a second apart each, up to 100 seconds out of order
    for n in range(8):
        lines = [json.dumps({"host": h, "seq": i, "success": s, "retry_after": a, "at": start + i}) for h, i, s, a in mixed[n * 50 : n * 50 + 50]]
        (tmp_path / f"{n}.json").write_text("\n".join(lines))
    stream = spark.readStream.schema("host string, seq long, success boolean, retry_after double, at long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "*.json"))
    got = {tuple(r) for r in jobs.run_available(jobs.cooldown_stream(stream.withColumn("at", F.timestamp_seconds("at")), "120 seconds"), conf=jobs.TIMERS).collect()}
    assert got == {r for r in by_hand(rows) if r[1] <= 399 - 120} and len(got) > 20


def test_cooldowns_of_hosts_in_many_stretches_across_micro_batches(spark, tmp_path):
    """Every stretch of a host is its own work: what is left before it comes from stretches, micro-batches and rows that waited."""
    import random

    rng, start = random.Random(5), 1_700_000_000
    rows = [(rng.choice(["a", "a", "b", "c", None]), i, rng.random() < (0.1 if i % 200 < 150 else 0.0), rng.choice([None, None, None, 0.0, 5.0, 900.0])) for i in range(600)]
    rows = [(h, i, s and h != "c", a) for h, i, s, a in rows]  # c never has a success
    mixed = sorted(rows, key=lambda r: r[1] + rng.random() * 100)
    for n in range(6):
        lines = [json.dumps({"host": h, "seq": i, "success": s, "retry_after": a, "at": start + i}) for h, i, s, a in mixed[n * 100 : n * 100 + 100]]
        (tmp_path / f"{n}.json").write_text("\n".join(lines))
    stream = spark.readStream.schema("host string, seq long, success boolean, retry_after double, at long").option("maxFilesPerTrigger", 1).json(str(tmp_path / "*.json"))
    stream = stream.withColumn("at", F.timestamp_seconds("at"))
    for stretch in (7, 10_000):
        got = [tuple(r) for r in jobs.run_cooldowns(stream, "120 seconds", stretch).collect()]
        assert len(got) == len(set(got)) and set(got) == {r for r in by_hand(rows) if r[1] <= 599 - 120} and len(got) > 100


def test_cooldown_batches_can_be_replayed_and_leave_late_rows_out(spark, tmp_path):
    make = lambda *rows: spark.createDataFrame([("h", i, s, None, i) for i, s in rows], "host string, seq long, success boolean, retry_after double, at long").withColumn("at", F.timestamp_seconds("at"))
    batches = [make((0, True), (1, False), (20, False)), make((2, False), (3, False), (30, False)), make((4, False), (21, False), (60, False)), make().filter("seq IS NULL")]
    find = jobs.cooldown_batches(str(tmp_path), "10 seconds", 2)
    got = [[tuple(r) for r in find(batches[n], n).collect()] for n in (0, 1, 1, 2, 2, 3)]
    # 2, 3 and 4 come after the watermark has passed 10, then 20; so 1, 20, 21 and 30 are the streak
    assert got == [[], [], [], [("h", 30, 4, 30)], [("h", 30, 4, 30)], []]


def test_an_outcome_that_is_not_known_is_no_failure(spark):
    rows = [("h", i, {0: True, 2: None, 3: None, 11: None}.get(i, False), None) for i in range(14)]
    df = spark.createDataFrame(rows, "host string, seq long, success boolean, retry_after double")
    for stretch in (1, 3, 4, 100):
        assert {tuple(r) for r in retrieval.cooldowns(df, stretch).collect()} == by_hand([r for r in rows if r[2] is not None])


def test_files_of_events_share_micro_batches_in_any_order(spark, tmp_path):
    """The number of micro-batches doesn't grow with that of files, and a file with older rows than one read before isn't late."""
    import os

    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.coalesce(1).write.parquet(str(tmp_path / "one" / "events.parquet"))
    for n in range(4):
        events.filter(F.floor(F.col("event_id") / 250) == n).coalesce(1).write.mode("append").parquet(str(tmp_path / "many" / "events.parquet"))
        for f in (tmp_path / "many" / "events.parquet").glob("*.parquet"):
            if f.stat().st_mtime > 1_000_000:
                os.utime(f, (10_000 - n, 10_000 - n))
    one, many = (queries.queries()["stream_cooldowns"](spark, str(tmp_path / d)) for d in ("one", "many"))
    assert {f.rsplit(f"{jobs.BATCH}=", 1)[1].split("/")[0] for f in many.inputFiles()} == {"0"}
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, one.collect())) and many.count() > 500


def test_a_replayed_batch_is_there_once(spark, tmp_path):
    """What a crash between write and commit leaves: the same batch comes again under its number."""
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "id int, state string")
    for n in (0, 1, 1):
        rows.write.mode("overwrite").parquet(jobs.numbered_folder(str(tmp_path / "out"), n))
    assert jobs.read_batches(spark, str(tmp_path / "out"), rows).count() == 4
    assert sorted(map(tuple, jobs.read_batches(spark, str(tmp_path / "out"), rows, "update", ["id"]).collect())) == [(1, "a"), (2, "b")]
    write = jobs.change_feed(spark.createDataFrame([(1, "x")], "id int, state string"), str(tmp_path / "feed"))
    for n in (0, 0, 1, 0):
        write(rows, n)
    assert spark.read.parquet(str(tmp_path / "feed" / "trail")).count() == 4 and spark.read.parquet(str(tmp_path / "feed" / "changes")).groupBy("batch").count().collect()[0][1] == 2


def test_update_mode_writes_changes_only(spark, tmp_path):
    schema = "item int, seq int, success boolean, pass int, source string"
    for n, rows in enumerate([[(i, i, False, 1, "s") for i in range(10)], [(3, 11, True, 2, "t")], [(4, 12, False, 2, "t")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    got = jobs.run_available(jobs.superseded(stream), "update", ["item"])
    assert sorted((r.item, r.success, r.source) for r in got.collect()) == [(i, i == 3, "t" if i == 3 else "s") for i in range(10)]
    assert sum(spark.read.parquet(f).count() for f in got.inputFiles()) <= 12


def test_complete_mode_keeps_only_the_last_state(spark, tmp_path):
    for n in range(3):
        spark.createDataFrame([(n % 2, n, n == 2, 1, "s")], "item int, seq int, success boolean, pass int, source string").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    schema = "item int, seq int, success boolean, pass int, source string"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    got = jobs.run_available(jobs.superseded(stream), "complete")
    assert sorted((r.item, r.success) for r in got.collect()) == [(0, True), (1, False)]
    assert len({f.rsplit(f"{jobs.BATCH}=", 1)[1].split("/")[0] for f in got.inputFiles()}) == 1


def test_identifiers_meet_in_any_case(spark):
    ledger_ = spark.createDataFrame([("10.1/A", "incluir", "r", "p", 2, "s", None, None, None)], ", ".join(f"{c} {'int' if 'version' in c else 'string'}" for c in ("doi", *ledger.DECISION, *ledger.SUGGESTION)))
    new = spark.createDataFrame([("10.1/a ", "m", "excluir", 1), ("10.1/B", "m", "incluir", 1)], "doi string, ai_provider string, ai_decision string, ai_version int")
    assert sorted((r.doi, r.decision, r.ai_decision) for r in ledger.upsert_suggestions(ledger_, new).collect()) == [("10.1/A", "incluir", "excluir"), ("10.1/B", None, "incluir")]
    assert ledger.restore(ledger_, ledger_.withColumn("doi", F.lower("doi"))).count() == 1
    before, after = (spark.createDataFrame([r], "doi string, success boolean") for r in (("10.1/A", False), ("10.1/a", True)))
    assert [tuple(r) for r in retrieval.run_changes(before, after).collect()] == [("10.1/A", "gain")]
    rows = spark.createDataFrame([("10.1/A", "crossref", "", "", "", "", "abc"), ("10.1/a", "openalex", "T", "", "", "", "abcd")], "doi string, source string, title string, authors string, year string, journal string, abstract string")
    assert [(r.doi, r.title, r.sources) for r in records.merge_records(rows).collect()] == [("10.1/a", "T", 2)]
    assert [(r.doi, r.abstract) for r in records.longest_abstract(rows).collect()] == [("10.1/a", "abcd")]
    assert [(r.doi, r.title, r.abstract) for r in records.refresh(rows.filter("source = 'crossref'"), rows.filter("source = 'openalex'")).collect()] == [("10.1/A", "T", "abcd")]
    status = spark.createDataFrame([("10.1/a", "gold")], "doi string, oa_status string")
    assert [r.doi for r in retrieval.missed_open(before, status).collect()] == ["10.1/A"] and retrieval.open_access_ceiling(before, status).first().open == 1
    assert [tuple(r) for r in records.enrich(before.select("doi"), rows.filter("title = 'T'").select("doi", "title"), status).collect()] == [("10.1/A", "T", "gold")]


def test_numbers_run_on_over_stretches(spark):
    from sievework.operators import ledger

    rows = spark.createDataFrame([("a", i * 7 % 50) for i in range(50)] + [("b", 3), (None, 1), (None, 45)], "g string, id long")
    whole = sorted(map(tuple, ledger.numbered(rows, "g", "id").collect()), key=str)
    assert sorted(map(tuple, ledger.numbered(rows, "g", "id", F.floor(F.col("id") / 10)).collect()), key=str) == whole
    assert ledger.batches(rows, "g", "id", 20, F.floor(F.col("id") / 10)).groupBy("g").agg(F.max("batch")).filter("g = 'a'").collect()[0][1] == 2


def test_titles_fold_as_unicode_says(spark):
    import random
    import re
    import unicodedata

    def plain(title):
        folded = unicodedata.normalize("NFKC", title).casefold().replace("&", " and ")
        return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", folded)).strip()

    rng = random.Random(1)
    pool = [chr(c) for c in range(0x20, 0x250)] + list("ßẞﬁﬃĲⅣ½²₂ﾊＦｕｌｌΣςσИйЁёЍ㎏…—“”İıŉǅḞṩ") + ["e\u0301", "E\u0301", "s\u0323\u0307", "и\u0306", "A\u030a", "x\u0301"]
    titles = ["Straße & STRASSE", "Ｆｕｌｌ Ｗｉｄｔｈ", "x² + H₂O", "ΣΊΣΥΦΟΣ Σίσυφος", "e\u0301tude École", "ﬁnal oﬃce", "", *("".join(rng.choice(pool) for _ in range(rng.randrange(1, 25))) for _ in range(400))]
    got = [r.t for r in spark.createDataFrame([(i, t) for i, t in enumerate(titles)], "i int, title string").orderBy("i").select(text.title_words(F.col("title")).alias("t")).collect()]
    assert got == [plain(t) for t in titles]


def test_pages_of_an_order(spark):
    rows = spark.createDataFrame([(i, t, a) for i, (t, a) in enumerate([("Zebra", "b"), ("água", "É"), ("Água", "e"), ("abc", "f"), ("École", None)])], "number int, title string, authors string")
    page = lambda sort, n, size: [r.number for r in screening.assessment_page(rows, sort, "number", n, size).orderBy("n").collect()]
    assert page("title", 1, 3) == [3, 1, 2] and page("title", 2, 3) == page("title", 9, 3) == [4, 0] and page("author", 1, 5) == [4, 0, 2, 1, 3] and page("number", 0, 2) == [0, 1]
    assert screening.assessment_page(rows.limit(0), "title").count() == 0


def test_lists_in_several_encodings(spark, tmp_path):
    latin = "Uma revisão\n10.1/A\nÉtude\n"
    (tmp_path / "utf8.txt").write_bytes("Pesquisa é\n10.1/b\n".encode())
    (tmp_path / "mark.txt").write_bytes(b"\xef\xbb\xbf" + "10.1234/c\nTítulo\n".encode())
    (tmp_path / "latin.txt").write_bytes((latin + "plain line\n" * 2000).encode("latin-1"))
    (tmp_path / "none.txt").write_bytes(b"")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        lines_ = lists.read_id_list(spark, str(tmp_path / "*.txt"))
        assert lines_.rdd.getNumPartitions() > 1
        assert {r.value for r in lines_.collect()} == {"Pesquisa é", "10.1/b", "10.1234/c", "Título", "Uma revisão", "10.1/A", "Étude", "plain line"}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    (tmp_path / "t.csv").write_bytes("título;https://doi.org/10.1234/Z.\n".encode("latin-1"))
    assert [r.doi for r in lists.read_delimited_ids(spark, str(tmp_path / "t.csv")).collect()] == ["10.1234/z"]


def test_tagged_records_count_by_file(spark, tmp_path):
    for name, n in (("a", 700), ("b", 3)):
        (tmp_path / f"{name}.ris").write_text("".join(f"TY  - JOUR\nAB  - {'x' * 50}\nER  - \n" for _ in range(n)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        got = sorted(r.label for r in lists.read_tagged(spark, str(tmp_path / "*.ris"), "core").collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == sorted([f"core #{i}" for i in range(1, 701)] + [f"core #{i}" for i in (1, 2, 3)])


def test_a_merge_touches_the_buckets_of_its_ids(spark, tmp_path):
    import pathlib

    columns = ", ".join(f"{c} {'int' if 'version' in c else 'string'}" for c in ("doi", *ledger.DECISION, *ledger.SUGGESTION))
    rows = [(f"10.1/{i}", "incluir", "r", "p", 2, "s", "m", "incluir", 2) for i in range(400)]
    path = tmp_path / "ledger"
    ledger.store_ledger(spark.createDataFrame(rows, columns), str(path), buckets=16)
    files = lambda: {p: p.stat().st_mtime_ns for p in pathlib.Path(path).rglob("part-*.parquet")}
    before = files()
    new = spark.createDataFrame([("10.1/7", "excluir", "x", "q", 3, "t"), ("10.1/NEW", "excluir", "x", "q", 3, "t")], ", ".join(f"{c} {'int' if c == 'version' else 'string'}" for c in ("doi", *ledger.DECISION)))
    for _ in range(2):
        touched = ledger.merge_stored(str(path), new, ledger.upsert_decisions)
        assert 1 <= touched <= 2 and len(before.items() - files().items()) == len({p.parent for p in before.keys() - files().keys()}) == touched
        got = {r.doi: (r.decision, r.ai_decision) for r in ledger.read_ledger(spark, str(path)).collect()}
        assert len(got) == 401 and got["10.1/7"] == ("excluir", "incluir") and got["10.1/8"] == ("incluir", "incluir") and got["10.1/NEW"] == ("excluir", None)
    assert ledger.merge_stored(str(path), new.limit(0), ledger.upsert_decisions) == 0


def test_descent_gives_the_first_places_of_a_whole_search(spark):
    import random

    rng = random.Random(4)
    pool = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()
    title = lambda: " ".join(rng.choice(pool) for _ in range(rng.randint(3, 7)))
    base = [title() for _ in range(25)]
    sure = [f"a title of its own number {i} on {w}" for i, w in enumerate(pool)]
    asked = spark.createDataFrame([(t, 2001, "C B") for t in {*base, *sure}], "title string, requested_year int, requested_author string")
    near = lambda t: rng.choice([t, t, t + " mu", t.replace("a", "e", 1), title()])
    rows = [(near(rng.choice(base)), rng.choice([None, *(f"10.5555/{i}" for i in range(12))]), f"s{rng.randrange(3)}", rng.choice([2000, 2001, 2009]), rng.choice(["A B", "X Y"]), ["u"]) for _ in range(400)]
    rows += [(t, f"10.5555/{i}{d}", f"s{s}", 2001, "A B", ["v"]) for i, t in enumerate(sure) for d in "ab" for s in range(3)]
    hits = spark.createDataFrame(rows, "hit_title string, doi string, resolver string, year int, author string, urls array<string>")
    whole = linkage.rank_recovery(linkage.recovery_pairs(asked, hits, 0.5)).filter("n <= 2")
    columns = ["request", "key", "n", "rank_score", "source_count", "hit_title"]
    got = linkage.first_places(asked, hits, sources=3)
    assert sorted(map(tuple, got.select(*columns).collect())) == sorted(map(tuple, whole.select(*columns).collect()))
    assert {r.band for r in got.collect()} > {0.5}
