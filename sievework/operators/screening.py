"""Screening of titles and abstracts: worklists, decisions by rule, model suggestions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions.ids import fingerprint, join_by_id, same_id
from sievework.operators.ledger import batches

PAGE = 50


def screenable(items: DataFrame) -> DataFrame:
    """Records that can be screened: metadata found and the search ended."""
    return items.filter(F.col("found") & F.col("status").isin("done", "partial"))


def in_force(decision: Column, version: Column, current: int) -> Column:
    """A decision of the current protocol version, else ``pendente``."""
    return F.when((version == current) & decision.isin("incluir", "excluir"), decision).otherwise("pendente")


def obtained(items: DataFrame, corpus: DataFrame) -> DataFrame:
    """``items`` with ``state`` (no_corpus, nao_obtido, aguardando) and ``why``; errors of the batch go before the engine's."""
    have = corpus.select(same_id(F.col("doi")).alias("k")).filter("k IS NOT NULL").distinct().withColumn("there", F.lit(True))
    engine = F.col("engine_error") if "engine_error" in items.columns else F.lit(None).cast("string")
    why = F.coalesce(F.nullif(F.trim("error"), F.lit("")), F.nullif(F.trim(engine), F.lit("")), F.lit(""))
    out = items.withColumn("k", same_id(F.col("doi"))).join(have, "k", "left").drop("k")
    state = F.when(F.col("there"), "no_corpus").when(why != "", "nao_obtido").otherwise("aguardando")
    return out.withColumn("state", state).withColumn("why", F.when(state == "nao_obtido", why).otherwise("")).drop("there")


def worklist(items: DataFrame, ledger: DataFrame, corpus: DataFrame, current: int) -> DataFrame:
    """Screenable records with their situation, whether a decision is out of date, and for included ones the state."""
    marks = ledger.select("doi", "decision", "version")
    rows = join_by_id(screenable(items), marks)
    rows = rows.withColumn("situation", in_force(F.col("decision"), F.col("version"), current)).withColumn("stale", F.col("decision").isNotNull() & ~F.col("version").eqNullSafe(F.lit(current)))
    rows = obtained(rows, corpus)
    included = F.col("situation") == "incluir"
    return rows.withColumn("state", F.when(included, F.col("state"))).withColumn("why", F.when(included, F.col("why")))


def worklist_counts(rows: DataFrame) -> DataFrame:
    no_abstract = F.trim(F.coalesce("abstract", F.lit(""))) == ""
    is_ = lambda s: F.count_if(F.col("situation") == s)
    return rows.agg(F.count("*").alias("todos"), is_("pendente").alias("pendente"), is_("incluir").alias("incluir"), is_("excluir").alias("excluir"), F.count_if(no_abstract).alias("sem_resumo"), F.count_if(F.col("state") == "nao_obtido").alias("nao_obtido"))


def worklist_filter(rows: DataFrame, which: str = "pendente", search: str = "") -> DataFrame:
    if which == "sem_resumo":
        rows = rows.filter(F.trim(F.coalesce("abstract", F.lit(""))) == "")
    elif which == "nao_obtido":
        rows = rows.filter(F.col("state") == "nao_obtido")
    elif which != "todos":
        rows = rows.filter(F.col("situation") == which)
    if asked := search.strip().lower():
        rows = rows.filter(F.contains(F.lower(F.concat_ws(" ", "title", "authors", "doi", "journal", "abstract")), F.lit(asked)))
    return rows


def page_of(rows: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page of the ordered rows, with their place ``n``; a number beyond the end gives the last page.

    Nothing runs until the caller asks: only the first ``page * size`` rows of the order are kept and numbered, beside one row
    with the total.
    """
    first, last = rows.orderBy(*order).limit(max(1, page) * size), Window.orderBy(*order)
    total = rows.agg(F.count("*").alias("__total"))
    numbered = first.withColumn("n", F.row_number().over(last)).join(F.broadcast(total))
    at = F.least(F.lit(max(1, page)), F.greatest(F.lit(1), F.ceil(F.col("__total") / size)))
    return numbered.filter(F.ceil(F.col("n") / size) == at).drop("__total")


def worklist_page(rows: DataFrame, order: str, page: int = 1, size: int = PAGE) -> DataFrame:
    """One page of the worklist; a number beyond the end gives the last page."""
    return page_of(rows, [F.col(order)], page, size).drop("n")


def assessment_filter(rows: DataFrame, decision: str = "all", search: str = "", agreement: str = "all") -> DataFrame:
    """Articles (title, authors, doi, filename, decision, agreement) of one decision and one state of the models' agreement that hold a text."""
    if decision != "all":
        rows = rows.filter(F.col("decision") == decision)
    if agreement != "all":
        rows = rows.filter(F.col("agreement") == agreement)
    return rows.filter(F.contains(F.lower(F.concat_ws(" ", "title", "authors", "doi", "filename")), F.lit(search.lower()))) if search else rows


def assessment_page(rows: DataFrame, sort: str = "number", number: str = "number", page: int = 1, size: int = 10) -> DataFrame:
    """One page of the articles by ``number``, or by title or author as Portuguese sorts them, with their place ``n``."""
    by = [] if sort == "number" else [F.collate(F.coalesce({"title": "title", "author": "authors"}[sort], F.lit("")), "pt")]
    return page_of(rows, [*by, F.col(number)], page, size)


def answer_action(answer: Column, rule: Column) -> Column:
    """What a question's rule makes of an answer; without a rule yes and unknown include, no excludes."""
    given = F.lower(answer)
    return F.when(given == "sim", F.coalesce(rule["yes"], F.lit("include"))).when(given.isin("não", "nao"), F.coalesce(rule["no"], F.lit("exclude"))).otherwise(F.coalesce(rule["unknown"], F.lit("include")))


def rule_array(rules: list[dict]) -> Column:
    """Per-question rules (yes, no, unknown) as a constant."""
    one = lambda r: F.struct(*[F.lit(r.get(k)).cast("string").alias(k) for k in ("yes", "no", "unknown")])
    return F.array(*map(one, rules)) if rules else F.array().cast("array<struct<yes:string,no:string,unknown:string>>")


def decide(rows: DataFrame, rules: list[dict], n_questions: int) -> DataFrame:
    """Rows (answers, reason) with ``decision`` and ``reject``; one of the two is null."""
    known = F.forall("answers", lambda a: a.isin("Sim", "Não", "Indeterminado"))
    whole = (F.size("answers") == n_questions) & (F.size("answers") > 0) & known
    out = F.exists(F.zip_with("answers", rule_array(rules), lambda a, r: F.struct(a.alias("a"), r.alias("r"))), lambda x: x["a"].isNotNull() & (answer_action(x["a"], x["r"]) == "exclude"))
    reject = F.when(F.col("answers").isNull() | ~whole, "answer every question").when(out & (F.trim(F.coalesce("reason", F.lit(""))) == ""), "give a reason for the exclusion")
    return rows.withColumn("reject", reject).withColumn("decision", F.when(F.col("reject").isNull(), F.when(out, "excluir").otherwise("incluir")))


def suggest(rows: DataFrame, rules: list[dict], version: int, criteria_hash: str) -> DataFrame:
    """Model answers (sim, nao, indeterminado) as suggestions: the decision comes from the rules, never from the model."""
    plain = F.transform("answers", lambda a: F.translate(F.lower(F.trim(a)), "ãáàâ", "aaaa"))
    valid = F.forall(plain, lambda a: a.isin("sim", "nao", "indeterminado"))
    out = F.exists(F.zip_with(plain, rule_array(rules), lambda a, r: F.struct(a.alias("a"), r.alias("r"))), lambda x: x["a"].isNotNull() & (answer_action(x["a"], x["r"]) == "exclude"))
    rows = rows.withColumn("reject", F.when(F.col("answers").isNull() | ~valid, "invalid answer"))
    return rows.withColumn("suggested", F.when(F.col("reject").isNull(), F.when(out, "excluir").otherwise("incluir"))).withColumn("ai_version", F.lit(version)).withColumn("ai_criteria", F.lit(criteria_hash))


def record_hash() -> Column:
    """What a suggestion about a record depends on."""
    return fingerprint("doi", "title", "authors", "abstract")


def is_current(version: Column, criteria: Column, source: Column, now_version: int, now_criteria: str, now_source: Column, compatible: Column | None = None) -> Column:
    same = (version == now_version) & (criteria == now_criteria) & (source == now_source)
    return F.coalesce(same if compatible is None else same & compatible, F.lit(False))


def pending_for_model(articles: DataFrame, analyses: DataFrame, provider: str, model: str, limit: int) -> tuple[DataFrame, DataFrame]:
    """Articles without a current analysis by this model: the first ``limit`` by id, and how many remain after them."""
    done = analyses.filter((F.col("provider") == provider) & (F.col("model") == model) & F.col("current")).select(F.col("article").alias("id"))
    todo = articles.join(done, "id", "left_anti")
    return todo.orderBy("id").limit(limit), todo.agg(F.greatest(F.count("*") - limit, F.lit(0)).alias("remaining"))


def bulk_candidates(articles: DataFrame, agreement: DataFrame) -> DataFrame:
    """Pending articles with one or agreeing analyses as ``accept``, conflicts as ``conflict``."""
    status = F.when(F.col("status").isin("single", "agreement"), "accept").when(F.col("status") == "conflict", "conflict")
    return articles.filter("situation = 'pendente'").join(agreement, "article").withColumn("group", status).filter("group IS NOT NULL")


def not_acceptable() -> Column:
    """Why the suggestion on a record of the worklist can't be accepted, else null."""
    return F.when(F.col("situation").isNull(), "unknown record").when(F.col("situation") != "pendente", "already decided").when(F.col("suggested").isNull(), "no suggestion").when(~F.coalesce("current", F.lit(False)), "suggestion out of date")


def accept_all(chosen: DataFrame, worklist_: DataFrame, most: int = 500) -> tuple[DataFrame, DataFrame]:
    """(decisions, violations) of a bulk acceptance; the decisions are empty if anything is violated."""
    rows = join_by_id(chosen.select("doi").distinct(), worklist_.select("doi", "situation", "suggested", "current"))
    rows = rows.withColumn("why", not_acceptable())
    bad = rows.filter("why IS NOT NULL").select("doi", "why")
    over = rows.agg(F.count("*").alias("n")).filter(F.col("n") > most).select(F.lit(None).cast("string").alias("doi"), F.lit("too many records").alias("why"))
    violations = bad.unionByName(over)
    none = violations.agg(F.count("*").alias("bad"))
    good = rows.filter("why IS NULL").join(F.broadcast(none), F.col("bad") == 0).select("doi", F.col("suggested").alias("decision"), F.lit("ia_accepted").alias("source"))
    return good, violations


def accept_batches(chosen: DataFrame, worklist_: DataFrame, most: int = 500) -> tuple[DataFrame, DataFrame]:
    """As ``accept_all`` for many acceptances, told apart by ``batch``: each is accepted whole or not at all."""
    rows = join_by_id(chosen.select("batch", "doi").distinct(), worklist_.select("doi", "situation", "suggested", "current")).withColumn("why", not_acceptable())
    batches = rows.groupBy(F.col("batch").alias("b")).agg(F.count("*").alias("n"), F.count("why").alias("bad"))
    over = batches.filter(F.col("n") > most).select(F.col("b").alias("batch"), F.lit(None).cast("string").alias("doi"), F.lit("too many records").alias("why"))
    violations = rows.filter("why IS NOT NULL").select("batch", "doi", "why").unionByName(over)
    whole = batches.filter((F.col("bad") == 0) & (F.col("n") <= most))
    good = rows.join(whole, F.col("batch").eqNullSafe(F.col("b"))).select("batch", "doi", F.col("suggested").alias("decision"), F.lit("ia_accepted").alias("source"))
    return good, violations


def keyword_screen(records: DataFrame, all_of: list[list[str]], none_of: list[str], columns: tuple[str, ...] = ("title", "abstract")) -> DataFrame:
    """Records whose text has a term of every group of ``all_of`` and none of ``none_of``; terms are literal, whole words."""
    import re

    text = F.concat_ws("\n", *columns)
    has = lambda t: text.rlike(r"(?i)(?:^|[^\p{L}\p{N}])" + re.escape(t) + r"(?:$|[^\p{L}\p{N}])")
    keep = F.lit(True)
    for group in all_of:
        one = F.lit(False)
        for term in group:
            one = one | has(term)
        keep = keep & one
    for term in none_of:
        keep = keep & ~has(term)
    return records.filter(keep)


def parse_response(rows: DataFrame, column: str = "response") -> DataFrame:
    """Rows with ``json``, the object in a model's answer; fences and words around it are tolerated, cut objects are not."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim(column), r"(?s)^```(?:json)?\s*", ""), r"\s*```\s*$", ""))
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    is_object = lambda c: F.try_parse_json(c).isNotNull() & F.trim(c).startswith("{")
    return rows.withColumn("json", F.when(is_object(bare), bare).when((inner != "") & is_object(inner), inner))


def unify_responses(rows: DataFrame) -> DataFrame:
    """(…, item): the items of a parsed answer under any of its envelopes, or the answer itself."""
    paths = ("items", "results", "avaliacoes", "artigos", "analyses", "respostas")
    found = F.coalesce(*[F.nullif(F.get_json_object("json", f"$.{p}"), F.lit("null")) for p in paths])
    listed = F.from_json(found, "array<string>")
    return rows.withColumn("item", F.explode(F.coalesce(listed, F.array("json"))))


def verdict(parsed: DataFrame, protocol: Column, least: int = 400) -> DataFrame:
    """Parsed answers with ``decision`` and ``confidence``; without a protocol of ``least`` characters nothing is excluded."""
    said = F.upper(F.coalesce(F.get_json_object("json", "$.parecer_final"), F.lit("")))
    allowed = F.length(F.trim(F.coalesce(protocol, F.lit("")))) >= least
    decision = F.when(said.contains("INCLU"), "INCLUIDO").when(said.contains("EXCLU") & allowed, "EXCLUIDO").otherwise("REVISÃO MANUAL")
    raw = F.get_json_object("json", "$.confianca")
    number = F.regexp_replace(F.trim(raw), r"\s*%$", "").try_cast("double")
    return parsed.withColumn("decision", F.when(F.col("json").isNotNull(), decision)).withColumn("confidence", F.when(number.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), number.try_cast("int")))))


def score_with_model(texts: DataFrame, done: DataFrame, scorer: Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]], schema: str, protocol_hash: str) -> DataFrame:
    """Run a scorer over the texts (article_id, text, text_quality) that have no verdict under this text and protocol.

    A text that can't be screened becomes a failure row by the gate and never reaches the scorer, whose ``schema`` must
    have article_id and response.
    """
    from sievework.operators.documents import screen_gate

    task = texts.withColumn("task_hash", F.sha2(F.concat_ws("\u0001", "text", F.lit(protocol_hash)), 256))
    todo = screen_gate(task.join(done.select("article_id", "task_hash"), ["article_id", "task_hash"], "left_anti"))
    failed = todo.filter("gate IS NOT NULL").select("article_id", "task_hash", F.lit("FAILED").alias("status"), F.col("gate").alias("failure_reason"), F.lit(None).cast("string").alias("response"))
    scored = todo.filter("gate IS NULL").select("article_id", "text").mapInPandas(scorer, schema)
    answered = parse_response(todo.filter("gate IS NULL").select("article_id", "task_hash").join(scored, "article_id", "left"))
    ok = F.col("json").isNotNull()
    return failed.unionByName(answered.select("article_id", "task_hash", F.when(ok, "COMPLETED").otherwise("FAILED").alias("status"), F.when(~ok, "resposta_invalida").alias("failure_reason"), "response"))


def request_packages(articles: DataFrame, size: int, criteria: Column, stretch: Column | None = None) -> DataFrame:
    """(package, n, json): articles in batches of ``size`` with their hashes and whether they have an abstract.

    ``stretch``: as in ``ledger.numbered``, for projects that hold most of the articles.
    """
    rows = batches(articles, "project", "id", size, stretch).withColumnRenamed("batch", "package")
    item = F.struct(F.col("id").alias("article_id"), "title", "abstract", F.when(F.trim(F.coalesce("abstract", F.lit(""))) == "", "nao_localizado").otherwise("localizado").alias("abstract_status"), fingerprint("id", "title", "abstract").alias("source_hash"))
    return rows.groupBy("project", "package").agg(F.array_sort(F.collect_list(item)).alias("items")).select("project", "package", F.size("items").alias("n"), F.to_json(F.struct(criteria.alias("criteria"), "items")).alias("json"))


def attach_texts(articles: DataFrame, texts: DataFrame, most: int) -> DataFrame:
    """Articles with their text up to ``most`` characters and whether it was cut."""
    out = articles.join(texts.select(F.col("article_id").alias("id"), "text"), "id", "left")
    return out.withColumn("truncated", F.coalesce(F.length("text") > most, F.lit(False))).withColumn("text", F.substring("text", 1, most))
