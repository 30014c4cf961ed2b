"""Analysis of retrieval runs: outcomes, sources, failures, retries and comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.functions.ids import host, join_by_id

# Codes that say "not now", and hours until a retry makes sense.
RETRY_CODES = ("download_host_cooldown", "download_network_error", "download_timeout", "download_http_408", "download_http_425", "download_http_429", "worker_exception", "item_deadline", "download_item_deadline")
RETRY_HOURS = {"download_http_429": 1, "download_host_cooldown": 1, "download_timeout": 1, "download_network_error": 1, "download_http_503": 2, "download_http_500": 2, "download_http_502": 2, "download_http_504": 2, "download_http_403": 24, "not_found": 168}


def category(success: Column, code: Column) -> Column:
    """Why an item failed, in nine classes."""
    c = F.coalesce(code, F.lit(""))
    return (
        F.when(success, "ok")
        .when(c == "article_identity_not_confirmed", "identidade_rejeitada")
        .when(c == "not_found", "nenhuma_fonte_tem_pdf")
        .when(c == "resolve_network_error", "metadados_indisponiveis")
        .when(c.isin("download_item_deadline", "download_timeout") | c.contains("deadline"), "tempo_esgotado")
        .when(c.rlike("^download_http_40[13]$"), "bloqueio_401_403")
        .when(c == "download_not_a_pdf", "pagina_em_vez_de_pdf")
        .when(c.startswith("download_"), "falha_de_download")
        .otherwise(F.when(c == "", "desconhecido").otherwise(c))
    )


def item_status(success: Column, skipped: Column, source: Column) -> Column:
    cached = F.coalesce(skipped, F.lit(False)) | F.coalesce(source == "cache", F.lit(False))
    return F.when(~F.coalesce(success, F.lit(False)), "failed").when(cached, "cached").otherwise("ok")


def worth_retrying(success: Column, code: Column) -> Column:
    """Whether a later attempt could mend the failure; refusals and wrong articles are answers."""
    return ~F.coalesce(success, F.lit(False)) & F.coalesce(code.isin(*RETRY_CODES) | code.startswith("download_http_5"), F.lit(False))


def retry_advice(failures: DataFrame) -> DataFrame:
    """Failures (code, at) with ``retryable`` and ``retry_at``."""
    table = failures.sparkSession.createDataFrame(list(RETRY_HOURS.items()), "code string, hours int")
    # The table of codes is a constant.
    out = failures.join(F.broadcast(table), "code", "left")
    return out.withColumn("retryable", worth_retrying(F.lit(False), F.col("code"))).withColumn("retry_at", F.col("at") + F.make_interval(hours=F.col("hours")))


def supersede(attempts: DataFrame) -> DataFrame:
    """One row per item: a success replaces a failure, else the first pass stands; no item counts twice."""
    order = Window.partitionBy("item").orderBy(F.desc("success"), "pass", "seq")
    return attempts.withColumn("rn", F.row_number().over(order)).filter("rn = 1").drop("rn")


def second_pass_totals(attempts: DataFrame) -> DataFrame:
    """Items, those retried, those recovered, and the net outcome."""
    by = attempts.groupBy("item").agg(F.bool_or(F.col("success") & (F.col("pass") == 1)).alias("first"), F.bool_or(F.col("success") & (F.col("pass") > 1)).alias("late"), (F.max("pass") > 1).alias("again"))
    ok = F.col("first") | F.col("late")
    return by.agg(F.count("*").alias("items"), F.count_if(~F.col("first") & F.col("again")).alias("retried"), F.count_if(~F.col("first") & F.col("late")).alias("recovered"), F.count_if(ok).alias("ok"), F.count_if(~ok).alias("failed"))


def source_use(results: DataFrame) -> DataFrame:
    """Per source: items it was tried for (once each), items it served, rate. ``results``: item, sources_tried, source, success."""
    tried = results.select("item", F.explode(F.array_union(F.coalesce("sources_tried", F.array().cast("array<string>")), F.filter(F.array("source"), lambda s: s.isNotNull()))).alias("src")).groupBy("src").agg(F.count_distinct("item").alias("attempts"))
    served = results.filter("success").groupBy(F.col("source").alias("src")).agg(F.count_distinct("item").alias("ok"))
    out = tried.join(served, "src", "left").select(F.col("src").alias("source"), "attempts", F.coalesce("ok", F.lit(0)).alias("ok"))
    return out.withColumn("rate", F.round(100 * F.col("ok") / F.col("attempts"), 1))


def telemetry(attempts: DataFrame) -> DataFrame:
    """Per source: attempts, successes, failures, rate, mean seconds, last error by time."""
    bad = ~F.col("success")
    return attempts.groupBy("source").agg(F.count("*").alias("attempts"), F.count_if("success").alias("ok"), F.count_if(bad).alias("failed"), F.round(F.count_if("success") / F.count("*"), 4).alias("rate"), F.round(F.avg("ms") / 1000, 3).alias("mean_s"), F.max_by(F.when(bad, F.col("code")), F.when(bad, F.col("seq"))).alias("last_error"))


def telemetry_of_maps(runs: DataFrame) -> DataFrame:
    """As ``telemetry`` over runs whose ``stats`` maps a source to its counters."""
    rows = runs.select("run", F.explode("stats").alias("source", "s")).select("run", "source", "s.*")
    return rows.groupBy("source").agg(F.sum("attempts").alias("attempts"), F.sum("ok").alias("ok"), F.sum("failed").alias("failed"), F.round(F.sum("ms") / F.sum("attempts") / 1000, 3).alias("mean_s"), F.max_by("last_error", F.when(F.col("last_error").isNotNull(), F.col("run"))).alias("last_error"))


def benchmark_summary(results: DataFrame) -> DataFrame:
    ok = F.col("success")
    return results.agg(F.count("*").alias("total"), F.count_if(ok).alias("ok"), F.round(F.count_if(ok) / F.count("*"), 4).alias("rate"), F.round(F.avg("seconds"), 1).alias("mean_s"), F.round(F.avg(F.when(ok, F.col("seconds"))), 1).alias("mean_ok_s"))


def benchmark_groups(results: DataFrame) -> DataFrame:
    """(grouping, name, n): successes by source and failures by category."""
    by = lambda df, name, key: df.groupBy(key.alias("name")).agg(F.count("*").alias("n")).select(F.lit(name).alias("grouping"), "name", "n")
    return by(results.filter("success"), "source", F.col("source")).unionByName(by(results.filter("NOT success"), "category", category(F.col("success"), F.col("code"))))


def open_access_ceiling(results: DataFrame, status: DataFrame) -> DataFrame:
    """Open, closed and unknown items, those recovered of each, and the open ones that were missed."""
    rows = join_by_id(results, status)
    closed, open_ = F.coalesce(F.col("oa_status") == "closed", F.lit(False)), F.coalesce(F.col("oa_status") != "closed", F.lit(False))
    return rows.agg(
        F.count_if(open_).alias("open"), F.count_if(closed).alias("closed"), F.count_if(~open_ & ~closed).alias("unknown"), F.round(F.count_if(open_) / F.count("*"), 4).alias("ceiling"),
        F.count_if(open_ & F.col("success")).alias("open_recovered"), F.count_if(closed & F.col("success")).alias("closed_recovered"), F.count_if(open_ & ~F.col("success")).alias("open_missed"),
    )


def missed_open(results: DataFrame, status: DataFrame) -> DataFrame:
    return join_by_id(results.filter("NOT success"), status.filter("oa_status <> 'closed'"), "inner").select("doi")


def transient_by_host(failures: DataFrame, most: int = 15) -> DataFrame:
    """The hosts with most transient failures, by status; a top-k report."""
    rows = failures.filter(worth_retrying(F.lit(False), F.col("code"))).select(host(F.col("url")).alias("host"), F.coalesce(F.nullif(F.regexp_extract("code", r"(\d{3})$", 1), F.lit("")), F.lit("rede/timeout")).alias("status"), (F.col("code") == "download_host_cooldown").alias("cool"))
    return rows.groupBy("host", "status").agg(F.count("*").alias("n"), F.count_if("cool").alias("cooldowns")).orderBy(F.desc("n"), "host", "status").limit(most)


def run_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per item of two runs: gain, loss, same, new or gone; an item that wasn't there before is no gain."""
    both = join_by_id(before.select("doi", F.col("success").alias("b")), after.select("doi", F.col("success").alias("a")), "full_outer")
    change = F.when(F.col("b").isNull(), "new").when(F.col("a").isNull(), "gone").when(~F.col("b") & F.col("a"), "gain").when(F.col("b") & ~F.col("a"), "loss").otherwise("same")
    return both.select("doi", change.alias("change"))


def exit_status(results: DataFrame, *by: str) -> DataFrame:
    """The status by precedence of the run, or of each group of ``by``: validation, transport, unresolved, ok."""
    c = F.coalesce("code", F.lit(""))
    bad = ~F.col("success")
    has = results.groupBy(*by).agg(F.coalesce(F.bool_or(bad & c.contains("identity")), F.lit(False)).alias("v"), F.coalesce(F.bool_or(bad & c.startswith("download_")), F.lit(False)).alias("t"), F.coalesce(F.bool_or(bad), F.lit(False)).alias("u"))
    return has.select(*by, F.when(F.col("v"), "validation").when(F.col("t"), "transport").when(F.col("u"), "unresolved").otherwise("ok").alias("status"))


def failed_work(results: DataFrame) -> DataFrame:
    """What is left to do, from the results themselves, with a hint by category."""
    left = results.filter("NOT success").withColumn("category", category(F.col("success"), F.col("code")))
    hint = F.when(worth_retrying(F.col("success"), F.col("code")), "retry later").when(F.col("category") == "bloqueio_401_403", "open the page by hand").when(F.col("category") == "identidade_rejeitada", "check the identifier").otherwise("search elsewhere")
    return left.select("item", "code", "category", hint.alias("hint"))


#: Failures that bring a cooldown, its seconds for that one and the next, and the most that a host may ask for.
COOLDOWN_AFTER, COOLDOWN_SECONDS, MOST_RETRY_AFTER = 4, (30, 120, 600), 60


def cooldown_seconds(streak: Column, retry_after: Column) -> Column:
    """Seconds after a failure: what the host asks for, at most a minute, else what the streak of failures asks for; null if nothing does."""
    by_streak = F.get(F.array(*map(F.lit, COOLDOWN_SECONDS)), F.least(streak - COOLDOWN_AFTER, F.lit(len(COOLDOWN_SECONDS) - 1)).cast("int"))
    asked = F.least(retry_after.cast("int"), F.lit(MOST_RETRY_AFTER))
    return F.when(retry_after > 0, asked).when(streak >= COOLDOWN_AFTER, by_streak)


#: Where ``stretch_begins`` expects what was left before the first stretch.
BEFORE_ALL = -(1 << 63)


def _stretch(seq: Column, stretch: int) -> Column:
    return F.floor(seq / stretch)


def stretch_ends(events: DataFrame, stretch: int = 10_000) -> DataFrame:
    """(host, at, clears, left): of each stretch of ``seq``, whether it has a success and how many failures follow its last one."""
    cut = events.select("host", _stretch(F.col("seq"), stretch).alias("at"), "seq", "success")
    last = cut.filter("success").groupBy(F.col("host").alias("__host"), F.col("at").alias("__at")).agg(F.max("seq").alias("last"))
    both = cut.join(last, F.col("host").eqNullSafe(F.col("__host")) & (F.col("at") == F.col("__at")), "left")
    left = ~F.col("success") & (F.col("last").isNull() | (F.col("seq") > F.col("last")))
    return both.groupBy("host", "at").agg((F.count("last") > 0).alias("clears"), F.count_if(left).alias("left"))


def stretch_begins(ends: DataFrame) -> DataFrame:
    """(host, at, begins, leaves): the failures since the last success, at the begin and at the end of each stretch.

    What was left before all of them may be a row too, at ``BEFORE_ALL``.
    """
    in_order = Window.partitionBy("host").orderBy("at")
    since = F.sum(F.col("clears").cast("int")).over(in_order)
    leaves = F.sum("left").over(Window.partitionBy("host", "since").orderBy("at"))
    return ends.withColumn("since", since).withColumn("leaves", leaves).select("host", "at", F.coalesce(F.lag("leaves").over(in_order), F.lit(0)).alias("begins"), "leaves")


def failure_streaks(events: DataFrame, stretch: int = 10_000, begins: DataFrame | None = None) -> DataFrame:
    """The failures of ``events`` (host, seq, success, ...) with their ``streak``: failures of the host since its last success.

    A scan in stretches of ``seq``: each tells whether it has a success and how many failures follow its last one; these add
    up to what each stretch begins with, and a stretch then numbers its own failures. Only one row a stretch is sorted by the
    whole host, so a host may have most of the rows. ``begins`` says what the stretches begin with, if that is known.
    """
    begins = stretch_begins(stretch_ends(events, stretch)) if begins is None else begins
    begins = begins.select(F.col("host").alias("__host"), F.col("at").alias("__stretch"), F.col("begins").alias("__begins"))
    own = Window.partitionBy("host", "__at").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = events.withColumn("__at", _stretch(F.col("seq"), stretch)).withColumn("__failed", F.count_if(~F.col("success")).over(own))
    rows = rows.withColumn("__cleared", F.max(F.when(F.col("success"), F.col("__failed"))).over(own)).filter(~F.col("success"))
    both = rows.join(begins, F.col("host").eqNullSafe(F.col("__host")) & (F.col("__at") == F.col("__stretch")))
    streak = F.col("__failed") + F.coalesce(-F.col("__cleared"), F.col("__begins"))
    return both.select(*[F.col(f"`{c}`") for c in events.columns], streak.alias("streak"))


def cooldowns(events: DataFrame, stretch: int = 10_000, begins: DataFrame | None = None) -> DataFrame:
    """(host, seq, streak, seconds): the failures that bring their host a cooldown.

    ``events``: host, seq, success and, if known, retry_after (seconds). A success clears the streak.
    """
    if "retry_after" not in events.columns:
        events = events.withColumn("retry_after", F.lit(None).cast("double"))
    found = failure_streaks(events.select("host", "seq", "success", "retry_after"), stretch, begins)
    return found.select("host", "seq", "streak", cooldown_seconds(F.col("streak"), F.col("retry_after")).alias("seconds")).filter("seconds IS NOT NULL")
