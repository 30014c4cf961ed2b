"""URL filters: rules first, else logistic regression on hashed character n-grams, with DataFrame functions only.

A URL's host is what stands between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z in lower case; its path goes
on from there to ``?``, ``#`` or the end.

Rules name a host and the beginning of a path. One fits its host and all subdomains if the path begins with its own; of
several, the longest rule holds, of equal ones a block. Few rules are compared one by one, without a shuffle; more than
``inline_rules`` are joined to the distinct sites on (host or parent host, beginning of the path).

The method learns from a small table of labelled URLs: character n-grams of host and path, marked by their part and with
marks at both ends, hashed to ``dims`` features; a URL's features are the distinct ones, scaled to length one. Weights come
from gradient descent on the weighted log loss: each step is one aggregation over the labelled rows, which may be any
number; the weights, ``dims`` + 1 numbers, pass through the driver between steps. A row weighs as much as its label's
share makes it, so that ``allow`` and ``block`` count alike but for ``prior``. URLs are scored by a narrow map.

Defined results: a null URL or one without ``://`` has an empty host and path, which no rule with a host fits; repeated rows and
null ids are judged each; very long URLs are scored in time proportional to their length; labels other than allow and block
and null URLs in the labelled table are ignored; labels of one kind, or none, make every URL without a rule ``allow``; an empty
table gives no rows; further columns are kept, and the new ones get a leading ``_`` where the input has their names.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import free_name, table

GRAMS = (3, 4, 5)

# The rules of the contract.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]

# The small table that the query learns from, invented hosts of two kinds. Both kinds have the same paths.
BLOCKED_HOSTS = """
casino-royal.example.com www.best-casino.example.net online-casino-bonus.example.org casino-win-big.example.com win-jackpot.example.net poker-win.example.com free-poker.example.net bets-today.example.com
blog.sport-bets.example.net free-betting.example.org cheap-meds.example.com pills-online.example.net www.buy-pills.example.com cheap-viagra.example.net m.cheap-watches.example.com discount-pills.example.org
adult-video.example.net m.adult-chat.example.com xxx-cams.example.net adult-xxx.example.com porn-x.example.org hot-adult.example.net ads-server.example.com www.ads-network.example.net ad-track.example.com
clicks-track.example.org track-ads.example.net spam-mail.example.com www.link-farm.example.net content-farm.example.com spam-links.example.org free-money.example.net free-loans.example.com payday-loans.example.net
warez-free.example.com blog.spam-site.example.net
""".split()
ALLOWED_HOSTS = """
city-library.example.com www.museum.example.net gardener.example.org weather.example.com news.example.net university.example.com cooking.example.net wiki.example.com
blog.history.example.net the-school.example.org docs.example.com chess.example.net www.music.example.com travel-notes.example.net m.health.example.com science.example.org
parliament.example.net m.theatre.example.com mathematics.example.net birds.example.com forest.example.org transport.example.net kitchen.example.com www.sailing.example.net painting.example.com
letters.example.org bakery.example.net nature.example.com www.radio.example.net village.example.com astronomy.example.org tension.example.net thinking.example.com harbour.example.net
stations.example.com blog.other-motion.example.net
""".split()
PATHS = """
/en/12 /es/44/ /en/301.html /de/17 /en/2024 /research/ /fr/560 /page/rivers /en/900/ /de/15.html /guide.html /en/61
/es/77 /en/830/ /fr/19 /en/411.html /en/laws /fr/23 /de/510/ /en/95 /es/640.html /en/81 /de/5 /en/733/
/fr/402 /en/18.html /en/250 /de/39 /en/66/ /es/127 /en/1000 /en/52.html /fr/208 /en/11 /en/63/ /
""".split()
LABELLED = [(label, f"http://{host}{path}") for label, hosts in (("block", BLOCKED_HOSTS), ("allow", ALLOWED_HOSTS)) for host, path in zip(hosts, PATHS, strict=True)]


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fits(host: Column, path: Column, rule_host: Column, rule_path: Column) -> Column:
    return ((host == rule_host) | F.endswith(host, F.concat(F.lit("."), rule_host))) & F.startswith(path, rule_path)


def with_rules(sites: DataFrame, rules: list[tuple[str, str, str]], inline_rules: int) -> DataFrame:
    """``sites`` (with ``host`` and ``path``) and the rule that holds, as a struct (rule, verdict) or null, in ``held``."""
    ordered = sorted(set(rules), key=lambda r: (-len(r[0] + r[1]), r[2] != "block", r))
    if len(ordered) <= inline_rules:
        held = [F.when(fits(F.col("host"), F.col("path"), F.lit(h), F.lit(p)), F.struct(F.lit(h + p).alias("rule"), F.lit(v).alias("verdict"))) for h, p, v in ordered]
        return sites.withColumn("held", F.coalesce(*held) if held else F.lit(None).cast("struct<rule:string,verdict:string>"))
    known = sites.sparkSession.createDataFrame(ordered, "rule_host string, rule_path string, verdict string")
    known = known.withColumn("order", F.struct(-F.length(F.concat("rule_host", "rule_path")), F.col("verdict") != "block", "rule_host"))
    lengths = sorted({len(p) for _, p, _ in ordered})
    distinct = sites.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    beginnings = F.array_distinct(F.array(*[F.substring("path", 1, n) for n in lengths]))
    keys = distinct.select("host", "path", F.explode(parents).alias("rule_host"), beginnings.alias("beginnings")).select("host", "path", "rule_host", F.explode("beginnings").alias("rule_path"))
    held = keys.join(known, ["rule_host", "rule_path"]).groupBy("host", "path").agg(F.min_by(F.struct(F.concat("rule_host", "rule_path").alias("rule"), "verdict"), "order").alias("held"))
    return sites.join(held, ["host", "path"], "left")


def features(df: DataFrame, dims: int) -> DataFrame:
    """``df`` with the distinct features of ``host`` and ``path`` in ``f``."""
    made = df.withColumn("chars", F.transform(F.array(F.concat(F.lit("^"), "host", F.lit("$")), F.concat(F.lit("^"), "path", F.lit("$"))), lambda x: F.split(x, "")))

    def grams(part: int, n: int) -> Column:
        chars = F.get("chars", part)
        cut = F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.size(chars) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(cut, lambda i: F.pmod(F.xxhash64(F.lit(part), *[F.get(F.get("chars", part), i + j) for j in range(n)]), F.lit(dims)).cast("int"))

    return made.withColumn("f", F.array_distinct(F.concat(*[grams(part, n) for part in (0, 1) for n in GRAMS]))).drop("chars")


def margin(weights: list[float]) -> Column:
    """Bias and scaled sum of the weights of ``f``; the bias is the last weight."""
    w = F.from_json(F.lit("[" + ",".join(map(repr, weights)) + "]"), "array<double>")
    total = F.aggregate("f", F.lit(0.0), lambda acc, i: acc + F.get(w, i))
    return F.lit(weights[-1]) + total / F.sqrt(F.greatest(F.size("f"), F.lit(1)).cast("double"))


def fit(labelled: DataFrame, dims: int = 4096, steps: int = 25, rate: float = 8.0, decay: float = 1e-3, prior: float = 0.35) -> list[float] | None:
    """Weights and bias of the logistic regression; ``prior`` is the weight of the label ``block``. None without both labels."""
    rows = labelled.filter("url IS NOT NULL AND label IN ('allow', 'block')").select(host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), (F.col("label") == "block").alias("y"))
    n = {r.y: r.n for r in rows.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return None
    share = F.when(F.col("y"), prior / n[True]).otherwise((1 - prior) / n[False])
    rows = features(rows, dims).select("f", "y", share.alias("share")).cache()
    weights, speed = [0.0] * (dims + 1), [0.0] * (dims + 1)
    for _ in range(steps):
        slope = F.col("share") * (1 / (1 + F.exp(-margin(weights))) - F.col("y").cast("double"))
        each = rows.select("f", slope.alias("s"), (slope / F.sqrt(F.greatest(F.size("f"), F.lit(1)).cast("double"))).alias("g"))
        parts = each.select(F.explode(F.concat(F.transform("f", lambda i: F.struct(i.alias("i"), F.col("g").alias("g"))), F.array(F.struct(F.lit(dims).alias("i"), F.col("s").alias("g"))))).alias("x"))
        # At most dims + 1 rows come to the driver; rounding makes them independent of the order of addition.
        gradient = {r.i: r.g for r in parts.groupBy("x.i").agg(F.round(F.sum("x.g"), 12).alias("g")).collect()}
        for i in range(dims + 1):
            if i in gradient or speed[i] or weights[i]:
                speed[i] = 0.8 * speed[i] + gradient.get(i, 0.0) + (decay * weights[i] if i < dims else 0.0)
                weights[i] -= rate * speed[i] * (0.1 if i == dims else 1.0)
    rows.unpersist()
    return weights


def judge_urls(pages: DataFrame, rules: list[tuple[str, str, str]], labelled: DataFrame, inline_rules: int = 64, dims: int = 4096) -> DataFrame:
    """``pages`` with host, path, rule, verdict and the method's score (chance of ``block``, null where a rule holds)."""
    weights = fit(labelled, dims)
    own = {c: free_name(pages, c) for c in ("host", "path", "rule", "verdict", "score")}
    row = free_name(pages, "row")
    sites = pages.select(F.struct(*[F.col(f"`{c}`") for c in pages.columns]).alias(row), host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    sites = with_rules(sites, rules, inline_rules)
    score = 1 / (1 + F.exp(-margin(weights))) if weights else F.lit(0.0)
    judged = (features(sites, dims) if weights else sites).withColumn("score", F.when(F.col("held").isNull(), score))
    verdict = F.coalesce("held.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    new = {"host": F.col("host"), "path": F.col("path"), "rule": F.col("held.rule"), "verdict": verdict, "score": F.col("score")}
    return judged.select(*[F.col(f"`{row}`.`{c}`") for c in pages.columns], *[value.alias(own[c]) for c, value in new.items()])


def op13_url_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict on every page's URL."""
    labelled = spark.createDataFrame(LABELLED, "label string, url string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), RULES, labelled).select("page_id", "host", "path", "rule", "verdict", "score")
