"""Audits of the corpus, its files and its snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.ids import same_id


def findings(files: DataFrame, authorised: DataFrame | None) -> DataFrame:
    """(finding, file, detail) of a corpus: not on a list, no record, not validated, other identifier, repeated id or content.

    ``files``: file, recorded, validated, reason, expected_doi, detected_doi, sha256, gate. Without lists nothing is
    judged against them.
    """
    say = lambda df, name, detail: df.select(F.lit(name).alias("finding"), "file", detail.cast("string").alias("detail"))
    rows = files.withColumn("want", same_id(F.col("expected_doi"))).withColumn("have", same_id(F.col("detected_doi")))
    read = rows.filter("recorded")
    out = say(rows.filter("NOT recorded"), "sem_sidecar", F.lit(None))
    out = out.unionByName(say(read.filter(~F.coalesce("validated", F.lit(False))), "nao_validado", F.col("reason")))
    out = out.unionByName(say(read.filter("want <> have"), "doi_divergente", F.concat_ws(" ", "want", "have")))
    out = out.unionByName(say(read.filter("want IS NULL"), "fora_da_lista", F.lit("(no id asked)")))
    if authorised is not None:
        known = authorised.select(same_id(F.col("doi")).alias("want")).filter("want IS NOT NULL").distinct()
        # An empty list judges nothing: one row tells whether there is any.
        some = known.agg((F.count("*") > 0).alias("some"))
        strange = read.filter("want IS NOT NULL").join(known, "want", "left_anti").join(F.broadcast(some), F.col("some"))
        out = out.unionByName(say(strange, "fora_da_lista", F.col("want")))
    if "gate" in files.columns:
        out = out.unionByName(say(read.filter("gate IS NOT NULL"), "conteudo_suspeito", F.col("gate")))
    for name, key in (("doi_duplicado", "want"), ("conteudo_duplicado", "sha256")):
        twice = read.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).filter("n > 1").select(key)
        out = out.unionByName(say(read.join(twice, key, "left_semi"), name, F.col(key)))
    return out


def finding_counts(found: DataFrame) -> DataFrame:
    return found.groupBy("finding").agg(F.count("*").alias("n"))


def methods(files: DataFrame) -> DataFrame:
    return files.filter("recorded").groupBy(F.coalesce("method", F.lit("?")).alias("method")).agg(F.count("*").alias("n"))


def unlisted(corpus: DataFrame, authorised: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(in the corpus but on no list, on a list but not in the corpus)."""
    a, b = corpus.select(same_id(F.col("doi")).alias("doi")).distinct(), authorised.select(same_id(F.col("doi")).alias("doi")).distinct()
    return a.join(b, "doi", "left_anti"), b.join(a, "doi", "left_anti")


def orphan_texts(stored: DataFrame, articles: DataFrame) -> DataFrame:
    """Stored texts (key, project, doi, bytes) whose record never entered the corpus; only keys under their own project."""
    own = stored.filter(F.startswith("key", F.concat(F.col("project"), F.lit("/"))))
    return own.withColumn("k", same_id(F.col("doi"))).join(articles.select(same_id(F.col("doi")).alias("k")).filter("k IS NOT NULL"), "k", "left_anti").drop("k")


def released(orphans: DataFrame) -> DataFrame:
    return orphans.groupBy("project").agg(F.count("*").alias("texts"), F.sum("bytes").alias("bytes"))


def storage(documents: DataFrame) -> DataFrame:
    """Bytes and files of each project."""
    return documents.groupBy("project").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


def team_sizes(members: DataFrame, projects: DataFrame) -> DataFrame:
    """Accepted members and the owner of each project."""
    n = members.filter("status = 'accepted'").groupBy("project").agg(F.count_distinct("email").alias("n"))
    return projects.select("project").join(n, "project", "left").select("project", (F.coalesce("n", F.lit(0)) + 1).alias("people"))


def roles(projects: DataFrame, members: DataFrame, actor: str) -> DataFrame:
    """The projects an actor sees, as owner or else by an accepted membership."""
    mine = members.filter((F.col("email") == actor) & (F.col("status") == "accepted")).select("project", "role")
    out = projects.join(mine, "project", "left")
    return out.select("project", "name", F.when(F.col("owner") == actor, "owner").otherwise(F.col("role")).alias("role")).filter("role IS NOT NULL")


def invitations(members: DataFrame, projects: DataFrame, actor: str) -> DataFrame:
    return members.filter((F.col("email") == actor) & (F.col("status") == "pending")).join(projects.select("project", "name"), "project").select("project", "name", "role")


def snapshot_changes(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """(key, change): rows added, removed or changed between two snapshots of the same columns."""
    digest = lambda df, name: df.select(key, F.xxhash64(*[F.col(f"`{c}`") for c in sorted(df.columns) if c != key]).alias(name))
    both = digest(before, "b").join(digest(after, "a"), key, "full_outer")
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return both.select(key, change.alias("change")).filter("change IS NOT NULL")


def invalidated(changes: DataFrame, children: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """Child tables without the rows of the articles in ``changes`` (id)."""
    gone = changes.select("id").distinct()
    return {name: df.join(gone.withColumnRenamed("id", key), key, "left_anti") for name, (df, key) in children.items()}


def once_by_content(files: DataFrame) -> DataFrame:
    """Local files, the first of each content."""
    digest = F.sha2("content", 256)
    return files.withColumn("sha256", digest).groupBy("sha256").agg(F.min("id").alias("id"), F.count("*").alias("copies"))


def file_validity(files: DataFrame, least: int = 1024, most: int = 50 * 1024 * 1024) -> DataFrame:
    """Files (id, content, length) with ``problem``: size, missing header or missing end mark, else null."""
    head = F.decode(F.substring("content", 1, 4), "ISO-8859-1")
    tail = F.decode(F.substring("content", -8192, 8192), "ISO-8859-1")
    problem = F.when(F.col("length") < least, "too small").when(F.col("length") > most, "too large").when(head != "%PDF", "no header").when(~tail.contains("%%EOF"), "no end mark")
    return files.withColumn("problem", problem)
