"""Writers of tables, lists, bibliographies, reports and bundles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.functions.text import csv_safe


def csv_rows(table: DataFrame) -> DataFrame:
    """All cells as text that a spreadsheet won't run."""
    return table.select(*[csv_safe(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))).alias(c) for c in table.columns])


def write_csv(table: DataFrame, path: str, sep: str = ";", mode: str = "overwrite") -> None:
    csv_rows(table).write.mode(mode).option("header", True).option("sep", sep).option("quoteAll", True).option("escape", '"').csv(path)


def question_extracts(answers: DataFrame) -> DataFrame:
    """(question, article, answer, snippets) without empty answers and those that don't apply."""
    given = F.upper(F.trim("answer"))
    return answers.filter(F.coalesce(given, F.lit("")) != "").filter(~given.isin("N/A", "NAP")).select("question", "article", "answer", "snippets")


def write_question_extracts(answers: DataFrame, path: str, mode: str = "overwrite") -> None:
    question_extracts(answers).repartition("question").write.mode(mode).partitionBy("question").json(path)


def bibtex_entries(records: DataFrame) -> DataFrame:
    """(doi, entry) of validated records, one for each id."""
    field = lambda n, c: F.when(F.coalesce(F.trim(c), F.lit("")) != "", F.concat(F.lit(f"  {n} = {{"), F.regexp_replace(c, r"[{}]", ""), F.lit("}")))
    key = F.concat(F.lit("ref_"), F.regexp_replace("doi", r"[^A-Za-z0-9]+", "_"))
    body = F.concat_ws(",\n", field("doi", F.col("doi")), field("title", F.col("title")), field("author", F.col("authors")), field("journal", F.col("journal")), field("year", F.col("year")))
    once = records.filter("identity_validated").groupBy("doi").agg(F.min(F.struct("title", "authors", "journal", "year")).alias("r")).select("doi", "r.*")
    return once.select("doi", F.concat(F.lit("@article{"), key, F.lit(",\n"), body, F.lit("\n}")).alias("entry"))


def write_bibtex(records: DataFrame, path: str, written: DataFrame | None = None) -> None:
    """Append the entries whose id isn't among those ``written`` before."""
    entries = bibtex_entries(records)
    entries = entries if written is None else entries.join(written.select("doi"), "doi", "left_anti")
    entries.orderBy("doi").select("entry").write.mode("append").text(path)


def search_lists(found: DataFrame) -> dict[str, DataFrame]:
    """The four lists of a search (doi, title): ids, titles without id, both, and links."""
    ids = found.filter("doi IS NOT NULL").select("doi").distinct()
    titles = found.filter("doi IS NULL AND title IS NOT NULL").select("title").distinct()
    return {
        "ids": ids.orderBy("doi").select(F.col("doi").alias("value")),
        "without_id": titles.orderBy("title").select(F.col("title").alias("value")),
        "combined": ids.select(F.lit(0).alias("k"), F.col("doi").alias("value")).unionByName(titles.select(F.lit(1).alias("k"), F.col("title").alias("value"))).orderBy("k", "value").select("value"),
        "links": ids.orderBy("doi").select(F.concat(F.lit("https://doi.org/"), "doi").alias("value")),
    }


def write_search_lists(found: DataFrame, path: str) -> None:
    for name, rows in search_lists(found).items():
        rows.write.mode("overwrite").text(f"{path}/{name}")


def report_lines(counts: DataFrame, title: str) -> DataFrame:
    """(n, value): a heading and a line for each (label, value) of a report table."""
    rows = counts.select(F.concat_ws(": ", F.col("label"), F.col("value").cast("string")).alias("value"))
    head = counts.sparkSession.createDataFrame([(0, f"# {title}"), (1, "")], "n long, value string")
    from pyspark.sql.window import Window

    return head.unionByName(rows.select((F.row_number().over(Window.orderBy("value")) + 1).cast("long").alias("n"), "value"))


def write_report(counts: DataFrame, title: str, path: str) -> None:
    report_lines(counts, title).orderBy("n").select("value").coalesce(1).write.mode("overwrite").text(path)


def bundle_manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, rows, checksum) of the tables of a snapshot; the checksum doesn't depend on order of rows or columns.

    It adds up 60 bits of each row's digest, so that another system can check it: MD5 of the cells as text, by column name.
    """
    cell = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\x1e"))
    digest = lambda t: F.conv(F.left(F.md5(F.concat_ws("\x1f", *[cell(c) for c in sorted(t.columns)])), F.lit(15)), 16, 10).cast("decimal(38,0)")
    parts = [t.agg(F.lit(name).alias("name"), F.count("*").alias("rows"), F.coalesce(F.sum(digest(t)), F.lit(0)).cast("string").alias("checksum")) for name, t in sorted(tables.items())]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def export_bundle(tables: dict[str, DataFrame], path: str) -> None:
    for name, t in tables.items():
        t.write.mode("overwrite").parquet(f"{path}/{name}")
    bundle_manifest(tables).write.mode("overwrite").json(f"{path}/manifest")


def restore_bundle(spark: SparkSession, path: str, names: list[str]) -> tuple[dict[str, DataFrame], DataFrame]:
    """The bundle's tables, and the manifest lines that don't hold (none if it is whole)."""
    tables = {name: spark.read.parquet(f"{path}/{name}") for name in names}
    told = spark.read.schema("name string, rows long, checksum string").json(f"{path}/manifest")
    return tables, told.join(bundle_manifest(tables), ["name", "rows", "checksum"], "left_anti")


def restore_problems(articles: DataFrame, documents: DataFrame, ledger: DataFrame) -> DataFrame:
    """(problem, key): repeated ids, documents and decisions that refer to nothing."""
    say = lambda df, problem, key: df.select(F.lit(problem).alias("problem"), F.col(key).cast("string").alias("key"))
    twice = lambda df, key: df.groupBy(key).count().filter("count > 1")
    lost = documents.select(F.col("article").alias("id")).join(articles, "id", "left_anti").distinct()
    absent = articles.filter("has_document").join(documents.select(F.col("article").alias("id")), "id", "left_anti")
    return say(twice(articles, "id"), "repeated article", "id").unionByName(say(twice(ledger, "doi"), "repeated decision", "doi")).unionByName(say(lost, "document without article", "id")).unionByName(say(absent, "article without document", "id"))
