"""Scans of full-text folders, identity records and logs."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ATTEMPT_LOG = "at timestamp, doi string, situation string, source string, file string"
RUN_EVENT = "event string, run string, item string, status string, source string, code string, ms double, pass int, at timestamp"


def read_corpus_text(spark: SparkSession, path: str) -> DataFrame:
    """(folder, article_id, filename, text_quality, hash, text) of folders that hold metadata.json and content.md."""
    folder = F.regexp_extract(F.col("_metadata.file_path"), r"^(.*)/[^/]+$", 1).alias("folder")
    meta = spark.read.schema("article_id string, filename string, text_quality string, hash string").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "metadata.json").json(path).select(folder, "*")
    text = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "content.md").text(path).select(folder, F.col("value").alias("text"))
    return meta.join(text, "folder", "left")


def read_identity_records(spark: SparkSession, path: str, suffix: str = ".identity.json") -> DataFrame:
    """One row per file with its identity record, or ``missing`` or ``unreadable``."""
    schema = "identity_validated boolean, validation_method string, validation_score double, reason string, detected_doi string, sha256 string, expected struct<doi:string,title:string,author:string,journal:string,year:string>, _corrupt_record string"
    name = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)$", 1)
    records = spark.read.schema(schema).option("multiLine", True).option("columnNameOfCorruptRecord", "_corrupt_record").option("pathGlobFilter", "*" + suffix).json(path).select(F.regexp_replace(name, re.escape(suffix) + "$", "").alias("file"), "*")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("file"), F.col("length").alias("bytes"))
    state = F.when(F.col("identity_validated").isNull() & F.col("expected").isNull() & F.col("_corrupt_record").isNull(), "missing").when(F.col("_corrupt_record").isNotNull(), "unreadable").otherwise("read")
    return files.join(records, "file", "left").withColumn("record", state)


def read_attempt_log(spark: SparkSession, path: str) -> DataFrame:
    """The tab-separated retrieval log; a dash is an absent value."""
    log = spark.read.schema(ATTEMPT_LOG).option("sep", "\t").csv(path)
    return log.select(*[F.nullif(c, F.lit("-")).alias(c) if t == "string" else F.col(c) for c, t in log.dtypes])


def read_run_events(spark: SparkSession, path: str) -> DataFrame:
    """The run's event log, a JSON object a line."""
    return spark.read.schema(RUN_EVENT).json(path)


def _parsed(least: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import xml.etree.ElementTree as tree

        tail = lambda tag: tag.rsplit("}", 1)[-1].lower() if isinstance(tag, str) else ""
        inner = lambda node: re.sub(r"\s+", " ", "".join(node.itertext())).strip()
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    nodes = list(tree.fromstring(content).iter())
                except tree.ParseError:
                    rows.append((path, None, None, None, None, "not XML"))
                    continue
                first = lambda *names: next((t for n in nodes if tail(n.tag) in names and (t := inner(n))), "")
                surnames = [inner(n) for n in nodes if tail(n.tag) == "surname"][:10]
                skip = {id(x) for n in nodes if tail(n.tag) in ("abstract", "ref-list", "bibliography") for x in n.iter()}
                paragraphs = [t for n in nodes if tail(n.tag) in ("p", "para", "simple-para") and id(n) not in skip and (t := inner(n))]
                problem = None if sum(map(len, paragraphs)) >= least else "short body"
                rows.append((path, first("article-title", "title"), surnames, first("abstract"), paragraphs, problem))
            yield pd.DataFrame(rows, columns=["path", "title", "authors", "abstract", "paragraphs", "problem"])

    return run


def read_fulltext_xml(spark: SparkSession, path: str, least: int = 2000) -> DataFrame:
    """(path, title, authors, abstract, paragraphs) of article XML; files of ``fulltext_problems`` go."""
    return _articles(spark, path, least).filter("problem IS NULL").drop("problem")


def fulltext_problems(spark: SparkSession, path: str, least: int = 2000) -> DataFrame:
    """(path, problem) of files that aren't XML, or whose body is shorter than ``least`` characters."""
    return _articles(spark, path, least).filter("problem IS NOT NULL").select("path", "problem")


def _articles(spark: SparkSession, path: str, least: int) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.xml").load(path).select("path", "content")
    return files.mapInPandas(_parsed(least), "path string, title string, authors array<string>, abstract string, paragraphs array<string>, problem string")
