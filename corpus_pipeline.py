"""The corpus pipeline: each stage reads what the one before has written.

Defined results, in all stages: extra columns stay, whatever their names; an empty table gives an empty one. Null or empty
texts and texts without a letter go in the language stage, since no language is recognised. Rows that share a doc_id but not a
text, and rows with a null id, are documents of their own in all stages: what one loses, or that it goes, costs no other. Rows that
share both are one document in the line stage, and one of them stays in the near-copy stage. The order of rows doesn't matter.
Very long texts are treated whole.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm import bagminhash, bpe, decontaminate, langid, lines
from sievework.llm.common import Scratch, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised; text without letters and undecided texts go."""
    model, (lang, score) = langid.fit(langid.training_rows(docs)), langid.new_columns(docs)
    return langid.predict(docs, model, keep=docs.columns).filter((F.col(lang) != "und") & (F.col(score) >= 0.5)).select(*docs.columns)


def repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier one has; ``n_chars`` follows the text."""
    return lines.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies."""
    return bagminhash.drop_near_copies(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the texts that are left."""
    return bpe.digest_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [("language", language), ("repeated_lines", repeated_lines), ("near_copies", near_copies), ("benchmark_leaks", benchmark_leaks), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what lies between them is written to the shared folder."""
    docs, read = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        written = Scratch(spark)
        docs = written.write(stage(spark, docs, sf_dir))
        if read is not None:  # nothing reads the table before last any more
            read.remove()
        read = written
    return STAGES[-1][1](spark, docs, sf_dir)


#: The hashing stages and the tokenizer have no SQL; the tests compare the pipeline with brute force.
ORACLE_SQL = None
