"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD_GAP = r"[^\p{L}\p{N}]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given Parquet tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_folder(spark: SparkSession) -> str:
    """The shared folder that the cluster names in ``spark.checkpoint.dir``; a local session that names none (a test) gets a temporary one."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if shared is None and not sc.master.startswith(("local[", "local,")) and sc.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="sievework-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    work_folder(df.sparkSession)
    return df.checkpoint(eager=True)


class Scratch:
    """Tables in a folder of their own below the shared one; columns that a later step doesn't need aren't read again."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.n = spark, f"{work_folder(spark)}/tables-{uuid.uuid4().hex}", 0

    def write(self, df: DataFrame) -> DataFrame:
        """``df``, written and read back. Its partitioning is forgotten, so that a later join can split a hot key."""
        self.n += 1
        path = f"{self.folder}/{self.n}"
        df.write.option("parquet.block.size", 16 << 20).parquet(path)  # small row groups: a writer's buffers count in its executor
        return self.spark.read.schema(df.schema).parquet(path)

    def remove(self) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Scratch]:
    """Tables for the steps of one job, removed at its end; what the job returns must be checkpointed by then."""
    tables = Scratch(spark)
    try:
        yield tables
    finally:
        tables.remove()


def handing_back(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInPandas``, giving what it has freed back to the system at its end: workers wait for their next task in the same process."""

    def wrapped(batches: Iterator) -> Iterator:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return wrapped


def normal_words(text: Column) -> Column:
    """Lower-case letter and digit runs joined by single spaces; empty for null text."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), WORD_GAP, " "))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (null ids count as the empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted
