"""Streaming forms of the log jobs: DataFrame to DataFrame, and one way to run them to the end of what is there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from sievework.functions.ids import join_by_id
from sievework.operators.retrieval import BEFORE_ALL, COOLDOWN_AFTER, COOLDOWN_SECONDS, MOST_RETRY_AFTER, cooldowns, stretch_begins, stretch_ends

#: The column that tells a row's micro-batch.
BATCH = "__batch"


def work_folder(spark: SparkSession) -> str:
    """A folder of its own below ``spark.checkpoint.dir``; a local session that names none (a test) gets a temporary one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{shared or tempfile.mkdtemp(prefix='sievework-')}/stream-{uuid.uuid4().hex}"


def _remove(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run_available(stream: DataFrame, mode: str = "append", keys: list[str] = (), upsert: Callable[[DataFrame, int], DataFrame] | None = None, conf: dict[str, str] | None = None, schema: str | None = None) -> DataFrame:
    """Run a stream over all that is available and return what it wrote.

    Each micro-batch writes a folder of its own number, so one that is replayed after a crash is there once. Append mode
    returns all rows; update mode the last row for each of ``keys``, of which a micro-batch writes only those that changed;
    complete mode keeps the last state, whose predecessor goes once it is written. ``schema`` is that of what ``upsert`` makes,
    if it isn't the stream's own.
    """
    spark, folder = stream.sparkSession, work_folder(stream.sparkSession)

    def write(batch: DataFrame, n: int) -> None:
        rows = batch if upsert is None else upsert(batch, n)
        rows.write.mode("overwrite").parquet(numbered_folder(f"{folder}/out", n))
        if mode == "complete":
            _remove(spark, numbered_folder(f"{folder}/out", n - 1))

    before = {k: spark.conf.get(k, None) for k in conf or {}}
    for k, v in (conf or {}).items():
        spark.conf.set(k, v)
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(write).start().awaitTermination()
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    return read_batches(spark, f"{folder}/out", stream if schema is None else spark.createDataFrame([], schema), mode, keys)


def numbered_folder(folder: str, n: int) -> str:
    """Where micro-batch ``n`` writes."""
    return f"{folder}/{BATCH}={n}"


def read_batches(spark: SparkSession, folder: str, rows: DataFrame, mode: str = "append", keys: list[str] = ()) -> DataFrame:
    """What micro-batches have written below ``folder``, as ``run_available`` describes it. ``rows`` has its columns."""
    whole = spark.read.schema(StructType([*rows.schema.fields, StructField(BATCH, LongType())])).parquet(folder)
    if mode == "complete":
        last = whole.agg(F.max(BATCH).alias(BATCH))
        whole = whole.join(F.broadcast(last), BATCH)
    elif mode == "update":
        kept = F.max_by(F.struct(*[c for c in rows.columns if c not in keys]), BATCH)
        whole = whole.groupBy(*keys).agg(kept.alias("r")).select(*keys, "r.*")
    return whole.select(*rows.columns)


def events_stream(spark: SparkSession, sf_dir: str, bytes_a_batch: int = 1 << 30) -> DataFrame:
    """The events table as a file stream, with a real event time.

    A micro-batch has a fixed price, so its size is counted in bytes: their number doesn't grow with the number of files.
    """
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("maxBytesPerTrigger", bytes_a_batch).parquet(f"{sf_dir}/event[s].parquet")
    return stream.withColumn("at", F.col("ts").cast("timestamp"))


def run_progress(events: DataFrame) -> DataFrame:
    """Per run: items that are ok, cached, failed and done so far (complete mode)."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    return events.groupBy("run").agg(is_("ok").alias("ok"), is_("cached").alias("cached"), is_("failed").alias("failed"), F.count("*").alias("done"))


def superseded(events: DataFrame) -> DataFrame:
    """Per item the outcome that counts: a success replaces a failure, else the first pass stands (update mode by item)."""
    best = F.max_by(F.struct("success", "source", "pass"), F.struct(F.col("success").cast("int"), -F.col("pass"), -F.col("seq")))
    return events.groupBy("item").agg(best.alias("r")).select("item", "r.*")


def failure_rate(events: DataFrame, delay: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """Per host and window: attempts and transient failures; late rows beyond the watermark are left out (append mode)."""
    rows = events.withWatermark("at", delay)
    return rows.groupBy(F.window("at", width).alias("w"), "host").agg(F.count("*").alias("attempts"), F.count_if("transient").alias("failures")).select(F.col("w.start").alias("start"), "host", "attempts", "failures")


def once(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events without repeats of a fingerprint within the watermark (append mode)."""
    return events.withWatermark("at", delay).dropDuplicatesWithinWatermark(["fingerprint"])


def live_worklist(records: DataFrame, ledger: DataFrame, current: int) -> DataFrame:
    """New records as they arrive, joined with the ledger as it stands (append mode)."""
    from sievework.operators.screening import in_force

    rows = join_by_id(records.filter(F.col("found") & F.col("status").isin("done", "partial")), ledger.select("doi", "decision", "version"))
    return rows.withColumn("situation", in_force(F.col("decision"), F.col("version"), current)).drop("decision", "version")


#: Settings that a stream with timers needs.
TIMERS = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


def _milliseconds(at: Column) -> Column:
    return F.unix_millis(at)


class _Waiting(StatefulProcessor):
    """Keeps a key's rows until the watermark has passed them, then takes them in order; so the state is bounded by the delay."""

    row = ""  # columns of a waiting row; the first one, ``ms``, is its event time

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.row)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows))[[c.split()[0] for c in self.row.split(", ")]]
        self.waiting.appendList([tuple(None if pd.isna(v) else v for v in r) for r in new.astype(object).itertuples(index=False)])
        self.handle.registerTimer(int(new["ms"].min()))
        yield self.out([])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        rows = [tuple(r) for r in self.waiting.get()]
        passed, later = [r for r in rows if r[0] <= now], [r for r in rows if r[0] > now]
        self.waiting.clear()
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(min(r[0] for r in later))
        yield self.out(self.take(key[0], passed))

    def out(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({c: pd.Series([r[i] for r in rows], dtype=t) for i, (c, t) in enumerate(self.columns.items())})

    def close(self) -> None:
        pass


class _Streaks(_Waiting):
    row = "ms long, seq long, success boolean, retry_after double"
    columns = {"host": "str", "seq": "int64", "streak": "int64", "seconds": "int32"}

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.streak = handle.getValueState("streak", "n long")

    def take(self, host: str, rows: list[tuple]) -> list[tuple]:
        n, found = self.streak.get()[0] if self.streak.exists() else 0, []
        for _, seq, success, retry_after in sorted(rows, key=lambda r: r[1]):
            n = 0 if success else n + 1
            if not success and retry_after is not None and retry_after > 0:
                found.append((host, seq, n, int(min(retry_after, MOST_RETRY_AFTER))))
            elif n >= COOLDOWN_AFTER:
                found.append((host, seq, n, COOLDOWN_SECONDS[min(n - COOLDOWN_AFTER, len(COOLDOWN_SECONDS) - 1)]))
        if rows:
            self.streak.update((n,))
        return found


def cooldown_stream(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Cooldowns as ``retrieval.cooldowns`` finds them, once the watermark has passed (append mode; run with ``TIMERS``).

    ``events``: host, seq, success, at and, if known, retry_after; ``seq`` rises with ``at``. Rows may come in any order, within
    a micro-batch and across them, as far as ``delay`` goes; later ones are left out. A host's waiting rows go through one task:
    ``run_cooldowns`` is the form for hosts with many rows.
    """
    asked = F.col("retry_after").cast("double") if "retry_after" in events.columns else F.lit(None).cast("double")
    rows = events.withWatermark("at", delay).select("at", "host", "seq", "success", asked.alias("retry_after"), _milliseconds(F.col("at")).alias("ms"))
    return rows.groupBy("host").transformWithStateInPandas(_Streaks(), "host string, seq long, streak long, seconds int", "append", "eventTime")


def cooldown_batches(folder: str, delay: str = "1 hour", stretch: int = 10_000) -> Callable[[DataFrame, int], DataFrame]:
    """An ``upsert`` for ``run_available`` that finds cooldowns as ``cooldown_stream`` does, a host in as many tasks as it has stretches.

    Each micro-batch keeps three tables below ``folder``: the watermark, the rows that it hasn't passed yet, and the streak
    that each host is left with. It reads those of the micro-batch before, which stay until the next one, so it can be replayed.
    """

    def found(batch: DataFrame, n: int) -> DataFrame:
        spark = batch.sparkSession

        def before(table: str) -> DataFrame:
            return spark.read.parquet(numbered_folder(f"{folder}/{table}", n - 1))

        def kept(table: str, rows: DataFrame) -> DataFrame:
            path = numbered_folder(f"{folder}/{table}", n)
            rows.write.mode("overwrite").parquet(path)
            _remove(spark, numbered_folder(f"{folder}/{table}", n - 2))
            return spark.read.schema(rows.schema).parquet(path)

        micros, rows = F.unix_micros(F.col("at")), batch.filter("at IS NOT NULL")
        mark = rows.agg(F.unix_micros(F.max("at") - F.expr(f"INTERVAL {delay}"))).first()[0]
        old = before("mark").first()[0] if n else None
        if old is not None:
            rows, mark = rows.filter(micros > old), old if mark is None else max(mark, old)
        if n:
            rows = rows.unionByName(before("waiting"))
        kept("mark", spark.range(1).select(F.lit(mark).cast("long").alias("mark")))
        kept("waiting", rows.filter(micros > F.lit(mark)))
        passed = rows.filter(micros <= F.lit(mark)).drop("at")
        ends = stretch_ends(passed, stretch)
        if n:
            ends = ends.unionByName(before("left").select("host", F.lit(BEFORE_ALL).alias("at"), F.lit(False).alias("clears"), "left"))
        begins = kept("begins", stretch_begins(ends))
        kept("left", begins.groupBy("host").agg(F.max_by("leaves", "at").alias("left")))
        return cooldowns(passed, stretch, begins)

    return found


def run_cooldowns(events: DataFrame, delay: str = "1 hour", stretch: int = 10_000) -> DataFrame:
    """What ``cooldown_stream`` would write over all that is available, for hosts with any number of rows (``events`` as there)."""
    asked = F.col("retry_after").cast("double") if "retry_after" in events.columns else F.lit(None).cast("double")
    rows = events.select("at", "host", "seq", "success", asked.alias("retry_after"))
    state = f"{work_folder(events.sparkSession)}/state"
    return run_available(rows, upsert=cooldown_batches(state, delay, stretch), schema="host string, seq long, streak long, seconds int")


class _Leases(StatefulProcessor):
    """An item's newest row by event time, and a timer for the end of its lease."""

    def __init__(self, seconds: int):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.newest = handle.getValueState("newest", "ms long, running boolean")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:
        new = max((int(ms), bool(running)) for part in rows for ms, running in zip(part["ms"], part["running"], strict=True))
        old = tuple(self.newest.get()) if self.newest.exists() else None
        if old is None or new > old:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.newest.update(new)
            # What isn't running is remembered as long as an older row may still come.
            self.handle.registerTimer(new[0] + self.seconds * 1000 if new[1] else new[0] + 1)
        yield self.out([])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:
        ms, running = self.newest.get()
        self.newest.clear()
        yield self.out([(key[0], pd.Timestamp(ms, unit="ms"))] if running else [])

    def out(self, rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame({"doi": pd.Series([r[0] for r in rows], dtype=str), "since": pd.Series([r[1] for r in rows], dtype="datetime64[us]")})

    def close(self) -> None:
        pass


def expired_leases(items: DataFrame, seconds: int = 180, delay: str = "1 minute") -> DataFrame:
    """Items left ``running`` for longer than the lease by event time (append mode; run with ``TIMERS``).

    The newest row of an item counts, in whatever micro-batch it comes within ``delay``.
    """
    rows = items.withWatermark("at", delay).select("at", "doi", _milliseconds(F.col("at")).alias("ms"), (F.col("status") == "running").alias("running"))
    return rows.groupBy("doi").transformWithStateInPandas(_Leases(seconds), "doi string, since timestamp", "append", "eventTime")


def claimable(items: DataFrame, now: Column, seconds: int = 180) -> DataFrame:
    """The batch form: running items whose last update is older than the lease."""
    return items.filter((F.col("status") == "running") & (F.col("updated") < now - F.expr(f"interval {seconds} seconds")))


def change_feed(before: DataFrame, folder: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` writer that adds the batch to the trail and its changes against ``before`` beside it, each in the batch's folder: a replay writes them anew."""
    from sievework.operators.audit import snapshot_changes

    def write(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/trail/batch={n}")
        snapshot_changes(before.join(batch.select("id"), "id", "left_semi"), batch).write.mode("overwrite").parquet(f"{folder}/changes/batch={n}")

    return write
