"""Sharding by sampled splitters.

Every document gets the key (hash of its text, hash of its id). A size-weighted sample of the keys gives quantile
boundaries for many small ranges; exact bytes of each range are then counted. A range that holds more than its share
is cut again with a fresh sample of its own rows: between different texts where that suffices, inside a group of
equal texts only if the group alone is larger than a shard. The ranges are dealt to the shards largest first,
so the shards' bytes come out near equal. All counts are exact; only the boundaries depend on the sample.

What passes through the driver is bounded by parameters: about ``sample`` keys and about ``ranges`` range totals a round.

Ranges are cut until none is overfull; rows that share text and id can't be told apart and stay together.

Defined results: null text has size 1 and the checksum of the empty text; null ids hash as one value and are kept;
repeated rows get slots of their own; an empty table gives no rows; further columns of the input are ignored.
"""

from __future__ import annotations

import heapq
import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.llm.common import durable, table

KEY = "struct<t:bigint,d:bigint>"


def keyed(docs: DataFrame) -> DataFrame:
    """The few bytes of each row that the rest needs: id, size, checksum and the two key hashes."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 1).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.struct(F.xxhash64(text, F.lit(1)).alias("t"), F.xxhash64(F.col("doc_id"), F.lit(2)).alias("d")).alias("key"),
    )


def weighted_sample(keys: DataFrame, total: int, n: int, salt: int) -> list[tuple[int, int]]:
    """About ``n`` keys; a row is drawn with a chance in proportion to its size (``total`` bytes in all)."""
    u = F.pmod(F.xxhash64("key", F.lit(salt)), F.lit(1 << 52)).cast("double") / float(1 << 52)
    return sorted((r.key.t, r.key.d) for r in keys.filter(u < F.col("size") * (n / max(1, total))).select("key").collect())


def range_of(key: Column, splitters: list[tuple[int, int]]) -> Column:
    """How many splitters are at most ``key``: a binary search in a constant array."""
    if not splitters:
        return F.lit(0)
    width = 1 << max(0, (len(splitters)).bit_length())
    top = (1 << 63) - 1
    padded = splitters + [(top, top)] * (width - len(splitters))
    array = F.from_json(F.lit("[" + ",".join('{"t":%d,"d":%d}' % s for s in padded) + "]"), f"array<{KEY}>")
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(width.bit_length()))])
    found = F.aggregate(steps, F.lit(0), lambda at, step: at + F.when((at + step <= width) & (F.get(array, at + step - 1) <= key), step).otherwise(0))
    return F.least(found, F.lit(len(splitters)))


def totals(keys: DataFrame, splitters: list[tuple[int, int]]) -> dict[int, tuple[int, int, bool]]:
    """Bytes, rows and whether there is one text only, for each range."""
    rows = (
        keys.groupBy(range_of(F.col("key"), splitters).alias("cell"))
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("n"), (F.min("key.t") == F.max("key.t")).alias("one"))
        .collect()
    )
    return {r.cell: (r.bytes, r.n, r.one) for r in rows}


def find_cells(keys: DataFrame, shards: int, ranges: int, sample: int) -> tuple[list[tuple[int, int]], dict[int, tuple[int, int, bool]]]:
    """Splitters of fine ranges and the exact totals of each, overfull ranges cut again."""
    low = -(1 << 63)
    total = keys.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first().bytes
    drawn = weighted_sample(keys, total, sample, 0)
    step = max(1, len(drawn) // ranges)
    splitters = sorted({(t, low) for t, _ in drawn[step::step]})
    cells = totals(keys, splitters)
    for salt in itertools.count(1):
        wide = [c for c, (b, n, one) in cells.items() if n > 1 and not one and b > 4 * total / ranges]
        hot = [c for c, (b, n, one) in cells.items() if n > 1 and one and b > total / shards]
        if not wide and not hot:
            break
        part = keys.filter(range_of(F.col("key"), splitters).isin(wide + hot))
        again = weighted_sample(part, sum(cells[c][0] for c in wide + hot), sample, salt)
        step = max(1, len(again) // ranges)
        bounds = [(low, low), *splitters, (1 << 63, 0)]
        single = [(bounds[c], bounds[c + 1]) for c in hot]
        inside = lambda k: any(a <= k < b for a, b in single)
        heavy = {t for t, d in again if inside((t, d))}
        new = {(t, d) if t in heavy else (t, low) for t, d in again[step::step]}
        # A text that is large enough to be cut gets a range of its own first.
        new |= {(t + 1, low) for t, _ in again if t not in heavy and sum(x == t for x, _ in again[step::step]) > 1 and t < (1 << 63) - 1}
        if new <= {*splitters}:  # what is left are rows of one key, or one row
            break
        splitters = sorted({*splitters, *new})
        cells = totals(keys, splitters)
    return splitters, cells


def deal(cells: dict[int, tuple[int, int, bool]], shards: int) -> tuple[dict[int, int], dict[int, int]]:
    """Ranges to shards, largest first to the emptiest shard; the first slot of each range."""
    heap = [(0, s) for s in range(shards)]
    shard: dict[int, int] = {}
    for cell, (size, _, _) in sorted(cells.items(), key=lambda x: (-x[1][0], x[0])):
        full, s = heapq.heappop(heap)
        shard[cell] = s
        heapq.heappush(heap, (full + size, s))
    start, used = {}, [0] * shards
    for cell in sorted(cells):
        start[cell] = used[shard[cell]]
        used[shard[cell]] += cells[cell][1]
    return shard, start


def shard_documents(docs: DataFrame, shards: int = 8, ranges: int = 1024, sample: int = 16384) -> DataFrame:
    """Every row with its shard and its slot in the shard, under the law ``bytes``."""
    keys = durable(keyed(docs))
    splitters, cells = find_cells(keys, shards, ranges, sample)
    shard, start = deal(cells, shards)
    cell = F.col("cell")
    n = len(splitters) + 1
    of = lambda d: F.get(F.from_json(F.lit("[" + ",".join(str(d.get(i, 0)) for i in range(n)) + "]"), "array<bigint>"), cell)
    # Rows of a large range are numbered in several parts, so that no group of copies meets in one task.
    big = max([1, *(rows for _, rows, _ in cells.values())])
    mean = max(1, sum(rows for _, rows, _ in cells.values()) // max(1, len(cells)))
    parts = min(4096, max(1, big // (4 * mean)))
    placed = keys.withColumn("cell", range_of(F.col("key"), splitters)).withColumn("part", F.pmod(F.xxhash64("key.d", "doc_id", F.lit(3)), F.lit(parts)))
    within = Window.partitionBy("cell", "part").orderBy("key", "doc_id", "size")
    numbered = placed.withColumn("at", F.row_number().over(within) - 1)
    if parts > 1:
        before = placed.groupBy("cell", "part").count()
        before = before.withColumn("before", F.sum("count").over(Window.partitionBy("cell").orderBy("part")) - F.col("count")).drop("count")
        numbered = numbered.join(before, ["cell", "part"])
    else:
        numbered = numbered.withColumn("before", F.lit(0))
    return numbered.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        of(shard).cast("int").alias("shard"),
        (of(start) + F.col("before") + F.col("at")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_sampled_splitters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes."""
    return shard_documents(table(spark, sf_dir, "documents"), shards=8)
