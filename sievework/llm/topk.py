"""Exact top-k inner-product search by distributed histogram selection.

Each round scores every candidate against a block of queries, counts the scores by bin, and adds the counts over all
partitions; the bin that holds the kth score is cut into finer bins until it is one score wide. A last pass keeps
the candidates at or above that score and breaks ties by the smaller id. A partition reports no bin below its own kth
score: those counts can't move the kth value. So rows that leave a batch are bounded by queries times k.

Queries are handled in blocks of ``block`` vectors; only such a block is sent to the executors, so what is broadcast
is bounded by ``block`` times the dimension. Scores are exact integers.

Defined results: vectors that are null or hold null or non-finite components take no part; a query with fewer than k
candidates gets all of them; vectors of another length than the query's aren't compared with it; rows that share a
vec_id, and rows that repeat it with its vector, are queries and candidates of their own: every row but the query's own is
a candidate, and each of several equal queries gets its rows (a query that isn't in the table is taken for the first row that equals it in both); scores beyond a long are clipped to its range; an empty
table gives no rows; other columns are ignored; rows with a null vec_id take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.llm.common import durable, table

BINS = 256
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def as_integers(vectors: pd.Series) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Row numbers and floor(1024 x) of the usable vectors, by dimension."""
    by_dim: dict[int, tuple[list[int], list[np.ndarray]]] = {}
    for i, v in enumerate(vectors):
        if v is not None and len(v):
            x = np.floor(np.asarray(v, dtype=np.float64) * 1024)
            if np.isfinite(x).all():
                rows, values = by_dim.setdefault(len(x), ([], []))
                rows.append(i)
                values.append(x)
    return {d: (np.array(rows), np.stack(values)) for d, (rows, values) in by_dim.items()}


def exact_scores(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Integer inner products, in doubles while those are exact."""
    bound = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * q.shape[1]
    if bound < 2**53:
        return (q @ c.T).astype(np.int64)
    if bound < 2**63:
        return q.astype(np.int64) @ c.astype(np.int64).T
    whole = lambda m: np.array([[int(x) for x in row] for row in m], dtype=object)
    return np.clip(whole(q) @ whole(c).T, LEAST, MOST).astype(np.int64)


class Block:
    """A bounded block of queries with the open score interval of each."""

    def __init__(self, ids: list[int], vectors: list[list[float]]):
        self.ids = np.array(ids, dtype=np.int64)
        self.parts = as_integers(pd.Series(vectors, dtype=object))

    def scores(self, batch: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(query rows, candidate ids, scores, mask of the rows that equal the query)."""
        for dim, (rows, c) in as_integers(batch["embedding"]).items():
            if dim in self.parts:
                own, q = self.parts[dim]
                ids = batch["vec_id"].to_numpy()[rows]
                same = self.ids[own][:, None] == ids[None, :]
                for i, j in zip(*np.nonzero(same), strict=True):  # another row may have the query's id
                    same[i, j] = np.array_equal(q[i], c[j])
                yield own, ids, exact_scores(q, c), same


def kth_largest(values: np.ndarray, k: int) -> int:
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) > k else int(values.min())


def histogram(block: Block, bounds: dict[int, tuple[int, int]], k: int):
    """Per batch and query: counts of the scores by bin; ``bin`` -1 holds what lies above the interval."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for own, _, scores, _ in block.scores(batch):
                for row, s in zip(own, scores, strict=True):
                    low, width = bounds[int(row)]
                    s = s[s >= max(low, kth_largest(s, k))]
                    over = (s.astype(np.uint64) - np.int64(low).astype(np.uint64)) // np.uint64(width)
                    bins, n = np.unique(np.where(over >= BINS, -1, over.astype(np.int64)), return_counts=True)
                    out.append(pd.DataFrame({"row": int(row), "bin": bins, "n": n}))
            if out:
                yield pd.concat(out)

    return run


def extremes(block: Block, k: int):
    """Per batch and query: largest score, the least that its own first k need, and the number of candidates."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for own, _, scores, _ in block.scores(batch):
                rows = [(int(r), kth_largest(s, k), int(s.max()), len(s)) for r, s in zip(own, scores, strict=True)]
                yield pd.DataFrame(rows, columns=["row", "low", "high", "n"])

    return run


def above(block: Block, least: dict[int, int], k: int):
    """Candidates at or above each query's kth score; of a batch at most the k best of each query."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for own, ids, scores, same in block.scores(batch):
                for row, s, equal in zip(own, scores, same, strict=True):
                    if int(row) not in least:
                        continue
                    at = np.flatnonzero(s >= least[int(row)])
                    at = at[np.lexsort((ids[at], -s[at].astype(np.float64), -s[at]))[:k]] if len(at) else at
                    out.append(pd.DataFrame({"row": int(row), "query_id": block.ids[row], "vec_id": ids[at], "score": s[at], "same": equal[at]}))
            if out:
                yield pd.concat(out)

    return run


def kth_scores(usable: DataFrame, block: Block, k: int) -> dict[int, int]:
    """The exact kth largest score of each query of the block, by refining global histograms."""
    first = usable.mapInPandas(extremes(block, k), "row int, low long, high long, n long")
    first = first.groupBy("row").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect()
    least: dict[int, int] = {}
    open_: dict[int, tuple[int, int, int]] = {}
    for r in first:
        if r.n <= k:
            least[r.row] = r.low
        else:
            open_[r.row] = (r.low, r.high, k)
    while open_:
        bounds = {row: (low, max(1, -(-(high - low + 1) // BINS))) for row, (low, high, _) in open_.items()}
        asked = Block.__new__(Block)
        asked.ids = block.ids
        asked.parts = {}
        for dim, (rows, q) in block.parts.items():
            keep = np.array([int(x) in bounds for x in rows])
            if keep.any():
                asked.parts[dim] = (rows[keep], q[keep])
        counted = usable.mapInPandas(histogram(asked, bounds, k), "row int, bin long, n long").groupBy("row", "bin").agg(F.sum("n").alias("n")).collect()
        bins: dict[int, dict[int, int]] = {}
        for r in counted:
            bins.setdefault(r.row, {})[r.bin] = r.n
        for row, (low, _, _) in list(open_.items()):
            width, left = bounds[row][1], k - bins[row].pop(-1, 0)
            for b in sorted(bins[row], reverse=True):
                if bins[row][b] >= left:
                    break
                left -= bins[row][b]
            start = low + b * width
            if width == 1:
                least[row] = start
                del open_[row]
            else:
                open_[row] = (start, start + width - 1, k)
    return least


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, block: int = 4096) -> DataFrame:
    """The k best candidates of ``vectors`` for every row of ``queries`` (both: vec_id, embedding)."""
    usable = vectors.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    asked = queries.select("vec_id", "embedding").filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).groupBy("vec_id", "embedding").agg(F.count("*").alias("times"))
    n = asked.count()
    blocks = max(1, -(-n // block))
    wanted = asked.withColumn("b", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    wanted = durable(wanted) if blocks > 1 else wanted
    out = None
    for b in range(blocks):
        rows = wanted.filter(F.col("b") == b).collect() if blocks > 1 else wanted.collect()
        held = Block([r.vec_id for r in rows], [r.embedding for r in rows])
        # A query meets itself: one more than k, less one of the rows that equal it.
        least = kth_scores(usable, held, k + 1)
        found = usable.mapInPandas(above(held, least, k + 1), "row int, query_id long, vec_id long, score long, same boolean")
        best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id", F.desc("same"))
        found = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k + 1)
        itself = F.min(F.when(F.col("same"), F.col("rank"))).over(Window.partitionBy("row"))
        found = found.withColumn("itself", itself).filter("itself IS NULL OR rank <> itself").withColumn("rank", F.col("rank") - F.coalesce((F.col("rank") > F.col("itself")).cast("int"), F.lit(0))).filter(F.col("rank") <= k)
        times = F.get(F.array(*[F.lit(r.times) for r in rows]), F.col("row")) if any(r.times > 1 for r in rows) else F.lit(1)
        found = found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), times.cast("long"))))
        found = durable(found) if blocks > 1 else found
        out = found if out is None else out.unionByName(found)
    return out.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op8_histogram_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best neighbours of every vector whose id is divisible by 100."""
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter(F.col("vec_id") % 100 == 0), k=10)


TOPK_SQL = """
WITH v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.r, q.vec_id AS query_id, c.vec_id AS vec_id,
             CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.r <> c.r),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""
