"""Benchmark decontamination by spaced seeds, with DataFrame functions only.

Texts become runs of letters and digits in lower case. A fixed mask looks at some token positions of a window and ignores
the others, so a window with substituted words still hashes alike under one of the masks. Hashes of the corpus's windows
are joined with those of the benchmark. Every hit gives a diagonal (offset of the document against the item); along it
the best run is scored, +1 for a token that agrees and -1 for one that doesn't. A pair is reported if the run scores at
least ``min_score``, or ``min_share`` of a short item's tokens.

Items shorter than the widest mask are also found by hashes of their whole run and of the run without one token; the corpus
is only hashed for the lengths that the benchmark has.

Long items are cut into overlapping passages, so that what a hit carries is bounded. Benchmarks whose hashes number at
most ``broadcast_rows`` are broadcast (counted first) and the corpus isn't shuffled; larger ones are joined by shuffle.
Windows carry a short stretch of their text only; the tokens that are scored are fetched for the hits alone.

Defined results: null and empty texts match nothing; rows that share a doc_id (or have none) but not a text are scored
each: ``decontaminate`` drops the texts that leak and leaves the others, and a pair has the best score of its doc_id; rows that
share an item_id are one item (best score counts); the order of rows doesn't matter; null ids are kept as null; further columns
are ignored in pairs and kept by ``decontaminate``; an empty table on either side gives no pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import Scratch, free_name, normal_words, table

# Token positions that each mask looks at.
MASKS = ((0, 1, 2, 4, 5, 6), (0, 1, 3, 4, 6, 8), (0, 1, 2, 4, 7, 8))
WIDEST = max(m[-1] for m in MASKS) + 1
PASSAGE, STRIDE = 256, 192
#: Windows that begin in one stretch of a text.
CHUNK = 128


def token_hashes(text: Column) -> Column:
    words = normal_words(text)
    return F.when(words != "", F.transform(F.split(words, " "), lambda w: F.xxhash64(w)))


def chunks(tokens: DataFrame) -> DataFrame:
    """Token hashes ``h`` cut into stretches from ``base``, so that what a window carries doesn't grow with its text. They overlap by a window."""
    bases = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("h") - 1), F.lit(CHUNK))
    cut = tokens.filter(F.size("h") > 0).select("doc_id", "t", F.explode(F.transform(bases, lambda b: F.struct(b.alias("base"), F.slice("h", b + 1, F.lit(CHUNK + WIDEST - 1)).alias("h")))).alias("c"))
    return cut.select("doc_id", "t", "c.base", "c.h")


def windows(df: DataFrame, keep: list[str], most: int = 1 << 30) -> DataFrame:
    """(keep..., p, k): masked hash of every window; ``df`` has the token hashes ``h``, and windows begin at its first ``most``."""
    shortest = min(m[-1] for m in MASKS) + 1
    at = df.filter(F.size("h") >= shortest).select(*keep, "h", F.explode(F.sequence(F.lit(0), F.least(F.size("h") - shortest, F.lit(most - 1)))).alias("p"))
    keys = [F.when(F.col("p") + mask[-1] < F.size("h"), F.xxhash64(F.lit(m), *[F.get("h", F.col("p") + o) for o in mask])) for m, mask in enumerate(MASKS)]
    return at.select(*keep, "p", F.explode(F.array(*keys)).alias("k")).filter("k IS NOT NULL")


def runs(df: DataFrame, keep: list[str], lengths: list[int], whole: bool = False, most: int = 1 << 30) -> DataFrame:
    """As ``windows``, for runs of the lengths: hashes of each and, from three tokens, of each without one token. ``whole``: only runs that are all of ``h``."""
    at = df.filter(F.size("h") > 0).select(*keep, "h", F.explode(F.sequence(F.lit(0), F.least(F.size("h"), F.lit(most)) - 1)).alias("p"))
    fits = lambda n: F.size("h") == F.col("p") + n if whole else F.size("h") >= F.col("p") + n
    alone = (F.col("p") == 0) if whole else F.lit(True)
    keys = [F.when(alone & fits(n), F.xxhash64(F.lit("run"), F.lit(n), F.lit(out), *[F.get("h", F.col("p") + o) for o in range(n) if o != out])) for n in lengths for out in range(-1, n if n > 2 else 0)]
    return at.select(*keep, "p", F.explode(F.array(*keys)).alias("k")).filter("k IS NOT NULL")


def passages_of(benchmark: DataFrame) -> DataFrame:
    """(item_id, passage, n, g): the items' token hashes, cut into passages; equal passages of an item once."""
    whole = benchmark.select("item_id", token_hashes(F.col("text")).alias("all")).filter("all IS NOT NULL")
    starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("all") - (PASSAGE - STRIDE) - 1), F.lit(STRIDE))
    cut = whole.select("item_id", F.size("all").alias("n"), F.explode(F.transform(starts, lambda s: F.slice("all", s + 1, F.lit(PASSAGE)))).alias("g")).distinct()
    return cut.withColumn("passage", F.xxhash64("item_id", "n", "g"))


def best_run(pairs: Column) -> Column:
    """The best sum over a stretch of an array of booleans, +1 for true and -1 for false."""
    step = lambda acc, hit: F.struct(
        F.greatest(F.lit(0), acc["now"] + F.when(hit, 1).otherwise(-1)).alias("now"),
        F.greatest(acc["best"], acc["now"] + F.when(hit, 1).otherwise(-1)).alias("best"),
    )
    return F.aggregate(pairs, F.struct(F.lit(0).alias("now"), F.lit(0).alias("best")), step, lambda acc: acc["best"])


def text_hash() -> Column:
    return F.xxhash64("text", F.lit(5))


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, min_score: int = 12, min_share: float = 0.6, broadcast_rows: int = 2_000_000) -> DataFrame:
    """(doc_id, t, item_id, score, item_tokens) of texts (``t``: their hash) that hold a passage of a benchmark item."""
    tables = Scratch(docs.sparkSession)
    passages = tables.write(passages_of(benchmark))
    lengths = sorted(r.n for r in passages.filter(F.col("n") < WIDEST).select("n").distinct().collect())
    made = windows(passages.select("passage", F.size("g").alias("m"), F.col("g").alias("h")), ["passage", "m"])
    if lengths:
        short = passages.filter(F.col("n") < WIDEST).select("passage", F.size("g").alias("m"), F.col("g").alias("h"))
        made = made.unionByName(runs(short, ["passage", "m"], lengths, whole=True))
    seeds = tables.write(made.select("k", "passage", "m", F.col("p").alias("j")).distinct())
    few = seeds.count() <= broadcast_rows
    cut = chunks(docs.select("doc_id", text_hash().alias("t"), token_hashes(F.col("text")).alias("h")))
    corpus = windows(cut, ["doc_id", "t", "base"], CHUNK)
    if lengths:
        corpus = corpus.unionByName(runs(cut, ["doc_id", "t", "base"], lengths, most=CHUNK))
    met = corpus.join(F.broadcast(seeds) if few else seeds, "k")
    hits = tables.write(met.select(F.col("doc_id").alias("hit_id"), F.col("t").alias("hit_t"), "passage", (F.col("base") + F.col("p") - F.col("j")).alias("diagonal"), "m").distinct())
    # Only texts with a hit give their tokens once more.
    some = hits.select("hit_id", "hit_t").distinct()
    same = F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("t") == F.col("hit_t"))
    near = hits.count() <= broadcast_rows
    texts = docs.select("doc_id", text_hash().alias("t"), "text").join(F.broadcast(some) if near else some, same, "left_semi")
    texts = texts.select("doc_id", "t", token_hashes(F.col("text")).alias("h")).join(F.broadcast(hits) if near else hits, same)
    part = F.slice("h", F.greatest(F.lit(0), F.col("diagonal")) + 1, F.col("m") + F.least(F.lit(0), F.col("diagonal")))
    parts = texts.select("doc_id", "t", "passage", "diagonal", part.alias("part"))
    known = passages.select("passage", "item_id", "n", "g")
    along = parts.join(F.broadcast(known) if few else known, "passage")
    own = F.slice("g", F.greatest(F.lit(0), -F.col("diagonal")) + 1, F.size("part"))
    along = along.select("doc_id", "t", "item_id", F.col("n").alias("item_tokens"), best_run(F.zip_with(own, "part", lambda a, b: a.eqNullSafe(b))).alias("score"))
    found = along.groupBy("doc_id", "t", "item_id").agg(F.max("score").alias("score"), F.max("item_tokens").alias("item_tokens"))
    return found.filter(F.col("score") >= F.least(F.lit(min_score), F.ceil(F.lit(min_share) * F.col("item_tokens"))))


def contaminated_pairs(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """(doc_id, item_id, score, item_tokens) of documents that hold a passage of a benchmark item."""
    found = contaminated_texts(docs, benchmark, **settings)
    return found.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"), F.max("item_tokens").alias("item_tokens"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """``docs`` without the texts that hold a passage of the benchmark."""
    bad_id, bad_t = free_name(docs, "bad_id"), free_name(docs, "bad_t")
    bad = contaminated_texts(docs, benchmark, **settings).select(F.col("doc_id").alias(bad_id), F.col("t").alias(bad_t)).distinct()
    return docs.join(bad, F.col("doc_id").eqNullSafe(F.col(bad_id)) & (text_hash() == F.col(bad_t)), "left_anti")


def op1_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a passage of a benchmark item."""
    return contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def _masked(mask: tuple[int, ...], m: int) -> str:
    return f"SELECT id, p, {m} || ' ' || " + " || ' ' || ".join(f"w[p + {o + 1}]" for o in mask) + f" AS k FROM (SELECT id, w, unnest(range(len(w) - {mask[-1]})) AS p FROM {{0}} WHERE len(w) > {mask[-1]})"


_WORDS = r"string_split(trim(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g')), ' ')"

SEEDS_SQL = f"""
WITH d AS (SELECT doc_id AS id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL),
b AS (SELECT item_id AS id, {_WORDS} AS w FROM benchmark WHERE text IS NOT NULL),
dk AS ({" UNION ALL ".join(_masked(mask, m).format("d") for m, mask in enumerate(MASKS))}),
bk AS ({" UNION ALL ".join(_masked(mask, m).format("b") for m, mask in enumerate(MASKS))}),
hit AS (SELECT DISTINCT dk.id AS doc_id, bk.id AS item_id, dk.p - bk.p AS diagonal FROM dk JOIN bk ON dk.k = bk.k),
step AS (SELECT doc_id, item_id, diagonal, j, len(b.w) AS n, CASE WHEN b.w[j + 1] = d.w[j + diagonal + 1] THEN 1 ELSE -1 END AS s
         FROM (SELECT *, unnest(range((SELECT max(len(w)) FROM b))) AS j FROM hit) JOIN b ON b.id = item_id JOIN d ON d.id = doc_id
         WHERE j < len(b.w) AND j + diagonal >= 0 AND j + diagonal < len(d.w)),
run AS (SELECT doc_id, item_id, diagonal, j, n, sum(s) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY j) AS t FROM step),
best AS (SELECT doc_id, item_id, n, t - least(0, coalesce(min(t) OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY j ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS r FROM run)
SELECT doc_id, item_id, CAST(max(r) AS INTEGER) AS score, CAST(max(n) AS INTEGER) AS item_tokens FROM best GROUP BY doc_id, item_id
HAVING max(r) >= least(12, ceil(CAST(0.6 AS DOUBLE) * max(n)))
"""
