"""Near-duplicate documents by BagMinHash.

A document is the multiset of its runs of five words (letter and digit runs, lower case). Each (shingle, copy number) owns
a Poisson process over signature slots: the copies of a shingle lie on a weight axis cut into intervals 1, 1, 2, 4, 8, ...;
an interval's process is the same in every document, and its points count if they fall below the shingle's weight. A slot
keeps its earliest point. Two documents then agree in a slot with a probability equal to their weighted Jaccard
similarity. Processes are advanced together and stop once they have passed the latest slot, so few points are drawn.

Signatures are banded; documents that share a band are candidates. Which documents belong together:

1. Documents with the same words in the same order are one text class; only its smallest id goes on.
2. Each remaining document is verified against at most two of its buckets' smallest members. Verified links give first
   components.
3. Of the members of buckets that hold several components, the shingles that no other such member has are counted. Members
   and pairs for which these exclude the threshold go. The rest are verified against at most two of their buckets' centres:
   the member with the smallest share of shingles of its own, so the text that the others were copied from.
4. In a bucket that still holds several components, the members outside its most frequent component are paired with the
   members of other components, as far as the shingles that more than ``RARE`` members have can make a link; pairs for
   which that takes a rarer shingle are found by joining on those, at most ``RARE`` members each. So a bucket of thousands
   of near copies yields few pairs, while no link across components is lost. Pairs whose signatures exclude ``threshold`` (by ``slack``) are dropped, the others verified on the multisets.
5. Components of all verified links are the classes.

No group is collected in a task: sums and least values are combined before they move, and joins on a bucket, a document or
a text have tables of one row a key or shuffles of their own on both sides, so that Spark splits a hot key. With the
settings given, a pair at similarity 0.8 shares a band with probability 0.9994.

Steps write tables in the shared folder, which go when the classes are checkpointed.

Defined results: null text is a class of its own row; texts without a word are one class (they are equal copies); texts
of fewer than five words are one shingle; for ``near_classes`` rows that repeat a doc_id are one document: each of its texts
has the copies of that text in the class, and the text with the smallest digest stands for it in similarities; for
``drop_near_copies`` rows that share an id but not a text, and rows with no id, are documents of their own; further columns are
ignored by ``near_classes`` and kept by ``drop_near_copies``; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import Scratch, durable, free_name, handing_back, scratch, table

SHINGLE = 5
ROWS, BANDS = 8, 40
SLOTS = ROWS * BANDS
CACHE = 400_000
#: Processes that are advanced together.
POINTS = 30_000
#: Shingles that so many members have at most are joined on, and taken out of what a bucket's members may share.
RARE = 8
#: Size of the set of hashed ids that scans are filtered by.
FILTER = 1 << 18


class WordHashes(dict):
    """Word to 64-bit hash; starts anew when it has reached its bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(words: list[str], hashes: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes and their multiplicities."""
    h = np.fromiter(map(hashes.__getitem__, words), dtype=np.uint64, count=len(words))
    n = max(1, len(h) - SHINGLE + 1) if len(h) else 0
    total = np.zeros(n, dtype=np.uint64)
    for i in range(min(SHINGLE, len(h))):
        total = mix(total * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(total, return_counts=True)


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], slots: int = SLOTS) -> np.ndarray:
    """For each multiset (distinct keys, weights; not empty) the owner, a hash, of the earliest point of each slot.

    The processes of all multisets advance together, several points at a time when few are left.
    """
    doc, owner, base, width, limit = [], [], [], [], []
    for d, (keys, weights) in enumerate(bags):
        # One process for each shingle and interval of the weight axis: [0,1), [1,2), [2,4), [4,8), ...
        low, high = 0, 1
        while len(keys):
            owner.append(mix(keys ^ np.uint64(low * 2 + 1)))
            limit.append(weights)
            n = len(keys)
            doc.append(np.full(n, d))
            base.append(np.full(n, low))
            width.append(np.full(n, high - low))
            low, high = high, high * 2
            more = weights > low
            keys, weights = keys[more], weights[more]
    doc, owner, base, width, limit = (np.concatenate(x) for x in (doc, owner, base, width, limit))
    earliest, who = np.full(len(bags) * slots, np.inf), np.zeros(len(bags) * slots, dtype=np.uint64)
    time, state, golden = np.zeros(len(owner)), owner.copy(), np.uint64(0x9E3779B97F4A7C15)
    while len(owner):
        points = np.arange(1, min(64, max(1, POINTS // len(owner))) + 1, dtype=np.uint64)
        states = state[:, None] + golden * points
        a, b = mix(states), mix(states ^ np.uint64(0x5851F42D4C957F2D))
        gaps = -np.log(((a >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)) / (width * slots)[:, None]
        times = time[:, None] + np.cumsum(gaps, axis=1)
        slot = doc[:, None] * slots + (b % np.uint64(slots)).astype(np.int64)
        copy = base[:, None] + ((b >> np.uint64(20)) % width.astype(np.uint64)[:, None]).astype(np.int64)
        row, col = np.nonzero((copy < limit[:, None]) & (times < earliest[slot]))
        t, at = times[row, col], slot[row, col]
        order = np.argsort(-t, kind="stable")
        earliest[at[order]] = t[order]
        who[at[order]] = mix(owner[row] ^ copy[row, col].astype(np.uint64) * golden)[order]
        time, state = times[:, -1], states[:, -1]
        on = time < earliest.reshape(-1, slots).max(axis=1)[doc]
        doc, owner, base, width, limit, time, state = doc[on], owner[on], base[on], width[on], limit[on], time[on], state[on]
    return who.reshape(-1, slots)


def signature(keys: np.ndarray, weights: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    return signatures([(keys, weights)], slots)[0]


def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Word-sequence digest, number of shingles, band keys and one byte of each slot, for each row."""
    word, hashes = re.compile(r"[^\W_]+"), WordHashes()
    powers = np.cumprod(np.full(ROWS, np.uint64(0x2545F4914F6CDD1D)))
    columns = ["doc_id", "h", "digest", "n", "bands", "bytes"]

    def finish(rows: list, bags: list) -> pd.DataFrame:
        if bags:
            who = signatures([bag for _, bag in bags])
            bands = mix((who.reshape(-1, BANDS, ROWS) * powers).sum(axis=2, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64)).astype(np.int64)
            low = (who & np.uint64(255)).astype(np.uint8)
            for k, (i, (_, weights)) in enumerate(bags):
                rows[i][3:] = [int(weights.sum()), bands[k], low[k].tobytes()]
        return pd.DataFrame(rows, columns=columns)

    for batch in batches:
        rows, bags, size = [], [], 0
        for doc_id, h, text in zip(batch["doc_id"], batch["h"], batch["text"], strict=True):
            words = word.findall(text.lower())
            digest = hashlib.md5(" ".join(words).encode("utf-8", "surrogatepass")).digest()
            bag = shingles(words, hashes)
            if len(bag[0]):
                bags.append((len(rows), bag))
                size += len(bag[0])
            rows.append([doc_id, h, digest, 0, [], b""])
            if size >= POINTS:
                yield finish(rows, bags)
                rows, bags, size = [], [], 0
        if rows:
            yield finish(rows, bags)


def looks_similar(threshold: float, slack: float):
    """Keep pairs whose signatures (bytes of the slots) don't exclude the threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                a, b = (np.frombuffer(b"".join(batch[c]), dtype=np.uint8).reshape(len(batch), SLOTS) for c in ("sa", "sb"))
                agree = ((a == b).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
                yield batch.loc[agree >= threshold - slack, ["x", "hx", "y", "hy"]]

    return run


def verified(threshold: float):
    """Keep pairs whose multisets of shingles reach the threshold."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        word, hashes = re.compile(r"[^\W_]+"), WordHashes()
        for batch in batches:
            keep = []
            for a, b in zip(batch["ta"], batch["tb"], strict=True):
                (ka, wa), (kb, wb) = (shingles(word.findall(t.lower()), hashes) for t in (a, b))
                _, i, j = np.intersect1d(ka, kb, assume_unique=True, return_indices=True)
                both = int(np.minimum(wa[i], wb[j]).sum())
                keep.append(both >= threshold * (int(wa.sum()) + int(wb.sum()) - both))
            yield batch.loc[keep, ["x", "y"]]

    return run


def components(links: DataFrame, tables: Scratch) -> DataFrame:
    """(id, root) of every id in ``links`` (x, y): the smallest id it is connected with.

    Each round renames every id to its first neighbour, if that comes before it, and the links with it, until no link is left.
    In the first rounds the smaller id comes first, since most links point to a smallest member; later ones go by a hash,
    so that a chain in the order of its ids shrinks by a share in each round, too.
    """
    pair = lambda x, y: [F.greatest(x, y).alias("x"), F.least(x, y).alias("y")]
    edges = tables.write(links.select(*pair("x", "y")).filter("x <> y").distinct())
    renamed, turn = [], 0
    while not edges.isEmpty():
        first = lambda c, k=turn: F.xxhash64(c, F.lit(k)) if k > 1 else F.col(c)
        both = edges.unionByName(edges.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min_by("y", first("y")).alias("y"))
        names = tables.write(least.select(F.col("x").alias("id"), F.when(first("y") < first("x"), F.col("y")).otherwise(F.col("x")).alias("name")))
        renamed.append(names)
        moved = edges.join(names.withColumnsRenamed({"id": "x", "name": "a"}), "x").join(names.withColumnsRenamed({"id": "y", "name": "b"}), "y")
        edges = tables.write(moved.select(*pair("a", "b")).filter("x <> y").distinct())
        turn += 1
    if not renamed:
        return edges.select(F.col("x").alias("id"), F.col("y").alias("root"))
    last = renamed.pop()
    for names in reversed(renamed):
        last = names.join(last.withColumnsRenamed({"name": "final", "id": "name"}), "name", "left").select("id", F.coalesce("final", "name").alias("name"))
    last = tables.write(last)
    roots = tables.write(last.groupBy("name").agg(F.min("id").alias("root")))
    return tables.write(last.join(roots, "name").select("id", "root"))


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, text) of the texts (id, h). A set of hashed ids with at most ``FILTER`` members goes to the scan first, so few texts move."""
    part = lambda c: F.pmod(F.xxhash64(c), F.lit(FILTER))
    some = F.broadcast(ids.select(part("id").alias("part")).distinct())
    near = docs.join(some, part("doc_id") == F.col("part"), "left_semi")
    return near.join(ids, (F.col("doc_id") == F.col("id")) & (F.xxhash64("text") == F.col("h")), "left_semi").dropDuplicates(["doc_id"]).select(F.col("doc_id").alias("id"), "text")


def check_pairs(pairs: DataFrame, reps: DataFrame, docs: DataFrame, threshold: float, slack: float, tables: Scratch) -> DataFrame:
    """The pairs (x, y) that reach the threshold: by signature first, then on the texts."""
    signs = reps.select("id", "h", "bytes")
    both = pairs.join(signs.withColumnsRenamed({"id": "x", "h": "hx", "bytes": "sa"}), "x").join(signs.withColumnsRenamed({"id": "y", "h": "hy", "bytes": "sb"}), "y")
    likely = tables.write(both.mapInPandas(handing_back(looks_similar(threshold, slack)), "x long, hx long, y long, hy long"))
    ids = likely.select(F.explode(F.array(F.struct(F.col("x").alias("id"), F.col("hx").alias("h")), F.struct(F.col("y").alias("id"), F.col("hy").alias("h")))).alias("s")).select("s.*").distinct()
    texts = tables.write(texts_of(docs, ids))
    both = likely.select("x", "y").join(texts.withColumnsRenamed({"id": "x", "text": "ta"}), "x").join(texts.withColumnsRenamed({"id": "y", "text": "tb"}), "y")
    return tables.write(both.mapInPandas(handing_back(verified(threshold)), "x long, y long"))


def shingle_rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    word, hashes = re.compile(r"[^\W_]+"), WordHashes()
    for batch in batches:
        for i, text in zip(batch["id"], batch["text"], strict=True):
            keys, weights = shingles(word.findall(text.lower()), hashes)
            yield pd.DataFrame({"id": np.full(len(keys), i), "shingle": keys.astype(np.int64), "w": weights})


def with_roots(members: DataFrame, roots: DataFrame, tables: Scratch) -> DataFrame:
    """The members (bucket, id, ...) with their ``root`` by ``roots``, of the buckets that hold several roots."""
    marked = tables.write(members.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id")))
    several = tables.write(marked.groupBy("bucket").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a <> b").select("bucket"))
    return tables.write(marked.join(several, "bucket"))


def with_shared(members: DataFrame, docs: DataFrame, threshold: float, tables: Scratch) -> tuple[DataFrame, DataFrame]:
    """The members with the weights ``s`` of the shingles that others of them have and ``f`` of those that more than ``RARE`` have.

    Members whose ``s`` excludes the threshold are left out. Also the rows (shingle, id, w) of the shingles that 2 to ``RARE`` have.
    """
    rows = tables.write(texts_of(docs, members.select("id", "h").distinct()).mapInPandas(handing_back(shingle_rows), "id long, shingle long, w long"))
    few = tables.write(rows.groupBy("shingle").agg(F.count("*").alias("c"), F.min("id").alias("id"), F.sum("w").alias("w")).filter(F.col("c") <= RARE))
    rare = tables.write(rows.join(few.filter("c > 1").select("shingle"), "shingle").select("shingle", "id", "w"))
    weights = few.filter("c = 1").select("id", "w", F.lit(0).alias("r")).unionByName(rare.select("id", F.lit(0).alias("w"), F.col("w").alias("r")))
    weights = tables.write(weights.groupBy("id").agg(F.sum("w").alias("own"), F.sum("r").alias("rare")))
    shared = members.join(weights, "id", "left").withColumn("s", F.col("n") - F.coalesce("own", F.lit(0)))
    shared = shared.withColumn("f", F.col("s") - F.coalesce("rare", F.lit(0))).filter(F.col("s") >= F.lit(threshold) * F.col("n"))
    return tables.write(shared.select("bucket", "id", "n", "s", "f", "root")), rare


def may_reach(threshold: float, most: Column) -> Column:
    """Whether x and y of sizes nx and ny, which share ``most`` at most, can reach the threshold: that takes ``threshold / (1 + threshold)`` of both sizes."""
    sizes = F.least("nx", "ny") >= F.lit(threshold) * F.greatest("nx", "ny")
    return sizes & (most >= F.lit(threshold / (1 + threshold) - 1e-9) * (F.col("nx") + F.col("ny"))) & (F.col("rx") != F.col("ry"))


def to_centres(mixed: DataFrame, threshold: float, tables: Scratch) -> DataFrame:
    """Pairs (x, y) of every member and at most two centres of its buckets, in another component."""
    share = F.col("s") / F.col("n")
    centre = mixed.groupBy("bucket").agg(F.max_by(F.struct("id", "n", "s", "root"), F.struct(share, -F.col("id"))).alias("c"))
    centre = tables.write(centre.select("bucket", F.col("c.id").alias("y"), F.col("c.n").alias("ny"), F.col("c.s").alias("sy"), F.col("c.root").alias("ry")))
    pairs = mixed.withColumnsRenamed({"id": "x", "n": "nx", "s": "sx", "root": "rx"}).join(centre, "bucket").filter(may_reach(threshold, F.least("sx", "sy")))
    best = pairs.groupBy("x").agg(F.mode("y", True).alias("a"), F.max_by("y", F.col("sy") / F.col("ny")).alias("b"))
    both = best.select("x", F.explode(F.array_distinct(F.array("a", "b"))).alias("y"))
    return both.select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()


def pairs_across(mixed: DataFrame, rare: DataFrame, threshold: float, tables: Scratch) -> DataFrame:
    """Pairs (x, y) of members in different components: of a bucket, those outside its most frequent component with all others; and those that share a rare shingle."""
    main = mixed.groupBy("bucket", "root").count().groupBy("bucket").agg(F.max_by("root", F.struct("count", -F.col("root"))).alias("main"), F.count("*").alias("roots"))
    main = tables.write(main.filter("roots > 1").select("bucket", "main"))
    side = lambda i: {"id": i, **{c: c + i for c in ("n", "s", "f")}, "root": "r" + i}
    inside = tables.write(mixed.join(main, "bucket"))
    left, right = inside.filter("root <> main").drop("main").withColumnsRenamed(side("x")), inside.withColumnsRenamed(side("y"))
    near = may_reach(threshold, F.least("fx", "fy")) & ((F.col("ry") == F.col("main")) | (F.col("x") < F.col("y")))
    common = left.join(right, "bucket").filter(near).select("x", "y")
    each = tables.write(mixed.select("id", "n", "s", "f", "root").distinct())
    rare = tables.write(rare.join(each, "id"))
    pairs = rare.withColumnsRenamed(side("x") | {"w": "wx"}).join(rare.withColumnsRenamed(side("y") | {"w": "wy"}), "shingle").filter("x > y AND rx <> ry")
    pairs = pairs.groupBy("x", "y").agg(F.sum(F.least("wx", "wy")).alias("w"), *[F.first(c).alias(c) for c in ("nx", "ny", "fx", "fy", "rx", "ry")])
    seldom = pairs.filter(may_reach(threshold, F.least("fx", "fy") + F.col("w"))).select("x", "y")
    return common.unionByName(seldom).select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct()


def with_own_ids(docs: DataFrame, own: str) -> DataFrame:
    """``docs`` with a number in ``own`` that rows share only if they share id and text.

    That is the id, except where different texts share one or have none: those get numbers made of a hash, beyond all ids.
    Where ids leave no room for that, all rows get one.
    """
    texts = docs.filter("text IS NOT NULL").groupBy("doc_id").agg(F.min(F.xxhash64("text")).alias("x"), F.max(F.xxhash64("text")).alias("y"))
    several = texts.filter("doc_id IS NULL OR x <> y").select(F.col("doc_id").alias(of := free_name(docs, "of")))
    if not several.head(1):
        return docs.withColumn(own, F.col("doc_id"))
    made = F.xxhash64("doc_id", "text", F.lit(17))
    high = docs.agg(F.coalesce(F.max("doc_id"), F.lit(0)).alias("high")).first().high
    if high >= 1 << 62:
        return docs.withColumn(own, F.when(F.col("text").isNotNull(), made))
    marked = docs.join(several.withColumn(mark := free_name(docs, "mark"), F.lit(True)), F.col("doc_id").eqNullSafe(F.col(of)), "left")
    beyond = F.lit(max(high, 0) + 1) + F.pmod(made, F.lit((1 << 62) - 1))
    return marked.withColumn(own, F.when(F.col("text").isNull(), F.col("doc_id")).when(F.col(mark), beyond).otherwise(F.col("doc_id"))).drop(of, mark)


def near_classes(docs: DataFrame, threshold: float = 0.8, slack: float = 0.14) -> DataFrame:
    """(doc_id, class_id), one row per row of ``docs``: ids whose texts reach the threshold through a chain of links."""
    rows = docs.select("doc_id", "text").filter("doc_id IS NOT NULL AND text IS NOT NULL")
    with scratch(docs.sparkSession) as tables:
        made = rows.select("doc_id", F.xxhash64("text").alias("h"), "text").mapInPandas(handing_back(signed), "doc_id long, h long, digest binary, n long, bands array<long>, bytes binary")
        sig = tables.write(made)
        copies = tables.write(sig.groupBy("digest").agg(F.min("doc_id").alias("id")))
        chosen = copies.groupBy("id").agg(F.min("digest").alias("of"))
        reps = sig.filter("n > 0").join(chosen, (F.col("doc_id") == F.col("id")) & (F.col("digest") == F.col("of")), "left_semi").dropDuplicates(["doc_id", "digest"])
        reps = tables.write(reps.select(F.col("doc_id").alias("id"), "h", "n", "bands", "bytes"))
        buckets = reps.select("id", "h", "n", F.explode("bands").alias("bucket"))
        shared = tables.write(buckets.groupBy("bucket").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last").select("bucket", "first"))
        members = tables.write(buckets.join(shared, "bucket"))
        # Of every document's buckets, the smallest members: the one met most often and the smallest of all.
        firsts = members.filter("first < id").groupBy("id").agg(F.mode("first", True).alias("a"), F.min("first").alias("b"))
        stars = firsts.select(F.col("id").alias("x"), F.explode(F.array_distinct(F.array("a", "b"))).alias("y"))
        links = check_pairs(stars, reps, rows, threshold, slack, tables)
        mixed, rare = with_shared(with_roots(members.drop("first"), components(links, tables), tables), rows, threshold, tables)
        links = links.unionByName(check_pairs(to_centres(mixed, threshold, tables), reps, rows, threshold, slack, tables))
        mixed = with_roots(mixed.drop("root"), components(links, tables), tables)
        links = links.unionByName(check_pairs(pairs_across(mixed, rare, threshold, tables), reps, rows, threshold, slack, tables))
        roots = components(links, tables)
        class_of = tables.write(copies.join(roots, "id", "left").select("digest", F.coalesce("root", "id").alias("class_id")))
        of = sig.select("doc_id", "digest").join(class_of, "digest").select("doc_id", "class_id")
        return durable(of.unionByName(docs.filter("doc_id IS NULL OR text IS NULL").select("doc_id", F.col("doc_id").alias("class_id"))))


def drop_near_copies(docs: DataFrame, **settings) -> DataFrame:
    """``docs`` with one document of each class: the one with the smallest id, and of its repeated rows one.

    Rows that share an id but not a text, or have none, are documents of their own and come after the others.
    """
    own, of, gone, n = (free_name(docs, c) for c in ("own", "of", "gone", "n"))
    columns, docs = docs.columns, with_own_ids(docs, own)
    marks = near_classes(docs.select(F.col(own).alias("doc_id"), "text"), **settings).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max(F.col("doc_id") != F.coalesce("class_id", "doc_id")).alias(gone), F.count("*").alias(n))
    marks = marks.filter(F.col(gone) | (F.col(n) > 1)).withColumnRenamed("doc_id", of)
    kept = docs.join(marks, F.col(own) == F.col(of), "left").filter(~F.coalesce(gone, F.lit(False)))
    once = kept.filter(F.col(n).isNull()).unionByName(kept.filter(F.col(n).isNotNull()).dropDuplicates([own, "text"]))
    return once.select(*[F.col(f"`{c}`") for c in columns])


def op3_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate class of every document."""
    return near_classes(table(spark, sf_dir, "documents"))
