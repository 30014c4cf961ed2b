"""Phrase collocation mining on a weighted de Bruijn graph.

A node is four words that follow each other in a piece of text, an edge five: from its first four words to its last four.
Only edges are counted. What a piece's end leaves, runs of one to four words without a next word, is counted beside them.

1. Words are counted by language. Those in fewer than ``min_count`` places can be in no phrase, nor in a part of one;
   they cut pieces as punctuation does. The others get numbers.
2. Tasks count edges and ends in blocks, as rows of word numbers. Rows are sorted by range, so that all that flows
   through a node, and through any shorter run of words, lies together.
3. A phrase's count is the flow through it: the sum of the edges that begin with it, and of the ends that do. One pass
   over a sorted range gives the counts of all lengths; what reaches over a range's border is added up afterwards.
4. Unary paths are compacted: where all that flows through a phrase goes on through, or comes from, one phrase a word
   longer, the shorter one is a point of that path and is folded into it.
5. Each cut of a phrase gets its score from the counts of its two parts; the lowest counts.

A longer phrase that holds a shorter one at a distance of two words or more holds one between them whose count lies between
theirs, so one word at a time is enough. Counts and scores are whole numbers of any size (decimals beyond 64 bits).

The words' numbers go to every executor if there are at most ``max_words``; beyond that, words are known by a hash
of 63 bits that is checked to be unique, and tried with another seed until it is. Only the representation differs.

Defined results: null and empty texts have no words; null language counts as ``und``; ids don't matter; repeated rows count
each; words may hold any character but the separators, control characters included; very long texts are counted in
blocks that overlap by four words; ties go to the shorter first part and, between phrases, to UTF-8 order; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.llm.common import Scratch, table

LONGEST = 5
WORDS = [f"w{i}" for i in range(1, LONGEST + 1)]
EDGE = ", ".join(f"{w} bigint" for w in WORDS) + ", n bigint"
#: Numbers below 2^BITS travel three to a column, in an order that is that of the words.
BITS = 21
PACKED = ["w123", "w45"]
#: Bytes of a text that are split at once; word places that are counted at once.
BLOCK, PLACES = 1 << 22, 1 << 20

# A-Z in lower case, marks that end a piece as line feeds, tabs as spaces.
_PLAIN = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def tokens(text: bytes) -> Iterator[list[bytes]]:
    """Words in order, a line feed between pieces; empty tokens mean nothing."""
    plain, start = text.translate(_PLAIN), 0
    while start < len(plain):
        end = plain.find(b" ", start + BLOCK) if len(plain) - start > BLOCK else len(plain)
        end = len(plain) if end < 0 else end
        yield plain[start:end].replace(b"\n", b" \n ").split(b" ")
        start = end


def plain_texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def word_counts(docs: DataFrame, held: int = 400_000) -> DataFrame:
    """(lang, word, n), counted in the tasks before they are added up."""

    def rows(lang: bytes, count: Counter) -> pa.RecordBatch:
        text = lambda values: pa.array(values, pa.binary()).cast(pa.string())
        words = [w for w in count if w not in (b"", b"\n")]
        return pa.RecordBatch.from_arrays([text([lang] * len(words)), text(words), pa.array([count[w] for w in words], pa.int64())], ["lang", "word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[bytes, Counter] = {}
        for batch in batches:
            for lang, text in zip(*(batch.column(i).cast(pa.large_binary()).to_pylist() for i in range(2)), strict=True):
                count = counts.setdefault(lang, Counter())
                for some in tokens(text):
                    count.update(some)
                if sum(map(len, counts.values())) > held:
                    yield from (rows(*x) for x in counts.items())
                    counts = {}
        yield from (rows(*x) for x in counts.items())

    return plain_texts(docs).mapInArrow(run, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def hashed(lang: bytes, word: bytes, seed: int) -> int:
    """1 to 2^63 - 1."""
    return (xxhash.xxh64_intdigest(lang + b"\n" + word, seed) >> 1) or 1


def with_hashes(words: DataFrame, seed: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = zip(*(batch.column(i).cast(pa.large_binary()).to_pylist() for i in range(2)), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([hashed(*x, seed) for x in pairs], pa.int64())], ["lang", "word", "id"])

    return words.select("lang", "word").mapInArrow(run, "lang string, word string, id bigint")


def numbered_words(words: DataFrame, min_count: int, max_words: int, tables: Scratch) -> tuple[DataFrame, dict[bytes, dict[bytes, int]] | int]:
    """Frequent words with their numbers from 1, and these by language and word; or, of too many, all words with their hashes, and the seed."""
    frequent = words.filter(F.col("n") >= min_count)
    if frequent.count() <= min(max_words, (1 << BITS) - 1):
        # At most max_words rows come to the driver.
        found = frequent.orderBy("lang", "word").select("lang", "word").toArrow()
        numbers: dict[bytes, dict[bytes, int]] = {}
        pairs = zip(*(column.cast(pa.large_binary()).to_pylist() for column in found.columns), strict=True)
        for i, (lang, word) in enumerate(pairs, 1):
            numbers.setdefault(lang, {})[word] = i
        rows = pa.table({"lang": found["lang"], "word": found["word"], "id": pa.array(range(1, len(found) + 1), pa.int64())})
        known = words.sparkSession.createDataFrame(rows, "lang string, word string, id bigint")
        return tables.write(known), numbers
    for seed in itertools.count():
        known = tables.write(with_hashes(words, seed))
        if not known.groupBy("id").count().filter("count > 1").head(1):
            return known, seed


def pack(columns: list[np.ndarray]) -> list[np.ndarray]:
    a, b, c, d, e = columns
    return [a << 2 * BITS | b << BITS | c, d << BITS | e]


def unpack(packed: list[np.ndarray]) -> list[np.ndarray]:
    low = (1 << BITS) - 1
    return [packed[0] >> 2 * BITS, packed[0] >> BITS & low, packed[0] & low, packed[1] >> BITS, packed[1] & low]


def block_counts(ids: np.ndarray, places: int, names: list[str]) -> pa.RecordBatch | None:
    """Edges and ends that begin at the first ``places`` of the word numbers; 0 stands between pieces."""
    ids = np.append(ids, np.zeros(LONGEST, dtype=np.int64))
    at = np.flatnonzero(ids[:places])
    if not len(at):
        return None
    columns = [ids[at]]
    for i in range(1, LONGEST):
        columns.append(np.where(columns[-1] > 0, ids[at + i], 0))
    keys = pack(columns) if names == PACKED else columns
    order = np.lexsort(keys[::-1])
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.any([k[order[1:]] != k[order[:-1]] for k in keys], axis=0)
    first = np.flatnonzero(new)
    n = np.diff(np.append(first, len(order)))
    return pa.RecordBatch.from_arrays([*(pa.array(k[order[first]]) for k in keys), pa.array(n)], [*names, "n"])


def edges(docs: DataFrame, numbers: dict[bytes, dict[bytes, int]] | int, places: int = PLACES) -> DataFrame:
    """(w1..w5, n), or the words packed: the tasks' counts of edges, and of ends, whose last words are 0."""
    names = WORDS if isinstance(numbers, int) else PACKED
    shared = docs.sparkSession.sparkContext.broadcast(numbers)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, waiting, length = shared.value, [], 0

        def number(lang: bytes, some: list[bytes]) -> np.ndarray:
            if isinstance(known, int):
                return np.array([0 if w == b"\n" else hashed(lang, w, known) for w in some if w], dtype=np.int64)
            found = known.get(lang, {})
            return np.fromiter(map(found.get, filter(None, some), itertools.repeat(0)), dtype=np.int64)

        def counted() -> Iterator[pa.RecordBatch]:
            ids = np.concatenate(waiting) if waiting else np.zeros(0, dtype=np.int64)
            for start in range(0, len(ids), places):
                if (found := block_counts(ids[start : start + places + LONGEST - 1], places, names)) is not None:
                    yield found

        for batch in batches:
            for lang, text in zip(*(batch.column(i).cast(pa.large_binary()).to_pylist() for i in range(2)), strict=True):
                for some in tokens(text):
                    waiting.append(number(lang, some))
                    length += len(waiting[-1])
                waiting.append(np.zeros(1, dtype=np.int64))
                if length > places:
                    yield from counted()
                    waiting, length = [], 0
        yield from counted()

    return plain_texts(docs).mapInArrow(run, ", ".join(f"{c} bigint" for c in [*names, "n"]))


def flows(sorted_edges: DataFrame, min_count: int) -> DataFrame:
    """(w1..w5, n): counts of all runs of one to five words, of sorted ranges of edges and ends.

    Runs inside a range are whole, and left out below ``min_count``. Those that the first or last row of a range begins with may
    go on in another range.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_at: list[tuple[list[int], int, bool] | None] = [None] * LONGEST  # run, count so far, begins the range

        def out(words: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            columns = [pa.array(words[:, i] if i < words.shape[1] else np.zeros(len(n), dtype=np.int64)) for i in range(LONGEST)]
            return pa.RecordBatch.from_arrays([*columns, pa.array(n)], [*WORDS, "n"])

        for batch in batches:
            if not batch.num_rows:
                continue
            *keys, n = (column.to_numpy() for column in batch.columns)
            words = np.stack(unpack(keys) if len(keys) < LONGEST else keys, axis=1)
            differs = np.ones(len(n), dtype=bool)
            differs[1:] = False
            for k in range(LONGEST):
                differs[1:] |= words[1:, k] != words[:-1, k]
                at = np.flatnonzero(words[:, k])
                if not len(at):
                    continue
                changes = np.cumsum(differs)[at]
                first = np.flatnonzero(np.append(True, changes[1:] > changes[:-1]))
                sums, groups = np.add.reduceat(n[at], first), words[at[first], : k + 1]
                before, begins = open_at[k], np.zeros(len(first), dtype=bool)
                if before is None:
                    begins[0] = True
                elif before[0] == groups[0].tolist():
                    sums[0] += before[1]
                    begins[0] = before[2]
                elif before[2] or before[1] >= min_count:
                    yield out(np.array([before[0]]), np.array([before[1]]))
                open_at[k] = (groups[-1].tolist(), int(sums[-1]), bool(begins[-1]))
                chosen = begins | (sums >= min_count)
                chosen[-1] = False
                if chosen.any():
                    yield out(groups[chosen], sums[chosen])
        for last in open_at:
            if last is not None:
                yield out(np.array([last[0]]), np.array([last[1]]))

    return sorted_edges.mapInArrow(run, EDGE)


def phrase_counts(docs: DataFrame, numbers: dict[bytes, dict[bytes, int]] | int, min_count: int, parts: int, places: int = PLACES) -> DataFrame:
    """(w1..w5, n) of every run of one to five words with at least ``min_count`` occurrences."""
    counted = edges(docs, numbers, places)
    order = counted.columns[:-1]
    dealt = counted.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return flows(dealt, min_count).groupBy(*WORDS).agg(F.sum("n").alias("n")).filter(F.col("n") >= min_count)


def compacted(counts: DataFrame, share: int) -> DataFrame:
    """Phrases of two words or more through which no one longer phrase takes ``share`` per cent of the flow."""
    zero, length = F.lit(0).cast("bigint"), phrase_length()
    without_last = F.array(*[F.when(F.lit(i) < length - 1, F.col(w)).otherwise(zero) for i, w in enumerate(WORDS)])
    without_first = F.array(*WORDS[1:], zero)
    shorter = counts.filter(F.col(WORDS[2]) > 0).select("n", F.explode(F.array(without_last, without_first)).alias("part"))
    through = shorter.groupBy(*[F.get("part", i).alias(w) for i, w in enumerate(WORDS)]).agg(F.max("n").alias("most"))
    phrases = counts.filter(F.col(WORDS[1]) > 0).join(through, WORDS, "left")
    return phrases.filter(F.col("most").isNull() | (F.lit(100).cast("decimal(20,0)") * F.col("most") < F.lit(share).cast("decimal(20,0)") * F.col("n"))).select(*WORDS, "n")


def phrase_length() -> Column:
    total = F.lit(0)
    for w in WORDS:
        total = total + (F.col(w) > 0).cast("int")
    return total


def scored(phrases: DataFrame, counts: DataFrame) -> DataFrame:
    """(w1..w5, a, l, r, total, score) of the cut with the lowest score. ``phrases``: w1..w5, a, total."""
    zero = F.lit(0).cast("bigint")
    length = phrase_length()
    cuts = phrases.withColumn("k", F.explode(F.sequence(F.lit(1), length - 1)))
    left = [F.when(F.lit(i) < F.col("k"), F.col(w)).otherwise(zero).alias(f"l{w}") for i, w in enumerate(WORDS)]
    right = [F.coalesce(F.get(F.array(*WORDS), F.lit(i) + F.col("k")), zero).alias(f"r{w}") for i, w in enumerate(WORDS)]
    cuts = cuts.select(*WORDS, "a", "total", "k", *left, *right)
    for side in "lr":
        cuts = cuts.join(counts.select(*[F.col(w).alias(f"{side}{w}") for w in WORDS], F.col("n").alias(side)), [f"{side}{w}" for w in WORDS])
    big = lambda c: F.col(c).cast("decimal(19,0)")
    cuts = cuts.withColumn("above", (F.lit(1000).cast("decimal(4,0)") * big("a")).cast("decimal(22,0)") * F.col("total").cast("decimal(16,0)")).withColumn("below", big("l") * big("r"))
    cuts = cuts.withColumn("score", F.expr("above div below"))
    best = cuts.groupBy(*WORDS).agg(F.min_by(F.struct("a", "l", "r", "total", "score"), F.struct("score", "k")).alias("b"))
    return best.select(*WORDS, "b.*")


def spelled(phrases: DataFrame, words: DataFrame) -> DataFrame:
    """``phrases`` with their words joined by spaces."""
    each = phrases.select(*WORDS, F.posexplode(F.filter(F.array(*WORDS), lambda w: w > 0)).alias("i", "id")).join(words.select("id", "word"), "id")
    texts = each.groupBy(*WORDS).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    return phrases.join(texts, WORDS)


def collocations(docs: DataFrame, min_count: int = 100, best: int = 2000, share: int = 100, max_words: int = 1_000_000, places: int = PLACES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``best`` phrases of two to five words."""
    spark = docs.sparkSession
    tables, parts = Scratch(spark), int(spark.conf.get("spark.sql.shuffle.partitions"))
    words = tables.write(word_counts(docs))
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    known, numbers = numbered_words(words, min_count, max_words, tables)
    counts = tables.write(phrase_counts(docs, numbers, min_count, parts, places))
    named = known.join(totals, "lang").select(F.col("id").alias("w1"), "lang", "total")
    phrases = tables.write(compacted(counts, share))
    found = tables.write(scored(phrases.withColumnRenamed("n", "a").join(named.select("w1", "total"), "w1"), counts))
    # All that ties with the last place stays until the phrases are spelled.
    ranked = found.join(named.select("w1", "lang"), "w1").withColumn("place", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))))
    top = tables.write(ranked.filter(F.col("place") <= best))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = spelled(top, known).withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= best)
    return out.select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def op12_de_bruijn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The collocations of all documents."""
    return collocations(table(spark, sf_dir, "documents"))


_A_TO_Z = "abcdefghijklmnopqrstuvwxyz"

DE_BRUIJN_SQL = rf"""
WITH piece AS (SELECT row_number() OVER () AS id, lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w
               FROM (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{_A_TO_Z.upper()}', '{_A_TO_Z}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)),
place AS (SELECT lang, w, unnest(range(len(w))) AS i FROM piece),
total AS (SELECT lang, count(*) AS n FROM place GROUP BY lang),
freq AS (SELECT lang, k, p, count(*) AS f FROM (SELECT lang, k, w[i + 1 : i + k] AS p FROM place, (SELECT unnest(range(1, 6)) AS k) WHERE i + k <= len(w)) GROUP BY lang, k, p HAVING count(*) >= 100),
cut AS (SELECT c.lang, c.k, c.p, c.f AS a, x.f AS l, y.f AS r, total.n, (1000 * c.f::HUGEINT * total.n) // (x.f::HUGEINT * y.f) AS score, j
        FROM (SELECT *, unnest(range(1, k)) AS j FROM freq WHERE k > 1) c JOIN total USING (lang)
        JOIN freq x ON x.lang = c.lang AND x.p = c.p[1 : j] JOIN freq y ON y.lang = c.lang AND y.p = c.p[j + 1 : c.k]),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, j) = 1),
inner_part AS (SELECT lang, p[a + 1 : a + m] AS q, max(f) AS most FROM freq, (SELECT unnest(range(4)) AS a), (SELECT unnest(range(2, 5)) AS m) WHERE m < k AND a + m <= k GROUP BY lang, q),
kept AS (SELECT best.*, array_to_string(p, ' ') AS phrase FROM best LEFT JOIN inner_part i ON i.lang = best.lang AND i.q = best.p WHERE i.most IS NULL OR 100 * i.most < 100 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, CAST(score AS BIGINT) AS score FROM kept
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""
