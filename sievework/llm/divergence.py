"""Source divergence audit by in-mapper stripes.

How a source's use of words differs from its language's, and from each other source's of that language.

1. A task folds whole documents into stripes, one for each (language, term): the number of documents that hold the term, and
   its occurrences by source. When the stripes hold ``cells`` counts they are spilled as rows and begun anew.
2. One shuffle brings the spilled stripes of a (language, term) together, where they are added up. A task spills a term
   once or a few times, so frequent terms and large sources make no large group.
3. A merged stripe has all that a term adds to any divergence: shares for each source, and for the language. A task adds
   up the differences of each pair of sources over its stripes; Spark adds up the tasks' sums.

A term's share is 1 + floor(10^9 * (count + 5) / (N + 5 V)), in whole numbers: V kept terms of the language, N occurrences of
kept terms in the source or language. Terms are runs of ASCII letters and of all characters beyond ASCII; only A-Z are
lower-cased. Terms in fewer than ``min_docs`` documents of a language aren't kept.

Defined results: null text, language or source counts as ''; repeated rows count each; ids don't matter; a source without
terms has N = 0; a language without kept terms has pairs of value 0 and no terms; a language with one source has no pairs;
very long texts are cut into blocks between terms while they are counted; ties rank by the item's UTF-8 bytes; an empty
table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sievework.llm.common import Scratch, table

SCALE, SMOOTH = 1_000_000_000, 5
#: Rows of one language are dealt to this many tasks, whatever its number of terms.
PARTS = 64
#: Bytes of a text that are split at once, and stripes that are compared at once.
BLOCK, ROWS = 1 << 22, 1024

STRIPE = "lang string, term string, cells array<struct<source:string,n:bigint>>"

_LETTERS = bytes(range(65, 91))
_KEPT = bytes(c if c >= 128 or 97 <= c < 123 else c + 32 if c in _LETTERS else 32 for c in range(256))


def term_counts(text: bytes) -> Counter:
    """Occurrences of the terms of a UTF-8 text."""
    plain, found, start = text.translate(_KEPT), Counter(), 0
    while start < len(plain):
        end = plain.find(b" ", start + BLOCK) if len(plain) - start > BLOCK else len(plain)
        end = len(plain) if end < 0 else end
        found.update(plain[start:end].split())
        start = end
    return found


def stripe_rows(stripes: dict[bytes, dict[bytes, dict[bytes, int]]]) -> Iterator[pa.RecordBatch]:
    """Stripes as rows; the cell without a source is the number of documents."""
    text = lambda values: pa.array(values, pa.binary()).cast(pa.string())
    for lang, terms in stripes.items():
        names, offsets, sources, counts = [], [0], [], []
        for term, cells in terms.items():
            names.append(term)
            sources.extend(cells)
            counts.extend(cells.values())
            offsets.append(len(sources))
        cells = pa.StructArray.from_arrays([text(sources), pa.array(counts, pa.int64())], ["source", "n"])
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), cells)
        yield pa.RecordBatch.from_arrays([text([lang] * len(names)), text(names), lists], ["lang", "term", "cells"])


def fold(docs: DataFrame, cells: int = 400_000) -> DataFrame:
    """(lang, term, cells): the tasks' stripes. A row without a term tells the sources of the language with the task's documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stripes, held = {}, 0
        for batch in batches:
            columns = (batch.column(i).cast(pa.large_binary()).to_pylist() for i in range(3))
            for text, lang, source in zip(*columns, strict=True):
                terms = stripes.setdefault(lang, {})
                for term, n in (*term_counts(text).items(), (None, 1)):
                    stripe = terms.get(term)
                    if stripe is None:
                        terms[term] = {None: 1, source: n}
                        held += 2
                    else:
                        stripe[None] += 1
                        if source in stripe:
                            stripe[source] += n
                        else:
                            stripe[source] = n
                            held += 1
                if held > cells:
                    yield from stripe_rows(stripes)
                    stripes, held = {}, 0
        yield from stripe_rows(stripes)

    plain = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("text", "lang", "source")]
    return docs.select(*plain).mapInArrow(run, STRIPE)


def merge(spilled: DataFrame, min_docs: int) -> DataFrame:
    """One stripe for each (lang, term) in enough documents, and one without a term for each language."""
    whole = spilled.repartition("lang", "term").select("lang", "term", F.explode("cells").alias("c"))
    added = whole.groupBy("lang", "term", F.col("c.source").alias("source")).agg(F.sum("c.n").alias("n"))
    both = added.groupBy("lang", "term").agg(
        F.max(F.when(F.col("source").isNull(), F.col("n"))).alias("docs"),
        F.collect_list(F.when(F.col("source").isNotNull(), F.struct("source", "n"))).alias("cells"),
    )
    return both.filter(F.col("term").isNull() | (F.col("docs") >= min_docs))


def language_totals(stripes: DataFrame) -> DataFrame:
    """(lang, v, total, sources): kept terms, their occurrences, and (source, N) in order, for each language."""
    cells = stripes.select("lang", "term", F.explode("cells").alias("c"))
    known = F.col("term").isNotNull()
    groups = cells.groupBy("lang", F.col("c.source").alias("source")).agg(F.sum(F.when(known, F.col("c.n")).otherwise(0)).alias("n"))
    groups = groups.groupBy("lang").agg(F.sum("n").alias("total"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("sources"))
    terms = stripes.groupBy("lang").agg(F.count("term").alias("v"))
    return groups.join(terms, "lang").select("lang", "v", "total", "sources")


def shares(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * counts / whole), exactly: a decimal place at a time, which holds up to 9 * 10^17 occurrences."""
    quotient, rest = np.divmod(counts, whole)
    for _ in range(9):
        digit, rest = np.divmod(rest * 10, whole)
        quotient = quotient * 10 + digit
    return 1 + quotient


class Language:
    """Sums of one language in one task."""

    def __init__(self, v: int, total: int, sources: list[dict]):
        self.names = [s["source"] for s in sources]
        self.at = {name: i for i, name in enumerate(self.names)}
        self.whole = np.array([s["n"] for s in sources], dtype=np.int64) + SMOOTH * v
        self.all = np.int64(total + SMOOTH * v)
        self.apart = np.zeros((len(sources), len(sources)), dtype=np.int64)

    def add(self, terms: list[str], cells: list[list[dict]]) -> tuple[list, list, list]:
        """Takes the stripes in; returns what they add to the part ``term``: source, term, value."""
        counts = np.zeros((len(terms), len(self.names)), dtype=np.int64)
        for row, stripe in zip(counts, cells, strict=True):
            for cell in stripe:
                row[self.at[cell["source"]]] = cell["n"]
        p = shares(counts + SMOOTH, self.whole[None, :])
        for i in range(len(self.names) - 1):
            self.apart[i, i + 1 :] += np.abs(p[:, i + 1 :] - p[:, i : i + 1]).sum(axis=0)
        more = p - shares(counts.sum(axis=1) + SMOOTH, self.all)[:, None]
        found = np.argwhere((counts > 0) & (more > 0))
        return [self.names[s] for _, s in found], [terms[t] for t, _ in found], [int(more[t, s]) for t, s in found]

    def pairs(self) -> tuple[list, list, list]:
        found = [(i, j) for i in range(len(self.names)) for j in range(i + 1, len(self.names))]
        return [self.names[i] for i, _ in found], [self.names[j] for _, j in found], [int(self.apart[i, j]) for i, j in found]


def differences(stripes: DataFrame, totals: DataFrame) -> DataFrame:
    """(lang, part, source, item, value): one row for each term of a source, and the tasks' sums for each pair of sources."""

    def rows(lang: str, part: str, found: tuple[list, list, list]) -> pa.RecordBatch:
        n = len(found[0])
        columns = [pa.array([lang] * n, pa.string()), pa.array([part] * n, pa.string()), pa.array(found[0], pa.string()), pa.array(found[1], pa.string()), pa.array(found[2], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, ["lang", "part", "source", "item", "value"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Language] = {}
        for batch in batches:
            langs, terms = batch.column("lang").to_pylist(), batch.column("term").to_pylist()
            waiting: dict[str, list[int]] = {}
            for i, lang in enumerate(langs):
                if lang not in known:
                    known[lang] = Language(batch.column("v")[i].as_py(), batch.column("total")[i].as_py(), batch.column("sources")[i].as_py())
                if terms[i] is not None:
                    waiting.setdefault(lang, []).append(i)
            for lang, at in waiting.items():
                for start in range(0, len(at), ROWS):
                    some = at[start : start + ROWS]
                    yield rows(lang, "term", known[lang].add([terms[i] for i in some], batch.column("cells").take(pa.array(some)).to_pylist()))
        for lang, language in known.items():
            yield rows(lang, "pair", language.pairs())

    # The totals of a language are copied, not its stripes, so that each language is dealt to PARTS tasks.
    copies = totals.withColumn("deal", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    dealt = stripes.withColumn("deal", F.pmod(F.xxhash64("term"), F.lit(PARTS)).cast("int"))
    joined = dealt.join(copies, ["lang", "deal"]).select("lang", "term", "cells", "v", "total", "sources")
    return joined.mapInArrow(run, "lang string, part string, source string, item string, value bigint")


def source_divergence(docs: DataFrame, min_docs: int = 30, best: int = 50, cells: int = 400_000) -> DataFrame:
    """(lang, source, part, item, value, rank): the distance to each other source, and the ``best`` terms that a source uses more than its language."""
    tables = Scratch(docs.sparkSession)
    stripes = tables.write(merge(fold(docs, cells), min_docs))
    found = tables.write(differences(stripes, language_totals(stripes)))
    summed = found.filter("part = 'pair'").groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    other = summed.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), "value")
    order = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = summed.unionByName(other).withColumn("rank", order).withColumn("part", F.lit("pair"))
    terms = found.filter("part = 'term'").select("lang", "source", "item", "value").withColumn("rank", order).filter(F.col("rank") <= best).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", "rank")


def op11_stripes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The divergences of all documents' sources."""
    return source_divergence(table(spark, sf_dir, "documents"))


_A_TO_Z = "abcdefghijklmnopqrstuvwxyz"

STRIPES_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all(translate(coalesce(text, ''), '{_A_TO_Z.upper()}', '{_A_TO_Z}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
word AS (SELECT r, lang, source, unnest(terms) AS term FROM d),
kept AS (SELECT lang, term FROM word GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
cell AS (SELECT lang, source, term, count(*) AS n FROM word JOIN kept USING (lang, term) GROUP BY lang, source, term),
v AS (SELECT d.lang, (SELECT count(*) FROM kept k WHERE k.lang = d.lang) AS v FROM (SELECT DISTINCT lang FROM d) d),
grp AS (SELECT g.lang, g.source, v.v, coalesce(sum(c.n), 0) AS total FROM (SELECT DISTINCT lang, source FROM d) g JOIN v USING (lang) LEFT JOIN cell c ON c.lang = g.lang AND c.source = g.source GROUP BY ALL),
q AS (SELECT k.lang, k.term, 1 + (1000000000::HUGEINT * (sum(n) + 5)) // (any_value(t.total) + 5 * any_value(t.v)) AS q
      FROM kept k JOIN cell USING (lang, term) JOIN (SELECT lang, any_value(v) AS v, sum(total) AS total FROM grp GROUP BY lang) t USING (lang) GROUP BY k.lang, k.term),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * g.v) AS p
      FROM grp g JOIN kept k USING (lang) LEFT JOIN cell c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (SELECT a.lang, a.source, b.source AS item, coalesce((SELECT sum(abs(x.p - y.p)) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source), 0) AS value
         FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source),
term AS (SELECT p.lang, p.source, p.term AS item, p.p - q.q AS value FROM p JOIN q USING (lang, term) WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, 'pair' AS part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS INTEGER) AS rank FROM pair
UNION ALL
SELECT lang, source, 'term', item, CAST(value AS BIGINT), CAST(rank AS INTEGER) FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS rank FROM term) WHERE rank <= 50
"""
