"""Line deduplication by a deletion-neighbourhood join, with DataFrame functions only.

Lines are compared as sequences of words (lower case, split at white space). A line goes if an earlier line, by
(doc_id, text, position), equals it or differs by at most one edit: a word put in, taken out or replaced. The one bound
``max_edits`` is 0 or 1. Edits are only considered for lines of at least ``min_words`` words: that is what near means, since
one word of a shorter line is too large a share of it ("chapter one", "chapter two"). Blank lines stay.

1. Equal lines: one partial aggregation per line hash finds the earliest occurrence, so no group of copies meets.
2. A pair one edit apart shares its first half or its last half. Distinct lines that share no half with another line
   are left out of the rest; this loses no pair.
3. The remaining lines emit hashed keys of the line without each of its words, and of the line itself. A bucket of equal
   keys needs no pairs: its earliest line stands for it. Rows of a bucket are aggregated before the shuffle.
4. Each candidate's edit distance to its earliest partner is verified on the words.
5. Positions that stay are gathered by document and the text is put together from them.

Step 1 moves hashes of the lines, not the lines.

Lines are ordered by (doc_id, hash of the text, position). Rows that share a doc_id but not a text are documents of their own,
as are rows with a null id, which come last; so no text decides about another's lines by its id.

Defined results: null text stays null and has no lines; empty text stays; a text whose lines all go becomes empty, the
row stays; rows that share doc_id and text are one document: a position that stays, stays in each of them; the further
columns of the input are kept; the order of the rows doesn't matter; an empty table gives no rows.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import Scratch, durable, free_name, scratch, table

BLOCK = 256
#: Bits of a place and of a document: what fits a decimal of 38 digits, and what a quotient of such has before the point.
BITS, DOC_BITS = 126, 102


class Places:
    """A document, and a line in it, as one sortable number: id (null ids last), hash of the text, position.

    Each part gets as many bits as the table needs; the hash gets what is left, and is tried with other seeds until no two
    different texts of one id share it.
    """

    def __init__(self, docs: DataFrame):
        found = docs.agg(
            F.coalesce(F.min("doc_id"), F.lit(0)).alias("low"),
            F.coalesce(F.max("doc_id"), F.lit(0)).alias("high"),
            F.coalesce(F.max(F.length("text") - F.length(F.replace("text", F.lit("\n")))), F.lit(0)).alias("last"),
        ).first()
        self.low, self.null = found.low, found.high + 1 - found.low
        self.pos_bits = int(found.last + 1).bit_length()
        self.text_bits = min(62, min(BITS - self.pos_bits, DOC_BITS) - int(self.null).bit_length())
        for self.seed in itertools.count():
            texts = docs.filter("text IS NOT NULL").groupBy(self.doc().alias("doc")).agg(F.min(F.xxhash64("text", F.lit("all"))).alias("x"), F.max(F.xxhash64("text", F.lit("all"))).alias("y"))
            if not texts.filter("x <> y").head(1):
                break

    def doc(self) -> Column:
        """The document's number: rows with one id and one text are one document."""
        whole = F.coalesce((F.col("doc_id").cast("decimal(20,0)") - F.lit(self.low).cast("decimal(20,0)")).cast("decimal(20,0)"), F.lit(str(self.null)).cast("decimal(20,0)"))
        text = F.pmod(F.xxhash64("text", F.lit(self.seed)), F.lit(1 << self.text_bits)).cast("decimal(19,0)")
        return (whole * F.lit(1 << self.text_bits).cast("decimal(19,0)")).cast("decimal(38,0)") + text

    def place(self, doc: Column, pos: Column) -> Column:
        return ((doc * F.lit(1 << self.pos_bits).cast("decimal(11,0)")).cast("decimal(38,0)") + pos.cast("decimal(11,0)")).cast("decimal(38,0)")

    def doc_and_pos(self) -> tuple[Column, Column]:
        """What ``place`` was made of."""
        shift = F.lit(1 << self.pos_bits).cast("decimal(38,0)")
        pos = F.pmod(F.col("place"), shift)
        return ((F.col("place") - pos) / shift).cast("decimal(38,0)").alias("d"), pos.cast("int").alias("pos")


#: White space within lines, as the pattern ``\\s`` has it.
GAPS = " \t\x0b\f\r"


def normal_lines(text: Column) -> Column:
    """The lines of a text in their normal form: lower case, white space as single spaces. Texts with single spaces only need no pattern."""
    odd = text.contains("  ")
    for gap in GAPS[1:]:
        odd = odd | text.contains(gap)
    tidy = F.when(odd, F.regexp_replace(text, r"[\t\x0B\f\r][ \t\x0B\f\r]*| [ \t\x0B\f\r]+", " ")).otherwise(text)
    return F.split(F.lower(tidy), "\n")


def line_rows(docs: DataFrame, places: Places) -> DataFrame:
    """One row per line that isn't blank: document, position, normal form."""
    return (
        docs.filter(F.col("text").isNotNull())
        .select(places.doc().alias("d"), F.posexplode(normal_lines(F.col("text"))).alias("pos", "line"))
        .withColumn("line", F.trim("line"))
        .filter("line <> ''")
    )


def running(values: Column) -> Column:
    """Sums before each element of an array of longs, in blocks so that long lines stay cheap."""
    scan = lambda a: F.aggregate(
        a,
        F.struct(F.array().cast("array<bigint>").alias("out"), F.lit(0).cast("bigint").alias("sum")),
        lambda acc, x: F.struct(F.concat(acc["out"], F.array(acc["sum"])).alias("out"), (acc["sum"] + x).alias("sum")),
    )
    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int"))), lambda b: scan(F.slice(values, b * BLOCK + 1, F.lit(BLOCK))))
    starts = scan(F.transform(blocks, lambda s: s["sum"]))["out"]
    return F.flatten(F.zip_with(blocks, starts, lambda s, start: F.transform(s["out"], lambda x: x + start)))


def halves(line: Column, n: Column) -> Column:
    """Keys of the first and last half, for partners of the same length, and of one word more or less."""
    keys = []
    for least in (n, n - 1):
        first = F.floor(least / 2).cast("int")
        keys.append(F.xxhash64(F.lit(1), least, F.call_function("substring_index", line, F.lit(" "), first)))
        keys.append(F.xxhash64(F.lit(2), least, F.call_function("substring_index", line, F.lit(" "), (first - least).cast("int"))))
    return F.array(*keys)


def near_lines(first: DataFrame, docs: DataFrame, places: Places, tables: Scratch) -> DataFrame:
    """``place`` of the distinct lines that lie one edit from an earlier one. ``first``: place, halves."""
    keyed = first.filter("halves IS NOT NULL").select("place", F.explode("halves").alias("half"))
    shared = tables.write(keyed.groupBy("half").agg(F.min("place").alias("x"), F.max("place").alias("y")).filter("x <> y").select("half"))
    some = keyed.join(shared, "half").select("place").distinct()
    wanted = some.select(*places.doc_and_pos()).groupBy("d").agg(F.collect_set("pos").alias("wanted"))
    texts = docs.filter("text IS NOT NULL").select(places.doc().alias("d"), "text").join(wanted, "d").select("d", "wanted", normal_lines(F.col("text")).alias("lines"))
    rows = texts.select("d", F.explode(F.transform("wanted", lambda pos: F.struct(pos.alias("pos"), F.trim(F.get("lines", pos)).alias("line")))).alias("l")).filter("l.line IS NOT NULL")
    lines = tables.write(rows.select(places.place(F.col("d"), F.col("l.pos")).alias("place"), F.col("l.line").alias("line")).dropDuplicates(["place"]))
    variants = tables.write(line_variants(lines))
    buckets = tables.write(variants.groupBy("k", "i").agg(F.min("place").alias("earliest"), F.count("*").alias("c")))
    # Replaced words: lines of one length that agree without the word at the same place.
    best = buckets.filter("i >= 0 AND c > 1").select("k", "i", "earliest")
    replaced = variants.join(best, ["k", "i"]).filter("earliest < place").select("place", F.col("earliest").alias("partner"))
    # A word put in or taken out: a whole line that equals a longer one without a word.
    both = buckets.groupBy("k").agg(F.min(F.when(F.col("i") < 0, F.col("earliest"))).alias("short"), F.min(F.when(F.col("i") >= 0, F.col("earliest"))).alias("longer"))
    both = tables.write(both.filter("short IS NOT NULL AND longer IS NOT NULL"))
    shorter = both.filter("longer < short").select(F.col("short").alias("place"), F.col("longer").alias("partner"))
    lengthened = variants.filter("i >= 0").join(both.select("k", "short"), "k").filter("short < place").select("place", F.col("short").alias("partner"))
    pairs = replaced.unionByName(shorter).unionByName(lengthened).distinct()
    words = lines.select("place", F.split("line", " ").alias("words"))
    pairs = pairs.join(words, "place").join(words.select(F.col("place").alias("partner"), F.col("words").alias("others")), "partner")
    return tables.write(pairs.filter(one_edit(F.col("words"), F.col("others"))).select("place").distinct())


def line_variants(lines: DataFrame) -> DataFrame:
    """(k, i, place): hashed keys of each line without its word i, and with i = -1 of the whole line.

    A word's share of a key depends on its place, so a key is a sum, and running sums give those of all variants at once.
    """
    hashes = F.transform(F.split("line", " "), lambda w: F.xxhash64(w))
    at = lambda shift: F.transform("h", lambda h, i: F.pmod(F.xxhash64(h, i - shift), F.lit(1 << 40)))
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    sums = lines.select("place", hashes.alias("h")).select("place", F.size("h").alias("n"), at(0).alias("own"), at(1).alias("moved"))
    sums = sums.select("place", "n", running(F.col("own")).alias("before"), F.transform(F.arrays_zip("moved", running(F.col("moved")).alias("sum")), lambda x: x["moved"] + x["sum"]).alias("moved_through"), total("moved").alias("moved_all"), total("own").alias("whole"))
    without = F.zip_with("before", "moved_through", lambda b, m: b + F.col("moved_all") - m)
    rows = sums.select("place", "n", F.posexplode(F.concat(without, F.array("whole"))).alias("i", "sum"))
    whole = F.col("i") == F.col("n")
    return rows.select(F.xxhash64("sum", F.when(whole, F.col("n")).otherwise(F.col("n") - 1)).alias("k"), F.when(whole, F.lit(-1)).otherwise(F.col("i")).alias("i"), "place")


def one_edit(a: Column, b: Column) -> Column:
    """Whether two word arrays are at most one edit apart: what their common beginning and end leave is one word each at most."""
    common = lambda x, y: F.coalesce(F.nullif(F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False), F.lit(0)) - 1, F.least(F.size(x), F.size(y)))
    longest = F.greatest(F.size(a), F.size(b))
    return (F.abs(F.size(a) - F.size(b)) <= 1) & (common(a, b) + common(F.reverse(a), F.reverse(b)) >= longest - 1)


def dedup_lines(docs: DataFrame, max_edits: int = 1, min_words: int = 6) -> DataFrame:
    """``docs`` with repeated lines taken out of ``text``, and how many lines each row had and lost (``n_lines``, ``n_dropped``)."""
    if max_edits not in (0, 1):
        raise ValueError("max_edits is 0 or 1")
    places = Places(docs)
    n_lines, n_dropped = free_name(docs, "n_lines"), free_name(docs, "n_dropped")
    half = F.when(F.col("n") >= min_words, halves(F.col("line"), F.col("n"))) if max_edits else F.lit(None).cast("array<bigint>")
    rows = line_rows(docs, places).withColumn("n", F.size(F.split("line", " "))).select(F.xxhash64(F.lit(11), "line").alias("a"), F.xxhash64("line", F.lit(13)).alias("b"), places.place(F.col("d"), F.col("pos")).alias("place"), half.alias("halves"))
    rows = rows.select("a", "b", "place", *[F.get("halves", i).alias(f"h{i}") for i in range(4)])
    first = rows.groupBy("a", "b").agg(F.min("place").alias("place"), *[F.min(f"h{i}").alias(f"h{i}") for i in range(4)])
    first = first.select("place", F.when(F.col("h0").isNotNull(), F.array("h0", "h1", "h2", "h3")).alias("halves"))
    with scratch(docs.sparkSession) as tables:
        stay = first.select("place")
        if max_edits:
            first = tables.write(first)
            stay = first.select("place").join(near_lines(first, docs, places, tables), "place", "left_anti")
        by_doc = durable(stay.select(*places.doc_and_pos()).groupBy("d").agg(F.collect_list("pos").alias("keep")))
    mine = {c: F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c.lower() != "text"}
    joined = docs.withColumn(d := free_name(docs, "d"), places.doc()).alias("doc").join(by_doc.alias("by"), F.col(f"doc.{d}") == F.col("by.d"), "left")
    lines = F.split("doc.text", "\n")
    out = joined.select(*mine.values(), F.struct(lines.alias("lines"), F.coalesce("by.keep", F.array().cast("array<int>")).alias("keep")).alias(both := free_name(docs, "both")))
    blank = F.filter(F.transform(f"{both}.lines", lambda x, i: F.when(F.btrim(x, F.lit(GAPS)) == "", i)), lambda i: i.isNotNull())
    inside = F.filter(f"{both}.keep", lambda i: i < F.size(f"{both}.lines"))
    keep = F.array_sort(F.array_union(blank, inside))
    out = out.withColumn(both, F.struct(F.col(f"{both}.lines"), keep.alias("keep")))
    text = F.when(F.col(f"{both}.lines").isNotNull(), F.array_join(F.transform(f"{both}.keep", lambda i: F.get(F.col(f"{both}.lines"), i)), "\n"))
    count = lambda c: F.when(F.col(f"{both}.lines").isNull(), 0).otherwise(F.size(f"{both}.{c}"))
    columns = [text.alias("text") if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*columns, count("lines").alias(n_lines), (count("lines") - count("keep")).alias(n_dropped))


def op4_deletion_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated lines."""
    return dedup_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_dropped")
