"""Language identification: known words first, then character n-grams.

A word of the vocabulary is scored by its log frequency in each language. A word that isn't known is read from left to
right with the longest known n-gram at each place, falling back to shorter ones. A text's score is the sum over all of
its words; the winner's share of the tempered posterior is the confidence.

The model is fitted on a bounded sample of labelled rows: per language about ``sample_chars`` characters, chosen by a hash
of the id, and at most ``max_words`` words and ``max_grams`` n-grams. These bounds hold whatever the corpus, so the model
(a few MB) may be broadcast. It passes the driver in Arrow columns, without a Python object a word. Every row is scored, in a
narrow map.

Words are runs of letters (Unicode's categories of letters), in training as in prediction.

Defined results: null text, or text without a letter, gives ``und`` with score 0; ties go to the language that sorts
first; without any labelled row all are ``und``; repeated rows are scored alike; a null id is hashed as the empty text;
other columns are ignored or, if asked for, kept beside ``lang_pred`` and ``score``, which get a leading ``_`` where the
input has columns of these names; texts are scored whole.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import free_name, handing_back, remainder, table

LONGEST = 4
CACHE = 400_000
ALPHA = 0.05


WORD = r"[^\W\d_]+"
#: What Python counts as alphanumeric also holds numbers such as fractions, which aren't letters and part words.
NUMBERS = "[" + "".join(c for c in map(chr, range(0x20000)) if c.isalnum() and not c.isalpha() and not c.isdecimal()) + "]+"


class Model:
    """Log frequencies per language of words and n-grams: names, a line each, and a matrix row for each name."""

    def __init__(self, langs: list[str], words: str, word_logs: np.ndarray, grams: str, gram_logs: np.ndarray, floor: np.ndarray):
        self.langs, self.words, self.word_logs, self.grams, self.gram_logs, self.floor = langs, words, word_logs, grams, gram_logs, floor

    def parts(self) -> tuple:
        return self.langs, self.words, self.word_logs, self.grams, self.gram_logs, self.floor


def rows_of(names: str) -> dict[str, int]:
    return {name: i for i, name in enumerate(names.split("\n"))} if names else {}


class Scorer(dict):
    """Word to row of a growing matrix; starts anew when it has reached its bound."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.known, self.grams = model, rows_of(model.words), rows_of(model.grams)
        self.start()

    def start(self) -> None:
        self.clear()
        self.update(self.known)
        self.rows = np.concatenate([self.model.word_logs, np.empty((4096, len(self.model.langs)))])
        self.words_in = np.ones(len(self.rows))

    def __missing__(self, word: str) -> int:
        at = len(self)
        if at == len(self.rows):
            self.rows = np.concatenate([self.rows, np.empty_like(self.rows)])
            self.words_in = np.concatenate([self.words_in, np.ones_like(self.words_in)])
        parts = [word] if word.isalpha() else [w for w in re.split(NUMBERS, word) if w]
        self.rows[at] = sum((self.model.word_logs[self.known[w]] if w in self.known else self.unseen(w) for w in parts), np.zeros(len(self.model.langs)))
        self.words_in[at] = len(parts)
        self[word] = at
        return at

    def unseen(self, word: str) -> np.ndarray:
        """The mean over the places of the word of the longest known n-gram that starts there."""
        marked, total, get = f"^{word}$", np.zeros(len(self.model.langs)), self.grams.get
        for at in range(len(marked)):
            for end in range(min(at + LONGEST, len(marked)), at, -1):
                if (known := get(marked[at:end])) is not None:
                    total += self.model.gram_logs[known]
                    break
            else:
                total += self.model.floor
        return total / len(marked)

    def total(self, words: list[str]) -> tuple[np.ndarray, float]:
        """The sum of the words' rows, and how many words there are."""
        if len(self) > CACHE:
            self.start()
        at = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        return self.rows[at].sum(axis=0), float(self.words_in[at].sum())


def letters(text):
    """Letter runs of a text column, as an array (lower case)."""
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}]+", " ")), " ")


def fit(labelled: DataFrame, sample_chars: int = 6_000_000, max_words: int = 120_000, max_grams: int = 120_000) -> Model:
    """A model from rows with ``doc_id``, ``text`` and ``lang`` (both not null)."""
    sizes = {r.lang: r.chars for r in labelled.groupBy("lang").agg(F.sum(F.length("text")).alias("chars")).filter("chars > 0").collect()}
    langs = sorted(sizes)
    share = F.lit(0.0)
    for lang in langs:
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, sample_chars / sizes[lang]))).otherwise(share)
    u = F.pmod(F.xxhash64("doc_id", F.lit(20)), F.lit(1 << 30)) / float(1 << 30)
    words = labelled.filter(u < share).select("lang", F.explode(letters(F.col("text"))).alias("word")).filter("word <> ''")
    counts = words.groupBy("lang", "word").count()
    counts = counts.persist()
    try:
        by_lang = {r.lang: r.n for r in counts.groupBy("lang").agg(F.sum("count").alias("n")).collect()}
        totals = {lang: by_lang.get(lang, 1) for lang in langs}
        part = F.lit(1.0)
        for lang in langs:
            part = F.when(F.col("lang") == lang, F.lit(1.0 / totals[lang])).otherwise(part)
        def chosen(df: DataFrame, name: str, most: int):
            """The most frequent names, in Arrow: the name, and its counts in the order of ``langs``."""
            by_lang = [F.sum(F.when(F.col("lang") == lang, F.col("count")).otherwise(0)).alias(f"n{i}") for i, lang in enumerate(langs)]
            best = df.groupBy(name).agg(F.max(F.col("count") * part).alias("f"), *by_lang).orderBy(F.desc("f"), name).limit(most)
            return best.select(name, F.array(*[f"n{i}" for i in range(len(langs))]).cast("array<double>").alias("n")).toArrow()

        known = chosen(counts.filter("count > 1"), "word", max_words)
        marked = F.concat(F.lit("^"), "word", F.lit("$"))
        sizes_ = F.explode(F.sequence(F.lit(1), F.lit(LONGEST))).alias("size")
        spread = counts.select("lang", "count", marked.alias("marked"), sizes_).filter(F.length("marked") >= F.col("size"))
        grams = spread.select("lang", "count", "size", F.explode(F.transform(F.sequence(F.lit(1), F.length("marked") - F.col("size") + 1), lambda i: F.substring(F.col("marked"), i, F.col("size")))).alias("gram"))
        pieces = chosen(grams.groupBy("lang", "gram").agg(F.sum("count").alias("count")).filter("count > 2"), "gram", max_grams)
    finally:
        counts.unpersist()
    base = np.array([totals[lang] for lang in langs], dtype=float)

    def logs(found) -> np.ndarray:
        n = found.column("n").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(found), len(langs))
        return np.log((n + ALPHA) / (base + ALPHA * len(found)))

    lines = lambda found, name: "\n".join(map(str, found.column(name)))
    floor = np.log(ALPHA / (base + ALPHA * max(1, len(pieces))))
    return Model(langs, lines(known, "word"), logs(known), lines(pieces, "gram"), logs(pieces), floor)


def new_columns(df: DataFrame) -> tuple[str, str]:
    """What ``predict`` names its two columns beside those of ``df``."""
    return free_name(df, "lang_pred"), free_name(df, "score")


def predict(docs: DataFrame, model: Model, keep: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """The columns ``keep`` of ``docs``, with ``lang_pred`` and ``score`` of its ``text``."""
    lang_pred, score = new_columns(docs.select(*keep))
    shared = docs.sparkSession.sparkContext.broadcast(model.parts())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, word = Model(*shared.value), re.compile(WORD)
        scorer, langs = Scorer(model), model.langs
        for batch in batches:
            preds, scores = [], []
            for text in batch["text"]:
                words = word.findall(text.lower()) if text else []
                total, n = scorer.total(words) if words and langs else (None, 0)
                if not n:
                    preds.append("und")
                    scores.append(0.0)
                    continue
                best = int(total.argmax())
                preds.append(langs[best])
                scores.append(1.0 / float(np.exp(np.maximum((total - total[best]) / math.sqrt(n), -700)).sum()))
            yield batch[keep].assign(**{lang_pred: preds, score: scores})

    fields = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInPandas(handing_back(run), f"{fields}, `{lang_pred}` string, `{score}` double")


def training_rows(docs: DataFrame) -> DataFrame:
    """Labelled rows outside the held-out quarter."""
    return docs.select("doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (remainder(F.col("doc_id"), 4) != 2))


def op2_word_first_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document."""
    docs = table(spark, sf_dir, "documents")
    found = predict(docs, fit(training_rows(docs)))
    return found.select("doc_id", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", "score")
