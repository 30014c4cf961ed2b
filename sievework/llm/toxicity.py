"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is logistic in its words; the document's is the noisy-or of its
sentences, so only document labels are needed. A word's features are the word itself and its beginnings of ``SHORTEST`` to
``LONGEST`` letters, so that inflected forms that training never saw count by their stem. After training, the sentences that score at least one half are the
offending ones.

Training uses a bounded sample: at most ``positives`` and ``negatives`` labelled documents, the first by a hash of the id,
whole texts (of several under one id, the one with the smallest hash), weighted back to the labels' shares. It runs in one task over that sample. The fitted list has at most
``features`` features and is broadcast. Scoring is a narrow map over all rows.

Defined results: null or empty text has no sentence and score 0; texts are scored whole; a doc_id with several labels is
toxic if one of them says so; null labels are ignored; repeated rows are scored alike; without labels of both kinds
every score is 0; other columns are ignored or, if asked for, kept beside ``score`` and ``offending``, which get a leading
``_`` where the input has columns of these names.
"""

from __future__ import annotations

import json
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.llm.common import free_name, remainder, table

SENTENCE = r"[^.!?\n。！？]+"
WORD = r"[^\W\d_]+"
SHORTEST, LONGEST = 3, 10
CACHE = 500_000


def features_of(word: str) -> list[str]:
    """The word and, marked by a star, its proper beginnings."""
    return [word, *(word[:n] + "*" for n in range(SHORTEST, min(LONGEST, len(word) - 1) + 1))]


class WordWeights(dict):
    """Word to the sum of its features' weights; starts anew when it has reached its bound."""

    def __init__(self, weights: dict[str, float]):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) > CACHE:
            self.clear()
        self[word] = total = sum(self.weights.get(f, 0.0) for f in features_of(word))
        return total


def bags(texts: pd.Series) -> list[list[set[str]]]:
    """Word sets of the sentences of each text."""
    sentence, word = re.compile(SENTENCE), re.compile(WORD)
    return [[w for s in sentence.findall((t or "").lower()) if (w := set(word.findall(s)))] for t in texts]


def choose_features(found: list[list[set[str]]], y: np.ndarray, weight: np.ndarray, features: int) -> list[str]:
    """Features whose presence in a document says most about its label (weighted z of the log odds)."""
    seen = Counter(), Counter()
    for sentences, label in zip(found, y, strict=True):
        seen[int(label)].update({f for bag in sentences for w in bag for f in features_of(w)})
    each = np.array([weight[y == label].mean() for label in (0, 1)])
    n = np.array([weight[y == label].sum() for label in (0, 1)])
    names = [f for f, total in (seen[0] + seen[1]).items() if total >= 3]
    c = np.array([[seen[0][f], seen[1][f]] for f in names], dtype=float).reshape(-1, 2) * each
    odds = np.log((c + 0.5) / (n + 0.5 - c))
    z = np.abs(odds[:, 1] - odds[:, 0]) / np.sqrt((1 / (c + 0.5)).sum(axis=1))
    return [f for _, f in sorted((-z[i], names[i]) for i in np.flatnonzero(z > 3))[:features]]


def train(texts: pd.Series, y: np.ndarray, weight: np.ndarray, features: int, steps: int = 400) -> dict:
    """Word weights and bias that maximise the weighted likelihood of the noisy-or."""
    found = bags(texts)
    words = choose_features(found, y, weight, features)
    index = {w: i for i, w in enumerate(words)}
    doc, sentence, feature, plain = [], [], [], np.zeros(len(y))
    s = 0
    for d, sentences in enumerate(found):
        for bag in sentences:
            if known := [index[f] for w in bag for f in features_of(w) if f in index]:
                doc.append(d)
                sentence.extend([s] * len(known))
                feature.extend(known)
                s += 1
            else:
                plain[d] += 1
    doc, sentence, feature = (np.array(x, dtype=np.int64) for x in (doc, sentence, feature))
    theta = np.zeros(len(words) + 1)
    theta[-1] = -7.0
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    weight = weight / weight.sum()
    for step in range(1, steps + 1):
        z = theta[-1] + np.bincount(sentence, theta[feature], minlength=s)
        p, p0 = 1 / (1 + np.exp(-z)), 1 / (1 + np.exp(-theta[-1]))
        none = -np.bincount(doc, np.logaddexp(0, z), minlength=len(y)) - plain * np.logaddexp(0, theta[-1])
        some = np.maximum(-np.expm1(none), 1e-12)
        slope = weight * np.where(y == 1, 1 - 1 / some, 1.0)
        g_s = slope[doc] * p
        grad = np.append(np.bincount(feature, g_s[sentence], minlength=len(words)), g_s.sum() + (slope * plain * p0).sum())
        grad[:-1] += 1e-5 * theta[:-1]
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        theta -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
    return {"bias": float(theta[-1]), "weights": {w: float(theta[i]) for w, i in index.items()}}


def fit(docs: DataFrame, labels: DataFrame, positives: int = 2000, negatives: int = 4000, features: int = 2000) -> dict:
    """The model from a bounded sample of labelled documents."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n = {bool(r.toxic): r.n for r in known.groupBy((F.col("toxic") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    if len(n) < 2:
        return {"bias": 0.0, "weights": {}, "empty": True}
    by_hash = lambda df, most: df.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(most)
    sample = by_hash(known.filter("toxic > 0"), positives).unionByName(by_hash(known.filter("toxic <= 0"), negatives))
    # The sample's ids are bounded by the two parameters, so they may be sent to every executor.
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text"), F.max("toxic").alias("toxic"))
    weights = {True: n[True] / min(n[True], positives), False: n[False] / min(n[False], negatives)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if len(rows := [b for b in batches if len(b)]):
            whole = pd.concat(rows).sort_values("doc_id")
            y = (whole["toxic"].to_numpy() > 0).astype(int)
            model = train(whole["text"], y, np.where(y == 1, weights[True], weights[False]), features) if 0 < y.sum() < len(y) else {"bias": 0.0, "weights": {}, "empty": True}
            yield pd.DataFrame({"model": [json.dumps(model)]})

    found = rows.repartition(1).mapInPandas(run, "model string").collect()
    return json.loads(found[0].model) if found else {"bias": 0.0, "weights": {}, "empty": True}


def score_documents(docs: DataFrame, model: dict, keep: list[str] = ["doc_id"]) -> DataFrame:  # noqa: B006
    """``keep`` columns with the document's score and its offending sentences (start, end, score)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    score, offending = (free_name(docs.select(*keep), c) for c in ("score", "offending"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights, bias, empty = shared.value["weights"], shared.value["bias"], "empty" in shared.value
        of, sentence, word = WordWeights(weights), re.compile(SENTENCE), re.compile(WORD)
        plain = float(np.logaddexp(0, bias))
        for batch in batches:
            scores, spans = [], []
            for text in batch["text"]:
                none, found = 0.0, []
                for m in sentence.finditer((text or "").lower()) if not empty else ():
                    bag = set(word.findall(m[0]))
                    if not bag:
                        continue
                    total = sum(of[w] for w in bag)
                    if total == 0.0:
                        none -= plain
                        continue
                    z = bias + total
                    none -= float(np.logaddexp(0, z))
                    if z >= 0:
                        found.append({"start": m.start(), "end": m.end(), "score": 1 / (1 + float(np.exp(-min(z, 50))))})
                scores.append(float(-np.expm1(none)))
                spans.append(found)
            yield batch[keep].assign(**{score: scores, offending: spans})

    fields = ", ".join(f"`{c}` {t}" for c, t in docs.select(*keep).dtypes)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInPandas(run, f"{fields}, `{score}` double, `{offending}` array<struct<start:int,end:int,score:double>>")


def op7_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity, learned from labels outside the held-out fifth."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit(docs, labels.filter(remainder(F.col("doc_id"), 5) != 0))
    scored = score_documents(docs, model)
    return scored.select(
        "doc_id",
        (remainder(F.col("doc_id"), 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
        F.size("offending").alias("n_offending"),
    )
