"""Similarity of titles, names and journals as columns."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from sievework.functions.text import once, title_ascii, title_words, token_set
from sievework.functions.title_cells import COVERAGE, JACCARD, SEQUENCE, SORTED


def coverage(asked: Column, found: Column) -> Column:
    """Share of the asked words that are found (arrays of distinct words)."""
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, found)) / F.size(asked)).otherwise(0.0)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(0.0)


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matched characters over all characters, by longest matching blocks."""
    return pd.Series([1.0 if x == y else SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b, strict=True)])


def word_score(asked: Column, found: Column) -> Column:
    """What word overlap alone adds to the title score."""
    a, b = token_set(title_words(asked)), token_set(title_words(found))
    return COVERAGE * coverage(a, b) + JACCARD * jaccard(a, b)


def title_score(asked: Column, found: Column) -> Column:
    """Bibliographic title similarity, 0 to 1, six places. Python sees every row; null titles, as a caller gives for rows it has decided, and equal ones cost nothing there."""
    na, nb = title_words(asked), title_words(found)
    ordered = lambda n: F.array_join(F.array_sort(token_set(n)), " ")
    score = word_score(asked, found) + SEQUENCE * sequence_ratio(na, nb) + SORTED * sequence_ratio(ordered(na), ordered(nb))
    return F.when((F.coalesce(na, F.lit("")) == "") | (F.coalesce(nb, F.lit("")) == ""), 0.0).when(na == nb, 1.0).otherwise(F.round(F.least(F.lit(1.0), score), 6))


def _pairs_of(text: Column) -> Column:
    """Character pairs, each with the number of the same ones before it, so that repeats are told apart."""
    n = F.length(text)
    pairs = F.when(n > 1, F.sort_array(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(text, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))
    return once(pairs, lambda g: F.transform(g, lambda p, i: F.concat(p, (i - F.array_position(g, p)).cast("string"))))


def dice_title_score(a: Column, b: Column) -> Column:
    """Character-pair Dice (as multisets) and word coverage, 0.55 and 0.45."""

    def score(x: Column, y: Column, gx: Column, gy: Column) -> Column:
        total = F.size(gx) + F.size(gy)
        dice = F.when(total > 0, 2 * F.size(F.array_intersect(gx, gy)) / total).otherwise(0.0)
        both = F.least(F.lit(1.0), 0.55 * dice + 0.45 * coverage(token_set(x), token_set(y)))
        return F.when((F.coalesce(x, F.lit("")) == "") | (F.coalesce(y, F.lit("")) == ""), 0.0).when(x == y, 1.0).otherwise(both)

    return once(title_ascii(a), lambda x: once(title_ascii(b), lambda y: once(_pairs_of(x), lambda gx: once(_pairs_of(y), lambda gy: score(x, y, gx, gy)))))


def same_surname(a: Column, b: Column) -> Column:
    """Whether the last words of two names are equal."""
    last = lambda n: F.nullif(F.element_at(F.split(title_words(n), " "), -1), F.lit(""))
    return F.coalesce(last(a) == last(b), F.lit(False))


def covered_by(title: Column, text: Column, least: float = 0.75) -> Column:
    """Whether enough of a title's words occur in a text."""
    words = token_set(title_words(title))
    return F.coalesce((F.size(words) > 0) & (coverage(words, token_set(title_words(text))) >= least), F.lit(False))
