"""Title scores of one cell: a block of requests against a block of hits, both as distinct normal forms.

Words in common are counted by postings, bounds are taken over arrays, and only pairs that these leave open are compared as sequences.
"""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import numpy as np

#: Fixed weights of the title score: coverage, Jaccard, character sequence, sequence of sorted words.
COVERAGE, JACCARD, SEQUENCE, SORTED = 0.34, 0.26, 0.25, 0.15
#: Scores are rounded to six places, so a bound on one may lie this far below the threshold.
SLACK = 1e-6
#: Longest texts, in characters, whose common subsequence is bounded: one machine word.
BITS = 64
#: Signs fall into so many bins when only their numbers are compared; sharing one raises a bound, never lowers it.
BINS = 32
#: Pairs whose bounds are taken at once.
PAIRS = 50_000


class _Texts:
    """Lengths, letter counts and codes of texts."""

    def __init__(self, texts: list[str]):
        self.texts, self.length = texts, np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
        row = np.repeat(np.arange(len(texts)), self.length)
        signs = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        counts = np.bincount(row * BINS + signs % BINS, minlength=len(texts) * BINS)
        self.letters = np.minimum(counts, 65_535).astype(np.uint16).reshape(len(texts), BINS)
        self.whole = self.length <= BITS
        at = np.arange(len(signs)) - np.repeat(np.cumsum(self.length) - self.length, self.length)
        short = self.whole[row]
        self.codes = np.full((len(texts), BITS), 256, dtype=np.int64)
        self.codes[row[short], at[short]] = signs[short] & 255

    def in_common(self, i: np.ndarray, other: _Texts, j: np.ndarray) -> np.ndarray:
        """At least what the sequences of pairs have in common: signs, whatever their order."""
        n = np.minimum(self.letters[i], other.letters[j]).sum(axis=1, dtype=np.int64)
        many = (self.length[i] > 65_535) | (other.length[j] > 65_535)
        return np.where(many, np.minimum(self.length[i], other.length[j]), n)

    def in_order(self, i: np.ndarray, other: _Texts, j: np.ndarray) -> np.ndarray:
        """The same by longest common subsequences, in bits; texts too long for that count as equal."""
        used, row = np.unique(i, return_inverse=True)
        masks = np.zeros((len(used), 257), dtype=np.uint64)
        for t in range(int(self.length[used][self.whole[used]].max(initial=0))):
            masks[np.arange(len(used)), self.codes[used, t]] |= np.uint64(1 << t)
        masks[:, 256] = 0
        v = np.full(len(i), np.iinfo(np.uint64).max, dtype=np.uint64)
        for t in range(int(other.length[j][other.whole[j]].max(initial=0))):
            u = v & masks[row, other.codes[j, t]]
            v = (v + u) | (v - u)
        n = np.minimum(self.length[i], BITS).astype(np.uint64)
        low = np.where(n == BITS, np.iinfo(np.uint64).max, (np.uint64(1) << (n % np.uint64(BITS))) - np.uint64(1))
        common = np.bitwise_count(~v & low).astype(np.int64)
        return np.where(self.whole[i] & other.whole[j], common, np.minimum(self.length[i], other.length[j]))

    def share(self, i: np.ndarray, other: _Texts, j: np.ndarray, common: np.ndarray) -> np.ndarray:
        return 2 * common / (self.length[i] + other.length[j])


def _words(text: str) -> list[str]:
    return sorted({w for w in text.split(" ") if w})


class Cell:
    """A block of requests and one of hits: distinct normal forms with a word at least."""

    def __init__(self, asked: list[str], hits: list[str]):
        self.asked, self.hits = asked, hits
        of_asked, of_hits = [_words(a) for a in asked], [_words(h) for h in hits]
        known: dict[str, int] = {}
        self.ids = [[known.setdefault(w, len(known)) for w in words] for words in of_asked]
        self.sizes = np.fromiter(map(len, of_hits), dtype=np.int64, count=len(hits))
        pairs = [(known[w], i) for i, words in enumerate(of_hits) for w in words if w in known]
        word, at = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
        order = np.argsort(word, kind="stable")
        self.at, self.start = at[order], np.searchsorted(word[order], np.arange(len(known) + 1))
        self.ordered_asked, self.ordered_hits = [" ".join(w) for w in of_asked], [" ".join(w) for w in of_hits]

    def overlapping(self, need: float):
        """Per request: its number, the hits whose words bring at least ``need``, and what they bring."""
        share = max(0.0, need / (COVERAGE + JACCARD))
        for i, ids in enumerate(self.ids):
            n = len(ids)
            common = np.bincount(np.concatenate([self.at[self.start[w] : self.start[w + 1]] for w in ids]), minlength=len(self.hits))
            near = np.flatnonzero(common >= max(1, math.ceil(n * share - 1e-9)))
            c = common[near]
            words = COVERAGE * (c / n) + JACCARD * (c / (n + self.sizes[near] - c))
            enough = words >= need - SLACK
            yield i, near[enough], words[enough]

    def by_words(self, threshold: float) -> tuple[list[str], list[str], list[float]]:
        """Pairs by word overlap alone, with their scores before rounding."""
        out: tuple[list[str], list[str], list[float]] = ([], [], [])
        for i, near, words in self.overlapping(threshold):
            out[0].extend([self.asked[i]] * len(near))
            out[1].extend(self.hits[j] for j in near)
            out[2].extend(words.tolist())
        return out

    def by_score(self, threshold: float) -> tuple[list[str], list[str], list[float]]:
        """Pairs whose full title score may reach the threshold, with their scores before rounding."""
        plain, hit_plain = _Texts(self.asked), _Texts(self.hits)
        ordered, hit_ordered = _Texts(self.ordered_asked), _Texts(self.ordered_hits)
        out: tuple[list[str], list[str], list[float]] = ([], [], [])
        least = threshold - SLACK

        def compare(i: np.ndarray, j: np.ndarray, words: np.ndarray) -> None:
            for bound in (_Texts.in_common, _Texts.in_order):
                by_plain = plain.share(i, hit_plain, j, bound(plain, i, hit_plain, j))
                by_ordered = ordered.share(i, hit_ordered, j, bound(ordered, i, hit_ordered, j))
                open_ = words + SEQUENCE * by_plain + SORTED * by_ordered >= least - 1e-9
                i, j, words, by_ordered = i[open_], j[open_], words[open_], by_ordered[open_]
            first, second = SequenceMatcher(None), SequenceMatcher(None)
            order = np.argsort(j, kind="stable")  # a matcher keeps what it knows of its second text
            before = -1
            for x, y, w, most in zip(i[order].tolist(), j[order].tolist(), words[order].tolist(), by_ordered[order].tolist(), strict=True):
                a, b = self.asked[x], self.hits[y]
                score = 1.0
                if a != b:
                    if y != before:
                        first.set_seq2(b)
                        second.set_seq2(self.ordered_hits[y])
                        before = y
                    first.set_seq1(a)
                    score = w + SEQUENCE * first.ratio()
                    if score + SORTED * most < least - 1e-9:
                        continue
                    second.set_seq1(self.ordered_asked[x])
                    score = min(1.0, score + SORTED * second.ratio())
                    if score < least:
                        continue
                out[0].append(a)
                out[1].append(b)
                out[2].append(score)

        waiting, n = [], 0
        for i, near, words in self.overlapping(threshold - SEQUENCE - SORTED):
            a, b = plain.length[i], hit_plain.length[near]
            c, d = ordered.length[i], hit_ordered.length[near]
            # The shorter of two texts bounds what their sequences have in common.
            open_ = words + SEQUENCE * 2 * np.minimum(a, b) / (a + b) + SORTED * 2 * np.minimum(c, d) / (c + d) >= least - 1e-9
            near, words = near[open_], words[open_]
            waiting.append((np.full(len(near), i), near, words))
            n += len(near)
            if n >= PAIRS:
                compare(*map(np.concatenate, zip(*waiting, strict=True)))
                waiting, n = [], 0
        if n:
            compare(*map(np.concatenate, zip(*waiting, strict=True)))
        return out
