"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece exactly one token can come last in the prefix's encoding. The table of these last
tokens is filled from left to right: a token that ends at the prefix's end is the right one if it may follow the last
token of the prefix before it. A pair of tokens may stand side by side if undoing their merges, newest first, never
meets an older merge across the border. Walking the table backwards gives the encoding; appending bytes only adds
entries, and an edit re-encodes only from the piece before it until the old piece borders are met again.

The work is a narrow map over partitions without a shuffle; the rank table has a fixed size and is broadcast. Caches of
piece encodings have two generations of a set size.

Defined results: null text counts as empty (no tokens, digests of no bytes); texts of any length are encoded whole;
repeated rows and null ids pass through row by row; other columns of the input are kept by ``encode_documents``
(its own column gets a free name) and ignored by the query; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from struct import pack

import numpy as np
import pandas as pd
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession

from sievework.llm.common import free_name, handing_back, table

CACHE = 300_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, of a file with a base64 token and a rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def last_merges(ranks: dict[bytes, int]) -> dict[int, tuple[int, int]]:
    """The two tokens that the last merge of each token joins; single bytes have none."""
    found = {}
    for token, rank in ranks.items():
        if len(token) == 1:
            continue
        parts = [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            joined = [ranks.get(a + b, rank) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(joined)
            if best >= rank:
                break
            i = joined.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        if len(parts) == 2:
            found[rank] = (ranks[parts[0]], ranks[parts[1]])
    return found


class Tokens:
    """The constant tables of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], merges: dict[int, tuple[int, int]] | None = None):
        self.ranks = ranks
        self.merges = last_merges(ranks) if merges is None else merges
        self.pairs = {pair: rank for rank, pair in self.merges.items()}
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks), default=1)


class Encoder:
    """Encodes texts with one vocabulary; holds bounded caches."""

    def __init__(self, tokens: Tokens, pattern: str):
        self.tokens, self.split = tokens, regex.compile(pattern)
        self.allowed: dict[int, bool] = {}
        self.packed: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def may_follow(self, left: int, right: int) -> bool:
        if len(self.allowed) > CACHE:
            self.allowed.clear()
        self.allowed[left << 20 | right] = known = self._border_holds(left, right)
        return known

    def _border_holds(self, left: int, right: int) -> bool:
        """Undo merges on both sides, newest first; false if an older merge would have crossed the border."""
        merges, pairs = self.tokens.merges, self.tokens.pairs
        undone = 1 << 60
        while True:
            if pairs.get((left, right), undone) < undone:
                return False
            # A token without a merge is a single byte and can't be undone; between equals the right one is newer.
            a, b = (left if left in merges else -1), (right if right in merges else -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                undone, left = a, merges[a][1]
            else:
                undone, right = b + 1, merges[b][0]

    def last_tokens(self, piece: bytes, last: list[int] | None = None) -> list[int]:
        """The last token of each prefix; ``last`` of a prefix of ``piece`` is continued."""
        rank, longest, known, may_follow = self.tokens.ranks.get, self.tokens.longest, self.allowed.get, self.may_follow
        last = [-1] if last is None else last
        for end in range(len(last), len(piece) + 1):
            found = -1
            for start in range(end - longest if end > longest else 0, end):
                token = rank(piece[start:end])
                if token is None:
                    continue
                if start:
                    before = last[start]
                    if before < 0:
                        continue
                    fits = known(before << 20 | token)
                    if fits is None:
                        fits = may_follow(before, token)
                    if not fits:
                        continue
                found = token
                break
            last.append(found)
        return last

    def piece(self, piece: bytes) -> list[int]:
        last, out, end = self.last_tokens(piece), [], len(piece)
        while end:
            out.append(last[end])
            end -= len(self.tokens.bytes[last[end]])
        return out[::-1]

    def ids_of(self, piece: str) -> bytes:
        """The piece's ids as little-endian 32-bit integers."""
        if (known := self.packed.get(piece)) is not None:
            return known
        if (packed := self.older.get(piece)) is None:
            raw = piece.encode("utf-8")
            ids = [known] if (known := self.tokens.ranks.get(raw)) is not None else self.piece(raw)
            packed = pack(f"<{len(ids)}I", *ids)
        if len(self.packed) >= CACHE:
            # Pieces in use move to the new generation; the others go with the old one.
            self.older = dict(self.packed)
            self.packed.clear()
        self.packed[piece] = packed
        return packed

    def encode(self, text: str) -> np.ndarray:
        get, miss = self.packed.get, self.ids_of
        return np.frombuffer(b"".join([get(p) or miss(p) for p in self.split.findall(text)]), dtype="<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.tokens.bytes.__getitem__, ids.tolist()))

    def edit(self, text: str, ids: np.ndarray, start: int, end: int, added: str) -> tuple[str, np.ndarray]:
        """``text`` with [start, end) replaced by ``added``, and its ids; only pieces near the edit are encoded again.

        Pieces look at most one character ahead, so those that end before ``start`` stay. Behind the edit, the first
        new piece that starts where an old one did ends the work.
        """
        new, at, kept, seen, old = text[:start] + added + text[end:], 0, 0, 0, {}
        shift = start + len(added) - end
        for m in self.split.finditer(text):
            if m.end() < start:
                at, kept = m.end(), seen + len(self.ids_of(m[0])) // 4
            elif m.start() >= end:
                old[m.start() + shift] = seen
            seen += len(self.ids_of(m[0])) // 4
        out = [np.asarray(ids[:kept], dtype="<u4")]
        for m in self.split.finditer(new, at):
            if m.start() in old and m.start() >= start + len(added):
                out.append(np.asarray(ids[old[m.start()] :], dtype="<u4"))
                break
            out.append(np.frombuffer(self.ids_of(m[0]), dtype="<u4"))
        return new, np.concatenate(out)

    def append(self, text: str, ids: np.ndarray, added: str) -> tuple[str, np.ndarray]:
        return self.edit(text, ids, len(text), len(text), added)


def share(spark: SparkSession, path: str) -> Broadcast:
    """The vocabulary's tables on every executor; their size is that of the vocabulary file, whatever the corpus."""
    ranks = read_ranks(path)
    return spark.sparkContext.broadcast({"ranks": ranks, "merges": last_merges(ranks)})


def encoder_of(held: dict, pattern: str) -> Encoder:
    """The worker process's encoder: kept beside the broadcast tables, so that later tasks find its caches warm."""
    if pattern not in held:
        held[pattern] = Encoder(Tokens(held["ranks"], held["merges"]), pattern)
    return held[pattern]


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", out: str = "token_ids") -> DataFrame:
    """``docs`` with the token ids of a text column."""
    tokens, name = share(docs.sparkSession, path), free_name(docs, out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(tokens.value, pattern)
        for batch in batches:
            yield batch.assign(**{name: [encoder.encode(t or "").astype(np.int32) for t in batch[text]]})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInPandas(run, f"{fields}, `{name}` array<int>")


def decode_documents(encoded: DataFrame, path: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that a column of token ids stands for."""
    tokens, name = share(encoded.sparkSession, path), free_name(encoded, out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        decoder = encoder_of(tokens.value, ".")
        for batch in batches:
            yield batch.assign(**{name: [decoder.decode(np.asarray(x if x is not None else [], dtype=np.int64)) for x in batch[ids]]})

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInPandas(run, f"{fields}, `{name}` binary")


def digest_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Number of tokens and digests of the ids and of the bytes decoded from them, one row per document."""
    tokens = share(docs.sparkSession, path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(tokens.value, pattern)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                ids = encoder.encode(text or "")
                rows.append((len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(encoder.decode(ids)).hexdigest()))
            done = pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
            yield pd.concat([batch[["doc_id"]].reset_index(drop=True), done], axis=1)

    return docs.select("doc_id", "text").mapInPandas(handing_back(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_prefix_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded with the 50k byte vocabulary, and decoded again."""
    import public_tokenizers as public

    return digest_documents(table(spark, sf_dir, "documents"), public.path("byte_bpe_50k.tiktoken"), public.PATTERN)
