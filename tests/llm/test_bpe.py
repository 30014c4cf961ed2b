import hashlib
import random

import numpy as np
import public_tokenizers as public
import pytest
import tiktoken

from sievework.llm import bpe


@pytest.fixture(scope="module")
def coder():
    ranks = bpe.read_ranks(public.path("byte_bpe_50k.tiktoken"))
    return bpe.Encoder(bpe.Tokens(ranks), public.PATTERN), tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts(n, seed=1):
    rng = random.Random(seed)
    bits = [*"abcdeThe  \n\t'sl1234é漢🙂-_=", "ing", "tion", " the", "    ", "aaaa", "0000", "!!!!", "<|endoftext|>"]
    return ["".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 5, 60]))) for _ in range(n)]


def test_ids_are_those_of_the_library(coder):
    own, library = coder
    for t in [*texts(400), "a" * 5000, "漢" * 700]:
        ids = own.encode(t)
        assert ids.tolist() == library.encode_ordinary(t) and own.decode(ids) == t.encode()


def test_edits_and_appends(coder):
    own, library = coder
    rng = random.Random(2)
    for t in texts(300, 3):
        start = rng.randrange(len(t) + 1)
        end = rng.randrange(start, len(t) + 1)
        new, ids = own.edit(t, own.encode(t), start, end, rng.choice(["", "x", " the", "'s", "  ", "\n"]))
        assert ids.tolist() == library.encode_ordinary(new)
        new, ids = own.append(t, own.encode(t), "ing on")
        assert ids.tolist() == library.encode_ordinary(new)


def test_prefixes_are_continued(coder):
    own, _ = coder
    word = b"unbelievableness"
    last = own.last_tokens(word[:7])
    assert own.last_tokens(word, last) == own.last_tokens(word)


def test_rows(spark, documents, coder):
    path = public.path("byte_bpe_50k.tiktoken")
    df = documents([(1, "Hello there"), (1, "Hello there"), (2, None), (3, ""), (None, "x")])
    out = bpe.decode_documents(bpe.encode_documents(df, path, public.PATTERN), path)
    assert sorted((bytes(r.decoded).decode(), r.text or "") for r in out.collect()) == sorted(((t, t) for t in ("Hello there", "Hello there", "", "", "x")))
    digests = bpe.digest_documents(df, path, public.PATTERN).collect()
    none = hashlib.sha256(b"").hexdigest()
    assert len(digests) == 5 and sum(r.n_tokens == 0 and r.ids_sha256 == none and r.decoded_sha256 == none for r in digests) == 2
    hello = next(r for r in digests if r.doc_id == 1)
    assert hello.ids_sha256 == hashlib.sha256(np.array(coder[1].encode_ordinary("Hello there"), dtype="<u4").tobytes()).hexdigest()
    assert bpe.digest_documents(df.limit(0), path, public.PATTERN).count() == 0
