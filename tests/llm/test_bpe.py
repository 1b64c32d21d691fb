"""Merge replay against the tiktoken library, and exact round trips."""

import hashlib
import random

import pytest
import tiktoken

from pixelweir.llm import bpe


@pytest.fixture(scope="module", params=["byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken"])
def vocabulary(request):
    import public_tokenizers as P

    path = P.path(request.param)
    ranks = bpe.load_ranks(path)
    return path, ranks, tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rnd = random.Random(4)
    odd = ["", "a", " ", "   x", "<|endoftext|>", "aaaa" * 400, "ab" * 500, "日本語テキスト", "😀😀 né", "it's we'll\r\n\t x", "\x00\x01", "ñ" * 999]
    some = ["".join(rnd.choice("abcde fghiéñ\n .,'0123中😀") for _ in range(rnd.randint(1, 300))) for _ in range(200)]
    return odd + some


def test_equals_tiktoken(vocabulary):
    path, ranks, enc = vocabulary
    import public_tokenizers as P

    own = bpe.Encoder(ranks, P.PATTERN)
    for (ids, plain), text in zip(own.encode(texts()), texts(), strict=True):
        assert ids == ",".join(map(str, enc.encode_ordinary(text)))
        assert plain == text.encode()


def test_lower_rank_after_a_merge_goes_first():
    ranks = {bytes([i]): i for i in range(256)} | {b"bc": 300, b"abc": 290, b"ab": 310, b"bcbc": 295}
    enc = tiktoken.Encoding("own", pat_str=r"\w+", mergeable_ranks=ranks, special_tokens={})
    words = ["bcbcabc", "abcbc", "babcbcbc", "ab", "cabcab"]
    assert bpe.MergeReplay(ranks).encode([w.encode() for w in words]) == [enc.encode_ordinary(w) for w in words]


def test_table(spark, vocabulary):
    path, _, enc = vocabulary
    rows = [(i, t, "y") for i, t in enumerate([None, *texts(), "twice", "twice"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = {r.doc_id: r for r in bpe.encode_decode(docs, path, memory=50).collect()}
    for i, t, _ in rows:
        ids = enc.encode_ordinary(t or "")
        assert list(got[i].ids) == ids and got[i].n_tokens == len(ids)
        assert got[i].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert bytes(got[i].decoded) == (t or "").encode() and got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_decode(docs.filter("false"), path).count() == 0
