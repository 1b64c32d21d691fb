"""Counts after edits against encoding the whole edited text with the tiktoken library."""

import random

import pytest
import tiktoken

from pixelweir.llm import bpe
from pixelweir.llm import edit_counts as E


@pytest.fixture(scope="module")
def enc():
    import public_tokenizers as P

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.default_vocabulary()[0]), special_tokens={})


def text(rnd, n):
    return "".join(rnd.choice("abcde fgé\n  .,'sdt0123中😀") for _ in range(n))


def test_tree_equals_whole_recount(enc):
    path, pattern = bpe.default_vocabulary()
    counter = E.Counter(bpe.Encoder(bpe.load_ranks(path), pattern))
    rnd = random.Random(11)
    for n in (0, 1, 5, 80, 700, 6000):
        now = text(rnd, n)
        words = counter.split(now)
        tree = E.Tree(words, counter.counts(words), counter.split, counter.counts)
        for _ in range(60):
            b = rnd.randint(-2, len(now) + 3)
            e = b + rnd.choice([-1, 0, 0, 1, 3, 30, 400])
            new = rnd.choice(["", " ", "   ", "'s", "s", "\n\n", text(rnd, rnd.randint(0, 40)), text(rnd, 900) if rnd.random() < 0.1 else "x"])
            lo = min(max(0, b), len(now))
            now = now[:lo] + new + now[min(max(lo, e), len(now)) :]
            tree.edit(b, e, new)
            assert tree.text() == now and tree.n_chars == len(now)
            assert [w for x in tree.words for w in x] == counter.split(now)
        assert tree.n_tokens == len(enc.encode_ordinary(now))


def test_only_the_surroundings_are_encoded():
    path, pattern = bpe.default_vocabulary()
    counter = E.Counter(bpe.Encoder(bpe.load_ranks(path), pattern))
    words = counter.split("some words go on and on " * 5000)
    tree = E.Tree(words, counter.counts(words), counter.split, counter.counts)
    tree.edit(60000, 60010, "another thing")
    assert tree.recounted < 20


def test_tables(spark, enc):
    rnd = random.Random(12)
    rows = [(1, None), (2, ""), (3, text(rnd, 300)), (3, text(rnd, 200)), (None, "abc def"), (4, text(rnd, 5000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    edits = spark.createDataFrame([(3, 2, 5, 9, "zz"), (3, 1, 0, 2, None), (4, 1, 4000, 9000, "end"), (9, 1, 0, 0, "x"), (2, 1, 0, 0, "hello you"), (None, 1, 0, 0, "x"), (4, 2, None, 1, "q")], "doc_id long, seq int, b long, e long, s string")

    def want(d, t):
        t = t or ""
        after = {3: t[2:][:5] + "zz" + t[2:][9:], 4: t[:4000] + "end", 2: "hello you"}.get(d, t)
        return (d, len(enc.encode_ordinary(t)), len(enc.encode_ordinary(after)), len(after))

    got = sorted((tuple(r)[:4] for r in E.recount(docs, edits).collect()), key=str)
    assert got == sorted((want(d, t) for d, t in rows), key=str)
    assert E.recount(docs.filter("false"), edits).count() == 0
