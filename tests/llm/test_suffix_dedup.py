"""Substring dedup against a brute-force count of all strings."""

import hashlib
import random
from collections import Counter

import pytest

from pixelweir.llm.suffix_dedup import remove_duplicates


def brute(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raws for i in range(len(r) - length + 1))
    rows = []
    for r in raws:
        gone = [False] * len(r)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        kept = bytes(b for b, g in zip(r, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        rows.append((len(r), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return rows


def corpus(seed):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeéñ") for _ in range(rnd.randint(1, 7)))
    passages = [" ".join(word() for _ in range(60)) for _ in range(6)]
    texts = [None, "", "short", "a" * 700, "ab" * 400, "a" * 150, "x" * 199, "y" * 200, "y" * 200]
    for _ in range(60):
        parts = [" ".join(word() for _ in range(rnd.randint(1, 60)))]
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            k = rnd.randint(0, 120)
            parts += [p[k : k + rnd.randint(100, 400)], " ".join(word() for _ in range(rnd.randint(0, 30)))]
        texts.append(" ".join(parts))
    return texts + texts[20:24] + [texts[30] * 2]


@pytest.mark.parametrize(("seed", "hot", "length", "grams"), [(1, 6000, 200, (64, 150, 200)), (2, 2, 200, (64, 150, 200)), (3, 6000, 64, (16, 64))])
def test_equals_brute_force(spark, seed, hot, length, grams):
    texts = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, spans string")
    got = {r.doc_id: tuple(r)[1:5] for r in remove_duplicates(docs, length, grams, hot).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts, length)


def test_repeated_rows_null_ids_and_empty_table(spark):
    t = "".join(random.Random(5).choice("abcdef ") for _ in range(500))
    docs = spark.createDataFrame([(7, t), (7, t), (None, "b" + t), (None, None)], "doc_id long, text string")
    got = sorted((r.n_bytes, r.n_removed) for r in remove_duplicates(docs).collect())
    assert got == [(0, 0), (500, 500), (500, 500), (501, 500)]
    assert remove_duplicates(docs.filter("false")).count() == 0
