"""Planted copies of items, whole and edited, against clean texts and a plain alignment."""

import random

import numpy as np

from pixelweir.llm import decontaminate as D


def plain_score(a, b):
    rows = [[0.0] * (len(b) + 1) for _ in range(len(a) + 1)]
    best = 0.0
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            rows[i][j] = max(0, rows[i - 1][j - 1] + (1 if x == y else -D.CHANGE), rows[i - 1][j] - D.GAP, rows[i][j - 1] - D.GAP)
            best = max(best, rows[i][j])
    return best


def test_alignment_equals_plain_dynamic_programming():
    rnd = random.Random(1)
    items = [[rnd.randint(1, 6) for _ in range(rnd.randint(1, 12))] for _ in range(60)]
    passages = [[rnd.randint(1, 6) for _ in range(rnd.randint(1, 25))] for _ in range(60)]
    score, _ = D.align([np.array(x, np.uint64) for x in items], [np.array(x, np.uint64) for x in passages])
    assert np.allclose(score, [plain_score(a, b) for a, b in zip(items, passages, strict=True)])


def make(seed=2, n=300):
    rnd = random.Random(seed)
    common = ["the", "of", "and", "a", "in"]
    word = lambda: rnd.choice(common) if rnd.random() < 0.4 else "".join(rnd.choice("abcdeñü") for _ in range(rnd.randint(3, 8)))
    items = [(i, " ".join(word() for _ in range(rnd.randint(12, 40)))) for i in range(12)]
    rows, want = [(0, None), (1, "")], set()
    for d in range(2, n):
        text = [word() for _ in range(rnd.randint(5, 120))]
        if d % 3 == 0:
            i = 0 if d % 2 else rnd.randrange(12)  # item 0 is copied by a sixth of all documents
            copy = items[i][1].split()
            for _ in range(len(copy) // 8 if d % 4 else 0):
                copy[rnd.randrange(len(copy))] = word()
            if d % 5 == 0:
                copy.insert(len(copy) // 2, word())
            text[3:3] = [w.upper() + rnd.choice(["", ",", "."]) for w in copy]
            want.add((d, i))
        rows.append((d, " ".join(text)))
    return rows, items, want


def test_planted_copies_and_no_others(spark, monkeypatch):
    rows, items, want = make()
    docs = spark.createDataFrame([(d, t, 0.5) for d, t in rows], "doc_id long, text string, score double")
    bench = spark.createDataFrame([*items, (90, None), (91, "")], "item_id long, text string")
    for block in (16 << 20, 700):
        monkeypatch.setattr(D, "BLOCK", block)
        got = D.find(docs, bench).collect()
        assert {(r.doc_id, r.item_id) for r in got} == want and len(got) == len(want)
    kept = {r.doc_id for r in D.clean(docs, bench).collect()}
    assert kept == {d for d, _ in rows} - {d for d, _ in want}


def test_edge_cases(spark):
    docs = spark.createDataFrame([(1, "x alpha beta y"), (1, "x alpha beta y"), (None, "one two three four"), (2, "one two")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, "Alpha, beta"), (None, "one two three four")], "item_id int, text string")
    got = sorted(((r.doc_id, r.item_id, r.score) for r in D.find(docs, bench).collect()), key=str)
    assert got == [(1, 7, 1.0), (1, 7, 1.0), (None, None, 1.0)]
    assert D.find(docs, bench.filter("false")).count() == 0
    assert D.find(docs.filter("false"), bench).count() == 0
