"""Near-dedup by word sequences against all pairs of sets, and what the pipeline leaves."""

import random

import corpus_pipeline as C
from pixelweir.llm import word_sets as W
from pixelweir.llm.simhash import words_of


def shingles(text):
    w = words_of(text)
    return {tuple(w)} if 0 < len(w) < 5 else {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    """The doc_ids kept: the smallest of each component, and all without a word."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                up[max(root(i), root(j))] = min(root(i), root(j))
    first = {}
    for i, (d, _) in enumerate(rows):
        first.setdefault(root(i), []).append(d)
    last = lambda d: (d is None, d or 0)
    return sorted((min(ds, key=last) for ds in first.values()), key=last)


def corpus(seed=3):
    rnd = random.Random(seed)
    words = ["".join(rnd.choice("abcdefgéñ") for _ in range(rnd.randint(2, 8))) for _ in range(900)]
    common = [rnd.choice(words) for _ in range(60)]
    texts = [None, "", "  ", "one two", "One  TWO\n", "one two three four five", "one two three four six"]
    for k in range(40):
        own = [rnd.choice(words) for _ in range(rnd.randint(20, 160))] + (common if k % 2 else [])
        texts.append(" ".join(own))
        for _ in range(rnd.randint(0, 7)):  # a chain of edits, of one word and of more
            own = list(own)
            for _ in range(rnd.randint(1, 5)):
                own[rnd.randrange(len(own))] = rnd.choice(words)
            texts.append(rnd.choice([" ", "\t", "\n"]).join(own))
    rnd.shuffle(texts)
    return list(enumerate(texts))


def test_equals_all_pairs(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows)
    assert 40 < len(want) < len(rows) - 20
    assert sorted(r.doc_id for r in W.keep_one(docs).collect()) == want
    frequent, W.FREQUENT = W.FREQUENT, 10**9  # another order of shingles, the same result
    try:
        assert sorted(r.doc_id for r in W.keep_one(docs).collect()) == want
    finally:
        W.FREQUENT = frequent


def test_edges(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "A B c d e f"), (3, ""), (3, ""), (None, None)]
    got = W.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted([(1, "a b c d e f"), (3, ""), (3, ""), (None, None)], key=str)
    assert W.keep_one(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pipeline_merges_one_word_edits(spark):
    rnd = random.Random(5)
    rows = []
    for k in range(12):
        own = ["".join(rnd.choice("abcdefg") for _ in range(6)) for _ in range(100)]
        other = list(own)
        other[50] = "changed"
        rows += [(2 * k, " ".join(own)), (2 * k + 1, " ".join(other))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for name, stage in C.STAGES:
        if name == "near_dedup":
            docs = stage(spark, docs, "")
    assert sorted(r.doc_id for r in docs.collect()) == list(range(0, 24, 2))
