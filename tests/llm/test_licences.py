"""Licence passages against Dice over all windows."""

import random
import re
import time
from collections import Counter

from pixelweir.llm import licences as L


def grams(text):
    words = re.findall(r"[a-z0-9]+", text.lower())
    return list(zip(words, words[1:], strict=False))


def test_every_notice_is_found_as_itself(spark):
    rnd = random.Random(1)
    rows = []
    for i, (name, text) in enumerate(L.templates()):
        before = " ".join(rnd.choice(["the", "of", "under", "software", "a"]) for _ in range(rnd.randint(0, 20)))
        rows.append((i, f"é {before}. {text.upper()}.\nnext é", name))
    docs = spark.createDataFrame(rows, "doc_id long, text string, licence string")
    got = {}
    for r in L.scan(docs).collect():
        got.setdefault(r.doc_id, []).append((r.licence, r.score))
    for i, _, name in rows:
        assert (name, 1.0) in got[i], (i, name, got.get(i))


def passages(index, text):
    """All passages of a text, before overlaps are resolved."""
    out = []
    inner = index._passages
    index._passages = lambda *a: out.extend(x for xs in inner(*a).values() for x in xs) or {}
    try:
        assert list(index.scan([text.encode()])) == []
    finally:
        del index._passages
    return out


def test_edited_texts_keep_their_licence():
    index, rnd = L._index(0.8), random.Random(6)
    texts = [(k, t) for k, t in L.TEXTS if len(t.split()) >= 60]
    right = total = 0
    for name, text in texts:
        for _ in range(5):
            words = ["Copyright", "2020", "Someone", *text.split(), "import", "os"]
            for p in rnd.sample(range(3, len(words) - 2), len(words) // 10):
                words[p] = rnd.choice(["thing", "changed", "other"])
            got = [n for _, n, *_ in index.scan([" ".join(words).encode()])]
            total += 1
            right += name in got
    # one changed word changes two bigrams, so that a tenth of the words leaves a score of about 0.8, on the threshold: 73 of 80
    assert right >= 0.9 * total, (right, total)
    for name, text in texts:
        words = text.split()
        for p in rnd.sample(range(len(words)), len(words) // 25):
            words[p] = "changed"
        assert name in [n for _, n, *_ in index.scan([" ".join(words).encode()])], name


def test_many_notices_take_linear_time():
    index = L._index(0.8)
    start = time.time()
    found = list(index.scan([b"Released under the MIT License. Some words stand between. " * 20_000]))
    assert len(found) == 20_000 and {n for _, n, *_ in found} == {"MIT"}
    assert time.time() - start < 60


def test_best_window_equals_brute_force():
    index = L._index(0.8)
    rnd = random.Random(2)
    i = index.names.index("ISC") if "ISC" in index.names else 0
    texts = L.templates()
    for _ in range(30):
        name, text = rnd.choice(texts)
        words = text.split()
        for _ in range(len(words) // 12):
            words[rnd.randrange(len(words))] = "changed"
        text = "lead words here " + " ".join(words) + " tail words"
        all_ = grams(text)
        best = 0.0
        for _, t in texts:
            bag = grams(t)
            low, high = len(bag) * 0.8 / 1.2, len(bag) * 1.2 / 0.8
            for a in range(len(all_)):
                for b in range(a + 1, len(all_) + 1):
                    if low <= b - a <= high:
                        common = sum((Counter(all_[a:b]) & Counter(bag)).values())
                        best = max(best, 2 * common / (len(bag) + b - a))
        found = [s for s, *_ in passages(index, text)]
        assert (max(found, default=0.0) if best >= 0.8 else 0.0) == (best if best >= 0.8 else 0.0), (name, i)


def test_edges_and_spans(spark):
    note = "Released under the MIT License"
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "mit"), (4, f"ñ {note}. {note}"), (None, note), (4, "the software of the license " * 400)], "doc_id long, text string")
    rows = L.scan(docs).collect()
    assert sorted((r.doc_id, r.licence) for r in rows if r.doc_id) == [(4, "MIT"), (4, "MIT")]
    assert sum(r.doc_id is None for r in rows) == 1
    spans = sorted((r.b, r.e) for r in rows if r.doc_id == 4)
    raw = f"ñ {note}. {note}".encode()
    assert [raw[b:e].decode() for b, e in spans] == [note, note]
    assert L.scan(docs.filter("false")).count() == 0
