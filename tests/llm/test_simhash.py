"""Golay fuzzy hashing against comparing all pairs."""

import random

import numpy as np
import xxhash

from pixelweir.llm import simhash as S


def test_golay_decodes_three_errors():
    words = np.arange(4096, dtype=np.int64) << 11
    rest, _ = S._syndromes()
    code = np.array([w ^ int(np.bitwise_xor.reduce([rest[i] for i in range(23) if w >> i & 1] or [0])) for w in words.tolist()])
    assert min(int(c).bit_count() for c in code[1:]) == 7
    rnd = random.Random(1)
    for c in rnd.sample(code.tolist(), 200):
        flips = sum(1 << i for i in rnd.sample(range(23), 3))
        assert S.decode(np.array([c ^ flips]))[0] == c >> 11


def test_pairs_within_three_bits_share_a_key():
    rnd = random.Random(2)
    for _ in range(300):
        a = rnd.getrandbits(64)
        b = a ^ sum(1 << i for i in rnd.sample(range(64), rnd.randint(0, 3)))
        key, _, role = S.keys_of(np.array([a, b], np.uint64))
        ka, _, ra = S.keys_of(np.array([a], np.uint64))
        kb, _, rb = S.keys_of(np.array([b], np.uint64))
        assert set(ka[ra]) & set(kb[~rb])
        assert set(kb[rb]) & set(ka[~ra])
        assert len(ka[ra]) == 3


def plain_fingerprint(text):
    words = [w for w in "".join(c.lower() if c.isascii() else c for c in text or "").translate(dict.fromkeys(range(9, 14), " ")).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << i for i in range(64) if 2 * sum(h >> i & 1 for h in hashes) > len(hashes))


def brute(rows):
    prints = [plain_fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                up[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[root(i)] = min(low.get(root(i), d), d)
    return sorted(((d, prints[i], low.get(root(i))) for i, (d, _) in enumerate(rows)), key=str)


def test_components_equal_brute_force(spark, monkeypatch):
    rnd = random.Random(3)
    base = [" ".join(rnd.choice(["alpha", "Beta", "gamma", "x", "ño", "zeta9"]) + str(rnd.randint(0, 99)) for _ in range(90)) for _ in range(12)]
    rows = [(1, None), (2, ""), (3, "one"), (4, "ONE"), (5, "one two"), (None, "one two"), (6, " \t\n")]
    for i in range(160):
        words = rnd.choice(base).split()
        for _ in range(rnd.randint(0, 4)):
            words[rnd.randrange(len(words))] = str(rnd.random())
        rows.append((10 + i, " ".join(words)))
    rows += [rows[20], rows[21]]
    docs = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, fp int")
    want = brute(rows)
    for block in (2048, 3):
        monkeypatch.setattr(S, "BLOCK", block)
        got = S.near_duplicates(docs).collect()
        assert sorted(((r.doc_id, r.fp % 2**64, r.component_id) for r in got), key=str) == want
    assert S.near_duplicates(docs.filter("false")).count() == 0


def test_long_chain_of_links(spark):
    prints = [0]
    for i in range(40):
        prints.append(prints[-1] ^ (0b111 << (i % 20) * 3))
    df = spark.createDataFrame([(int(np.uint64(p).view(np.int64)),) for p in set(prints)], "fp long")
    nodes = S.components(S.links(df)).collect()
    assert len({r.label for r in nodes}) == 1 and len(nodes) == len(set(prints))


def test_one_task_and_rounds_give_the_same_components(spark, monkeypatch):
    rnd = random.Random(5)
    edges = [(rnd.randint(-300, 300) << 40, rnd.randint(-300, 300) << 40) for _ in range(250)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    one = sorted(tuple(r) for r in S.components(df).collect())
    monkeypatch.setattr(S, "SETTLED", 10)
    assert one == sorted(tuple(r) for r in S.components(df).collect()) and 1 < len({label for _, label in one}) < len(one)
    monkeypatch.undo()
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("few links", "")
    S.components(df).collect()
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs.getJobIdsForGroup("few links")) <= 8
    assert S.components(df.filter("false")).count() == 0
