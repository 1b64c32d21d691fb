"""Spans against plain regular expressions, and the weak-supervision model on known truth."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from pixelweir.llm import pii as P

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(map(int, reversed(d)))) % 10 == 0


def ok(kind, s):
    d = re.sub("[^0-9]", "", s)
    return {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in s.split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]


def plain(text):
    spans = [(m.start(), k, m.end()) for k, kind in enumerate(P.KINDS) for m in re.finditer(PLAIN[kind], text or "") if ok(kind, m.group())]
    return sorted(spans)


def texts():
    rnd = random.Random(8)
    odd = [
        None, "", "a@b.c_d@e.f", "é😀a@b.co, +1 (407) 555-7710.", "1.2.3.4.5.6.7.8", "1.2.3", "256.1.1.1 0255.1.1.1 00000.0.0.0", "4111 1111 1111 1111", "4111-1111-1111-1111 9",
        "9" * 5000, "1 " * 9000, "a" * 20000 + "@", "+1" * 400, "+12345 (((", "x@y x@y.z..q", "a@b.c@d.e", "1.1.1.1" * 40, "99999999999999999999999.1.1.1", "٣.1.1.1", "u@v.w " * 700,
    ]
    alphabet = "aB9012345.@+-() _%é😀"
    return odd + ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 200))) for _ in range(300)] + ["".join(rnd.choice("0123 -.+") for _ in range(60)) for _ in range(200)]


def test_base_spans_equal_plain_regex(spark):
    rows = [(i, t, "n") for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, base string")
    got = {r.doc_id: [(x.b, x.k, x.e) for x in r.base_spans] for r in P.find(docs, P.NOTHING).collect()}
    for i, t, _ in rows:
        assert got[i] == plain(t), t


def test_em_finds_the_reliable_labelers():
    rnd = random.Random(9)
    right = [0.95, 0.7, 0.9, 0.8, 0.6]
    counted, truth = {}, {}
    for _ in range(6000):
        y = rnd.random() < 0.3
        votes = tuple(-1 if rnd.random() < 0.2 else int(y if rnd.random() < a else not y) for a in right)
        counted[votes] = counted.get(votes, 0) + 1
        truth.setdefault(votes, []).append(y)
    share, table, chance = P.reliabilities(counted)
    assert abs(share - 0.3) < 0.05
    skill = [t[1][2] / (t[1][2] + t[1][1]) for t in table]
    assert skill[0] > skill[3] > skill[4] and abs(skill[0] - 0.95) < 0.05
    best = sum(max(sum(v), len(v) - sum(v)) for v in truth.values())
    got = sum(sum(y == (chance[p] > 0.5) for y in v) for p, v in truth.items())
    assert got >= 0.97 * best


def test_secrets_are_found_and_words_are_not(spark):
    rnd = random.Random(10)
    rows, want = [], {}
    for i in range(200):
        word = "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(16, 24)))
        key = "".join(rnd.choice("0123456789abcdef") for _ in range(40))
        text = f"é {word} and 2024-01-01/2024-02-02 then {'token = ' if i % 4 else ''}\"{key}\" end" if i % 2 else f"plain {word} text"
        rows.append((i, text))
        want[i] = [text.index(key)] if i % 2 else []
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = P.fit(docs)
    got = {r.doc_id: [x.b for x in r.spans if x.k == 4] for r in P.find(docs, model).collect()}
    assert got == want
    assert P.fit(docs.filter("false")) == P.NOTHING
    assert P.find(docs.filter("false"), model).count() == 0


def test_digest(spark):
    docs = spark.createDataFrame([(1, "a@b.co 1.2.3.4 +1 (407) 555-7710 4929348385146306 4111111111111111")], "doc_id long, text string")
    want = ",".join(f"{P.KINDS[k]}:{b}:{e}" for b, k, e in plain(docs.first().text))
    got = P.find(docs, P.NOTHING).select(F.sha2(P.listed(F.col("base_spans")), 256).alias("h"), P.listed(F.col("spans")).alias("s")).first()
    assert got.s == want and got.h == hashlib.sha256(want.encode()).hexdigest()
