"""Quality statistics against plain Python, and the learner on held-out rows."""

import random
import re
from collections import Counter

from pixelweir.llm import quality as Q


def plain(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(8)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered), len(words) < 20 or 100 * len(covered) > 30 * len(words))


def texts():
    rnd = random.Random(6)
    odd = [None, "", " \t\n", "one", "a\n\na\n b\n b\n", "x " * 50, "é😀 # <b> | $", "a\x0bb\x0cc\rd e f", " ".join(map(str, range(19))), " ".join(map(str, range(20)))]
    for _ in range(40):
        part = " ".join(rnd.choice("abcdé#") + str(rnd.randint(0, 9)) for _ in range(rnd.randint(1, 40)))
        odd.append("\n".join([part, "tail", *[part] * rnd.randint(0, 2), " ".join(str(rnd.random()) for _ in range(rnd.randint(1, 60)))]))
    return odd


def test_statistics_equal_brute_force(spark):
    rows = [(i, t, 0) for i, t in enumerate(texts())]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int")
    got = {r.doc_id: tuple(r)[1:7] for r in Q.judge(docs, Q.DecisionList()).collect()}
    assert [got[i] for i, *_ in rows] == [plain(t) for _, t, _ in rows]


def labelled(n, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        row = {f: rnd.random() for f in Q.FEATURES} | {"order": rnd.random()}
        row["bad"] = row["symbol_ratio"] > 0.8 or (row["upper_ratio"] > 0.6 and row["mark_ratio"] <= 0.3)
        rows.append(row)
    return rows


def test_learned_list_holds_on_unseen_rows():
    rules = Q.learn(labelled(1500, 1))
    unseen = labelled(1500, 2)
    right = sum(rules.rejects(r) == r["bad"] for r in unseen)
    assert rules.rules and right >= 0.95 * len(unseen)
    good = [r for r in unseen if not r["bad"]]
    assert sum(map(rules.rejects, good)) <= 0.02 * len(good)


def test_expression_equals_the_list(spark):
    from pyspark.sql import functions as F

    rules = Q.DecisionList([Q.Rule([("symbol_ratio", ">", 0.05), ("word_length", "<=", 3.5)]), Q.Rule([("distinct_ratio", "<=", 0.2)])])
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts())], "doc_id long, text string")
    q = F.col("q")
    for r in docs.select(Q.statistics(F.col("text")).alias("q")).select(rules.expression(q).alias("no"), *[Q.ratio(q, f).alias(f) for f in Q.FEATURES]).collect():
        assert r.no == rules.rejects(r.asDict())
    kept = {r.doc_id for r in Q.judge(docs, rules).filter("kept").collect()}
    assert {r.doc_id for r in Q.keep(docs, rules).collect()} == kept


def test_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rules = Q.fit(docs, labels)
    found = Q.judge(docs, rules).join(labels, "doc_id").filter("not base_failed").collect()
    good = [r for r in found if r.quality == 1]
    assert sum(not r.kept for r in good) <= 0.02 * len(good)
    assert not Q.fit(docs, labels.filter("false")).rules
    assert Q.judge(docs.filter("false"), rules).count() == 0
