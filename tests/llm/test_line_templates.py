"""The template tree against a plain version on whole texts."""

import random
import re
from collections import Counter, defaultdict

from pixelweir.llm import line_templates as L


def plain(texts, depth, min_docs, least, keep_first=False):
    """The kept texts: the same definition with dictionaries. Texts differ, so that a row is a document."""
    lines = []
    for d, text in enumerate(texts):
        for k, line in enumerate((text or "").split("\n")):
            tokens = [None if re.search(r"[0-9]", t) else t for t in re.split(r"[\x00 \t\n\r\x0b\x0c]+", line) if t]
            if tokens:
                lines.append((d, k, (len(tokens), *tokens[:depth]), tuple(tokens)))
    leaf_docs = defaultdict(set)
    for d, _, leaf, _ in lines:
        leaf_docs[leaf].add(d)
    lines = [x for x in lines if len(leaf_docs[x[2]]) >= min_docs]
    count = Counter((leaf, i, t) for _, _, leaf, tokens in lines for i, t in enumerate(tokens) if t is not None)
    templates = defaultdict(list)
    for d, k, leaf, tokens in lines:
        t = tuple(x if x is not None and count[leaf, i, x] >= min_docs else None for i, x in enumerate(tokens))
        if sum(x is not None for x in t) >= least * len(t):
            templates[t].append((d, k))
    gone = set()
    for places in templates.values():
        if len({d for d, _ in places}) >= min_docs:
            gone |= set(places)
    return [t if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (d, k) not in gone) for d, t in enumerate(texts)]


def corpus(seed=1, n=160):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 5)))
    texts = [None, "", "\n\n", " \t"]
    for d in range(n):
        lines = [" ".join(word() for _ in range(rnd.randint(1, 9))) + f" u{word()}{word()}" for _ in range(rnd.randint(1, 6))]
        if d % 2:
            lines.insert(rnd.randint(0, len(lines)), f"Posted by {word()}{word()} on 2024-{d:02d} in the news")
        if d % 3 == 0:
            lines.append("All rights reserved.")
        if d % 3 == 1:
            lines += ["Read more about  this\tstory", "", f"{d} {d + 1} {d + 2}"]
        if d % 40 == 0:
            lines.append("A rare line that stays")
        texts.append("\n".join(lines))
    return texts


def test_equals_plain_version(spark):
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "q") for i, t in enumerate(texts)], "doc_id long, text string, line string")
    for depth, min_docs, least in ((2, 10, 0.6), (1, 5, 0.5), (3, 3, 1.0)):
        got = {r.doc_id: r.text for r in L.drop_templates(docs, depth, min_docs, least).collect()}
        assert [got[i] for i in range(len(texts))] == plain(texts, depth, min_docs, least)
    want = plain(texts, 2, 10, 0.6)
    assert any("Posted" in t for t in texts if t) and not any("Posted" in t or "rights" in t for t in want if t)
    assert sum("rare" in t for t in want if t) == 4


def test_keep_first_and_edges(spark):
    texts = corpus(3)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.text for r in L.drop_templates(docs, keep_first=True).orderBy("doc_id").collect()]
    assert sum("rights" in t for t in got if t) == 1
    twice = docs.union(docs.filter("doc_id = 9")).union(spark.createDataFrame([(None, "x")], "doc_id long, text string"))
    assert L.drop_templates(twice).count() == len(texts) + 2
    assert L.drop_templates(docs.filter("false")).count() == 0
