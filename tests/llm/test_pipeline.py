"""The pipeline's stages against plain versions of them, each on its own input."""

import hashlib
import random
import sys
from pathlib import Path

import pytest
import tiktoken

sys.path[:0] = [str(Path(__file__).parent), str(Path(__file__).parents[2])]

import corpus_pipeline as C
import test_line_templates
import test_quality
import test_simhash
import test_word_sets
from pixelweir.llm import bpe, decontaminate, quality

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rnd = random.Random(21)
    word = lambda: "".join(rnd.choice("abcdefgéñ") for _ in range(rnd.randint(3, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rnd.randint(15, 30))) for i in range(5)]
    base = [[prose(rnd.randint(15, 30)) for _ in range(4)] for _ in range(40)]
    texts = []
    for d in range(260):
        lines = list(base[d % 40]) if d % 4 == 0 else [prose(rnd.randint(8, 30)) for _ in range(rnd.randint(1, 6))]
        if d % 8 == 0:
            lines[0] += " " + word()
        if d % 3 == 0:
            lines.append(f"Posted by {word()} on 2024-{d} in our daily news")
        if d % 11 == 0:
            lines.insert(0, items[d % 5][1])
        if d % 7 == 0:
            lines = ["### ".join(line.split()) + "###" for line in lines]
        texts.append("\n".join(lines))
    texts += [None, "", "too short", "again and again " * 30, texts[5], texts[5]]
    rows = [(d, t, "en", "s", len(t or "")) for d, t in enumerate(texts)] + [(5, texts[5], "en", "s", len(texts[5])), (None, texts[9] + " end", "en", "s", 1)]
    labels = [(d, int(d % 7 != 0), 0) for d in range(0, 250)]
    top = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{top}/benchmark.parquet")
    return top, items


def test_stages_equal_plain_versions(spark, tables):
    top, items = tables
    docs = spark.read.parquet(f"{top}/documents.parquet")
    names = [n for n, _ in C.STAGES]
    inputs, frames = {}, {}
    for name, stage in C.STAGES:
        inputs[name] = [tuple(r)[:2] for r in docs.collect()]
        docs = frames[name] = stage(spark, docs, top).localCheckpoint() if name == names[-1] else spark.createDataFrame(stage(spark, docs, top).collect(), COLUMNS)
        if name != names[-1]:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    out = {name: [tuple(r)[:2] for r in frames[name].collect()] for name in names[:-1]}
    key = lambda rows: sorted(rows, key=str)

    rules = quality.fit(spark.read.parquet(f"{top}/documents.parquet"), spark.read.parquet(f"{top}/labels.parquet"))
    want = []
    for d, t in inputs["quality_rules"]:
        stats = dict(zip(("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), test_quality.plain(t)[:5], strict=True))
        t_ = t or ""
        stats |= {"n_lines": sum(bool(x.split()) for x in t_.split("\n")), "n_distinct": len(set(t_.split())), "n_upper": sum("A" <= c <= "Z" for c in t_), "n_digits": sum("0" <= c <= "9" for c in t_), "n_marks": sum(c in ".,;:!?\"'()[]{}=@/\\+-_~^`" for c in t_)}
        if not test_quality.plain(t)[5] and not rules.rejects({f: stats[a] / max(1, stats[b]) for f, (a, b) in quality.FEATURES.items()}):
            want.append((d, t))
    assert rules.rules and key(out["quality_rules"]) == key(want)

    rows = sorted(inputs["line_dedup"], key=lambda r: (-1 if r[0] is None else r[0]))
    cut = test_line_templates.plain([t for _, t in rows], 2, 10, 0.6)
    got = {}
    for d, t in out["line_dedup"]:
        got.setdefault(d, set()).add(t)
    for (d, t), c in zip(rows, cut, strict=True):
        assert got.get(d, {""}) <= {c, t} or all(x in t for x in got[d])
    assert sum("Posted" in t for d, t in out["line_dedup"] if d is not None) == 1

    comps = test_simhash.brute(inputs["near_dedup"])
    first = {c for _, _, c in comps}
    one = {d: t for d, t in inputs["near_dedup"] if d in first}
    want = test_word_sets.brute(list(one.items()))
    assert len(out["near_dedup"]) == len(want) < len(one) < len(inputs["near_dedup"]) and {d for d, _ in out["near_dedup"]} == set(want)

    block = decontaminate.Items.of(items)
    held = {i for i, *_ in decontaminate._matches(block, [t.encode() for _, t in inputs["decontamination"]], decontaminate.LEAST)}
    assert held and key(out["decontamination"]) == key([r for i, r in enumerate(inputs["decontamination"]) if i not in held])
    for _, t in out["decontamination"]:
        assert not any(x in t for _, x in items)

    import public_tokenizers as P

    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.load_ranks(bpe.default_vocabulary()[0]), special_tokens={})
    texts = dict(inputs["tokens"])
    last = frames["tokens"].collect()
    assert len(last) == len(inputs["tokens"])
    for r in last:
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert list(r.ids) == ids and r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def test_run_chains_the_stages(spark, tables):
    top, _ = tables
    found = C.run(spark, top)
    assert 0 < found.count() < 268 and "ids_sha256" in found.columns


def test_near_dedup_reads_documents_once_for_each_fate(spark, tables):
    """Fingerprints' fates and those of word sets make one selection; nested ones were planned and run again in each scan."""
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    got = C.near_dedup(spark, docs, tables[0])
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") <= 2
    nested = C.word_sets.keep_one(C.simhash.keep_one(docs))
    key = lambda df: sorted((tuple(r) for r in df.collect()), key=str)
    assert key(got) == key(nested) and 0 < got.count() < docs.count()
