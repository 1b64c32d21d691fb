"""Extra columns whose names the operators use themselves, and empty tables, change nothing."""

import pytest

from pixelweir.llm import decontaminate, line_templates, simhash, word_sets

LINE = "All rights of this page are reserved by its owner"
EXTRA = ("_d", "_H", "_lines", "_row", "s", "k", "key", "line", "leaf", "fp", "a.b", "n")
WAYS = {
    "line_templates": line_templates.drop_templates,
    "simhash": simhash.keep_one,
    "word_sets": word_sets.keep_one,
    "clean": lambda docs: decontaminate.clean(docs, docs.sparkSession.createDataFrame([(1, "the seventh item is a question with an answer of its own")], "item_id long, text string")),
}


@pytest.mark.parametrize("way", sorted(WAYS))
def test_clashing_columns_stay(spark, way):
    texts = [f"own words of the text number w{i} {'abcdefghij'[i % 10] * 5} and so on\n{LINE}" for i in range(14)]
    texts += [texts[3], texts[3] + " ", "the seventh item is a question with an answer of its own", None, "", "x" * 300_000, "y " * 100_000]
    rows = [(i, t, *[f"{c}{i}" for c in EXTRA]) for i, t in enumerate(texts)]
    plain = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in EXTRA))
    got = WAYS[way](docs)
    assert got.columns == docs.columns
    found = got.collect()
    assert sorted((r.doc_id, r.text) for r in WAYS[way](plain).collect() if r.text is not None) == sorted((r.doc_id, r.text) for r in found if r.text is not None)
    assert all(r[2:] == tuple(f"{c}{r.doc_id}" for c in EXTRA) for r in found)
    assert 10 < len(found) <= len(rows) and (way == "line_templates" or len(found) < len(rows))
    assert WAYS[way](docs.filter("false")).count() == 0


def test_a_taken_name_for_the_numbers_is_refused(spark):
    docs = spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, gone int")
    with pytest.raises(ValueError, match="GONE"):
        line_templates.drop_templates(docs, dropped="GONE")
