"""Long lines that stand in two documents stay in the first; templates keep their floor."""

import random

from pixelweir.llm import line_templates as L


def test_long_line_of_two_documents_stays_once(spark):
    rnd = random.Random(2)
    line = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    long, dated, short = line(60), line(59) + " 2024", line(20)
    texts = [f"{line(6)}\n{long}\n{short}", f"{long}\n{line(7)}", f"{short}\n{dated}", f"{line(8)}\n{dated}\n{long}", dated.replace("2024", "2025"), None, f"  {long.replace(' ', '  ')}"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(0, texts[0])], "doc_id long, text string")
    for keep_first in (False, True):
        rows = L.drop_templates(docs, keep_first=keep_first).collect()
        got = {r.doc_id: r.text for r in rows}
        assert len(rows) == 8 and [r.text for r in rows if r.doc_id == 0] == [texts[0]] * 2
        assert got[1] == texts[1].split("\n")[1] and got[2] == texts[2] and got[3] == texts[3].split("\n")[0]
        assert got[4] == texts[4] and got[5] is None and got[6] == ""
