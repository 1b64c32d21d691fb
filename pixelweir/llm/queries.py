"""The registered queries of the training-data operators and, where SQL can say the same, their DuckDB text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pixelweir.llm import bpe, decontaminate, edit_counts, html_text, licences, line_templates, pii, quality, simhash, suffix_dedup

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": suffix_dedup.op1_suffix_dedup,
    "op2_licences": licences.op2_licences,
    "op3_html_text": html_text.op3_html_text,
    "op4_pii": pii.op4_pii,
    "op5_quality": quality.op5_quality,
    "op6_simhash": simhash.op6_simhash,
    "op7_bpe": bpe.op7_bpe,
    "op8_decontaminate": decontaminate.op8_decontaminate,
    "op9_line_templates": line_templates.op9_line_templates,
    "op10_edit_counts": edit_counts.op10_edit_counts,
}

#: Windows of 200 bytes over the texts' hexadecimal digits, grouped; and the template tree on tokens as strings.
ORACLES: dict[str, str] = {
    "op1_suffix_dedup": """WITH d AS (SELECT row_number() OVER () AS id, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
h AS (SELECT id, c, substring(x, 2 * c + 1, 1422) AS y FROM (SELECT id, x, unnest(range(0, length(x) // 2 - 199, 512)) AS c FROM d WHERE length(x) >= 400)),
w AS (SELECT id, c + j AS i, md5(substring(y, 2 * j + 1, 400)) AS k FROM (SELECT id, c, y, unnest(range(0, least(512, length(y) // 2 - 199))) AS j FROM h)),
r AS (SELECT id, i FROM w SEMI JOIN (SELECT k FROM w GROUP BY k HAVING count(*) > 1) USING (k)),
f AS (SELECT id, i, CASE WHEN i - lag(i) OVER (PARTITION BY id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS f FROM r),
g AS (SELECT id, i, sum(f) OVER (PARTITION BY id ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM f),
s AS (SELECT id, min(i) AS a, max(i) + 200 AS b FROM g GROUP BY id, g),
p AS (SELECT id, a, b, coalesce(lag(b) OVER (PARTITION BY id ORDER BY a), 0) AS e FROM s),
c AS (SELECT id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substring(x, 2 * e + 1, 2 * (a - e)), '' ORDER BY a) AS head, max(b) AS e FROM p JOIN d USING (id) GROUP BY id)
SELECT doc_id, length(x) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head || substring(x, 2 * e + 1), x))) AS kept_sha256 FROM d LEFT JOIN c USING (id)""",
    "op9_line_templates": """WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS k FROM d),
t AS (SELECT *, list_filter(regexp_split_to_array(line, '[ \\t\\n\\r\\x0b\\x0c]+'), lambda x: x <> '') AS own FROM l),
v AS (SELECT doc_id, k, line, own, len(own) AS size, list_transform(own, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN '' ELSE x END) AS tokens FROM t WHERE len(own) > 0),
f AS (SELECT *, md5(size || chr(10) || array_to_string(tokens[1:2], chr(10))) AS leaf FROM v),
o AS (SELECT f.* FROM f SEMI JOIN (SELECT leaf FROM f GROUP BY leaf HAVING count(DISTINCT doc_id) >= 10) USING (leaf)),
u AS (SELECT doc_id, k, leaf, size, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM o),
c AS (SELECT leaf, place, token FROM u WHERE token <> '' GROUP BY ALL HAVING count(*) >= 10),
m AS (SELECT doc_id, k, u.leaf, string_agg(u.place || ':' || u.token, chr(10) ORDER BY u.place) AS template FROM u JOIN c USING (leaf, place, token) GROUP BY doc_id, k, u.leaf, size HAVING count(*) >= 0.6 * size),
y AS (SELECT doc_id, k FROM m SEMI JOIN (SELECT leaf, template FROM m GROUP BY ALL HAVING count(DISTINCT doc_id) >= 10) USING (leaf, template)),
e AS (SELECT doc_id, k, array_to_string(own, chr(10)) AS line FROM v WHERE size >= 50),
z AS (SELECT e.doc_id, e.k FROM e JOIN (SELECT line, min(doc_id) AS first FROM e GROUP BY line) q ON q.line = e.line WHERE e.doc_id <> q.first),
x AS (SELECT doc_id, k FROM y UNION SELECT doc_id, k FROM z),
g AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY k) AS kept, count(*) AS n FROM l ANTI JOIN x USING (doc_id, k) GROUP BY doc_id)
SELECT doc_id, len(string_split(text, chr(10))) AS n_lines, len(string_split(text, chr(10))) - coalesce(n, 0) AS n_dropped, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN g USING (doc_id)""",
}
