"""Extraction against pages built from known articles."""

import html
import random
import re
from pathlib import Path

import pytest

from pyspark.sql import functions as F

from pixelweir.llm import html_text as H

WORDS = "alpha beta gamma delta épsilon zeta eta theta iota kappa".split()


def prose(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def page(rnd, style):
    """(html, wanted text) in one of the hosts' layouts."""
    paragraphs = [prose(rnd, rnd.randint(8, 40)) + (" & <so> on" if rnd.random() < 0.3 else "") for _ in range(rnd.randint(1, 6))]
    esc = [p.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;") for p in paragraphs]
    head = f"<!DOCTYPE html><html><head><title>{paragraphs[0]}</title><style>p{{margin:0}}</style><script>var t='</p>';</script></head><body>"
    menu = "<nav><ul>" + "".join(f'<li><a href="/{w}">{w}</a></li>' for w in rnd.sample(WORDS, 4)) + "</ul></nav>"
    ad = f"<!-- ad --><div class='ad'>{prose(rnd, 7)}</div>"
    foot = f"<footer>&copy; {prose(rnd, 3)}</footer>"
    if style == 0:
        body = "<article><h1>" + esc[0] + "</h1><p><b>" + "<br><p>".join(esc[1:]) + "</article>"
        return head + menu + ad + body + foot, "\n".join(paragraphs)
    if style == 1:  # nothing says what it is: constant parts are the wrapper
        body = "<div class='x1'><p>Welcome to our pages</p></div><div class='x2'>" + "".join(f"<p>{p}</p>\n" for p in esc) + "</div><div class='x3'>Contact us at any time</div>"
        return head + body + "</body></html>", "\n".join(paragraphs)
    body = "<header><h1>Site name</h1></header><main>" + "".join(f"<p>{p}\n\t </p>" for p in esc) + f"<div class='comments'><p>{prose(rnd, 9)}</p></div><form><p>Your mail</p><input></form></main><aside><p>{prose(rnd, 5)}</p></aside><div id='cookie-notice'>We use cookies</div>"
    return head + body + foot + "</body>", "\n".join(paragraphs)


def test_known_articles(spark):
    rnd = random.Random(1)
    rows, want = [], {}
    for i in range(120):
        h, text = page(rnd, i % 3)
        rows.append((i, f"https://host{i % 3}.example.com/{i}", h, 5))
        want[i] = text
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars int")
    for most in (H.TEMPLATE_BYTES, 10):
        got = {r.page_id: r for r in H.extract_text(pages, most).collect()}
        for i in want:
            assert got[i].text == want[i], (i, got[i].text, want[i])
            assert got[i].n_chars == len(want[i]) and got[i].url == rows[i][1]


def test_edges(spark):
    same = "<p>just this</p>"
    rows = [(1, None, None), (2, "x", ""), (3, None, "a < b &nbsp; &eacute;<br>c"), (4, "http://h/", same), (4, "http://h/", same), (5, "http://h/", same), (6, "http://h/", same), (7, "//H:80/x", "<div>" * 300 + "deep" + "</div>" * 300), (None, "http://k/", "<p>ä" + " w" * 50000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted(((r.page_id, r.text, r.n_chars) for r in H.extract_text(pages).collect()), key=str)
    texts = {}
    for i, t, n in got:
        texts.setdefault(i, []).append(t)
        assert n == len(t)
    assert texts[1] == [""] and texts[2] == [""] and texts[3] == ["a < b é c"]
    assert texts[4] == ["just this"] * 2 and texts[6] == ["just this"] and texts[7] == ["deep"]
    assert texts[None] == ["ä" + " w" * 50000]
    assert H.extract_text(pages.filter("false")).count() == 0


def layout(*pages):
    rows = {}
    for page in pages:
        for path, up, key, text, words, nodes, place in H.rows_of(H.fold([H.parse(page)], "html.")):
            r = rows.setdefault(path, [path, up, key, 0, text, text, 0, 0, 0])
            r[3:] = [r[3] + 1, min(r[4], text), max(r[5], text), r[6] + words, r[7] + nodes, r[8] + place]
    return H.as_template(list(rows.values()))


def test_tree_matching_finds_the_largest_match():
    a = layout("<div><p>x</p><ul><li>1</li></ul><h2>y</h2></div>")
    b = H.fold([H.parse("<div><h2>z</h2><ul><li>2</li></ul><h2>y</h2></div>")], "html.")
    # html, div, and either ul with li or h2 alone, as these stand in another order
    assert H.match(a, b)[0] == 4


def test_deep_pages(spark):
    n = 10_000
    deep = "<p>before</p>" + "<div>" * n + "one" + "<b>two</b>" + "</div>" * n + "<p>after</p>"
    rows = [(i, "http://h/", deep + f"<p>{i} more</p>") for i in range(4)]
    got = H.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert sorted(r.text.split("\n")[-1] for r in got) == [f"{i} more" for i in range(4)]
    assert H.extract(deep, None) == "before\nonetwo\nafter"


def plain_layout(rnd, texts):
    """Pages without tags or names that say anything: varying adverts, menus and comments around the content."""
    out = []
    for paragraphs in texts:
        menu = "<div class=a1>" + "".join(f"<a href='/{w}'>{w}</a> " for w in rnd.sample(WORDS, 4)) + "</div>"
        ad, note = f"<div class=a2>{prose(rnd, 5)}</div>", f"<div class=a4><div>{prose(rnd, 6)}</div></div>"
        out.append(f"<body><div class=a0>Site name</div>{menu}{ad}<h1>{paragraphs[0]}</h1><div class=a3>" + "".join(f"<p>{p}</p>" for p in paragraphs[1:]) + f"</div>{note}<div class=a5>Contact us</div></body>")
    return out


def test_alignment_decides_without_names_or_tags(spark):
    rnd = random.Random(8)
    texts = [[prose(rnd, 6), *[prose(rnd, rnd.randint(30, 60)) for _ in range(3)]] for _ in range(9)]
    rows = [(i, "http://plain.example.org/", page) for i, page in enumerate(plain_layout(rnd, texts))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = {i: "\n".join(t) for i, t in enumerate(texts)}
    assert {r.page_id: r.text for r in H.extract_text(pages).collect()} == want
    assert {r.page_id: r.text for r in H.extract_text(pages.repartition(7).orderBy(F.desc("page_id")), 10).collect()} == want
    assert all(H.extract(page, None) != want[i] for i, _, page in rows)


def test_template_is_the_same_in_any_order():
    rnd = random.Random(9)
    pages = [page(rnd, rnd.randrange(3))[0] for _ in range(12)]
    show = lambda t: (t.key, t.pages, t.text, t.words, t.single, [show(c) for c in t.children])
    first = show(layout(*pages))
    for _ in range(5):
        rnd.shuffle(pages)
        assert show(layout(*pages)) == first


def plain_text(page):
    """The registered pages' articles by cutting strings."""
    part = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    part = re.sub(r"<!--.*?-->|<(script|style|aside|form|div class=\"ad\")\b.*?</\1>", "", part, flags=re.S)
    part = re.sub(r"<br\b[^>]*>", " ", part)
    blocks = re.split(r"</?(?:p|h[1-6]|ul|ol|li|table|tr|td|th|div|section|blockquote|pre|header|figure|figcaption)\b[^>]*>", part)
    lines = [" ".join(html.unescape(re.sub(r"</?[a-zA-Z][^>]*>", "", b)).split()) for b in blocks]
    return "\n".join(x for x in lines if x)


@pytest.mark.skipif(not Path("/root/testdata/sf0.01/pages.parquet").exists(), reason="needs the registered tables")
def test_registered_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    source = {r.page_id: r.html for r in pages.collect()}
    want = {i: plain_text(p) for i, p in source.items()}
    assert {r.page_id: r.text for r in H.extract_text(pages).collect()} == want
    # the same with names that say nothing: alignment alone knows where the article is, on hosts with pages enough
    opaque = pages
    for old, new in (("<article>", '<div class="q1">'), ("<nav>", '<div class="q2">'), ("<footer>", '<div class="q3">'), ('class="ad"', 'class="q4"'), ("</article>", "</div>"), ("</nav>", "</div>"), ("</footer>", "</div>")):
        opaque = opaque.withColumn("html", F.replace("html", F.lit(old), F.lit(new)))
    known = {r.host for r in H.templates(pages.withColumn("host", H.host_of(F.col("url")))).collect()}
    got = {r.page_id: r.text for r in H.extract_text(opaque).join(pages.select("page_id", H.host_of(F.col("url")).alias("host")), "page_id").collect() if r.host in known}
    assert len(got) > 200 and got == {i: want[i] for i in got}
    assert sum(H.extract(r.html, None) == want[r.page_id] for r in opaque.collect()) == 0
