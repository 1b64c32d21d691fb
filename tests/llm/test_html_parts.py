"""What is dropped inside an article, and which names and attributes say so."""

import random

from pixelweir.llm import html_text as H

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def texts(spark, pages):
    rows = [(i, "http://one.example.com/", h) for i, h in enumerate(pages)]
    return [r.text for r in H.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()]


def test_parts_repeated_inside_an_article_go(spark):
    rnd = random.Random(4)
    prose = [" ".join(rnd.choice(WORDS) for _ in range(20)) for _ in range(6)]
    box = "<div class='x7'><h3>Hello reader</h3><p>Our shop is open</p></div>"
    pages = [f"<body><article><h1>{p[:30]}</h1>{box}<h2>Introduction</h2><p><b>Note</b> {p}</p><table><tr><th>Name</th><td>{p[:9]}</td></tr></table></article></body>" for p in prose]
    for p, got in zip(prose, texts(spark, pages), strict=True):
        assert got == "\n".join([p[:30].strip(), "Introduction", f"Note {p}", "Name", p[:9].strip()])
    assert "Our shop" in H.extract(pages[0], None)
    assert all("Our shop" in t for t in texts(spark, pages[:2]))  # two pages prove nothing


def test_names_and_attributes_count_whole():
    article = "<article><p>the text of the article</p></article>"
    for start in ("<div class='site has-sidebar'>", "<div class='overflow-hidden'>", '<div title="a hidden gem">', '<div data-id="legal">', "<div data-hidden=no>", "<div class='page-wrapper' data-role='menu'>", "<div class='menu'>", "<form id=f>", "<div id='content' role='search'>"):
        assert H.extract(f"<body><p>a b</p>{start}{article}</div></form></body>", None) == "the text of the article", start
    assert H.extract("<article class='post no-sidebar'><p>text</p></article>", None) == "text"
    for part in ("<div class='a ad-slot'>", "<div id='cookie-notice'>", "<div class='post-comments'>", "<div class=site-header>", "<div class='ad0'>", "<div x=1 HIDDEN>", "<div style='display: none'>", '<div title="x"class="ads">', "<div role=banner>"):
        assert H.extract(f"<article><p>text</p>{part}more</div></article>", None) == "text", part
    teaser = "<div class='related'><article><p>one two</p></article></div>"
    assert H.extract(f"<body><p>the longer text of a page without an article</p>{teaser}</body>", None) == "the longer text of a page without an article"
