"""Main text of web pages by wrapper induction.

Pages become trees; like siblings are folded into one node, so that a tree is as small as the page's layout. The trees
of a host are laid over one another into a template: for each node, how many pages have it, whether its text is the same
on all of them, and how many words it held. These are sums and extremes by host and node, so that neither the order of
pages nor a host with very many of them matters. A node belongs to the template if LEAST_PAGES pages and a SUPPORT-th of
the host's pages have it, which leaves at most SUPPORT times as many nodes as a page has on average.

A page is aligned with its host's template by simple tree matching (the largest order-preserving match of nodes with
equal tags and classes). A node whose text never changes over the host's pages is the wrapper; nodes whose text varies
are slots. The innermost container that holds SHARE of the host's varying text outside links is where the content is:
on pages where it also holds most of the text, what stands beside it goes, but for headings. Tags, classes and roles
decide what alignment leaves open: parts inside the content that say they are menus, adverts, comments and the like, and
whole pages of hosts with fewer than LEAST_PAGES pages. Inside an <article> or <main> a wrapper part is a whole container
(PARTS) none of whose texts change on the host, beside slots that vary; single headings, cells, items and inline words
that an author repeats there are still content.

The templates are broadcast if they are small enough (TEMPLATE_BYTES), else joined by host.

Results: null and empty pages have no text. A null or odd url is a host of its own. Repeated rows are extracted alike;
equal pages prove nothing constant unless another page of the host differs. Elements nested more than DEPTH deep count
as siblings, as in browsers; their text stays in its place. Other columns are left out.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelweir.llm.common import bound_batches, durable, read, tidy

#: Pages from which a text that never changes counts as wrapper.
LEAST_PAGES = 3
#: A template's nodes stand on one of so many pages of the host at least.
SUPPORT = 100
#: Share of a host's varying text that a container has to hold, to be where the content is; and of a page's text, to be so there.
SHARE, HERE = 0.8, 0.2
#: Levels of a tree.
DEPTH = 256
TEMPLATE_BYTES = 16 << 20

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Tags that begin and end a block of text.
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Tags that are never main text.
OUT = frozenset("aside audio button canvas dialog footer form head iframe map math menu nav noembed noframes noscript object option script search select style svg template textarea title video".split())
#: Tags that a wrapper part inside an <article> or <main> begins with.
PARTS = frozenset("address blockquote center details div dl fieldset figure ol p section table ul".split())
#: Tags that may hold the content as a whole.
CONTAINERS = frozenset("article body center div html main section".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in classes and ids of parts that are never main text.
NAMES = frozenset(
    """ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs byline comment comments commentlist consent cookie cookies copyright disclaimer disqus footer gdpr hidden legal login masthead menu modal nav navbar
    navigation newsletter notice notices overlay pager pagination popup promo promoted recommended related reply replies respond responses rail search share sharing sidebar signup siteheader pageheader social sponsor sponsored
    subscribe toolbar topbar widget widgets""".split()
)
#: Words that may stand beside those in a hyphenated name: 'ad-slot', 'post-comments', but not 'has-sidebar' or 'overflow-hidden'.
BESIDE = frozenset("area bar block box bottom button buttons container form inner item items left link links list main page post posts right section site slot top unit wrap wrapper".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: A start tag that ends these open ones, up to the tag that holds them.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "body": ({"head"}, {"html"}),
}
#: Inside these, an open <p> isn't ended from within.
HOLDS_P = frozenset("article aside blockquote body button caption dd details dialog div fieldset figure footer form header li main nav object section table td th".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)|(?P<text>[^<]+|<)", re.S)
_ATTR = re.compile(r"([^\s\"'>/=][^\s>/=]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_READ = frozenset("class id role hidden aria-hidden style itemprop".split())


@lru_cache(10_000)
def says_out(name: str) -> bool:
    """Whether a whole class or id names a part that is never main text."""
    pieces = [x for x in re.split(r"[^a-z]+", name) if x]
    if "".join(pieces) in NAMES:
        return True
    return any(x in NAMES for x in pieces) and all(x in NAMES or x in BESIDE for x in pieces)


def attributes(source: str) -> dict[str, str]:
    """Those that are read here; of repeated ones the first counts, as in browsers."""
    out: dict[str, str] = {}
    for name, *values in _ATTR.findall(source):
        name = name.lower()
        if name in _READ:
            out.setdefault(name, next((html.unescape(v) for v in values if v), ""))
    return out


class Node:
    __slots__ = ("tag", "key", "out", "holds", "main", "parts", "wrapper", "fixed", "up", "beside")

    def __init__(self, tag: str, attrs: dict[str, str], up: Node | None = None):
        self.tag, self.up = tag, up
        names = f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()
        self.key = tag + "." + re.sub(r"[0-9]{2,}", "#", " ".join(sorted(names.split())))
        role = attrs.get("role", "").lower()
        unseen = "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or bool(re.search(r"display\s*:\s*none", attrs.get("style", ""), re.I))
        named = tag not in ("html", "body") and any(map(says_out, names.split()))
        self.out = tag in OUT or named or role in ROLES or unseen
        #: Whether only a name, a role or a form says so: it may still hold the article.
        self.holds = self.out and not unseen and (tag not in OUT or tag == "form")
        self.main = not self.out and (tag in ("article", "main") or attrs.get("role", "").lower() in ("main", "article") or attrs.get("itemprop", "").lower() == "articlebody")
        self.parts: list[Node | str] = []
        self.wrapper = self.fixed = self.beside = False


def parse(page: str) -> Node:
    """The page's tree; open ends are closed as browsers do, roughly."""
    root = Node("html", {})
    stack = [root]
    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.match(page, at)
        at = m.end()
        text = m["text"] or m["cdata"]
        if text is not None:
            stack[min(len(stack) - 1, DEPTH)].parts.append(html.unescape(text) if "&" in text and m["text"] else text)
            continue
        tag = m["tag"]
        if tag is None:
            continue
        tag = tag.lower()
        if m["close"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag not in BLOCKS and stack[k].tag in BLOCKS:  # a stray inline end doesn't end blocks
                    break
            continue
        attrs = attributes(m["attrs"]) if m["attrs"].strip(" /\n") else {}
        if tag == "html":
            continue
        if tag in ENDS:
            ended, holder = ENDS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in holder:
                    break
                if stack[k].tag in ended:
                    del stack[k:]
        elif tag in BLOCKS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in HOLDS_P:
                    break
        parent = stack[min(len(stack) - 1, DEPTH)]
        node = Node(tag, attrs, parent)
        parent.parts.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            if tag in ("textarea", "title"):
                node.parts.append(html.unescape(page[at : end.start() if end else n]))
            at = end.start() if end else n
            stack.append(node)
        elif tag not in VOID and not (m["attrs"].endswith("/") and tag not in BLOCKS):
            stack.append(node)
    return root


class Shape:
    """A node of the folded tree: all like siblings as one."""

    __slots__ = ("key", "nodes", "children", "text", "words")

    def __init__(self, key: str, nodes: list[Node]):
        self.key, self.nodes = key, nodes
        words = " ".join(" ".join(p for p in x.parts if isinstance(p, str)) for x in nodes).split()
        #: Hash of the nodes' own words, 0 if there are none, and their number.
        self.text = xxhash.xxh64_intdigest(" ".join(words).encode("utf-8", "surrogatepass")) >> 2 | 1 if words else 0
        self.words = len(words)
        self.children: list[Shape] = []


def fold(nodes: list[Node], key: str) -> Shape:
    shape = Shape(key, nodes)
    by_key: dict[str, list[Node]] = {}
    for x in nodes:
        for p in x.parts:
            if isinstance(p, Node) and p.tag not in ("script", "style", "head"):
                by_key.setdefault(p.key, []).append(p)
    shape.children = [fold(ns, k) for k, ns in by_key.items()]
    return shape


class Layout:
    """A node of a template."""

    __slots__ = ("key", "pages", "text", "words", "single", "children")

    def __init__(self, key: str, pages: int, text: int, words: int, single: bool):
        #: text: the hash of what never changes, 0 if there is no text, -1 if it varies; single: once a page at most.
        self.key, self.pages, self.text, self.words, self.single = key, pages, text, words, single
        self.children: list[Layout] = []

    @property
    def tag(self) -> str:
        return self.key.partition(".")[0]

    def mass(self) -> int:
        """Words of varying text outside links and parts that are never main text."""
        if self.tag in OUT or self.tag == "a":
            return 0
        return self.words * (self.text == -1) + sum(c.mass() for c in self.children)

    def varies(self) -> bool:
        return self.text == -1 or any(c.varies() for c in self.children)


#: A template node as a row: hashes of its and its parent's path, extremes of its text's hash, and sums over the host's pages.
ROW = "path long, up long, key string, pages long, low long, high long, words long, nodes long, place long"


def rows_of(shape: Shape) -> Iterator[tuple]:
    """A page's rows: (path, up, key, text, words, nodes, place)."""
    stack = [(shape, 0, 0)]
    while stack:
        x, up, place = stack.pop()
        path = xxhash.xxh64_intdigest(x.key.encode("utf-8", "surrogatepass"), up) >> 1
        yield path, up, x.key, x.text, x.words, len(x.nodes), place
        stack += [(c, path, i) for i, c in enumerate(x.children)]


def as_template(rows: list) -> Layout | None:
    """The tree of a host's rows (fields of ROW); children stand in the order of their mean places."""
    known = {r[0]: Layout(r[2], r[3], r[4] if r[4] == r[5] else -1, r[6], r[7] <= r[3]) for r in rows}
    root = None
    for r in sorted(rows, key=lambda r: (r[8] / r[3], r[2])):
        if r[1] == 0:
            root = known[r[0]]
        elif r[1] in known:
            known[r[1]].children.append(known[r[0]])
    return root


def match(template: Layout, shape: Shape) -> tuple[int, list[tuple[Layout, Shape]]]:
    """Simple tree matching: the number of matched nodes and the matched pairs, roots being equal."""
    a, b = template.children, shape.children
    if not a or not b:
        return 1, [(template, shape)]
    if len(a) == len(b) and all(x.key == y.key for x, y in zip(a, b, strict=True)):  # the usual case: the same layout
        inner = [match(x, y) for x, y in zip(a, b, strict=True)]
        return 1 + sum(n for n, _ in inner), [(template, shape), *[p for _, ps in inner for p in ps]]
    # keys are unique among siblings: only equal ones are tried
    place = {y.key: j for j, y in enumerate(b)}
    tried = [(i, place[x.key], *match(x, b[place[x.key]])) for i, x in enumerate(a) if x.key in place]
    best: list[tuple[int, int]] = []  # of each tried pair: the most matched nodes of a sequence that ends with it, and the pair before
    for k, (_, j, n, _) in enumerate(tried):
        most, before = max(((best[q][0], q) for q in range(k) if tried[q][1] < j), default=(0, -1))
        best.append((most + n, before))
    k = max(range(len(best)), key=lambda q: best[q][0], default=-1)
    total, pairs = best[k][0] if best else 0, []
    while k >= 0:
        pairs += tried[k][3]
        k = best[k][1]
    return 1 + total, [(template, shape), *pairs]


def content_node(template: Layout) -> Layout | None:
    """The innermost container that holds SHARE of the varying text; None if that is the page."""
    whole, x = template.mass(), template
    while whole:
        most = max(x.children, key=Layout.mass, default=None)
        if most is None or most.tag not in CONTAINERS or not most.single or most.mass() < SHARE * whole:
            break
        x = most
    return x if x is not template and x.tag != "body" else None


def _said(x: Node) -> int:
    """Words outside links and parts that are never main text by their tags."""
    return 0 if x.tag in OUT or x.tag == "a" else sum(len(p.split()) if isinstance(p, str) else _said(p) for p in x.parts)


def mark_wrapper(template: Layout, content: Layout | None, root: Shape) -> None:
    """Marks the page's nodes by the template: texts that never change on the host, and what stands beside the content. Without any varying text nothing is known."""
    if not template.varies():
        return
    pairs = match(template, root)[1]
    partner = {id(s): t for t, s in pairs}
    for t, s in pairs:
        if t.pages >= LEAST_PAGES and t.text not in (0, -1) and s.text == t.text:
            for x in s.nodes:
                x.wrapper = True

    def same(t: Layout, s: Shape) -> bool:
        return t.text != -1 and s.text == t.text and all(id(c) in partner and same(partner[id(c)], c) for c in s.children)

    def says(s: Shape) -> bool:
        return s.text != 0 or any(map(says, s.children))

    for t, s in pairs:
        for c in s.children:
            if c.nodes[0].tag in PARTS and id(c) in partner and says(c) and same(partner[id(c)], c) and t.varies():
                for x in c.nodes:
                    x.fixed = True

    here = [s.nodes[0] for t, s in pairs if t is content and len(s.nodes) == 1]
    if here and _said(here[0]) >= HERE * _said(root.nodes[0]):
        x = y = here[0]
        while y := y.up:  # an article that holds it says how far the content goes
            if y.main:
                x = y
        while x.up:
            for p in x.up.parts:
                if isinstance(p, Node) and p is not x and p.tag not in HEADINGS:
                    p.beside = True
            x = x.up


def main_text(root: Node) -> str:
    """The main text's blocks: of the parts that say they are the article, else of all that is left."""

    def seek(x: Node, tags: tuple[str, ...] | None, through: bool = False) -> list[Node]:
        found: list[Node] = []
        for p in x.parts:
            if isinstance(p, Node) and not p.beside and (not p.out or through and p.holds):
                found += [p] if p.main and (tags is None or p.tag in tags) else seek(p, tags, through)
        return found

    if mains := seek(root, ("article",)):
        return _text_of(mains, True)
    mains = seek(root, None)
    text = _text_of(mains or [root], bool(mains))
    held = seek(root, ("article",), True) or (not mains and seek(root, None, True))
    if held:  # the article stands in a part that says it is something else, unless these are teasers beside a longer text
        inner = _text_of(held, True)
        if len(inner.split()) > len(text.split()):
            return inner
    return text


def _text_of(parts: list[Node], within: bool) -> str:
    """The blocks of these parts; within: they say they are the article."""
    blocks: list[list[str]] = [[]]

    def walk(x: Node, inside: bool) -> None:
        if x.out or x.beside:
            return
        if x.tag == "header":
            if not inside:
                return
            for p in x.parts:  # an article's own header: its headings are text, the rest is about it
                if isinstance(p, Node) and p.tag in HEADINGS | {"hgroup"}:
                    walk(p, inside)
            return
        block = x.tag in BLOCKS
        if block and blocks[-1]:
            blocks.append([])
        for p in x.parts:
            if isinstance(p, str):
                if inside or not x.wrapper:
                    blocks[-1].append(p)
            elif p.tag == "br":
                blocks[-1].append(" ")
            elif inside and p.fixed:
                continue
            elif not inside and p.tag in ("ul", "ol", "div", "p", "table", "section") and _link_list(p):
                continue
            else:
                walk(p, inside)
        if block and blocks[-1]:
            blocks.append([])

    for m in parts:
        walk(m, within)
    lines = [" ".join("".join(b).split()) for b in blocks]
    return "\n".join(x for x in lines if x)


def _link_list(x: Node) -> bool:
    """Whether a part is two links or more and little else: a menu that doesn't say so."""
    links, size = [0], [0, 0]

    def count(y: Node, linked: bool) -> None:
        for p in y.parts:
            if isinstance(p, str):
                size[linked] += len(p.split())
            else:
                links[0] += p.tag == "a"
                count(p, linked or p.tag == "a")

    count(x, False)
    return links[0] >= 2 and size[1] > 0 and 4 * size[0] <= size[1]


def extract(page: str | None, template: Layout | None, content: Layout | None = None) -> str:
    if not page:
        return ""
    root = parse(page)
    if template:
        mark_wrapper(template, content, fold([root], root.key))
    return main_text(root)


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def templates(pages: DataFrame) -> DataFrame:
    """(host, nodes): each host's template as an array of ROW. pages: host, html."""

    def by_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple, list] = {}
        for b in batches:
            for host, page in zip(b.column("host").to_pylist(), b.column("html").to_pylist(), strict=True):
                if page:
                    root = parse(page)
                    for path, up, key, text, words, nodes, place in rows_of(fold([root], root.key)):
                        x = found.get((host, path))
                        if x is None:
                            found[host, path] = [up, key, 1, text, text, words, nodes, place]
                        else:
                            x[2] += 1
                            x[3], x[4] = min(x[3], text), max(x[4], text)
                            x[5], x[6], x[7] = x[5] + words, x[6] + nodes, x[7] + place
            if len(found) > 50_000:  # many layouts: hand them on
                yield _rows(found)
                found = {}
        yield _rows(found)

    parts = pages.select("host", "html").mapInArrow(tidy(by_task), f"host string, {ROW}")
    sums = [F.sum(c).alias(c) for c in ("pages", "words", "nodes", "place")]
    # by host and node; a node's key and parent follow from its path
    merged = durable(parts.groupBy("host", "path").agg(F.min("up").alias("up"), F.min("key").alias("key"), F.min("low").alias("low"), F.max("high").alias("high"), *sums).filter(F.col("pages") >= LEAST_PAGES))
    whole = merged.filter("up = 0").select("host", F.col("pages").alias("all"))
    kept = merged.join(whole, "host").filter(F.col("pages") * SUPPORT >= F.col("all"))
    return kept.groupBy("host").agg(F.collect_list(F.struct(*[x.split()[0] for x in ROW.split(", ")])).alias("nodes"))


def _rows(found: dict[tuple, list]) -> pa.RecordBatch:
    up, key, pages, low, high, words, nodes, place = zip(*found.values(), strict=True) if found else [()] * 8
    long = [pa.array(x, pa.int64()) for x in ([p for _, p in found], up, pages, low, high, words, nodes, place)]
    return pa.RecordBatch.from_arrays([pa.array([h for h, _ in found], pa.string()), long[0], long[1], pa.array(key, pa.string()), *long[2:]], ["host", *[x.split()[0] for x in ROW.split(", ")]])


def extract_text(pages: DataFrame, most_bytes: int = TEMPLATE_BYTES) -> DataFrame:
    """(page_id, url, text, n_chars) of each row of pages (page_id, url, html)."""
    spark = pages.sparkSession
    bound_batches(spark)
    url = F.col("url").cast("string")
    pages = pages.select("page_id", url.alias("url"), F.col("html").cast("string").alias("html"), host_of(url).alias("host"))
    known = durable(templates(pages))
    size = known.agg(F.sum(F.length("host") + 64 * F.size("nodes") + F.aggregate("nodes", F.lit(0), lambda n, x: n + F.length(x["key"])))).first()[0] or 0
    shared = spark.sparkContext.broadcast({r.host: [tuple(x) for x in r.nodes] for r in known.collect()}) if size <= most_bytes else None
    page_type = pages.schema["page_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read_: dict[str, tuple] = {}
        for b in batches:
            hosts, texts = b.column("host").to_pylist(), []
            for i, (host, page) in enumerate(zip(hosts, b.column("html").to_pylist(), strict=True)):
                if host not in read_:
                    if len(read_) > 500:
                        read_.clear()
                    rows = shared.value.get(host) if shared else [tuple(x.values()) for x in b.column("nodes")[i].as_py() or []]
                    template = as_template(rows) if rows else None
                    read_[host] = template, template and content_node(template)
                texts.append(extract(page, *read_[host]))
            yield pa.RecordBatch.from_arrays([b.column("page_id"), b.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    source = pages if shared else pages.join(known, "host", "left")
    return source.mapInArrow(tidy(run), f"page_id {page_type}, url string, text string, n_chars long")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(read(spark, sf_dir, "pages"))
