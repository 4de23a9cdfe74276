"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree of style nodes: paths of block elements with their classes. Following Yi, Liu and
Li (2003), a node's presentation importance is the entropy of its layouts (the styles of its children, in order) over the pages
that have it, to the base of their number, and its content importance is one minus the mean entropy of its features (block
texts) over these pages: what stands on every page has importance 0, what differs from page to page 1. The composite importance
of a page's element is (1 - g) presentation + g mean of its children and of its own content, g = DECAY ** layouts; an element
without children has its content's. A branch is cut from a page if neither its top nor anything in it reaches
``MIN_IMPORTANCE``. Nodes on fewer than ``MIN_PAGES`` pages have importance 1. Equal pages of a host count once.

Markup says the rest. Elements that HTML defines as something beside the text (navigation, footers, asides, controls, scripts,
hidden parts, headers outside an article, forms that hold neither an article nor half of the page's text) don't count.
Class names and ids are one bounded term: a name that stands for adverts, comments and the like takes ``NAME`` from the importance
of a branch, and ``SMALL_NAME`` more if the branch holds less than ``SMALL`` of the page's text; so a name alone cuts no larger
branch. Where a page marks an article, the text is what is left inside it; an article of which nothing would be left stays whole.

A null html is an empty page with an empty text, and a null url a page of the host ""; whole pages are read, cut-off ones as far
as they go; repeated rows each get their row; an empty table gives an empty result; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from .common import materialise

#: Pages from which on a node is judged, importance that a branch must reach, and how fast many layouts take over from contents.
MIN_PAGES, MIN_IMPORTANCE, DECAY = 8, 0.5, 0.9
#: What a name takes from a branch's importance, what more from one with less than this share of the page's text.
NAME, SMALL_NAME, SMALL = 0.45, 0.1, 0.2
#: Judged nodes (some 60 bytes each) up to which they are sent to all executors; beyond it they are joined to each page's nodes.
BROADCAST_NODES = 200_000
#: HTML element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b bdi bdo cite code data del dfn em font i ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BESIDE_TAGS = frozenset("head nav footer aside script style noscript template iframe object embed svg canvas button select option textarea input label fieldset dialog menu title audio video map xmp noembed noframes math".split())
BESIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
#: Whole class names and ids that stand for something beside the article.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu nav navigation navbar breadcrumb breadcrumbs masthead cookie cookies cookie-notice cookie-banner cookie-consent consent gdpr notice notices notification popup modal overlay newsletter subscribe signup login comments comment-list disqus replies respond share sharing social teaser widget toolbar pagination pager legal disclaimer skip-link".split()
)
ARTICLE = frozenset(("article", "main"))
SELF_CLOSING = {"p": "p", "li": "li", "dt": "dt", "dd": "dt", "tr": "tr", "td": "td", "th": "td", "option": "option"}
_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/><]*)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|=\s*[^\s\"'<>][^\s<>]*|[^<>])*)(?:>|\Z|(?=<))|<[!?][^>]*(?:>|\Z)|</(?:[^a-zA-Z][^>]*)?(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"(class|id|role|itemprop|hidden|aria-hidden)\b\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?", re.I)


def host_of(url: str | None) -> str:
    rest = (url or "").partition("://")[2]
    return re.split(r"[/?#]", rest, maxsplit=1)[0].lower()


def _node(parent: int, name: str) -> int:
    return xxhash.xxh64_intdigest(f"{parent:x}>{name}") - (1 << 63)


class Element:
    """A block element of a page: its parent's place in the page's list, its style node, what its markup says, its children's
    style nodes, and the texts (with their place among the page's blocks) that stand in it directly."""

    __slots__ = ("parent", "node", "beside", "named", "article", "form", "children", "texts")

    def __init__(self, parent: int, node: int, beside: bool, named: bool, article: bool, form: bool):
        self.parent, self.node, self.beside, self.named, self.article, self.form = parent, node, beside, named, article, form
        self.children: list[int] = []
        self.texts: list[tuple[int, str]] = []


#: A judged node: presentation importance, number of layouts, content importance.
Stats = tuple[float, int, float]
_UNJUDGED: Stats = (1.0, 1, 1.0)


class Pages:
    """Reads pages into elements; keeps what tags mean, as they repeat."""

    def __init__(self):
        self.tags: dict[tuple[str, str], tuple[str, bool, bool, bool]] = {}
        self.nodes: dict[tuple[int, str], int] = {}

    def _meaning(self, tag: str, attributes: str) -> tuple[str, bool, bool, bool]:
        """The style of a tag, whether it is beside the text, has a name that says so, and holds an article."""
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
        names = {w.lower() for k in ("class", "id") for w in found.get(k, "").split()}
        role = found.get("role", "").lower()
        article = tag in ARTICLE or role in ("main", "article") or "articlebody" in found.get("itemprop", "").lower()
        beside = tag in BESIDE_TAGS or role in BESIDE_ROLES or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
        return f"{tag}.{' '.join(sorted(found.get('class', '').split()))}", beside, tag not in ("html", "body") and bool(names & NAMES), article

    def elements(self, html: str | None) -> list[Element]:
        """The page's elements, parents first; the first is the page."""
        html = html or ""
        page = [Element(-1, 0, False, False, False, False)]
        stack: list[tuple[str, int]] = [("", 0)]  # tags, and the elements they are or are in
        text: list[str] = []
        blocks = 0

        def flush() -> None:
            nonlocal blocks
            if text:
                if joined := " ".join("".join(text).split()):
                    page[stack[-1][1]].texts.append((blocks, joined))
                    blocks += 1
                text.clear()

        at = 0
        while at < len(html):
            m = _TAG.search(html, at)
            piece = html[at : m.start() if m else len(html)]
            if piece:
                text.append(unescape(piece))
            if not m:
                break
            at = max(m.end(), m.start() + 1)
            if not m[2]:
                continue
            tag = m[2].lower()
            if m[1]:
                if any(s[0] == tag for s in stack):
                    while True:
                        if stack[-1][1] != stack[-2][1]:
                            flush()
                        if stack.pop()[0] == tag:
                            break
                elif tag == "br":
                    text.append(" ")
                continue
            if tag in VOID:
                if tag == "hr":
                    flush()
                else:
                    text.append(" ")
                continue
            key = (tag, m[3])
            if (known := self.tags.get(key)) is None:
                if len(self.tags) > 50_000:
                    self.tags.clear()
                known = self.tags[key] = self._meaning(tag, m[3])
            style, beside, named, article = known
            own = tag not in INLINE or beside
            if own:
                flush()
                closes = SELF_CLOSING.get(tag, "p" if tag not in ("article", "main") else "")
                for k in range(len(stack) - 1, 0, -1):
                    if tag in INLINE:
                        break
                    if stack[k][0] == closes or SELF_CLOSING.get(stack[k][0]) == closes and closes:
                        del stack[k:]
                        break
                    if stack[k][0] not in INLINE:
                        break
                parent = stack[-1][1]
                above = page[parent]
                if (node := self.nodes.get((above.node, style))) is None:
                    if len(self.nodes) > 100_000:
                        self.nodes.clear()
                    node = self.nodes[above.node, style] = _node(above.node, style)
                # A header outside the article belongs to the site; inside it holds the article's heading.
                page.append(Element(parent, node, above.beside or beside or tag == "header" and not (above.article or article), above.named or named, above.article or article, tag == "form"))
                above.children.append(node)
                stack.append((tag, len(page) - 1))
            else:
                stack.append((tag, stack[-1][1]))
            if tag in RAW:
                end = re.compile(rf"</{tag}\b[^>]*(?:>|\Z)", re.I).search(html, at)
                at = end.end() if end else len(html)
                stack.pop()
        flush()
        self._forms(page)
        return page

    @staticmethod
    def _forms(page: list[Element]) -> None:
        """Forms that hold neither an article nor half of the page's text are beside the text."""
        if not any(e.form for e in page):
            return
        sizes, holds = _sizes(page), [e.article for e in page]
        for k in range(len(page) - 1, 0, -1):
            holds[page[k].parent] |= holds[k] and not page[page[k].parent].article
        for k, e in enumerate(page[1:], 1):
            e.beside |= page[e.parent].beside or e.form and not (holds[k] and not page[e.parent].article) and 2 * sizes[k] < sizes[0]

    def branches(self, page: list[Element], stats: dict[int, Stats]) -> list[bool]:
        """Which elements stay, by the host's judged nodes and the markup."""
        sizes = _sizes(page)
        own, best = [1.0] * len(page), [0.0] * len(page)
        inside: list[list[float]] = [[] for _ in page]
        for k in range(len(page) - 1, -1, -1):
            e = page[k]
            layout, layouts, content = stats.get(e.node, _UNJUDGED)
            if e.texts:
                inside[k].append(content)
            if not inside[k]:
                continue  # nothing in it
            mean = sum(inside[k]) / len(inside[k])
            share = DECAY**layouts
            own[k] = (1 - share) * layout + share * mean if e.children else mean
            best[k] = max(best[k], own[k] - (NAME + SMALL_NAME * (sizes[k] < SMALL * sizes[0]) if e.named else 0.0))
            if k and not e.beside:
                inside[e.parent].append(own[k])
                best[e.parent] = max(best[e.parent], best[k])
        stay = [not e.beside for e in page]
        for k, e in enumerate(page[1:], 1):
            stay[k] = stay[k] and stay[e.parent] and best[k] >= MIN_IMPORTANCE
        return stay

    def main_text(self, html: str | None, stats: dict[int, Stats] | None = None) -> str:
        page = self.elements(html)
        stay = self.branches(page, stats or {})
        left = [x for e, ok in zip(page, stay, strict=True) if ok and e.article for x in e.texts]
        left = left or [x for e in page if e.article and not e.beside for x in e.texts]
        left = left or [x for e, ok in zip(page, stay, strict=True) if ok for x in e.texts]
        return "\n".join(text for _, text in sorted(left))


def _sizes(page: list[Element]) -> list[int]:
    """Characters in each element, those beside the text left out."""
    sizes = [0 if e.beside else sum(len(t) for _, t in e.texts) for e in page]
    for k in range(len(page) - 1, 0, -1):
        sizes[page[k].parent] += sizes[k]
    return sizes


def _print(text: str) -> int:
    return xxhash.xxh64_intdigest(text) >> 1


#: What a row of a page's tree says: the page has the node, its layout there, a text in it.
_PRESENT, _LAYOUT, _TEXT = 0, 1, 2


def style_nodes(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``host, node, pages, layout, layouts, content``: the merged tree's nodes that aren't beside the text, with the number of
    pages that have them, presentation importance, number of layouts and content importance."""

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Pages()
        for batch in batches:
            hosts, nodes, kinds, values, texts = [], [], [], [], []
            for u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                layouts: dict[int, list[list[int]]] = {}
                seen = set()
                for e in reader.elements(h):
                    if not e.beside:
                        layouts.setdefault(e.node, []).append(e.children)
                        seen |= {(e.node, _TEXT, _print(t)) for _, t in e.texts}
                for node, found in layouts.items():
                    seen |= {(node, _PRESENT, 0), (node, _LAYOUT, _print(repr(found)))}
                hosts += [host_of(u)] * len(seen)
                for parts, column in zip(zip(*seen, strict=True), (nodes, kinds, values), strict=True):
                    column += parts
                texts += [xxhash.xxh64_intdigest(h or "") - (1 << 63)] * len(seen)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(nodes, pa.int64()), pa.array(kinds, pa.int32()), pa.array(values, pa.int64()), pa.array(texts, pa.int64())], ["host", "node", "kind", "value", "page"])

    rows = pages.select(F.col(url).cast("string").alias("u"), F.col(html).cast("string").alias("h")).mapInArrow(features, "host string, node long, kind int, value long, page long").distinct()
    counts = rows.groupBy("host", "node", "kind", "value").agg(F.count("*").alias("c"))
    of = lambda kind, x: F.when(F.col("kind") == kind, x)
    sums = counts.groupBy("host", "node").agg(
        F.max(of(_PRESENT, F.col("c"))).alias("pages"),
        F.count(of(_LAYOUT, 1)).alias("layouts"),
        F.sum(of(_LAYOUT, F.col("c") * F.log("c"))).alias("layout_sum"),
        F.count(of(_TEXT, 1)).alias("texts"),
        F.sum(of(_TEXT, F.log("c"))).alias("text_sum"),
    )
    # Entropies to the base of the number of pages.
    base = F.log("pages")
    layout = F.when(F.col("pages") > 1, 1 - F.col("layout_sum") / F.col("pages") / base).otherwise(F.lit(1.0))
    content = F.when((F.col("pages") > 1) & (F.col("texts") > 0), 1 - F.col("text_sum") / F.col("texts") / base).otherwise(F.lit(1.0))
    return sums.select("host", "node", "pages", layout.alias("layout"), "layouts", content.alias("content"))


def _as_stats(rows) -> dict[int, Stats]:
    return {node: (layout, layouts, content) for node, layout, layouts, content in rows}


def main_texts(pages: DataFrame, id: str = "page_id", url: str = "url", html: str = "html", min_pages: int = MIN_PAGES, broadcast_nodes: int = BROADCAST_NODES) -> DataFrame:
    """``id, url, text, n_chars`` of every page."""
    spark = pages.sparkSession
    judged = materialise(style_nodes(pages, url, html).where(F.col("pages") >= min_pages).drop("pages"), "judged-nodes")
    plain = pages.select(F.col(id).alias("i"), F.col(url).cast("string").alias("u"), F.col(html).cast("string").alias("h"))
    kind = pages.schema[id].dataType.simpleString()
    out, schema = [id, url, "text", "n_chars"], f"`{id}` {kind}, `{url}` string, text string, n_chars long"
    if judged.count() <= broadcast_nodes:
        tree: dict[str, dict[int, Stats]] = {}
        for host, node, *stats in judged.collect():
            tree.setdefault(host, {})[node] = tuple(stats)
        shared = spark.sparkContext.broadcast(tree)

        def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            reader = Pages()
            for batch in batches:
                us, hs = (batch.column(k).to_pylist() for k in (1, 2))
                texts = [reader.main_text(h, shared.value.get(host_of(u))) for u, h in zip(us, hs, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], out)

        return plain.mapInArrow(extract, schema)

    # Too many judged nodes to send them around: each page's nodes look theirs up, and come back to the page as one row.
    def own_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Pages()
        for batch in batches:
            hosts, nodes, texts = [], [], []
            for u, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = {e.node for e in reader.elements(h) if not e.beside}
                hosts += [host_of(u)] * len(found)
                nodes += found
                texts += [xxhash.xxh64_intdigest(h or "") - (1 << 63)] * len(found)
            yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(nodes, pa.int64()), pa.array(texts, pa.int64())], ["host", "node", "page"])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts = pa.array([host_of(u) for u in batch.column(1).to_pylist()], pa.string())
            prints = pa.array([xxhash.xxh64_intdigest(h or "") - (1 << 63) for h in batch.column(2).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, hosts, prints], ["i", "u", "h", "host", "page"])

    def extract_joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Pages()
        for batch in batches:
            us, hs, stats = (batch.column(k).to_pylist() for k in (1, 2, 3))
            texts = [reader.main_text(h, _as_stats((x["node"], x["layout"], x["layouts"], x["content"]) for x in s or ())) for h, s in zip(hs, stats, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(us, pa.string()), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], out)

    nodes = plain.select("u", "h").mapInArrow(own_nodes, "host string, node long, page long").distinct()
    found = nodes.join(judged, ["host", "node"]).groupBy("host", "page").agg(F.collect_list(F.struct("node", "layout", "layouts", "content")).alias("stats"))
    with_key = plain.mapInArrow(keyed, f"i {kind}, u string, h string, host string, page long")
    return with_key.join(found, ["host", "page"], "left").select("i", "u", "h", "stats").mapInArrow(extract_joined, schema)
