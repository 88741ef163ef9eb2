"""Main text of web pages by wrapper induction: pages of one host are aligned, constant nodes are its template.

A host's pages of one layout have up to three reference pages, those of least hash. Every page is aligned with them by simple
tree matching, and for each node of a reference it is counted how many pages have it with the same text: all pages vote, in
counters that are summed before they are shuffled. A node whose text stays the same is template, varying slots are content, unless HTML
itself or the names of their classes say that they are a menu, header, footer, sidebar, notice, advert, form or comments. Pages
that declare their article have the slot there; else it is the innermost element that holds most of the varying text outside of
links.

References and counters meet the pages by host: sent to all while they are small by measure, by a shuffle beyond; the result is
the same. A page is one value of a task; its host may hold any share of the pages.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, pieces, settle, without
from .dom import INLINE, Node, Shapes, align, parse

#: Elements, roles and words in class or id that mark what isn't the article.
DROPPED = frozenset("script style noscript template head title svg math iframe object embed canvas audio video map select option datalist textarea button input form fieldset nav footer aside menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form status".split())
WORDS = frozenset(
    "nav navbar navigation menu submenu topbar toolbar sidebar side rail footer foot masthead banner breadcrumb breadcrumbs crumbs pagination pager "
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion promoted cookie cookies consent gdpr notice notices alert popup modal overlay paywall "
    "share sharing social related recommended recommendations comment comments disqus respond reply replies newsletter subscribe subscription signup signin login search widget widgets skip copyright legal".split()
)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: Layouts of a host are told apart by which of these a page has.
LAYOUT = ("<article", "<main", "<section", "<aside", "<table", "<form")
#: A node is template when so many pages, other than the reference's copies, were aligned and this share has its text; inside of a
#: declared article a repeated passage may be the article's own, so more is asked for.
LEAST, SHARE, LEAST_INSIDE, SHARE_INSIDE = 4, 0.8, 20, 0.95
#: References that are sent to all are at most so large.
SENT = 32 << 20
KEYS_HELD = 2048
#: References of a host and layout: the pages of least hash in so many parts of the hashes, as one page may be odd.
REFERENCES = 3


def main_text(pages: DataFrame) -> DataFrame:
    """pages(url, html, ...) with a column ``text``: the main text, blocks in page order joined by one space.

    A null html is an empty page, whose text is empty; a page without a host is read by itself. Pages that repeat are read alike
    and give no evidence of a template. All rows and other columns stay as they are, but an older ``text``, which is replaced.
    """
    kept = without(pages, ["text"])
    host, layout, ref = fresh(kept, "host"), fresh(kept, "layout"), fresh(kept, "ref")
    rows = kept.withColumn(host, F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1)))
    rows = rows.withColumn(layout, F.concat(*[F.coalesce(F.contains("html", F.lit(t)).cast("int").cast("string"), F.lit("0")) for t in LAYOUT]))
    keyed = rows.select(F.col(host).alias("host"), F.col(layout).alias("layout"), F.coalesce("html", F.lit("")).alias("html"))
    mark = F.xxhash64("html")
    refs = keyed.where("host <> '' and html <> ''").groupBy("host", "layout", F.pmod(mark, F.lit(REFERENCES)).alias("part")).agg(F.min_by("html", mark).alias("ref"), F.count("*").alias("n"))
    refs = settle(refs.groupBy("host", "layout").agg(F.collect_list("ref").alias("refs"), F.sum("n").alias("n_pages")), "references")
    small = (refs.agg(F.sum(F.aggregate("refs", F.lit(64), lambda s, r: s + F.octet_length(r)).cast("long"))).first()[0] or 0) <= SENT
    sent = F.broadcast if small else (lambda t: t)
    # Hosts of one page have nothing to compare.
    votes = keyed.join(sent(refs.where("n_pages > 1").drop("n_pages")), ["host", "layout"]).mapInArrow(_votes, "host string, layout string, part int, node int, votes long")
    votes = votes.groupBy("host", "layout", "part", "node").agg(F.sum("votes").alias("votes"))
    votes = votes.groupBy("host", "layout").agg(F.collect_list(F.struct("part", "node", "votes")).alias("votes"))
    wrappers = settle(refs.join(votes, ["host", "layout"]).select("host", "layout", F.struct("refs", "votes").alias(ref)), "wrappers")
    rows = rows.join(sent(wrappers.withColumnsRenamed({"host": host, "layout": layout})), [host, layout], "left")
    names = kept.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in pieces(batch):
                wrapper, html = piece.column(ref), piece.column("html")
                texts = [extract(h.as_py() or "", _wrapper(w.as_py()) if w.is_valid else None) for h, w in zip(html, wrapper, strict=True)]
                yield pa.RecordBatch.from_arrays([*(piece.column(n) for n in names), pa.array(texts, pa.string())], names=[*names, "text"])

    # The html is read by the name that it is asked for by.
    whole = rows.select(*[F.col(f"`{c}`").alias("html") if c.lower() == "html" else F.col(f"`{c}`") for c in names], ref)
    names = ["html" if c.lower() == "html" else c for c in names]
    out = whole.mapInArrow(run, T.StructType([*(T.StructField(n, f.dataType) for n, f in zip(names, kept.schema.fields, strict=True)), T.StructField("text", T.StringType())]))
    return out.toDF(*kept.columns, "text")


@lru_cache(maxsize=256)
def _reference(html: str) -> tuple[Shapes, list[Node]]:
    shapes = Shapes()
    return shapes, shapes.mark(parse(html))


def _same(page: Node, html: str) -> list[tuple[Node, Node]] | None:
    """Pairs of equal, not empty text in the alignment of a page with a reference; None if all of the text is the same."""
    shapes, nodes = _reference(html)
    if len(shapes.known) > 100_000:
        _reference.cache_clear()
        shapes, nodes = _reference(html)
    shapes.mark(page)
    if page.value == nodes[0].value:
        return None
    return [(a, b) for a, b in align(shapes, page, nodes[0]) if a.value and a.value == b.value]


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per reference: how many pages differ from it (node -1), and how many of these have a node's text."""
    held: dict[tuple[str, str, int], np.ndarray] = {}
    names, types = ["host", "layout", "part", "node", "votes"], (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64())

    def out() -> pa.RecordBatch:
        found = [(*key, int(i) - 1, int(v[i])) for key, v in held.items() for i in np.nonzero(v)[0]]
        held.clear()
        columns = list(zip(*found, strict=True)) or [[]] * len(names)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    for batch in batches:
        for host, layout, html, refs in zip(*(batch.column(c) for c in ("host", "layout", "html", "refs")), strict=True):
            page = parse(html.as_py())
            for part, ref in enumerate(refs.as_py()):
                same, key = _same(page, ref), (host.as_py(), layout.as_py(), part)
                if same is not None:
                    if key not in held:
                        if len(held) >= KEYS_HELD:
                            yield out()
                        held[key] = np.zeros(len(_reference(ref)[1]) + 1, np.int64)
                    held[key][[0, *(b.number + 1 for _, b in same)]] += 1
    yield out()


def _wrapper(row: dict) -> list[tuple[str, frozenset[int]]]:
    """The references that have constant nodes, with the numbers of these."""
    found = []
    for part, ref in enumerate(row["refs"]):
        votes = {v["node"]: v["votes"] for v in row["votes"] if v["part"] == part}
        n = votes.pop(-1, 0)
        if n >= LEAST and any(v >= SHARE * n for v in votes.values()):
            inside = {k.number for node in _reference(ref)[1] if declared(node) for k in below(node)}
            constant = {i for i, v in votes.items() if (n >= LEAST_INSIDE and v >= SHARE_INSIDE * n if i in inside else v >= SHARE * n)}
            if constant:
                found.append((ref, frozenset(constant)))
    return found


def below(node: Node) -> Iterator[Node]:
    stack = list(node.inner)
    while stack:
        k = stack.pop()
        yield k
        stack += k.inner


def declared(node: Node) -> bool:
    """Does the page itself call this its article?"""
    return node.tag in ("article", "main") or bool(node.attrs) and (node.attrs.get("role") == "main" or (node.attrs.get("itemprop") or "").lower() == "articlebody")


def _furniture(node: Node, in_article: bool) -> bool:
    """Is it a menu, header, footer, sidebar, notice, advert, form or comments, by its element, role or names?"""
    tag, attrs = node.tag, node.attrs
    if tag in DROPPED:
        return True
    if tag == "header" and not in_article:
        return not any(k.tag in ("article", "main") for k in below(node))
    if not attrs or tag in ("html", "body"):
        return False
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in (attrs.get("style") or "").replace(" ", "").lower() or attrs.get("role") in ROLES:
        return True
    names = f"{attrs.get('class') or ''} {attrs.get('id') or ''}"
    if names == " ":
        return False
    words = {w.lower() for w in _WORD.findall(names)}
    if not (words & WORDS or "header" in words and not in_article and tag not in ("h1", "h2", "h3")):
        return False
    return tag == "article" and bool(words & {"comment", "comments", "reply"}) or not (declared(node) or any(declared(k) for k in below(node)))


def extract(html: str, wrapper: list[tuple[str, frozenset[int]]] | None = None) -> str:
    """The main text of one page under the wrapper of its host."""
    page = parse(html)
    gone: set[int] = set()
    for ref, constant in wrapper or ():
        gone |= {id(a) for a, b in _same(page, ref) or () if b.number in constant}
    articles: list[Node] = []
    stack = [(page, False)]
    while stack:
        node, inside = stack.pop()
        mine = declared(node)
        if _furniture(node, inside or mine):
            gone.add(id(node))
            continue
        if id(node) in gone:
            continue
        if mine:
            articles.append(node)
        stack += [(k, inside or mine) for k in reversed(node.inner)]
    texts = {id(a): _text(a, gone) for a in articles}
    # Of nested ones the innermost that holds at least half of the outer one's text.
    outer = [a for a in articles if texts[id(a)]]
    for a in list(outer):
        inner = [k for k in below(a) if id(k) in texts and k in outer]
        if inner:
            first = [k for k in inner if not any(k is x for y in inner if y is not k for x in below(y))]
            if 2 * sum(len(texts[id(k)]) for k in first) >= len(texts[id(a)]):
                outer.remove(a)
            else:
                outer = [k for k in outer if k not in inner]
    if outer:
        return " ".join(texts[id(a)] for a in outer)
    return _text(_slot(page, gone), gone)


def _slot(page: Node, gone: set[int]) -> Node:
    """The innermost element that has four fifths of the text outside of links."""
    sizes: dict[int, int] = {}
    order, stack = [], [page]
    while stack:
        node = stack.pop()
        if id(node) not in gone and node.tag != "a":
            order.append(node)
            stack += node.inner
    for node in reversed(order):
        sizes[id(node)] = sum(sizes.get(id(k), 0) if k.__class__ is Node else len(k.split()) for k in node.kids)
    at = page
    while True:
        inner = [k for k in at.inner if k.tag not in INLINE and k.tag not in ("p", "h1", "h2", "h3", "li", "td", "tr") and 5 * sizes.get(id(k), 0) >= 4 * sizes[id(page)]]
        if not inner or not sizes[id(page)]:
            return at
        at = inner[0]


def _text(node: Node, gone: set[int]) -> str:
    """Texts in order; a space wherever a block begins or ends, white space as one space."""
    out: list[str] = []
    stack: list[Node | str] = [node]
    while stack:
        k = stack.pop()
        if k.__class__ is str:
            out.append(k)
        elif id(k) not in gone:
            if k.tag in INLINE:
                stack += reversed(k.kids)
            else:
                out.append(" ")
                stack.append(" ")
                stack += reversed(k.kids)
        elif k.tag not in INLINE:
            out.append(" ")
    return " ".join("".join(out).split())
