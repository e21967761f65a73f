"""Main text of web pages by tree scoring.

The page is read into a tree that forgives open tags.  Elements that never hold an article's text are
left out (scripts, styles, forms, menus, headers and footers of the page, hidden elements, and those whose class,
id or role names a notice, advert, side bar, comments and the like).  Each paragraph gives points for
its length and its commas to its parent, half of them to the next ancestor and less to those above; a container's points
are discounted by its link density.  The best container, or the ``article`` or ``main`` around it, and those of its
siblings that score or read like text are kept; all blocks in them are returned.

Defined results: null or empty html gives an empty text; character references are decoded; white space in a
block becomes one space; blocks are joined by a line feed, empty ones left out; a page without
paragraphs gives what is left of its ``article``, ``main`` or ``body``.
"""

from __future__ import annotations

import html as html_lib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .textkit import arrow_map, table

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes xmp".split())
NEVER = frozenset("script style textarea title noscript iframe noembed noframes template svg math canvas object audio video picture map nav footer aside form button select datalist menu dialog head fieldset".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split())
PARAGRAPH = frozenset("p pre blockquote td div section article main li dd figcaption body".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An open element that the start of another closes.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "thead", "tbody"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "option": {"select"}, "tbody": {"table"}, "tfoot": {"table"}}
UNWANTED_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar form tablist".split())
UNWANTED_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner promo promos promotion sponsor sponsors sponsored sidebar menu nav navbar navigation breadcrumb breadcrumbs"
    " cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup paywall comment comments commentlist respond disqus replies reply discussion"
    " share sharing social related recommended recommendations recirc outbrain taboola footer masthead topbar toolbar widget widgets pagination pager copyright legal disclaimer login signin search skip print".split()
)
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^'\">]|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "points", "size", "linked")

    def __init__(self, tag: str, attrs: dict, parent: "Node | None"):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []
        self.points, self.size, self.linked = 0.0, 0, 0


def parse(source: str) -> Node:
    root = at = Node("#root", {}, None)
    pos = 0
    while True:
        m = _TOKEN.search(source, pos)
        if m is None:
            if pos < len(source):
                at.children.append(source[pos:])
            return root
        if m.start() > pos:
            at.children.append(source[pos : m.start()])
        pos = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            up = at
            while up.parent is not None and up.tag != tag:
                up = up.parent
            if up.parent is not None:
                at = up.parent
            elif tag == "br":
                at.children.append(Node("br", {}, at))
            continue
        if tag in BLOCK:  # a block ends an open paragraph, unless a container lies between
            up = at
            while up.tag not in BLOCK and up.parent is not None:
                up = up.parent
            if up.tag == "p" or (up.tag in HEADINGS and tag in HEADINGS):
                at = up.parent
        if tag in CLOSES:
            up = at
            while up.parent is not None and up.tag not in CLOSES[tag] and up.tag not in SCOPE[tag]:
                up = up.parent
            while up.parent is not None and up.tag in CLOSES[tag]:
                at = up = up.parent
        attrs = {}
        for a in _ATTR.finditer(m[3]):
            attrs.setdefault(a[1].lower(), a[2] or a[3] or a[4] or "")
        node = Node(tag, attrs, at)
        at.children.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>", re.I).search(source, pos)
            pos = end.end() if end else len(source)
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            at = node


def unwanted(node: Node, in_article: bool) -> bool:
    tag, attrs = node.tag, node.attrs
    if tag in NEVER or (tag == "header" and not in_article):
        return True
    if tag in ("html", "body", "main", "#root"):
        return False
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(attrs.get("style", "")):
        return True
    if attrs.get("role", "").lower() in UNWANTED_ROLES:
        return True
    names = {w.lower() for w in _WORDS.findall(f"{attrs.get('class', '')} {attrs.get('id', '')}")}
    if tag == "article":
        return bool(names & {"comment", "comments", "reply", "ad", "ads", "related", "promo", "sponsored"})
    return not names.isdisjoint(UNWANTED_WORDS) or (not in_article and "header" in names and tag not in HEADINGS)


def prune(root: Node) -> None:
    """Leaves out unwanted elements and counts characters and linked characters, from the leaves up."""
    order, stack = [], [(root, False)]
    while stack:
        node, inside = stack.pop()
        inside = inside or node.tag in ("article", "main")
        order.append(node)
        kept = [c for c in node.children if isinstance(c, str) or not unwanted(c, inside)]
        node.children = kept
        stack += [(c, inside) for c in kept if not isinstance(c, str)]
    for node in reversed(order):
        for c in node.children:
            if isinstance(c, str):
                node.size += len(c.strip())
            else:
                node.size += c.size
                node.linked += c.size if c.tag == "a" else c.linked


def density(node: Node) -> float:
    return node.linked / node.size if node.size else 0.0


def own_text(node: Node) -> str:
    """Text of the node outside of blocks below it."""
    out, stack = [], [node]
    while stack:
        n = stack.pop()
        for c in n.children:
            if isinstance(c, str):
                out.append(c)
            elif c.tag not in BLOCK:
                stack.append(c)
    return " ".join(out)


def best_container(root: Node) -> Node | None:
    stack, scored = [root], []
    while stack:
        node = stack.pop()
        stack += [c for c in node.children if not isinstance(c, str)]
        if node.tag not in PARAGRAPH:
            continue
        text = " ".join(own_text(node).split())
        if len(text) < 25:
            continue
        points = (1 + text.count(",") + text.count("，") + min(len(text) / 100, 3)) * (1 - density(node))
        up = node.parent if node.tag in ("p", "pre", "blockquote", "td", "li", "dd", "figcaption") and node.parent else node
        share, depth = 1.0, 0
        while up is not None and up.tag not in ("html", "#root"):
            if not up.points:
                scored.append(up)
            up.points += points * share
            depth += 1
            share = 0.5 if depth == 1 else 1 / (depth * 3)
            up = up.parent
    return max(scored, key=lambda n: n.points * (1 - density(n)), default=None)


def in_article(node: Node | None) -> bool:
    while node is not None and node.tag not in ("article", "main"):
        node = node.parent
    return node is not None


def blocks(node: Node, out: list[str]) -> None:
    """Appends the text of the node's blocks in page order."""
    run: list[str] = []

    def flush() -> None:
        text = " ".join(html_lib.unescape("".join(run)).split())
        if text:
            out.append(text)
        run.clear()

    stack: list = [node]
    while stack:
        n = stack.pop()
        if n is flush:
            flush()
        elif isinstance(n, str):
            run.append(n)
        elif n.tag == "br":
            run.append(" ")
        else:
            if n.tag in BLOCK:
                flush()
                stack.append(flush)
            if n.tag in ("ul", "ol") and len(n.children) > 2 and density(n) > 0.8 and not in_article(n):
                continue  # a menu
            stack += reversed(n.children)
    flush()


def find(root: Node, tag: str) -> Node | None:
    stack = [root]
    while stack:
        n = stack.pop()
        if n.tag == tag:
            return n
        stack += [c for c in reversed(n.children) if not isinstance(c, str)]
    return None


def main_text(source: str | None) -> str:
    if not source:
        return ""
    root = parse(source)
    prune(root)
    best, out = best_container(root), []
    if best is None:
        blocks(find(root, "article") or find(root, "main") or find(root, "body") or root, out)
        return "\n".join(out)
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    top = up or best
    if top.tag in ("body", "#root", "html") or top.parent is None:
        blocks(top, out)
        return "\n".join(out)
    score = top.points * (1 - density(top))
    for c in top.parent.children:
        if c is top:
            blocks(c, out)
        elif isinstance(c, str) or top.tag in ("article", "main") and c.tag not in ("article", "main"):
            continue
        elif c.tag in HEADINGS or c.points * (1 - density(c)) >= max(4, 0.2 * score):
            blocks(c, out)
        elif c.tag in ("p", "pre", "blockquote", "ul", "ol", "table", "figure") and c.size and density(c) < 0.25:
            blocks(c, out)
    return "\n".join(out)


def extract(df: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, text and n_chars of every page."""

    def run(batches):
        for b in batches:
            texts = [main_text(h) for h in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*b.schema.names[:-1], "text", "n_chars"])

    rows = df.select(*keep, F.col(html).cast("string").alias("_html"))
    kinds = [f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return arrow_map(rows, run, ", ".join([*kinds, "text string", "n_chars long"]))


def op8_html_text(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {"op8_html_text": op8_html_text}
SQL: dict[str, str] = {}
