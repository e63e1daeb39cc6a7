"""Main text of web pages by tag-path ratios.

Every block of text hangs on a path of tags from the root. Text length and punctuation are summed per path and
divided by the path's blocks, the ratios are smoothed along the page, fused and averaged over each path again;
paths above a threshold are content and choose their blocks. If most of the chosen text lies in article or main
elements, every such element with a chosen block is the article. Otherwise the chosen blocks are, with what
stands beside them: all blocks below an element that has mostly chosen text, short headings too. Parts marked
as menus, adverts, comments and the like are left out, unless the marked part is where the article is.

A page is read once from front to back, in time that grows with its length.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed sets of element names and marking words.
RAW = {"script", "style", "title", "textarea", "noscript", "template", "iframe", "xmp", "noembed", "noframes"}
LEFT_OUT = RAW | {"head", "nav", "footer", "aside", "form", "button", "select", "option", "datalist", "svg", "math", "canvas", "audio", "video", "object", "dialog", "menu", "label", "fieldset"}
VOID = {"area", "base", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var"}
CLOSES_P = {"p", "div", "article", "section", "main", "header", "footer", "nav", "aside", "ul", "ol", "dl", "table", "form", "blockquote", "pre", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
MARKED = set(
    "nav navbar navigation menu sidebar sidenav footer header masthead ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent gdpr notice alert "
    "comment comments commentlist discussion disqus reply replies respond share sharing social related recommended newsletter subscribe subscription signup login search popup modal overlay widget breadcrumb breadcrumbs pagination pager toolbar skip hidden".split()
)
#: What is never the article, however long it is.
FIRM = set("comment comments commentlist discussion disqus reply replies respond ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr notice alert nav navbar navigation menu footer hidden".split())
MODIFIERS = ("has-", "with-", "no-", "without-", "is-", "has_", "with_", "no_")
OF_ARTICLE = {"article", "entry", "post", "content", "story", "main", "body", "text"}
ROOTS = {"article", "main"}

_TAG = re.compile(r"</?([a-zA-Z][^\s/>]*)")
_STOP = re.compile(r"[>\"']")
_CLOSE = {tag: re.compile(rf"</{tag}\b[^>]*>", re.I) for tag in RAW}
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_NAMES = re.compile(r"[a-z]+")
_POINTS = re.compile(r"[.,;:!?。，、；：！？…]")


@dataclass(eq=False)
class Node:
    """An open element: its path by number, whether it is left out, the nearest marked and the outermost article element it is in, itself included."""

    tag: str
    parent: Node | None
    path: int
    out: bool = False
    marked: Node | None = None
    firm: bool = False
    root: Node | None = None


@dataclass(eq=False)
class Block:
    node: Node
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""

    @property
    def own(self) -> int:
        return max(0, len(self.text) - self.linked)


def _marks(tag: str, attributes: dict[str, str], in_root: bool) -> set[str] | None:
    """The words that mark an element as something other than the article, or nothing."""
    if tag in ("html", "body", "article", "main"):
        return None
    if "hidden" in attributes or attributes.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attributes.get("style", "")):
        return {"hidden"}
    if attributes.get("role", "") in {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar"}:
        return {attributes["role"]}
    tokens = [t for t in f"{attributes.get('class', '')} {attributes.get('id', '')}".split() if not t.lower().startswith(MODIFIERS)]
    names = set(_NAMES.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", " ".join(tokens)).lower()))
    hits = names & MARKED
    if hits <= {"header"} and (in_root or names & OF_ARTICLE):
        return None
    return hits or None


class _Reader:
    """Finds where tags end. Quotes count until one of them is never closed; so no stretch of a page is searched again and again."""

    def __init__(self, page: str):
        self.page, self.quotes, self.tags, self.sections = page, True, True, True

    def tag_end(self, at: int) -> int:
        """The place after the tag that begins at `at`, or -1 if there is none."""
        i = at
        while self.quotes:
            stop = _STOP.search(self.page, i)
            if stop is None:
                break
            if stop.group() == ">":
                return stop.end()
            i = self.page.find(stop.group(), stop.end()) + 1
            if not i:
                break
        self.quotes = False
        end = self.page.find(">", at) + 1 if self.tags else 0
        self.tags = bool(end)
        return end or -1

    def section_end(self, at: int) -> int:
        """The place of the end of a CDATA section, or -1."""
        end = self.page.find("]]>", at) if self.sections else -1
        self.sections = end >= 0
        return end


def blocks_of(page: str) -> tuple[list[Block], list[Node]]:
    """The page's blocks of text in order, without what is no text, and its elements, parents first."""
    paths: dict[tuple[int, str], int] = {}
    top = Node("", None, -1)
    nodes, blocks = [top], []
    here, now = top, None
    opened: Counter = Counter()
    reader = _Reader(page)
    links = at = 0
    size = len(page)

    def add(raw: str) -> None:
        nonlocal now
        if raw and not here.out:
            text = html.unescape(raw)
            if now is None:
                if text.isspace():
                    return
                now = Block(here)
                blocks.append(now)
            now.parts.append(text)
            now.linked += len(text.strip()) if links else 0

    def leave(node: Node) -> None:
        """Close a node and all that is open in it."""
        nonlocal here
        while True:
            opened[here.tag] -= 1
            last, here = here, here.parent
            if last is node:
                return

    while at < size:
        mark = page.find("<", at) if reader.tags else -1
        if mark < 0:
            add(page[at:])
            break
        add(page[at:mark])
        if page.startswith("<!--", mark):
            end = page.find("-->", mark + 4)
            at = end + 3 if end >= 0 else size
            continue
        if page.startswith("<![CDATA[", mark) and (end := reader.section_end(mark)) >= 0:
            add(page[mark + 9 : end])
            at = end + 3
            continue
        found = _TAG.match(page, mark)
        if found is None and page[mark + 1 : mark + 2] not in ("!", "?"):
            add("<")
            at = mark + 1
            continue
        end = reader.tag_end(found.end() if found else mark + 2)
        if end < 0:
            add(page[mark:])
            break
        at = end
        if found is None:
            continue
        tag, closing = found[1].lower(), page[mark + 1] == "/"
        if tag == "a":
            links = 0 if closing else 1
        if tag in INLINE:
            continue
        if tag == "br":
            add(" ")
            continue
        now, links = None, 0
        if closing:
            if opened[tag] > 0:
                node = here
                while node.tag != tag:
                    node = node.parent
                leave(node)
            continue
        rest = page[found.end() : end - 1]
        if tag in VOID or rest.endswith("/") and tag not in CLOSES_P:
            continue
        if tag in RAW:
            close = _CLOSE[tag].search(page, at)
            at = close.end() if close else size
            continue
        ends = SIBLINGS.get(tag, {"p"} if tag in CLOSES_P else set())
        node = here
        while node is not top:
            if node.tag in ends:
                leave(node)
                break
            if node.tag not in ends | {"p", "li", "dt", "dd", "td", "th"} or tag in SIBLINGS and node.tag in ("ul", "ol", "dl", "table"):
                break
            node = node.parent
        attributes = {m[0].lower(): html.unescape(m[1] or m[2] or m[3]) for m in _ATTRIBUTE.findall(rest)}
        key = tag if tag in ("html", "body") else ".".join([tag, *sorted(set(attributes.get("class", "").split()))])
        child = Node(tag, here, paths.setdefault((here.path, key), len(paths)))
        child.root = here.root or (child if tag in ROOTS or attributes.get("role") == "main" else None)
        marks = _marks(tag, attributes, here.root is not None)
        child.marked, child.firm = (child, bool(marks & FIRM)) if marks else (here.marked, here.firm)
        child.out = here.out or tag in LEFT_OUT or tag == "header" and here.root is None
        opened[tag] += 1
        nodes.append(child)
        here = child
    for block in blocks:
        block.text = " ".join("".join(block.parts).split())
    return [b for b in blocks if b.text], nodes


def _unmarked(blocks: list[Block], nodes: list[Node]) -> list[Block]:
    """The blocks outside marked parts; a mark does not count where an article element lies in it, or, on pages without one, most of the text."""
    total = sum(b.own for b in blocks)
    lone = any(b.node.root and not b.node.marked for b in blocks)
    text: Counter = Counter()
    rooted = {id(b.node.root.marked) for b in blocks if b.node.root and b.node.root.marked}
    for b in blocks:
        if b.node.marked:
            text[id(b.node.marked)] += b.own
    marked = [n for n in nodes if n.marked is n]
    for n in reversed(marked):  # what a part holds, the part around it holds too
        if outer := n.parent.marked:
            text[id(outer)] += text[id(n)]
            if id(n) in rooted:
                rooted.add(id(outer))
    gone: set[int] = set()
    for n in marked:
        outer = n.parent.marked
        if outer and id(outer) in gone or not (id(n) in rooted or 2 * text[id(n)] > total and not n.firm and not lone):
            gone.add(id(n))
    return [b for b in blocks if not b.node.marked or id(b.node.marked) not in gone]


def _smoothed(values: np.ndarray, radius: int = 1) -> np.ndarray:
    kernel = np.array([math.exp(-(k**2) / 2) for k in range(-radius, radius + 1)])
    wide = np.pad(values, radius, mode="edge")
    return np.convolve(wide, kernel / kernel.sum(), "valid")


def chosen_paths(blocks: list[Block]) -> tuple[set[int], set[int]]:
    """The paths whose fused ratios reach the threshold, and those that are mostly link text, which none of them is."""
    length, points, linked, count = (defaultdict(float) for _ in range(4))
    for b in blocks:
        length[b.node.path] += len(b.text)
        points[b.node.path] += len(_POINTS.findall(b.text))
        linked[b.node.path] += min(len(b.text), b.linked)
        count[b.node.path] += 1
    # Ratios by path: text and punctuation for each block, less what is link text.
    text = np.array([(length[b.node.path] - linked[b.node.path]) / count[b.node.path] for b in blocks])
    point = np.array([points[b.node.path] / count[b.node.path] for b in blocks])
    fused = _smoothed(text) * (1 + np.log1p(_smoothed(point)))
    score: dict[int, float] = defaultdict(float)
    for b, f in zip(blocks, fused.tolist()):
        score[b.node.path] += f / count[b.node.path]
    threshold = float(fused.std()) * 0.5
    links = {p for p in length if linked[p] >= 0.7 * length[p]}
    return {p for p, f in score.items() if f >= threshold and p not in links}, links


def content(blocks: list[Block], nodes: list[Node]) -> list[Block]:
    """The blocks of the article, chosen by their paths."""
    blocks = _unmarked(blocks, nodes)
    if not blocks:
        return []
    paths, links = chosen_paths(blocks)
    chosen = [b.node.path in paths for b in blocks]
    if not any(chosen):  # nothing but links
        return [b for b in blocks if b.node.root] or blocks
    most = sum(b.own for b, c in zip(blocks, chosen) if c)
    roots = {id(b.node.root) for b, c in zip(blocks, chosen) if c and b.node.root}
    if roots and 2 * sum(b.own for b, c in zip(blocks, chosen) if c and b.node.root) >= most:
        return [b for b in blocks if b.node.root and id(b.node.root) in roots]
    # Text and chosen text below each element; the deepest element with all of the chosen text bounds the article.
    held, good = Counter(), Counter()
    for b, c in zip(blocks, chosen):
        held[id(b.node)] += len(b.text)
        good[id(b.node)] += len(b.text) * c
    for n in reversed(nodes[1:]):
        held[id(n.parent)] += held[id(n)]
        good[id(n.parent)] += good[id(n)]
    every, bound = good[id(nodes[0])], nodes[0]
    for n in nodes[1:]:
        if n.parent is bound and good[id(n)] == every:
            bound = n
    within, dense = {id(bound)}, set()
    for n in nodes:
        if n.parent and id(n.parent) in within:
            within.add(id(n))
        if id(n.parent) in dense or id(n) in within and n.tag not in ("", "html", "body") and 2 * good[id(n)] >= held[id(n)] > 0:
            dense.add(id(n))
    # Loose in the body: paths that are mostly text of their own.
    loose = lambda b: b.node.tag in ("", "html", "body") and b.node.path not in links
    return [b for b, c in zip(blocks, chosen) if c or id(b.node) in dense or loose(b)]


def main_text(page: str | None) -> str:
    return " ".join(b.text for b in content(*blocks_of(page or "")))


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The kept columns, text and n_chars of every page.

    Null and empty pages, and pages without text, have an empty text. A page that is plain text is its
    own article. Repeated rows repeat; an empty table gives an empty result.
    """

    @F.pandas_udf("string")
    def text(page: pd.Series) -> pd.Series:
        return pd.Series([main_text(p) for p in page.tolist()], dtype=object)

    rows = pages.select(*keep, text(F.col(html_col).cast("string")).alias("text"))
    return rows.withColumn("n_chars", F.length("text").cast("long"))
