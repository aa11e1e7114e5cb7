"""Main text of HTML pages by minimum-cut labelling.

A page becomes blocks of text. A classifier gives each block the cost of calling it boilerplate and the cost of calling
it content; these are the capacities of its edges from the source and to the sink. Blocks that follow each other, and
blocks that stand close in the document tree, are joined by smoothness edges. The minimum cut is the labelling of least
total cost; blocks on the source's side are the main text.

The classifier is a log-linear score of two parts. One says what the block stands in: landmark elements, words of class, id
and role; its rules are stated below. The other says what the block is like: length, density of links, end of sentence, kind
of element. Its weights are trained without labelled pages: blocks in the landmarks of an article and of what is none are
examples for all blocks, and `train` fits a logistic model to them that stays near START where they teach nothing. It reads a
bounded sample: PAGES pages of smallest hash, and at most SAMPLE_CHARS characters (pages are taken whole). Elements that are
never text (script, style, forms and the like) make no blocks.

Null html counts as empty; a page without main text gives an empty text. Repeated rows are each extracted on their own;
an empty table gives an empty result; columns other than id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed values of HTML. Elements whose content is text up to their end tag:
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "plaintext"}
# Elements whose content is never main text:
SKIPPED = RAW | {"head", "noscript", "template", "svg", "math", "canvas", "object", "form", "button", "select", "input", "datalist", "dialog", "audio", "video"}
HIDING = SKIPPED - {"form"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3",
    "h4", "h5", "h6", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
# An element of the first kind that begins ends an open one of the second kind, within the scope of the third.
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
SCOPE = {"html", "body", "table", "td", "th", "caption", "button", "object", "template"}

# A quote opens a value only behind an equals sign; elsewhere it is a letter of a name, and so is one that nothing closes.
_ATTRIBUTES = r"""(?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+)?+)?+)*+"""
TOKEN = re.compile(rf"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)({_ATTRIBUTES})(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s>"'][^\s>]*+))?+)?+""")
SPACE = re.compile(r"\s+")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# The classifier's rules: score of a block in an element of the kind, added over its ancestors (content above 0).
LANDMARK = {"nav": -8.0, "header": -5.0, "footer": -8.0, "aside": -8.0, "menu": -6.0, "search": -8.0, "address": -3.0, "article": 4.0, "main": 3.0, "figcaption": 0.5, "blockquote": 0.5, "pre": 1.0}
ROLES = {"navigation": -8.0, "banner": -6.0, "contentinfo": -8.0, "complementary": -8.0, "search": -8.0, "form": -8.0, "dialog": -8.0, "alertdialog": -8.0, "alert": -6.0, "menu": -8.0, "menubar": -8.0, "toolbar": -8.0, "note": -1.0, "main": 3.0, "article": 4.0}
# Words of names, by what they speak of. Those of a header say nothing about a heading or within an article.
HEADER_NAMES = {"header", "masthead", "banner"}
COMMENT_NAMES = {"comment", "comments", "discussion", "disqus", "replies", "reply", "respond"}
BAD_NAMES = HEADER_NAMES | COMMENT_NAMES | {
    "ad", "ads", "advert", "advertisement", "adverts", "advertising", "breadcrumb", "breadcrumbs", "consent", "cookie", "cookies", "copyright", "footer", "gdpr",
    "login", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pager", "pagination", "popup", "promo", "promoted", "recommended", "related", "search",
    "share", "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "tags", "toolbar",
}
GOOD_NAMES = {"article", "content", "entry", "main", "post", "story", "text", "body"}
BAD_NAME, GOOD_NAME, HIDDEN = -8.0, 1.5, -12.0
#: An element with such a score or less is no part of the article around it.
FOREIGN = -3.0
# What a block is like: one, tens of words up to MOST_TENS, end of sentence, share of links outside and inside an article (where
# lists of links belong to it), heading, item or cell; and the weights that training starts from and is drawn to.
START = (-0.5, 0.5, 0.75, -4.0, -1.0, 0.0, 0.0)
MOST_TENS = 4.0
ITEMS = {"li", "dt", "dd", "td", "th", "caption", "figcaption", "summary", "legend"}
#: Scores of places from which on a block is an example of content, and of none; bounds of the sample; pull to START; steps of Newton.
CONTENT_PLACE, OTHER_PLACE, PAGES, SAMPLE_CHARS, PULL, STEPS = 3.0, -5.0, 2000, 32_000_000, 0.005, 25
# Smoothness: between neighbours, and by steps through the tree to the next block; nothing beyond FAR steps.
NEIGHBOUR, PROXIMITY, FAR = 0.25, 1.0, 6


class _Element:
    """An element of the tree. whole: a heading, main part or article of the page stands in it."""

    __slots__ = ("tag", "attributes", "parent", "whole", "score", "own", "article")

    def __init__(self, tag: str, attributes: str, parent: _Element | None):
        self.tag, self.attributes, self.parent, self.whole = tag, attributes, parent, False
        self.score: float | None = None
        self.own: float | None = None
        self.article = False


class _Block:
    __slots__ = ("parts", "linked", "element")

    def __init__(self, element: _Element):
        self.parts: list[str] = []
        self.linked, self.element = 0, element


def _names(found: dict[str, str]) -> set[str]:
    return {x.lower() for key in ("class", "id", "aria-label", "data-role") for x in NAME_PART.findall(found.get(key, ""))}


def _attributes(source: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(source)} if source.strip() else {}


def _own_score(e: _Element, in_article: bool) -> float | None:
    """What an element adds to the score of the blocks in it; None if nothing in it is text."""
    if e.tag in SKIPPED and not (e.tag == "form" and e.whole):  # a form around the whole page is no form
        return None
    score = 0.0 if e.tag == "header" and in_article else LANDMARK.get(e.tag, 0.0)
    found = _attributes(e.attributes)
    if found:
        score += sum(ROLES.get(r, 0.0) for r in found.get("role", "").lower().split()[:1])
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I):
            score += HIDDEN
        if e.tag not in ("body", "html", "main"):
            names = _names(found)
            bad = names & BAD_NAMES
            if in_article or e.tag in HEADINGS or e.tag == "article":
                bad -= HEADER_NAMES
            if e.whole and not bad & HEADER_NAMES:  # what holds the page's own heading or article is a frame around it
                bad = set()
            score += BAD_NAME if bad else GOOD_NAME if names & GOOD_NAMES and e.tag != "article" else 0.0
    return score


def _score(elements: list[_Element]) -> None:
    """Scores of all elements; parents stand before their children."""
    for e in elements:
        above, in_article = (e.parent.score, e.parent.article) if e.parent else (0.0, False)
        if above is None:
            continue
        e.own = _own_score(e, in_article)
        if e.own is None:
            continue
        if e.own <= FOREIGN:
            above = min(above, 0.0)  # what stands in an article need not belong to it
        e.score = above + e.own
        e.article = e.score > 0 and (in_article or e.tag in ("article", "main"))


def parsed(html: str) -> tuple[list[_Element], list[_Block]]:
    """The elements, parents first, and the blocks of text in page order."""
    elements: list[_Element] = []
    stack: list[_Element] = []
    opened: Counter[str] = Counter()
    out: list[_Block] = []
    block: _Block | None = None
    at = articles = hidden = 0

    def text(data: str) -> None:
        nonlocal block
        if not data or hidden:
            return
        if block is None:
            if not data.strip():
                return
            block = _Block(stack[-1] if stack else root)
            out.append(block)
        data = entities.unescape(data)
        block.parts.append(data)
        if opened["a"]:
            block.linked += len(data)

    def close(k: int) -> None:
        nonlocal block, hidden
        for e in stack[k:]:
            opened[e.tag] -= 1
            hidden -= e.tag in HIDING
            if e.tag in BLOCKS:
                block = None
        del stack[k:]

    def close_in(tags: set[str], scope: set[str]) -> None:
        if not any(opened[t] for t in tags):
            return
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].tag in tags:
                return close(k)
            if stack[k].tag in scope:
                return

    def holds_the_page(e: _Element | None) -> None:
        while e is not None and not e.whole:
            e.whole, e = True, e.parent

    root = _Element("", "", None)
    elements.append(root)
    while at < len(html):
        begin = html.find("<", at)
        if begin < 0:
            text(html[at:])
            break
        m = TOKEN.match(html, begin)
        if m is None:  # a lone <
            text(html[at : begin + 1])
            at = begin + 1
            continue
        text(html[at:begin])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "p" and not opened["p"]:
                block = None
            elif tag == "br":
                text(" ")
            else:
                close_in({tag} if tag not in HEADINGS else HEADINGS, SCOPE - {tag} if tag in BLOCKS else SCOPE | BLOCKS)
        elif m[2]:
            tag = m[2].lower()
            if tag in BLOCKS:
                close_in({"p"}, SCOPE)
                block = None
                if tag in HEADINGS and stack and stack[-1].tag in HEADINGS:
                    close(len(stack) - 1)
            if tag in CLOSES:
                close_in(*CLOSES[tag])
            if tag == "a":
                close_in({"a"}, SCOPE)
            if tag in VOID:
                if tag in ("br", "hr", "img", "wbr"):
                    text("" if tag == "wbr" else " ")
                continue
            if tag == "body":
                close_in({"head"}, set())
            e = _Element(tag, m[3] or "", stack[-1] if stack else root)
            elements.append(e)
            stack.append(e)
            opened[tag] += 1
            hidden += tag in HIDING
            if tag == "article":
                articles += 1
            if tag in ("main", "h1") or tag == "article" and articles == 1 and not any(_names(_attributes(x.attributes)) & COMMENT_NAMES for x in stack):
                holds_the_page(e.parent)
            if tag in RAW and not (m[3] or "").endswith("/"):
                end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(html, at)
                at = end.start() if end else len(html)
    return elements, out


def described(html: str) -> list[tuple[str, tuple[float, ...], _Element]]:
    """Text, what it is like, and element of each block that has text, in page order."""
    elements, out = parsed(html)
    _score(elements)
    found = []
    for b in out:
        joined = SPACE.sub(" ", "".join(b.parts)).strip()
        if not joined or b.element.score is None:
            continue
        links = min(1.0, b.linked / max(1, len("".join(b.parts).strip())))
        e = b.element
        while e.tag not in BLOCKS and e.parent is not None:
            e = e.parent
        like = (1.0, min((joined.count(" ") + 1) / 10, MOST_TENS), float(joined[-1] in ".!?…。！？»”\""), 0.0 if b.element.article else links, links if b.element.article else 0.0, float(e.tag in HEADINGS), float(e.tag in ITEMS))
        found.append((joined, like, b.element))
    return found


def blocks_of(html: str, weights: tuple[float, ...] = START) -> list[tuple[str, float, _Element]]:
    """Text, score and element of each block that has text, in page order."""
    return [(text, e.score + sum(w * x for w, x in zip(weights, like)), e) for text, like, e in described(html)]


def fit(htmls: Iterable[str]) -> tuple[float, ...]:
    """Weights of what blocks are like, from blocks whose place says what they are; START without such blocks of both kinds."""
    rows, content = [], []
    for html in htmls:
        for _, like, e in described(html):
            if e.score >= CONTENT_PLACE or e.score <= OTHER_PLACE:
                rows.append(like)
                content.append(e.score > 0)
    x, y = np.array(rows, float).reshape(-1, len(START)), np.array(content, bool)
    if y.all() or not y.any():
        return START
    share = np.where(y, 0.5 / y.sum(), 0.5 / (~y).sum())  # either kind counts for half
    start = np.array(START)
    w = start.copy()
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (share * (p - y)) + PULL * (w - start)
        curve = (x * (share * p * (1 - p))[:, None]).T @ x + PULL * np.eye(len(start))
        w = w - np.linalg.solve(curve, slope)
    return tuple(w.tolist())


def train(pages: DataFrame, id_col: str = "page_id", html_col: str = "html") -> tuple[float, ...]:
    """Weights fitted to a bounded sample of the pages."""
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = pages.select(html.alias("html"), F.xxhash64(F.col(id_col), html).alias("h"))
    # Of many pages only those below some hash are put in order, about four times as many as are wanted, so that what meets in one
    # task does not grow with the pages.
    total = pages.count()
    low = rows.where(F.col("h") < int(4 * PAGES / total * 2**64) - 2**63) if total > 8 * PAGES else rows
    sample, chars = [], 0
    for r in low.orderBy("h", "html").limit(PAGES).toLocalIterator():
        if (chars := chars + len(r.html)) > SAMPLE_CHARS and sample:
            break
        sample.append(r.html)
    return fit(sample)


def minimum_cut(gains: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels of least cost: max(gain, 0) for a False, max(-gain, 0) for a True, an edge's weight for ends that differ.

    Shortest augmenting paths in level graphs, from the source through nodes of gain to the sink.
    """
    n = len(gains)
    source, sink = n, n + 1
    head: list[list[int]] = [[] for _ in range(n + 2)]
    to: list[int] = []
    room: list[float] = []

    def join(a: int, b: int, there: float, back: float) -> None:
        head[a].append(len(to))
        to.append(b)
        room.append(there)
        head[b].append(len(to))
        to.append(a)
        room.append(back)

    for i, g in enumerate(gains):
        if g > 0:
            join(source, i, g, 0.0)
        elif g < 0:
            join(i, sink, -g, 0.0)
    for a, b, w in edges:
        join(a, b, w, w)
    least = 1e-9
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            u = queue.popleft()
            for e in head[u]:
                if room[e] > least and level[to[e]] < 0:
                    level[to[e]] = level[u] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        begun = [0] * (n + 2)
        path: list[int] = []
        u = source
        while True:
            if u == sink:
                least_room = min(room[e] for e in path)
                for k, e in enumerate(path):
                    room[e] -= least_room
                    room[e ^ 1] += least_room
                back = next(k for k, e in enumerate(path) if room[e] <= least)
                u = to[path[back] ^ 1]
                del path[back:]
                continue
            while begun[u] < len(head[u]):
                e = head[u][begun[u]]
                if room[e] > least and level[to[e]] == level[u] + 1:
                    break
                begun[u] += 1
            if begun[u] < len(head[u]):
                path.append(head[u][begun[u]])
                u = to[path[-1]]
            elif path:
                u = to[path.pop() ^ 1]
                begun[u] += 1
            else:
                break


def graph_of(blocks: list[tuple[str, float, _Element]]) -> tuple[list[float], list[tuple[int, int, float]]]:
    """Gains of the blocks, and edges: to the block before, and to the last one that stands near in the tree."""
    edges = []
    last_in: dict[int, tuple[int, int]] = {}  # by element, the last block in it and its steps up to there
    for i, (_, _, element) in enumerate(blocks):
        ancestors, e = [], element
        while e is not None and len(ancestors) <= FAR:
            if e.tag in BLOCKS or e.parent is None:
                ancestors.append(e)
            e = e.parent
        near = None
        for up, e in enumerate(ancestors):
            if (met := last_in.get(id(e))) is not None:
                near = (met[0], up + met[1])
                break
        weights = {i - 1: NEIGHBOUR} if i else {}
        if near and near[1] <= FAR:
            weights[near[0]] = weights.get(near[0], 0.0) + PROXIMITY / (1 + near[1])
        edges += [(j, i, w) for j, w in weights.items()]
        for up, e in enumerate(ancestors):
            last_in[id(e)] = (i, up)
    return [score for _, score, _ in blocks], edges


def main_text(html: str | None, weights: tuple[float, ...] = START) -> str:
    blocks = blocks_of(html or "", weights)
    if not blocks:
        return ""
    content = minimum_cut(*graph_of(blocks))
    return "\n\n".join(text for (text, _, _), kept in zip(blocks, content, strict=True) if kept)


def extract_pages(pages: DataFrame, weights: tuple[float, ...] = START, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""

    def extract(batches):
        for batch in batches:
            texts = [main_text(x.as_py(), weights) for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    return rows.mapInArrow(extract, "page_id long, url string, text string, n_chars long")
