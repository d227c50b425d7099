"""Main text of HTML pages: flat text blocks classified by a decision tree.

A page is cut at block-level tags into flat blocks of text. The features of a block are its words, its link density
(share of its words inside ``a``), those of its two neighbours, and three weak ones of its surroundings: whether it is
inside an element that is page furniture by its tag (``nav``, ``footer``, ``form``, ...); what the nearest element with
a telling class, id or role says, furniture or article; and whether it is inside an article at all. A name is a hint
only: names like ``has-sidebar`` tell nothing, and an article inside a wrapper that is named like furniture is an
article again. A decision tree (CART, Gini impurity), trained on the small labelled table ``LABELLED`` when the
operator starts, keeps or drops each block; the table holds blocks whose names mislead.

Scale: each page is processed on its own, nothing is shuffled; time is linear in the page's length.

Defined cases: null or empty html: empty text. Unclosed comments, scripts and styles reach to the end of the page;
unclosed elements end with their parent. Repeated rows and extra columns pass through.
"""

from __future__ import annotations

import html as _html
import re
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import add_columns, read

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "furniture_tag", "furniture_name", "article")
#: words, link density, the same of the block before and after, in furniture by tag and by name, in article; 1: main text.
LABELLED: list[tuple] = [
    (1, 1.0, 0, 0.0, 1, 1.0, 1, 0, 0, 0), (1, 1.0, 0, 0.0, 1, 1.0, 0, 1, 0, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 0, 0),
    (1, 1.0, 1, 1.0, 1, 1.0, 0, 1, 0, 0), (1, 1.0, 1, 1.0, 8, 0.0, 1, 0, 0, 0), (1, 1.0, 1, 1.0, 8, 0.0, 0, 1, 0, 0),
    (2, 1.0, 2, 1.0, 3, 1.0, 1, 0, 0, 0), (2, 1.0, 2, 1.0, 3, 1.0, 0, 1, 0, 0), (8, 0.0, 1, 1.0, 9, 0.0, 1, 0, 0, 0),
    (8, 0.0, 1, 1.0, 9, 0.0, 0, 1, 0, 0), (9, 0.0, 1, 1.0, 40, 0.0, 1, 0, 0, 0),
    (9, 0.0, 1, 1.0, 40, 0.0, 0, 1, 0, 0), (30, 0.0, 8, 0.0, 60, 0.0, 1, 0, 0, 0),
    (30, 0.0, 8, 0.0, 60, 0.0, 0, 1, 0, 0), (60, 0.0, 30, 0.0, 80, 0.0, 1, 0, 0, 0),
    (60, 0.0, 30, 0.0, 80, 0.0, 0, 1, 0, 0), (12, 0.3, 90, 0.0, 0, 0.0, 1, 0, 0, 0),
    (12, 0.3, 90, 0.0, 0, 0.0, 0, 1, 0, 0), (7, 0.0, 70, 0.0, 0, 0.0, 1, 0, 0, 0),
    (7, 0.0, 70, 0.0, 0, 0.0, 0, 1, 0, 0), (25, 0.1, 50, 0.0, 3, 1.0, 1, 0, 0, 0),
    (25, 0.1, 50, 0.0, 3, 1.0, 0, 1, 0, 0), (14, 0.0, 60, 0.0, 20, 0.0, 1, 0, 1, 0),
    (14, 0.0, 60, 0.0, 20, 0.0, 0, 1, 1, 0), (45, 0.0, 60, 0.0, 45, 0.0, 1, 0, 1, 0),
    (45, 0.0, 60, 0.0, 45, 0.0, 0, 1, 1, 0), (3, 1.0, 40, 0.0, 3, 1.0, 1, 0, 1, 0),
    (3, 1.0, 40, 0.0, 3, 1.0, 0, 1, 1, 0), (9, 0.0, 9, 0.0, 9, 0.0, 1, 0, 1, 0), (9, 0.0, 9, 0.0, 9, 0.0, 0, 1, 1, 0),
    (120, 0.0, 8, 0.0, 90, 0.0, 0, 1, 0, 0), (5, 0.0, 0, 0.0, 5, 0.0, 1, 0, 0, 0),
    (5, 0.0, 0, 0.0, 5, 0.0, 0, 1, 0, 0), (2, 0.0, 30, 0.0, 30, 0.0, 1, 0, 1, 0),
    (2, 0.0, 30, 0.0, 30, 0.0, 0, 1, 1, 0), (9, 0.0, 8, 0.0, 9, 0.0, 0, 0, 1, 1),
    (40, 0.0, 9, 0.0, 50, 0.0, 0, 0, 1, 1), (1, 0.0, 90, 0.0, 1, 0.0, 0, 0, 1, 1),
    (1, 0.0, 1, 0.0, 60, 0.0, 0, 0, 1, 1), (2, 0.0, 2, 0.0, 2, 0.0, 0, 0, 1, 1),
    (70, 0.05, 40, 0.0, 7, 0.0, 0, 0, 1, 1), (25, 0.2, 60, 0.0, 50, 0.0, 0, 0, 1, 1),
    (12, 0.4, 60, 0.0, 50, 0.0, 0, 0, 1, 1), (200, 0.0, 30, 0.0, 10, 0.1, 0, 0, 1, 1),
    (4, 0.0, 80, 0.0, 30, 0.0, 0, 0, 1, 1), (1, 0.0, 0, 0.0, 0, 0.0, 0, 0, 1, 1),
    (16, 0.0, 0, 0.0, 7, 0.0, 0, 0, 1, 1), (3, 1.0, 40, 0.0, 3, 1.0, 0, 0, 1, 0),
    (4, 1.0, 3, 1.0, 4, 1.0, 0, 0, 1, 0), (2, 1.0, 60, 0.0, 9, 0.2, 0, 0, 1, 0),
    (6, 0.9, 3, 1.0, 20, 0.0, 0, 0, 1, 0), (8, 1.0, 8, 1.0, 8, 1.0, 0, 0, 1, 0), (5, 1.0, 5, 1.0, 0, 0.0, 0, 0, 1, 0),
    (3, 0.0, 8, 0.0, 2, 0.0, 0, 0, 1, 1), (5, 0.0, 7, 0.0, 5, 0.0, 0, 0, 1, 1), (2, 0.0, 6, 0.0, 1, 0.0, 0, 0, 1, 1),
    (7, 0.0, 1, 1.0, 4, 0.0, 0, 0, 1, 1), (6, 0.0, 4, 0.5, 0, 0.0, 0, 0, 1, 1), (1, 0.0, 3, 0.0, 6, 1.0, 0, 0, 1, 1),
    (3, 0.0, 5, 0.0, 3, 1.0, 0, 0, 1, 1), (2, 0.0, 2, 1.0, 2, 1.0, 0, 0, 1, 1), (4, 0.0, 1, 1.0, 2, 0.0, 0, 0, 1, 1),
    (5, 0.2, 3, 0.0, 1, 0.0, 0, 0, 1, 1), (4, 0.25, 2, 0.0, 6, 0.0, 0, 0, 1, 1), (6, 0.5, 5, 0.0, 3, 0.0, 0, 0, 1, 1),
    (3, 0.33, 4, 1.0, 5, 0.5, 0, 0, 1, 1), (1, 0.0, 0, 0.0, 4, 0.0, 0, 0, 1, 1), (5, 0.0, 9, 0.3, 0, 0.0, 0, 0, 1, 1),
    (40, 0.0, 30, 0.0, 50, 0.0, 0, 0, 0, 1), (60, 0.1, 5, 0.0, 70, 0.0, 0, 0, 0, 1),
    (25, 0.0, 40, 0.0, 30, 0.0, 0, 0, 0, 1), (6, 0.0, 50, 0.0, 60, 0.0, 0, 0, 0, 1),
    (8, 0.0, 6, 0.5, 70, 0.0, 0, 0, 0, 1), (18, 0.1, 60, 0.0, 20, 0.0, 0, 0, 0, 1),
    (90, 0.02, 2, 1.0, 100, 0.0, 0, 0, 0, 1), (20, 0.0, 45, 0.0, 4, 1.0, 0, 0, 0, 1),
    (35, 0.0, 9, 0.0, 8, 0.0, 0, 0, 0, 1), (5, 0.0, 35, 0.0, 5, 0.0, 0, 0, 0, 1),
    (3, 0.0, 45, 0.0, 40, 0.0, 0, 0, 0, 1), (150, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 1),
    (2, 1.0, 0, 0.0, 2, 1.0, 0, 0, 0, 0), (3, 1.0, 3, 1.0, 3, 1.0, 0, 0, 0, 0), (1, 1.0, 1, 1.0, 40, 0.0, 0, 0, 0, 0),
    (9, 0.7, 4, 1.0, 12, 0.6, 0, 0, 0, 0), (20, 0.8, 3, 1.0, 30, 0.7, 0, 0, 0, 0),
    (4, 0.0, 3, 1.0, 2, 1.0, 0, 0, 0, 0), (3, 0.0, 2, 0.0, 2, 0.0, 0, 0, 0, 0), (5, 0.0, 0, 0.0, 3, 1.0, 0, 0, 0, 0),
    (6, 0.0, 4, 0.5, 0, 0.0, 0, 0, 0, 0), (2, 0.0, 4, 1.0, 4, 0.0, 0, 0, 0, 0), (7, 0.3, 5, 1.0, 6, 0.4, 0, 0, 0, 0),
    (4, 0.0, 5, 0.0, 0, 0.0, 0, 0, 0, 0), (140, 0.0, 120, 0.0, 160, 0.0, 0, 1, 0, 1),
    (180, 0.02, 90, 0.0, 130, 0.0, 0, 1, 0, 1), (95, 0.0, 110, 0.0, 150, 0.0, 0, 1, 0, 1),
    (220, 0.01, 60, 0.0, 75, 0.0, 0, 1, 0, 1), (160, 0.0, 140, 0.0, 0, 0.0, 0, 1, 0, 1),
    (130, 0.0, 0, 0.0, 170, 0.0, 0, 1, 0, 1), (60, 0.0, 30, 0.0, 35, 0.0, 0, 1, 0, 0),
    (75, 0.0, 20, 0.0, 25, 0.0, 0, 1, 0, 0), (90, 0.0, 12, 0.0, 18, 0.0, 0, 1, 0, 0),
    (110, 0.0, 8, 0.0, 9, 0.0, 0, 1, 0, 0), (50, 0.0, 45, 0.0, 55, 0.0, 0, 1, 0, 0),
    (150, 0.9, 120, 0.8, 90, 0.9, 0, 1, 0, 0), (130, 0.0, 120, 0.0, 140, 0.0, 0, 1, 1, 0),
    (140, 0.0, 120, 0.0, 160, 0.0, 1, 0, 0, 0), (120, 0.0, 8, 0.0, 90, 0.0, 1, 0, 0, 0),
    (30, 0.95, 28, 0.9, 31, 1.0, 0, 0, 1, 0), (12, 0.9, 10, 1.0, 14, 0.8, 0, 0, 0, 0),
    (22, 0.9, 60, 0.0, 20, 0.9, 0, 0, 1, 0),
    (10, 0.0, 200, 0.0, 12, 0.0, 0, 1, 0, 0), (10, 0.0, 200, 0.0, 12, 0.0, 0, 1, 1, 0),
    (40, 0.0, 150, 0.0, 30, 0.0, 0, 1, 0, 0), (60, 0.0, 300, 0.0, 0, 0.0, 0, 1, 0, 0),
    (5, 0.0, 400, 0.0, 120, 0.0, 0, 1, 0, 0), (90, 0.0, 250, 0.0, 20, 0.0, 0, 1, 0, 0),
    (85, 0.0, 180, 0.0, 150, 0.0, 0, 1, 1, 0), (20, 0.0, 110, 0.0, 200, 0.0, 0, 1, 0, 0),
    (88, 0.0, 130, 0.0, 140, 0.0, 0, 1, 0, 0), (9, 0.0, 0, 0.0, 300, 0.0, 0, 1, 0, 0),
    (150, 0.0, 10, 0.0, 8, 0.0, 0, 1, 0, 0), (200, 0.0, 30, 0.0, 20, 0.0, 0, 1, 0, 0),
]

_SKIP = ("script", "style", "noscript", "template", "title", "iframe", "object", "svg", "math", "textarea", "select", "button", "option", "head", "canvas", "audio", "video", "datalist")
_RAW = {"script", "style", "title", "textarea", "iframe", "noscript"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
_FURNITURE_TAGS = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "search"}
_ARTICLE_TAGS = {"article", "main"}
_FURNITURE = set("ad ads adv advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices alert disclaimer legal copyright nav navbar navigation menu menus breadcrumb breadcrumbs header masthead footer sidebar aside rail widget widgets comment comments respond reply replies disqus share sharing social related recommended newsletter subscribe signup login search pagination pager popup modal overlay toolbar tags meta byline".split())
_ARTICLE = set("article content post story entry main body text maincontent".split())
_TAG = re.compile(r"<!--(?:.*?-->|.*\Z)|<!\[CDATA\[.*?\]\]>|<[!?][^>]*+>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*+\"|'[^']*+')*+)>", re.S)
_ATTR = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAMES = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


#: What these come before does not say what an element is, but what it has (``has-sidebar``, ``no-header``).
_ABOUT = {"has", "have", "with", "without", "no", "not", "show", "hide", "hidden", "is"}


def _named(attrs: str) -> tuple[bool, bool]:
    """Whether the class, id or role names furniture, or else an article."""
    furniture = article = False
    for m in _ATTR.finditer(attrs):
        for one in (m[2] or m[3] or m[4] or "").split():
            names = [x.lower() for x in _NAMES.findall(one)]
            if names and names[0] not in _ABOUT:
                furniture |= not _FURNITURE.isdisjoint(names)
                article |= not _ARTICLE.isdisjoint(names)
    return furniture, article and not furniture


Block = tuple[str, int, int, int, int, int]


def blocks(page: str | None) -> list[Block]:
    """(text, words, words in links, in furniture by tag, by the nearest name, in article) of each non-empty flat block,
    in page order."""
    if not page:
        return []
    out: list[Block] = []
    parts: list[tuple[str, bool]] = []
    # Name, whether furniture by tag, whether article, and what the nearest name said outside of the element.
    stack: list[tuple[str, bool, bool, bool]] = []
    furniture = article = links = skipped = breaks = 0
    named = False

    def close() -> None:
        nonlocal breaks
        breaks = 0
        if parts:
            text = " ".join("".join(x for x, _ in parts).split())
            if text:
                out.append((text, len(text.split()), sum(len(x.split()) for x, in_a in parts if in_a), int(furniture > 0), int(named), int(article > 0)))
            parts.clear()

    def pop() -> None:
        nonlocal furniture, article, links, skipped, named
        name, f, a, named = stack.pop()
        furniture -= f
        article -= a
        links -= name == "a"
        skipped -= name in _SKIP

    def leave(name: str, stop: set[str] | frozenset[str] = frozenset()) -> None:
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] == name:
                while len(stack) > i:
                    pop()
                return
            if stack[i][0] in stop:
                return

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        end = m.start() if m else n
        if end > at and not skipped:
            text = _html.unescape(page[at:end])
            if breaks > 1 and text.strip():
                close()
            if text.strip():
                breaks = 0
            parts.append((text, links > 0))
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name in _BLOCK:
                close()
            leave(name, _BLOCK - {"p", name} if name not in _BLOCK else frozenset())
            continue
        if name == "br":
            parts.append((" ", False))
            breaks += 1
            continue
        if name in _BLOCK:
            close()
            if name == "li":
                leave("li", {"ul", "ol", "menu", "dir"})
            elif name in ("dd", "dt"):
                leave("dd", {"dl"})
                leave("dt", {"dl"})
            elif name in ("td", "th", "tr"):
                leave("td", {"tr", "table"})
                leave("th", {"tr", "table"})
            leave("p", _BLOCK - {"p"})
        # A slash before the end means nothing in HTML but for drawings, of which no text is taken anyway.
        if name in _VOID or (skipped and m[3].endswith("/")):
            continue
        says_f, says_a = _named(m[3]) if m[3] else (False, False)
        f, a = name in _FURNITURE_TAGS, says_a or name in _ARTICLE_TAGS
        if name in ("body", "html"):
            f = a = says_f = False
        if name == "body":
            leave("head")
        stack.append((name, f, a, named))
        named = (named or says_f) and not (a and not says_f)
        furniture += f
        article += a
        links += name == "a"
        skipped += name in _SKIP
        if name in _RAW:
            stop = re.compile(rf"</{name}\b[^>]*>", re.I).search(page, at)
            at = stop.start() if stop else n
    close()
    return out


class Tree:
    """A binary decision tree: grown by Gini impurity until leaves are pure or ``depth`` is reached."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 1):
        self.nodes: list[tuple[int, float, int, int, int]] = []  # feature, threshold, left, right, label
        self._grow(x, y, depth, least)

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, least: int) -> int:
        me = len(self.nodes)
        self.nodes.append((-1, 0.0, 0, 0, int(2 * y.sum() >= len(y))))
        gini = lambda y: len(y) * (p := y.mean()) * (1 - p)
        best = (gini(y) - 1e-9, -1, 0.0)
        if depth:
            for f in range(x.shape[1]):
                vals = np.unique(x[:, f])
                for t in (vals[1:] + vals[:-1]) / 2:
                    left = x[:, f] <= t
                    if min(left.sum(), (~left).sum()) >= least:
                        best = min(best, (gini(y[left]) + gini(y[~left]), f, float(t)))
        _, f, t = best
        if f >= 0:
            left = x[:, f] <= t
            a = self._grow(x[left], y[left], depth - 1, least)
            b = self._grow(x[~left], y[~left], depth - 1, least)
            self.nodes[me] = (f, t, a, b, self.nodes[me][4])
        return me

    def predict(self, x: np.ndarray) -> np.ndarray:
        feature, threshold, left, right, label = (np.array(c) for c in zip(*self.nodes))
        at = np.zeros(len(x), int)
        while (inner := feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            k = at[rows]
            at[rows] = np.where(x[rows, feature[k]] <= threshold[k], left[k], right[k])
        return label[at]


def train(table: list[tuple] = LABELLED) -> Tree:
    t = np.array(table, float)
    return Tree(t[:, :-1], t[:, -1].astype(int))


def features(found: list[Block]) -> np.ndarray:
    n = len(found)
    words = np.array([0, *[b[1] for b in found], 0], float)
    links = np.array([0, *[min(1.0, b[2] / max(1, b[1])) for b in found], 0], float)
    ctx = np.array([b[3:] for b in found], float).reshape(n, 3)
    return np.column_stack([words[1:-1], links[1:-1], words[:-2], links[:-2], words[2:], links[2:], ctx])


def extract(pages: DataFrame, html_col: str = "html", out_col: str = "text", labelled: list[tuple] = LABELLED) -> DataFrame:
    """Adds the main text of each page: its kept blocks in page order, joined by one line end."""

    def make() -> Callable:
        tree = train(labelled)

        def fn(pages):
            found = [blocks(p) for p in pages]
            every = [b for bs in found for b in bs]
            keep = tree.predict(np.vstack([features(bs) for bs in found if bs])) if every else []
            out, at = [], 0
            for bs in found:
                out.append("\n".join(b[0] for b, k in zip(bs, keep[at : at + len(bs)]) if k))
                at += len(bs)
            return [out]

        return fn

    return add_columns(pages, [html_col], f"`{out_col}` string", make)


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = extract(read(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return d.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
