"""Main text of web pages: flat text blocks, classified by a decision tree over their own and their neighbours' features."""

from __future__ import annotations

import html
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROWS = 256
#: Elements that do not end a text block.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small "
                   "span strike strong sub sup time tt u var wbr br math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup "
                   "msubsup munder mover munderover mspace mstyle".split())
#: Elements whose content is not text of the page. Those of the first kind hold no markup: without an end tag they go on to
#: the page's end. The others end at their end tag; one without it, or closed in its own tag, holds nothing.
RAW = ("script", "style", "noscript", "title", "textarea", "iframe")
HIDDEN = frozenset(("template", "svg", "object", "select", "button", "canvas", "audio", "video"))
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that open a part of a page, and words in class, id and role that tell what a part is.
CHROME = frozenset("nav footer aside form header dialog menu".split())
MAIN = frozenset("article main".split())
CHROME_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising alert aside banner banners breadcrumb breadcrumbs comment comments "
    "complementary consent contentinfo cookie cookies copyright disclaimer disqus discussion footer form gdpr header login "
    "masthead menu menubar modal nav navbar "
    "navigation newsletter notice notices notification pager pagination popup promo promotion recommended related remark "
    "remarks replies reply responses search share sharing sidebar sidebars signup site-footer site-header skip social sponsor "
    "sponsored sponsors subscribe subscription teaser teasers toolbar topbar widget widgets".split()
)
REMARK_WORDS = frozenset("comment comments disqus discussion remark remarks replies reply responses".split())
MAIN_WORDS = frozenset("article articlebody article-body article-content article-text content content-body entry entry-content "
                       "main maincontent main-content page-content post post-body post-content post-text story story-body".split())
#: Words that tell how a page is laid out, not what a part is.
LAYOUT = ("has-", "with-", "no-", "without-", "is-")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")(?=[\s/>])(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>"
    r"(?:.*?</(?P=raw)(?=[\s/>])[^>]*>|.*)|<(?P<close>/?)(?P<tag>[a-z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*\"|'[^']*')*+>|[^>]*>)"
    r"|<[!?/][^>]*>", re.I | re.S,
)
_END = re.compile(r"</(" + "|".join(sorted(HIDDEN)) + r")(?=[\s/>])[^>]*>", re.I)
_HINT = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
_UNSEEN = re.compile(r"(?i)\s(?:aria-)?hidden(?:\s*=\s*[\"']?(?:true|hidden|)[\"']?)?(?=[\s/>])|display\s*:\s*none")
_PIECES = re.compile(r"[a-z0-9]+(?:-[a-z0-9]+)*")

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "part", "heading")
#: Blocks labelled by hand. Words, share of words in links; the same of the block before and after; part of the page
#: (-1 menus, notices and the like, 0 unknown, 1 article); heading; 1 for main text.
LABELLED = """
1 1 0 0 1 1 -1 0 0
1 1 1 1 1 1 -1 0 0
3 1 1 1 8 0 -1 0 0
8 0 1 1 9 0 -1 0 0
30 0 12 0 25 0 -1 0 0
60 0 80 0 45 0 -1 0 0
12 .1 30 0 0 0 -1 0 0
5 0 40 0 60 0 -1 1 0
45 .05 20 0 33 0 -1 0 0
9 0 8 0 20 0 1 1 1
1 0 8 0 50 0 1 0 1
2 0 70 0 2 0 1 0 1
1 0 1 0 90 0 1 0 1
25 0 9 0 60 0 1 0 1
90 .02 25 0 40 0 1 0 1
40 .3 90 .02 10 0 1 0 1
12 0 40 .1 0 0 1 0 1
14 .6 50 0 70 0 1 0 1
3 1 60 0 55 0 1 0 1
7 1 45 .1 38 0 1 0 1
4 1 3 1 5 1 1 0 0
6 1 5 1 6 1 1 0 0
2 1 2 1 3 1 1 0 0
5 1 40 0 5 1 1 0 0
4 1 5 1 0 0 1 0 0
1 1 0 0 1 1 0 0 0
2 1 2 1 2 1 0 0 0
3 1 3 1 12 0 0 0 0
6 0 2 1 3 1 0 0 0
4 0 0 0 2 1 0 0 0
8 0 1 1 6 0 0 0 0
5 .8 60 0 4 .7 0 0 0
10 .5 4 1 3 1 0 0 0
25 .7 20 .8 30 .9 0 0 0
7 0 30 0 0 0 0 0 0
9 0 6 0 5 .5 0 0 0
7 0 2 1 40 0 0 1 1
9 0 1 1 35 0 0 1 1
4 0 50 0 60 0 0 1 1
3 0 30 .1 28 0 0 0 1
2 0 44 0 52 0 0 0 1
22 0 9 0 40 0 0 0 1
35 0 22 0 50 .1 0 0 1
60 .1 35 0 18 0 0 0 1
18 0 60 0 25 0 0 0 1
28 .1 70 0 3 1 0 0 1
120 0 3 1 2 1 0 0 1
30 0 40 0 0 0 0 0 1
16 0 19 0 0 0 0 0 1
14 0 60 0 0 0 0 0 1
20 0 35 0 2 1 0 0 1
15 0 1 1 20 0 0 0 1
25 0 0 0 0 0 0 0 1
14 0 0 0 25 0 0 0 1
9 0 20 0 0 0 0 0 0
6 0 90 0 0 0 0 0 0
2 0 0 0 0 0 0 0 0
4 0 2 1 0 0 0 0 0
20 .5 2 1 1 1 0 0 0
1 0 1 0 1 0 1 0 1
1 0 1 0 9 0 1 0 1
1 0 1 0 60 0 1 0 1
1 0 7 0 1 0 1 0 1
1 0 7 0 9 0 1 0 1
1 0 7 0 60 0 1 0 1
1 0 50 0 1 0 1 0 1
1 0 50 0 9 0 1 0 1
1 0 50 0 60 0 1 0 1
6 0 1 0 1 0 1 0 1
6 0 1 0 9 0 1 0 1
6 0 1 0 60 0 1 0 1
6 0 7 0 1 0 1 0 1
6 0 7 0 9 0 1 0 1
6 0 7 0 60 0 1 0 1
6 0 50 0 1 0 1 0 1
6 0 50 0 9 0 1 0 1
6 0 50 0 60 0 1 0 1
40 0 1 0 1 0 1 0 1
40 0 1 0 9 0 1 0 1
40 0 1 0 60 0 1 0 1
40 0 7 0 1 0 1 0 1
40 0 7 0 9 0 1 0 1
40 0 7 0 60 0 1 0 1
40 0 50 0 1 0 1 0 1
40 0 50 0 9 0 1 0 1
40 0 50 0 60 0 1 0 1
1 0 1 0 1 0 -1 0 0
1 0 1 0 9 0 -1 0 0
1 0 1 0 60 0 -1 0 0
1 0 7 0 1 0 -1 0 0
1 0 7 0 9 0 -1 0 0
1 0 7 0 60 0 -1 0 0
1 0 50 0 1 0 -1 0 0
1 0 50 0 9 0 -1 0 0
1 0 50 0 60 0 -1 0 0
6 0 1 0 1 0 -1 0 0
6 0 1 0 9 0 -1 0 0
6 0 1 0 60 0 -1 0 0
6 0 7 0 1 0 -1 0 0
6 0 7 0 9 0 -1 0 0
6 0 7 0 60 0 -1 0 0
6 0 50 0 1 0 -1 0 0
6 0 50 0 9 0 -1 0 0
6 0 50 0 60 0 -1 0 0
40 0 1 0 1 0 -1 0 0
40 0 1 0 9 0 -1 0 0
40 0 1 0 60 0 -1 0 0
40 0 7 0 1 0 -1 0 0
40 0 7 0 9 0 -1 0 0
40 0 7 0 60 0 -1 0 0
40 0 50 0 1 0 -1 0 0
40 0 50 0 9 0 -1 0 0
40 0 50 0 60 0 -1 0 0
1 0 0 0 0 0 1 0 1
5 0 0 0 0 0 1 1 1
1 0 4 1 3 1 1 0 1
30 0 1 1 1 1 1 0 1
80 0 2 1 1 1 -1 0 0
6 0 30 0 9 0 -1 1 0
80 0 0 0 0 0 -1 0 0
40 0 0 0 0 0 1 0 1
"""


@dataclass
class Block:
    text: str
    words: int
    links: float
    part: int
    heading: bool


def blocks(page: str, hints: bool = True) -> list[Block]:
    """The text blocks of a page in order; without hints, class, id and role tell nothing about a part. Broken markup is read as far as it goes: an end tag closes the elements within
    its own, one without a start is skipped, and a new article or main part ends an open menu or footer."""
    out: list[Block] = []
    stack: list[tuple[str, int, bool]] = []  # element, part, whether nothing inside changes the part
    parts: list[str] = []
    link_parts: list[str] = []
    links = at = 0
    heading = False

    def end_block() -> None:
        nonlocal parts, link_parts
        if parts:
            words = "".join(parts).split()
            if words:
                linked = len("".join(link_parts).split())
                out.append(Block(" ".join(words), len(words), min(1.0, linked / len(words)), stack[-1][1] if stack else 0, heading))
            parts, link_parts = [], []

    def add(raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if links:
            link_parts.append(text)

    ends: dict[str, list[tuple[int, int]]] = {}  # of hidden elements, by where their end tags begin
    for found in _END.finditer(page):
        ends.setdefault(found[1].lower(), []).append(found.span())

    while found := _TOKEN.search(page, at):
        if found.start() > at:
            add(page[at: found.start()])
        at = found.end()
        tag = found["tag"]
        if tag is None:
            if found["raw"]:
                parts.append(" ")
            continue
        tag = tag.lower()
        if tag in HIDDEN:
            parts.append(" ")
            own = ends.get(tag, ())
            if not found["close"] and not found["rest"].endswith("/>") and (i := bisect_left(own, (at, 0))) < len(own):
                at = own[i][1]
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append(" ")
                link_parts.append(" ")
            elif tag == "a":
                links = 0 if found["close"] else 1
                link_parts.append(" ")
            continue
        end_block()
        if len(tag) == 2 and tag[0] == "h" and tag[1] in "123456":
            heading = not found["close"]
        elif tag in ("p", "li"):
            heading = False
        elif found["close"]:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
        elif tag not in VOID and not found["rest"].endswith("/>"):
            if tag in MAIN:
                while any(s[0] in ("nav", "footer", "menu") for s in stack):
                    stack.pop()
            stack.append((tag, *_part(tag, found["rest"], stack[-1] if stack else ("", 0, False), hints)))
    if at < len(page):
        add(page[at:])
    end_block()
    return out


def _part(tag: str, rest: str, outer: tuple[str, int, bool], hints: bool) -> tuple[int, bool]:
    """The part that an element opens within `outer`, and whether it holds for all that lies inside."""
    _, part, fixed = outer
    if fixed or tag in ("html", "body"):
        return part, fixed
    whole: set[str] = set()
    if hints and "=" in rest:
        names = (m[1] or m[2] or m[3] or "" for m in _HINT.finditer(rest))
        whole = {w for h in names for w in _PIECES.findall(_HUMP.sub("-", h).lower()) if not w.startswith(LAYOUT)}
    pieces = {p for w in whole for p in w.split("-")}
    if pieces & REMARK_WORDS or tag in ("nav", "footer", "aside") or _UNSEEN.search(rest):
        return -1, True
    if tag in MAIN:
        return 1, False
    own_header = part == 1 or bool(pieces & MAIN_WORDS)  # a heading of the article, not of the site
    if tag in CHROME and not (tag == "header" and own_header):
        return -1, False
    if pieces & CHROME_WORDS - ({"header"} if own_header else set()):
        return -1, False
    return (1 if whole & MAIN_WORDS else part), False


def features(own: list[Block]) -> np.ndarray:
    near = [(b.words, b.links) for b in own]
    return np.array([
        (*near[i], *(near[i - 1] if i else (0, 0)), *(near[i + 1] if i + 1 < len(near) else (0, 0)), b.part, b.heading)
        for i, b in enumerate(own)
    ], float).reshape(-1, len(FEATURES))


def grown(x: np.ndarray, y: np.ndarray, depth: int = 7):
    """A decision tree: (feature, bound, tree up to the bound, tree above it) or the share of main text at a leaf.

    Each split is the one of least Gini impurity, the first of equals, halfway between neighbouring values.
    """
    if depth == 0 or len(set(y.tolist())) < 2:
        return float(y.mean())
    best = None
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for bound in ((values[1:] + values[:-1]) / 2).tolist():
            left = x[:, f] <= bound
            impurity = sum(len(p) * p.mean() * (1 - p.mean()) for p in (y[left], y[~left]))
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, bound, left)
    if best is None:
        return float(y.mean())
    _, f, bound, left = best
    return f, bound, grown(x[left], y[left], depth - 1), grown(x[~left], y[~left], depth - 1)


def trained(labelled: str = LABELLED):
    table = np.array([line.split() for line in labelled.strip().splitlines()], float)
    return grown(table[:, :-1], table[:, -1])


def is_main(tree, row: np.ndarray) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree >= 0.5


def main_text(page: str, tree) -> str:
    """The main text of a page. Names may mislead (an article in class "related-work"): where they leave nothing, the page is
    read once more without them."""
    for hints in (True, False):
        own = blocks(page, hints)
        kept = [b.text for b, row in zip(own, features(own), strict=True) if is_main(tree, row)]
        if kept:
            return " ".join(kept)
    return ""


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", page: str = "html", tree=None) -> DataFrame:
    """(key, url, text) of every row: the blocks classified as main text, in order, joined by one space.

    Scripts, styles, comments in the markup and form controls are no text. Character references are decoded, white space
    within a block becomes one space. Null and empty pages, and pages without main text, have the empty text. Whole pages are
    read, one at a time; rows that repeat are extracted each; null keys and urls stay null.
    """
    tree = trained() if tree is None else tree

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), ROWS):
                part = batch.slice(at, ROWS)
                texts = [main_text(h.as_py(), tree) if h.is_valid else "" for h in part.column(2)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(texts, pa.string())], ["key", "url", "text"]
                )

    kinds = [pages.schema[c].dataType.simpleString() for c in (key, url)]
    return pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(page).alias("page")).mapInArrow(
        rows, f"key {kinds[0]}, url {kinds[1]}, text string"
    )
