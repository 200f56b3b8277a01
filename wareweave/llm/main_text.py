"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text, each with its path of block-level tags and class names
from the root. For every path the unlinked text and its punctuation are added up and
divided by the path's blocks. Both series, a value a block, are smoothed along the page
and fused with their own values into a score; paths whose score reaches a share of the
page's mean, weighed by text, are strong. The content is the outermost ``article``, else
``main``, else the deepest element that holds most of the strong blocks' text; of it every
block stays whose path is not mostly links.

What is never content: menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles, hidden elements and reader comments, by tag, role or a word of class or id. Such a
class says nothing on an element around the article, nor, on a page without article
and main, on one that holds most of the page's text. Headings inside an article's header stay.

Pages are independent, so nothing is shuffled; a task holds a few megabytes of pages, or
one longer page. Reading is linear in the page: elements in scope are looked up by tag.

Defined cases: a null or empty page has an empty text; a page of any length is read
whole; unclosed tags end where HTML ends them, a tag, comment or script that never ends
takes the rest of the page; white space of any kind, ``br`` too, becomes one space; a table
row is a block; repeated pages give a row each; an empty table gives an empty result;
input columns named like an output column are replaced, all others pass through.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wareweave.llm.batches import add_columns
from wareweave.llm.common import table

#: Share of the page's mean score, weighed by text, that a strong path reaches.
STRONG = 0.25
#: Weights of a block and its neighbours, a bell of two blocks on either side.
BELL = (0.0625, 0.25, 0.375, 0.25, 0.0625)
#: Share of the strong text that the content's element holds.
MOST = 0.8
#: Paths with more linked text than this share, and less unlinked text a block than this, are lists of links.
LINKED, SHORT = 0.5, 25

TAG = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:=\s*+(?:\"[^\"]*+\"|'[^']*+')|[^>])*+)>|<[!?/][^>]*+>?|<[a-zA-Z].*\Z", re.S
)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？।؟]")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6"
    " header hgroup html legend li main menu nav ol p pre section summary table tbody tfoot thead tr ul head noscript template svg".split()
)
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: An element of these tags ends an open one of the listed tags, unless a tag of its scope lies between.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu", "dir")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
    "td": (("td", "th"), ("table", "tr")), "th": (("td", "th"), ("table", "tr")), "tr": (("tr",), ("table",)),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)), "tfoot": (("thead", "tbody", "tfoot"), ("table",)), "thead": (("thead", "tbody", "tfoot"), ("table",)),
}
#: Never content: whatever stands around them, or unless they stand around the article.
NEVER = frozenset("head noscript template svg math canvas audio video object button select option datalist dialog nav aside footer menu".split())
DOUBTED = frozenset(("header", "form", "fieldset"))
BAD_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar form".split())
BAD_WORDS = frozenset(
    "nav navbar navigation menu submenu breadcrumb breadcrumbs header masthead footer sidebar aside ad ads adv advert adverts advertisement advertising banner"
    " sponsor sponsored sponsors promo promotion promoted notice notices notification alert cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription"
    " signup login comment comments commentlist disqus replies respond share sharing social related recommended recommendations widget pagination pager toolbar form search"
    " copyright hidden".split()
)


class _Page:
    """One page's blocks: text, unlinked characters and marks, linked characters, path and element."""

    def __init__(self) -> None:
        self.parent, self.tag = [-1], [""]  # of each element; 0 is the page
        self.doubt: list[int] = [0]  # 0: content, 1: by class or form, 2: header, 3: never
        self.path = [0]  # of each element
        self.paths: dict[tuple, int] = {}
        self.stack, self.at = [0], defaultdict(list)  # at: stack positions of each open tag
        self.roots: dict[str, list[int]] = {"article": [], "main": []}
        self.blocks: list[tuple[str, int, int, int, int]] = []  # text, free, marks, linked, element
        self.parts: list[tuple[str, bool]] = []

    def flush(self) -> None:
        if self.parts:
            text = " ".join("".join(p for p, _ in self.parts).split())
            if text:
                free = "".join(p for p, linked in self.parts if not linked)
                linked = sum(len(p.strip()) for p, linked in self.parts if linked)
                element = self.stack[-1]
                self.blocks.append((text, len("".join(free.split())), len(PUNCTUATION.findall(free)), linked, element))
            self.parts.clear()

    def pop_to(self, position: int) -> None:
        while len(self.stack) > position:
            self.at[self.tag[self.stack.pop()]].pop()

    def last(self, *tags: str) -> int:
        return max((self.at[t][-1] for t in tags if self.at[t]), default=-1)

    def open(self, tag: str, raw: str) -> None:
        if tag in BLOCK:
            self.flush()
            if self.at["p"] and tag not in ("tbody", "thead", "tfoot", "tr"):
                self.pop_to(self.at["p"][-1])
        if tag in ENDS:
            own, scope = ENDS[tag]
            if (k := self.last(*own)) > self.last(*scope):
                self.flush() if tag not in ("td", "th") else self.parts.append((" ", False))
                self.pop_to(k)
        if tag in HEADINGS and self.stack[-1] and self.tag[self.stack[-1]] in HEADINGS:
            self.pop_to(len(self.stack) - 1)
        if tag == "a" and self.at["a"]:
            self.shut("a")
        doubt, names = self.judge(tag, raw)
        up = self.stack[-1]
        here = len(self.parent)
        self.parent.append(up)
        self.tag.append(tag)
        self.doubt.append(doubt)
        step = (self.path[up], tag, names)
        self.path.append(self.paths.setdefault(step, len(self.paths) + 1) if tag in BLOCK else self.path[up])
        root = tag if tag in self.roots else None
        if root and not doubt:
            self.roots[root].append(here)
        self.at[tag].append(len(self.stack))
        self.stack.append(here)

    def judge(self, tag: str, raw: str) -> tuple[int, str]:
        """How doubtful an element is by itself, and its class names for the path."""
        doubt, names = 3 if tag in NEVER else 2 if tag == "header" else 1 if tag in DOUBTED else 0, ""
        if raw and not raw.isspace():
            for m in ATTRIBUTE.finditer(raw):
                name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
                if name in ("class", "id"):
                    names = names or re.sub(r"\d+", "", value)
                    words = {w.lower() for w in NAME_WORD.findall(value)}
                    if words & BAD_WORDS and tag not in ("html", "body", "main") and tag not in HEADINGS:
                        doubt = max(doubt, 2 if words & BAD_WORDS == {"header"} else 1)
                elif name == "role" and value.lower() in BAD_ROLES:
                    doubt = max(doubt, 1)
                elif name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                    doubt = 3
        return doubt, names

    def shut(self, tag: str) -> None:
        if tag in BLOCK:
            self.flush()
        if not self.at[tag]:
            return
        k = self.at[tag][-1]
        if tag in BLOCK or tag in ("td", "th") or k == len(self.stack) - 1:
            self.pop_to(k)
        else:  # an inline element that ends around others: they stay, it says nothing more
            self.at[tag].pop()
            gone = len(self.parent)
            self.parent.append(self.parent[self.stack[k]])
            self.tag.append("")
            self.doubt.append(0)
            self.path.append(self.path[self.stack[k]])
            self.at[""].append(k)
            self.stack[k] = gone

    def say(self, text: str) -> None:
        if text:
            self.parts.append((html.unescape(text) if "&" in text else text, bool(self.at["a"])))

    def read(self, page: str) -> _Page:
        at = 0
        while (m := TAG.search(page, at)) is not None:
            self.say(page[at : m.start()])
            at = m.end()
            if m[2]:
                tag = m[2].lower()
                if m[1]:
                    self.shut(tag)
                elif tag == "br":
                    self.parts.append((" ", False))
                elif tag in RAW:
                    end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                    at = end.end() if end else len(page)
                elif tag == "hr":
                    self.flush()
                elif tag not in VOID:
                    self.open(tag, m[3])
        self.say(page[at:])
        self.flush()
        return self


def _bad(page: _Page, element: int, cleared: set[int], memo: dict[int, int]) -> int:
    """The worst doubt about an element and those around it."""
    chain = []
    while element not in memo and element >= 0:
        chain.append(element)
        element = page.parent[element]
    worst = memo.get(element, 0)
    for e in reversed(chain):
        worst = max(worst, 0 if e in cleared else page.doubt[e])
        memo[e] = worst
    return worst


def path_scores(paths: np.ndarray, free: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Each block's fused score: its path's text and marks a block, and both smoothed along the page."""
    held = np.bincount(paths)
    length, mark = (np.bincount(paths, x)[paths] / held[paths] for x in (free, marks))
    bell = lambda x: np.convolve(np.pad(x, len(BELL) // 2, "edge"), BELL, "valid")
    own, smooth = length * (1 + mark), bell(length) * (1 + bell(mark))
    fused = np.sqrt(own * smooth)
    return np.bincount(paths, fused)[paths] / held[paths]


def main_text(source: str) -> str:
    """The main text of one page, blocks joined by two line feeds."""
    page = _Page().read(source)
    if not page.blocks:
        return ""
    # classes and forms around an article say nothing; comments that are articles say it of themselves
    cleared: set[int] = set()
    above: set[int] = set()
    for root in [r for rs in page.roots.values() for r in rs]:
        e = page.parent[root]
        while e > 0 and e not in above:
            above.add(e)
            if page.doubt[e] in (1, 2) and not page.tag[e] == "header":
                cleared.add(e)
            e = page.parent[e]
    memo: dict[int, int] = {}
    doubts = [_bad(page, b[4], cleared, memo) for b in page.blocks]
    inside = _inside(page, doubts)
    if not any(inside):
        cleared |= _holding_most(page, doubts)
        memo = {}
        doubts = [_bad(page, b[4], cleared, memo) for b in page.blocks]
    heading = [bool(HEADINGS & {page.tag[b[4]]}) for b in page.blocks]
    kept = [i for i, d in enumerate(doubts) if d == 0 or d == 2 and heading[i] and inside[i]]
    kept = [i for i in kept if inside[i]] or kept
    if not kept:
        return ""
    paths = np.unique([page.path[page.blocks[i][4]] for i in kept], return_inverse=True)[1]
    free, marks, linked = (np.array([page.blocks[i][k] for i in kept], dtype=float) for k in (1, 2, 3))
    if not any(inside):
        score = path_scores(paths, free, marks)
        strong = score >= STRONG * np.average(score, weights=free + 1e-9)
        root = _deepest(page, [page.blocks[i][4] for i in kept], np.where(strong, free, 0))
        known = {-1: False}
        within = np.array([_within(page, page.blocks[i][4], {root}, known) for i in kept])
    else:
        within = np.ones(len(kept), dtype=bool)
    total = np.maximum(np.bincount(paths, free + linked)[paths], 1)
    links = (np.bincount(paths, linked)[paths] / total > LINKED) & (np.bincount(paths, free)[paths] / np.bincount(paths)[paths] < SHORT)
    only = within & ~links
    return "\n\n".join(page.blocks[i][0] for i, ok in zip(kept, only if only.any() else within, strict=True) if ok)


def _inside(page: _Page, doubts: list[int]) -> list[bool]:
    """Whether blocks lie in an article or, on pages without text in one, in main."""
    for tag in ("article", "main"):
        roots = set(page.roots[tag])
        known: dict[int, bool] = {-1: False}
        found = [_within(page, b[4], roots, known) for b in page.blocks]
        if any(f and d == 0 for f, d in zip(found, doubts, strict=True)):
            return found
    return [False] * len(page.blocks)


def _within(page: _Page, element: int, roots: set[int], known: dict[int, bool]) -> bool:
    chain = []
    while element not in known:
        if element in roots:
            known[element] = True
            break
        chain.append(element)
        element = page.parent[element]
    for e in chain:
        known[e] = known[element]
    return known[element]


def _weights(page: _Page, elements: list[int], free) -> np.ndarray:
    """The text below each element."""
    held = np.zeros(len(page.parent))
    np.add.at(held, elements, free)
    for e in range(len(held) - 1, 0, -1):
        held[page.parent[e]] += held[e]
    return held


def _holding_most(page: _Page, doubts: list[int]) -> set[int]:
    """Elements doubted by class that hold most of the page's text that is not plainly none."""
    real = [(b[4], b[1]) for b, d in zip(page.blocks, doubts, strict=True) if d < 2]
    held = _weights(page, [e for e, _ in real], [n for _, n in real])
    return {e for e in np.flatnonzero(held > 0.5 * max(held[0], 1)).tolist() if page.doubt[e] == 1}


def _deepest(page: _Page, elements: list[int], free: np.ndarray) -> int:
    """The deepest element that holds most of the text; children come after their parents."""
    held = _weights(page, elements, free)
    enough = np.flatnonzero((held >= MOST * held[0]) & (held > 0))
    blocks = [e for e in enough.tolist() if page.tag[e] not in ("p", "li", "pre", "tr", *HEADINGS) and (e == 0 or page.tag[e] in BLOCK)]
    return max(blocks, default=0)


ADDED = T.StructType([T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])


def extract(pages: DataFrame, column: str = "html") -> DataFrame:
    """All columns of pages plus text and n_chars."""

    def work(sources: list[str]) -> list[pa.Array]:
        texts = [main_text(s) for s in sources]
        return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

    return add_columns(pages, column, ADDED, work)


def main_text_query(spark, sf_dir: str) -> DataFrame:
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", "n_chars")
