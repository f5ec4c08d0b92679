"""Main text of web pages by minimum-cut labelling.

A page is parsed into blocks of text. A logistic classifier, trained from the labelled pages of ``html_rows``, gives each
block the cost of calling it content and the cost of calling it boilerplate; these are the capacities of its edges to the
two terminals. Neighbouring blocks are tied by smoothness edges, stronger the nearer they are in the DOM, and so are
consecutive blocks of one container that have others between them. The minimum cut of this graph is the labelling of least total
cost; it is found by augmenting paths on the residual graph, and content is what stays on the source's side.

The result is the content blocks in page order: character references decoded, white space inside a block as one
space, trimmed, joined by an empty line. Nothing else is dropped and nothing is capped. What a page shows no text of is no block:
scripts, styles, the title, frames, templates, drawings (svg) and the inside of a text field. ``noscript`` is judged as what stands beside
the text, the fallback inside ``object`` as text where it stands.

Parsing is linear in the page: open elements are told by a pointer to their parents, and the nearest open one of a tag by an index. A
node that once failed to reach the other terminal never can, so the search for augmenting paths leaves it out from then on.

Defined results: null, empty or markup-only html gives the empty text; unclosed comments, scripts and tags reach to
where the next markup can begin, or to the end; a line break is white space inside its block; pages are judged one by one, so
repeated pages give equal rows; other columns don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .html_rows import LABELLED

_MARKUP = re.compile(r"<!--(?:(?!-->).)*+(?:-->|\Z)|<(script|style|title|iframe|textarea)\b[^>]*+>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:[^<>\"']|\"[^\"<>]*+\"|'[^'<>]*+'|[\"'])*+)>?|<[!?][^>]*+>?", re.S | re.I)
#: What decides where an svg or template ends: comments and raw texts can't hold its tags.
_UNSEEN = re.compile(r"<!--(?:(?!-->).)*+(?:-->|\Z)|<(script|style|iframe|textarea)\b[^>]*+>|<(/?)(svg|template)(?![\w:-])([^>]*+)>?", re.S | re.I)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_TOKEN = re.compile(r"[a-z]+")
_SENTENCE_END = re.compile(r"[.!?…][\"'»”)]*$")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body button center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html"
    " legend li main menu nav noscript ol option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose content is no text, from a start tag to the end tag that belongs to it. One without an end tag is empty.
UNSEEN = frozenset(("svg", "template"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: A start tag of the key ends an open element of the values, unless one of the last group is in between.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table",)),
    "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)),
}
SCOPE = ("div", "article", "section", "main", "aside", "nav", "header", "footer", "form", "li", "td", "th", "table", "body", "blockquote", "figure", "button", "fieldset")
MAIN_TAGS = frozenset(("article", "main"))
MAIN_WORDS = frozenset("article content entry main post story maincontent articlebody".split())
AWAY_TAGS = frozenset("nav footer aside form menu button select dialog search fieldset label input datalist noscript".split())
AWAY_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising advertorial alert banner breadcrumb breadcrumbs consent cookie cookies copyright dialog disclaimer footer gdpr"
    " imprint login menu menubar modal nav navbar navigation newsletter notice notification overlay pager pagination paywall popup privacy promo promotion"
    " recommended related search share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toolbar complementary contentinfo".split()
)
TALK_WORDS = frozenset("comment comments commentlist discussion disqus replies reply respond responses".split())
HEADER_WORDS = frozenset("header masthead topbar".split())
FEATURES = ("bias", "away tag", "away word", "talk word", "header", "in main", "beside main", "mostly links", "some links", "ten words", "thirty words", "sentence end", "heading", "list item", "control")


class Block:
    """A run of text. box: number of the nearest block element; sayer: of the nearest element that says something of its text."""

    __slots__ = ("text", "links", "tag", "box", "sayer", "flags")

    def __init__(self, text: str, links: int, tag: str, box: int, sayer: int):
        self.text, self.links, self.tag, self.box, self.sayer, self.flags = text, links, tag, box, sayer, frozenset()


class Page(list):
    """Blocks in page order. boxes: number of a block element -> (number of the one around it, depth)."""

    def __init__(self):
        super().__init__()
        self.boxes: dict[int, tuple[int, int]] = {0: (0, 0)}


class _Open:
    """The open elements."""

    def __init__(self, page: Page):
        self.boxes, self.outer, self.said = page.boxes, {0: 0}, {}  # outer: an element that says something -> the next one around it
        self.stack: list[tuple[str, int, int]] = [("", 0, 0)]  # tag, nearest box, nearest sayer
        self.at: dict[str, list[int]] = {}
        self.blocks = [0]
        self.tags = {0: ""}
        self.serial = 0

    def nearest(self, tags) -> int:
        """Place of the innermost open element of these tags, 0 if there is none."""
        return max((own[-1] for t in tags if (own := self.at.get(t))), default=0)

    def push(self, tag: str, said: set) -> None:
        _, box, sayer = self.stack[-1]
        self.serial += 1
        place = len(self.stack)
        if tag in BLOCK:
            self.boxes[self.serial] = (box, self.boxes[box][1] + 1)
            box = self.serial
            self.tags[box] = tag
            self.blocks.append(place)
        if said:
            self.outer[self.serial], self.said[self.serial] = sayer, said
            sayer = self.serial
        self.at.setdefault(tag, []).append(place)
        self.stack.append((tag, box, sayer))

    def cut(self, place: int) -> None:
        """Close the element at this place and all inside it."""
        while len(self.stack) > place:
            tag = self.stack.pop()[0]
            self.at[tag].pop()
            if self.blocks[-1] == len(self.stack):
                self.blocks.pop()


def _unseen_ends(page: str) -> dict[int, int]:
    """Where each start tag of an UNSEEN element that has an end tag begins -> where that end tag ends. An end tag belongs to the last open start tag."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {tag: [] for tag in UNSEEN}
    unclosed = set()
    m = _UNSEEN.search(page)
    while m:
        pos = m.end()
        if m[1]:
            raw = m[1].lower()
            close = None if raw in unclosed or m[0].endswith("/>") and opened["svg"] else re.compile(rf"</{raw}\b[^>]*>?", re.I).search(page, pos)
            if close:
                pos = close.end()
            elif not m[0].endswith("/>"):
                unclosed.add(raw)
        elif m[3]:
            tag = m[3].lower()
            if not m[2]:
                if tag != "svg" or not m[4].endswith("/"):
                    opened[tag].append(m.start())
            elif opened[tag]:
                ends[opened[tag].pop()] = pos
        m = _UNSEEN.search(page, pos)
    return ends


def parse(page: str) -> Page:
    """Blocks in page order, with their flags."""
    blocks = Page()
    open_ = _Open(blocks)
    parts: list[str] = []
    links = in_link = 0
    pos, end = 0, len(page)
    unseen: dict[int, int] | None = None

    def flush() -> None:
        nonlocal links
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                _, box, sayer = open_.stack[-1]
                blocks.append(Block(text, links, open_.tags[box], box, sayer))
            parts.clear()
        links = 0

    while pos < end:
        m = _MARKUP.search(page, pos)
        if m is None:
            parts.append(page[pos:])
            if in_link:
                links += end - pos
            break
        if m.start() > pos:
            parts.append(page[pos : m.start()])
            if in_link:
                links += m.start() - pos
        pos = m.end()
        if m[1]:  # its content is no text: up to its end tag, or to the end of the page
            close = re.compile(rf"</{m[1]}\b[^>]*>?", re.I).search(page, pos)
            pos = close.end() if close else end
            continue
        if not m[3]:
            continue
        tag = m[3].lower()
        if tag in UNSEEN:
            if unseen is None:
                unseen = _unseen_ends(page)
            pos = unseen.get(m.start(), pos)
            continue
        if m[2]:
            at = open_.nearest((tag,))
            if tag in BLOCK:
                flush()
            elif open_.blocks[-1] > at:
                at = 0  # an inline end tag doesn't end blocks
            if at:
                open_.cut(at)
            if tag == "a":
                in_link = max(0, in_link - 1)
            continue
        if tag == "br":
            parts.append(" ")
            continue
        if tag in BLOCK:
            flush()
            which, until = ENDS.get(tag, (("p",), SCOPE))
            at = open_.nearest(which)
            if at > open_.nearest(until):
                open_.cut(at)
        if tag in VOID or m[4].endswith("/") and tag not in BLOCK:
            continue
        open_.push(tag, _said(tag, m[4]))
        if tag == "a":
            in_link += 1
    flush()
    _settle(blocks, open_.said, open_.outer)
    return blocks


def _settle(blocks: Page, said: dict[int, set], outer: dict[int, int]) -> None:
    """Flags of blocks. A class that names something beside the text doesn't count at an element that holds the main element or
    half of the page's text: there it tells of the layout (``has-sidebar``). A header inside the main element is part of it."""
    weight = dict.fromkeys(outer, 0)
    for b in blocks:
        weight[b.sayer] += len(b.text)
    half = sum(weight.values()) / 2
    order = sorted(said)  # an element's number is larger than those around it
    holds_main = dict.fromkeys(outer, False)
    for e in reversed(order):
        weight[outer[e]] += weight[e]
        holds_main[e] |= "main tag" in said[e] and weight[e] > 0
        holds_main[outer[e]] |= holds_main[e]
    flags: dict[int, frozenset] = {0: frozenset()}
    for e in order:
        out = flags[outer[e]]
        own = said[e] - {"away word"} if holds_main[e] or weight[e] >= half else said[e]
        flags[e] = out | (own - {"header"} if "in main" in out else own)
    for b in blocks:
        own = flags[b.sayer]
        b.flags = own - {"in main"} if own & {"away word", "away tag", "talk word"} else own


def _said(tag: str, attrs: str) -> set:
    """What an element says of the text in it."""
    out = set()
    if tag in MAIN_TAGS:
        out |= {"in main", "main tag"}
    elif tag in AWAY_TAGS:
        out.add("away tag")
        if tag in ("button", "select", "label"):
            out.add("control")
    elif tag == "header":
        out.add("header")
    if attrs and attrs != "/" and tag not in ("html", "body"):
        for name, value in _ATTR.findall(attrs):
            name = name.lower()
            if name in ("class", "id", "role"):
                words = set(_TOKEN.findall(value.lower()))
                if tag in MAIN_TAGS:
                    continue
                if words & TALK_WORDS:
                    out.add("talk word")
                if words & AWAY_WORDS:
                    out.add("away word")
                if words & HEADER_WORDS:
                    out.add("header")
                if words & MAIN_WORDS and not out:
                    out.add("in main")
            elif name == "hidden" or name == "aria-hidden" and "true" in value.lower() or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
                out.add("away tag")
    return out


def features(blocks: list[Block]) -> np.ndarray:
    has_main = any("in main" in b.flags for b in blocks)
    rows = []
    for b in blocks:
        n, share = b.text.count(" ") + 1, b.links / len(b.text)
        inside = "in main" in b.flags
        rows.append((
            1, "away tag" in b.flags, "away word" in b.flags, "talk word" in b.flags, "header" in b.flags, inside, has_main and not inside, share > 0.6, 0.2 < share <= 0.6,
            n >= 10, n >= 30, _SENTENCE_END.search(b.text) is not None, b.tag in HEADINGS, b.tag == "li", "control" in b.flags,
        ))
    return np.array(rows, float).reshape(len(blocks), len(FEATURES))


def labelled_rows() -> tuple[np.ndarray, np.ndarray]:
    x, y = [], []
    for page in LABELLED:
        blocks = parse(page)
        signs = [b.text[0] for b in blocks]
        assert set(signs) <= {"+", "-"}, signs
        for b in blocks:
            b.text = b.text[1:].strip() or "x"
        x.append(features(blocks))
        y += [s == "+" for s in signs]
    return np.concatenate(x), np.array(y, float)


def fit(steps: int = 2000, penalty: float = 0.003, rate: float = 0.3) -> np.ndarray:
    """Logistic regression with L2 penalty on the labelled pages. Deterministic."""
    x, y = labelled_rows()
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-x @ w))
        w += rate * (x.T @ (y - p) / len(y) - penalty * w)
    return w


#: Smoothness between neighbours in one container, one level apart, further; and between blocks of a container with others between.
NEAR, NEXT, FAR, SIBLING = 400, 150, 30, 150


def edges(blocks: Page) -> list[tuple[int, int, int]]:
    out = []
    last_of: dict[int, int] = {}
    boxes = blocks.boxes
    for i, b in enumerate(blocks):
        if i:
            x, y = blocks[i - 1].box, b.box
            steps = [0, 0]
            while x != y:  # up to the element around both; as many steps as elements were closed and opened in between
                if boxes[x][1] >= boxes[y][1]:
                    x, steps[0] = boxes[x][0], steps[0] + 1
                else:
                    y, steps[1] = boxes[y][0], steps[1] + 1
            apart = max(steps)
            out.append((i - 1, i, NEAR if apart <= 1 else NEXT if apart == 2 else FAR))
        around = boxes[b.box][0]
        if around in last_of and last_of[around] < i - 1:
            out.append((last_of[around], i, SIBLING))
        last_of[around] = i
    return out


def min_cut(gain: list[int], links: list[tuple[int, int, int]]) -> list[bool]:
    """Labels of least cost: gain > 0 is what calling the node content saves, links cost their weight where labels differ.

    The capacities of a node to both terminals are reduced to their difference. Flow goes by breadth-first augmenting
    paths from the side with fewer nodes; the nodes it still reaches at the end are that side of a minimum cut.
    """
    n = len(gain)
    flip = 2 * sum(g > 0 for g in gain) > sum(g != 0 for g in gain)
    left = [-g for g in gain] if flip else list(gain)
    near: list[dict[int, int]] = [{} for _ in range(n)]
    for a, b, c in links:
        near[a][b] = near[a].get(b, 0) + c
        near[b][a] = near[b].get(a, 0) + c
    dead = [False] * n  # nothing leads from here to the other side any more
    for s in range(n):
        while left[s] > 0 and not dead[s]:
            came, queue, end = {s: s}, deque((s,)), -1
            while queue and end < 0:
                u = queue.popleft()
                for v, c in near[u].items():
                    if c > 0 and v not in came and not dead[v]:
                        came[v] = u
                        if left[v] < 0:
                            end = v
                            break
                        queue.append(v)
            if end < 0:
                for v in came:
                    dead[v] = True
                break
            flow, v = min(left[s], -left[end]), end
            while v != s:
                flow, v = min(flow, near[came[v]][v]), came[v]
            v = end
            while v != s:
                u = came[v]
                near[u][v] -= flow
                near[v][u] += flow
                v = u
            left[s] -= flow
            left[end] += flow
    reached = {i for i in range(n) if left[i] > 0}
    queue = deque(reached)
    while queue:
        u = queue.popleft()
        for v, c in near[u].items():
            if c > 0 and v not in reached:
                reached.add(v)
                queue.append(v)
    return [(i in reached) != flip for i in range(n)]


def main_text(page: str | None, weights: np.ndarray) -> str:
    blocks = parse(page) if page else []
    if not blocks:
        return ""
    gain = np.rint(1000 * np.clip(features(blocks) @ weights, -20, 20)).astype(int).tolist()  # -log p(boilerplate) + log p(content)
    keep = min_cut(gain, edges(blocks))
    return "\n\n".join(b.text for b, k in zip(blocks, keep) if k)


def extract(pages: DataFrame, weights: np.ndarray, html_col: str = "html") -> DataFrame:
    """page_id, url, text, n_chars of each page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(p, weights) for p in batch.column(html_col).to_pylist()]
            made = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())]
            yield pa.RecordBatch.from_arrays(made, names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.col(html_col)).mapInArrow(run, "page_id long, url string, text string, n_chars long")
