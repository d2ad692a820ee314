"""Main text of web pages by minimum-cut labelling of their blocks.

A page is read into blocks of text (what stands between block-level tags).
For every block the costs of calling it content or boilerplate become the
capacities to the two terminals. Where the page says by its elements or their
names what a part is, those costs are high. Elsewhere they are the log-odds of a
classifier of the block's form (tag, length, links, punctuation), which is fitted
on a bounded sample of the pages: blocks that their page declares are its
examples. Blocks that follow each other, and blocks that are near in the DOM, are
joined by smoothness edges of about the same weight, so that a short line between
paragraphs goes with them, and a sentence in a menu with the menu. The minimum cut
is the labelling of least total cost; blocks on the content side are the main text.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, tidy
from .quality import Logistic

#: Element names of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr "
    "math semantics maction menclose merror mfrac mi mmultiscripts mn mo mover mpadded mphantom mprescripts mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover".split()
)
RAW = frozenset("script style textarea title template iframe svg annotation annotation-xml select object canvas audio video xmp noembed noframes".split())
CLOSES_P = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Elements that end an open one of the same set, up to the nearest holder.
SIBLINGS = {
    **dict.fromkeys(("li",), (frozenset(("li",)), frozenset(("ul", "ol", "menu")))),
    **dict.fromkeys(("dt", "dd"), (frozenset(("dt", "dd")), frozenset(("dl",)))),
    **dict.fromkeys(("td", "th"), (frozenset(("td", "th")), frozenset(("tr", "table")))),
    **dict.fromkeys(("tr",), (frozenset(("tr", "td", "th")), frozenset(("table", "thead", "tbody", "tfoot")))),
    **dict.fromkeys(("thead", "tbody", "tfoot"), (frozenset(("thead", "tbody", "tfoot", "tr", "td", "th")), frozenset(("table",)))),
    **dict.fromkeys(("option", "optgroup"), (frozenset(("option", "optgroup")), frozenset(("select", "datalist")))),
}
TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*)(?:>|\Z)", re.S)
NAMES = re.compile(r"(?<![\w-])(class|id|role|aria-label|itemprop)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)", re.I)
HIDDEN = re.compile(r"(?:^|\s)(?:hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|style\s*=\s*(?:\"[^\"]*(?:display\s*:\s*none|visibility\s*:\s*hidden)|'[^']*(?:display\s*:\s*none|visibility\s*:\s*hidden)))", re.I)
PART = re.compile(r"[a-z]+|[A-Z][a-z]*|[0-9]+")
BOILERPLATE_TAGS = frozenset("nav footer aside form menu dialog button fieldset select label".split())
CONTENT_TAGS = frozenset("article main".split())
BAD_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion outbrain taboola "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc toolbar "
    "footer header masthead topbar bottombar copyright colophon contentinfo "
    "sidebar aside rail widget widgets complementary related recommended recommendations more trending popular "
    "cookie cookies consent gdpr notice notices notification alert banner disclaimer legal privacy popup modal overlay newsletter subscribe subscription signup paywall "
    "social share sharing follow comment comments commentlist reply replies disqus respond response responses discussion feedback reader "
    "search login form hidden skip".split()
)
GOOD_NAMES = frozenset("article content main body post entry story text page".split())
#: Of those, the ones that may stand in the name of a part of the article, and the ones that
#: also mark an article or main element (a reader's comment, an advert) as none.
MILD_NAMES = frozenset("header masthead more popular legal reader page banner".split())
FALSE_ARTICLE = frozenset("ad ads advert advertisement sponsored promo promoted teaser related recommended comment comments reply replies response responses".split())
#: Names that inside an article may also be those of its own sections: judged by their text.
AMBIGUOUS = frozenset("discussion response responses feedback related recommendations search more privacy legal disclaimer notice notices".split())
#: Headings and paragraphs; like inline elements they are not judged by their ids, which are often slugs.
OF_TEXT = frozenset("h1 h2 h3 h4 h5 h6 p".split())
NEGATION = frozenset("has with no without".split())
LEGAL = re.compile(r"©|\(c\) |copyright\b|all rights reserved", re.I)
SPACES = re.compile(r"\s+")

#: Costs of the terminals and edges; declared parts outweigh any sum of smoothness a block can meet.
CONTAINER = 8.0
WEAK = -2.5
MOST_ODDS = 2.5
NEXT_EDGE = 1.1
NEAR_EDGE = 0.7
#: Declared parts cut the ties to their neighbours: what is near them in the DOM may still be another part.
TIE = 0.3
#: Pages (each of so many bytes) and blocks on which the classifier is fitted, at most, and blocks of either class that it needs.
PAGES = 400
BLOCKS = 20_000
PAGE_BYTES = 1 << 18
ENOUGH = 50

FORM = ("paragraph", "heading", "item", "log_size", "links", "sentence", "marks", "legal")
#: The log-odds that count where there are too few examples: a summand, then a weight for each of FORM.
PLAIN_ODDS = (-3.5, 0.5, 0.5, -0.5, 1.0, -4.0, 1.0, 0.1, -3.0)
ITEMS = frozenset("li td th dt dd tr".split())
HEADINGS = frozenset(f"h{k}" for k in range(1, 7))


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    parent: int  # the element that holds the block's own
    inside: float  # positive inside article or main, negative inside boilerplate
    tag: str  # the heading around it, or the block-level element
    part: int = 0  # the outermost element around it that is judged by its text
    outside: bool = False  # that element is in no article

    def form(self) -> list[float]:
        """The features FORM."""
        size = len(self.text)
        marks = sum(map(self.text.count, ",.;:!?"))
        return [self.tag == "p", self.tag in HEADINGS, self.tag in ITEMS, math.log1p(size), self.linked / max(1, size), self.text[-1] in ".!?…\"”", 100 * marks / size, size < 200 and LEGAL.match(self.text) is not None]


@dataclass
class _Open:
    """An open element: its name and number, and what it says of the text in it."""

    name: str
    number: int
    standing: float
    own: int  # the nearest element that isn't inline, and the one around that
    parent: int
    tag: str
    part: int
    article: bool


def _standing(tag: str, attributes: str, above: float) -> float:
    """What an element says of the text inside it, given what its parents say."""
    if above <= -CONTAINER:
        return above
    if attributes and HIDDEN.search(attributes):
        return -CONTAINER
    names: set[str] = set()
    for m in NAMES.finditer(attributes) if attributes else ():
        if m[1].lower() == "id" and (tag in OF_TEXT or tag in INLINE):
            continue
        for token in m[2].strip("\"'").split():
            parts = [p.lower() for p in PART.findall(token)]
            if parts and parts[0] not in NEGATION:
                names.update(parts)
    if tag in CONTENT_TAGS:
        return -CONTAINER if names & FALSE_ARTICLE else above if above == WEAK else CONTAINER
    if tag == "noscript":
        return WEAK
    bad = names & BAD_NAMES if tag not in ("body", "html") else set()
    if above > 0 and names & GOOD_NAMES and bad <= MILD_NAMES:
        bad = set()
    if tag in BOILERPLATE_TAGS or bad and (above <= 0 and above != WEAK or bad - AMBIGUOUS):
        return -CONTAINER
    if bad or above == WEAK:
        return WEAK
    if tag == "header":
        return above if above > 0 else -CONTAINER
    if names & GOOD_NAMES:
        return max(above, CONTAINER / 4)
    return above


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order, empty ones left out."""
    out: list[Block] = []
    stack = [_Open("", 0, 0.0, 0, 0, "-", 0, False)]
    count: dict[str, int] = {}  # open elements of each name
    parts: list[tuple[str, bool]] = []
    number, at, end = 0, 0, len(page)
    lowered = ""

    def flush() -> None:
        nonlocal parts
        if parts:
            text = SPACES.sub(" ", html.unescape("".join(p for p, _ in parts))).strip()
            if text:
                top = stack[-1]
                out.append(Block(text, sum(len(p) for p, a in parts if a), top.parent, top.standing, top.tag, top.part, top.part > 0 and not top.article))
            parts = []

    def push(tag: str, attributes: str) -> None:
        nonlocal number
        number += 1
        top, standing = stack[-1], _standing(tag, attributes, stack[-1].standing)
        heading = tag in HEADINGS
        block = tag not in INLINE
        part = (top.part or number) if standing == WEAK else 0
        stack.append(_Open(tag, number, standing, number if block else top.own, top.own if block else top.parent, tag if heading or block and top.tag not in HEADINGS else top.tag, part, top.article or standing >= CONTAINER))
        count[tag] = count.get(tag, 0) + 1

    def pop_to(depth: int) -> None:
        for e in stack[depth:]:
            count[e.name] -= 1
        del stack[depth:]

    while at < end:
        m = TOKEN.search(page, at)
        if m is None or m.start() > at:
            parts.append((page[at : m.start() if m else end], count.get("a", 0) > 0))
        if m is None:
            break
        at = max(m.end(), m.start() + 1)
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag not in INLINE:
                flush()
            if count.get(tag):
                pop_to(next(k for k in range(len(stack) - 1, 0, -1) if stack[k].name == tag))
            continue
        if tag in RAW:
            if not m[3].endswith("/") or tag not in ("svg", "math"):
                lowered = lowered or page.lower()
                if len(lowered) != end:  # lower-casing changed lengths
                    close = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
                    k = close.start() if close else -1
                else:
                    k = lowered.find(f"</{tag}", at)
                if k < 0:
                    break
                stop = page.find(">", k)
                at = stop + 1 if stop >= 0 else end
            continue
        if tag in INLINE:
            if tag == "br":
                parts.append((" ", False))
            elif tag not in VOID:
                push(tag, m[3])
            continue
        flush()
        if tag in CLOSES_P and count.get("p"):
            depth = next((k for k in range(len(stack) - 1, 0, -1) if stack[k].name not in INLINE), 0)
            if depth and stack[depth].name == "p":
                pop_to(depth)
        if tag in SIBLINGS and any(map(count.get, SIBLINGS[tag][0])):
            same, holders = SIBLINGS[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name in holders:
                    break
                if stack[k].name in same:
                    pop_to(k)
                    break
        if tag not in VOID:
            push(tag, m[3])
    flush()
    return out


def costs(block: Block, marked: bool, odds: Sequence[float] = PLAIN_ODDS, whole: tuple[int, int] | None = None) -> tuple[float, float]:
    """The costs of calling a block boilerplate and of calling it content.

    ``marked``: the page has an article or main element. ``odds``: the classifier's summand and weights.
    ``whole``: the length of all text in the block's part, and of what is linked there.
    """
    score = block.inside
    if whole:
        score += 1.0 + min(2.0, whole[0] / 100) - 4.0 * min(1.0, whole[1] / max(1, whole[0]))
    elif not marked:
        said = odds[0] + sum(w * x for w, x in zip(odds[1:], block.form()))
        score += max(-MOST_ODDS, min(MOST_ODDS, said))
    if marked and (block.inside == 0 or block.outside):
        score -= CONTAINER / 2
    return max(score, 0.0), max(-score, 0.0)


def fitted_odds(forms: np.ndarray, content: np.ndarray) -> tuple[float, ...]:
    """The classifier's summand and weights, from blocks that their pages declare, each class with the same weight."""
    if min(content.sum(), (1 - content).sum()) < ENOUGH:
        return PLAIN_ODDS
    # Rows of the rarer class are repeated, so that log-odds of 0 mean neither.
    at = [np.flatnonzero(content == c) for c in (0, 1)]
    size = max(map(len, at))
    rows = np.concatenate([np.resize(a, size) for a in at])
    model = Logistic.fit(forms[rows], content[rows])
    weights = model.weights[:-1] / model.scale
    return (float(model.weights[-1] - weights @ model.mean), *map(float, weights))


def min_cut(to_content: Sequence[float], to_boilerplate: Sequence[float], edges: Sequence[tuple[int, int, float]]) -> list[bool]:
    """Which nodes are on the content side of a minimum cut (Dinic's maximum flow)."""
    n = len(to_content)
    s, t = n, n + 1
    to: list[int] = []
    left: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def arc(a: int, b: int, forth: float, back: float) -> None:
        out[a].append(len(to))
        to.append(b)
        left.append(forth)
        out[b].append(len(to))
        to.append(a)
        left.append(back)

    for k in range(n):
        both = min(to_content[k], to_boilerplate[k])
        if to_content[k] > both:
            arc(s, k, to_content[k] - both, 0.0)
        if to_boilerplate[k] > both:
            arc(k, t, to_boilerplate[k] - both, 0.0)
    for a, b, w in edges:
        arc(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[s] = 0
        queue = deque([s])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if left[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[t] < 0:
            return [x >= 0 for x in level[:n]]
        turn = [0] * (n + 2)
        path: list[int] = []
        a = s
        while True:
            if a == t:
                amount = min(left[e] for e in path)
                for e in path:
                    left[e] -= amount
                    left[e ^ 1] += amount
                k = next(k for k, e in enumerate(path) if left[e] <= 1e-9)
                a = to[path[k] ^ 1]
                del path[k:]
                continue
            while turn[a] < len(out[a]):
                e = out[a][turn[a]]
                if left[e] > 1e-9 and level[to[e]] == level[a] + 1:
                    break
                turn[a] += 1
            else:
                if a == s:
                    break
                level[a] = -1
                a = to[path.pop() ^ 1]
                continue
            path.append(e)
            a = to[e]


def labels(blocks: Sequence[Block], odds: Sequence[float] = PLAIN_ODDS, smooth: bool = True) -> list[bool]:
    """Which blocks of a page are content; ``smooth``: with edges between blocks."""
    marked = any(b.inside >= CONTAINER for b in blocks)
    wholes: dict[int, tuple[int, int]] = {}
    for b in blocks:
        if b.part:
            size, linked = wholes.get(b.part, (0, 0))
            wholes[b.part] = (size + len(b.text), linked + b.linked)
    terminal = [costs(b, marked, odds, wholes.get(b.part)) for b in blocks]
    edges: list[tuple[int, int, float]] = []
    near: dict[int, int] = {}
    for k, b in enumerate(blocks if smooth else ()):
        declared = lambda j, b=b: bool(b.inside or blocks[j].inside or marked)
        if k:
            edges.append((k - 1, k, NEXT_EDGE * (TIE if declared(k - 1) else 1.0)))
        if b.parent in near:
            edges.append((near[b.parent], k, NEAR_EDGE * (TIE if declared(near[b.parent]) else 1.0)))
        near[b.parent] = k
    return min_cut([a for a, _ in terminal], [b for _, b in terminal], edges)


def main_text(page: str | None, odds: Sequence[float] = PLAIN_ODDS) -> tuple[str, int, int]:
    """The main text of a page, and how many of its blocks are content and not."""
    blocks = blocks_of(page) if page else []
    chosen = [b.text for b, c in zip(blocks, labels(blocks, odds)) if c]
    return "\n".join(chosen), len(chosen), len(blocks) - len(chosen)


def _fitted(pages: DataFrame, column: str) -> tuple[float, ...]:
    """The classifier, from at most BLOCKS declared blocks of at most PAGES pages, chosen by a hash of the page."""

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            forms, content = [], []
            for page in batch.column(0).to_pylist():
                for b in blocks_of(page):
                    if abs(b.inside) >= CONTAINER:
                        forms.append([float(x) for x in b.form()])
                        content.append(int(b.inside > 0))
            yield pa.RecordBatch.from_arrays([pa.array(forms, pa.list_(pa.float64())), pa.array(content, pa.int32())], names=["form", "content"])

    html_ = F.col(f"`{column}`").cast("string")
    sample = pages.select(F.xxhash64(html_).alias("h"), html_.alias("html")).where(F.octet_length("html") <= PAGE_BYTES).orderBy("h", "html").limit(PAGES).select("html")
    found = sample.mapInArrow(work, "form array<double>, content int").limit(BLOCKS).toArrow()
    forms = np.array(found.column("form").to_pylist(), float).reshape(-1, len(FORM))
    return fitted_odds(forms, found.column("content").to_numpy().astype(float))


def extract_text(pages: DataFrame, keep: Sequence[str] = ("page_id", "url"), column: str = "html") -> DataFrame:
    """Columns ``keep`` of every row, then ``text``, ``n_blocks`` and ``n_boilerplate``.

    A null page counts as empty, and a page without main text gives an empty
    string. But for the classifier's sample rows are independent: repeats and null
    ids change nothing, an empty table gives an empty one. Where nothing is on either side, a block that no
    capacity ties to the content terminal is boilerplate.
    """

    odds = _fitted(pages, column)

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [main_text(p, odds) for p in batch.column(len(keep)).to_pylist()]
            columns = [pa.array([f[0] for f in found], pa.string()), *(pa.array([f[k] for f in found], pa.int32()) for k in (1, 2))]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(len(keep))), *columns], names=[*keep, "text", "n_blocks", "n_boilerplate"])

    own = pages.select(*keep, F.col(f"`{column}`").cast("string"))
    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in own.schema[: len(keep)])
    return own.mapInArrow(work, schema + "text string, n_blocks int, n_boilerplate int")


def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    found = extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return found.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))
