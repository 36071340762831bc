"""The main text of web pages: flat text blocks, told apart by a decision tree over words and link density."""

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.functions import arrow_udf

from sessionrank.llm.common import fresh

DEPTH = 7
SLICE = 256
FEATURES = (
    "words", "links", "words_before", "links_before", "words_after", "links_after",
    "region", "behind", "heading", "item", "container_words", "container_links", "legal",
)

_MARKUP = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(?:[!?]|/(?![a-zA-Z]))[^>]*(?:>|\Z)"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*+"[^"]*+"|=\s*+'[^']*+'|[="']|[^>"'=]++)*+)(?:>|\Z)""",
    re.S,
)
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I | re.S)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|display\s*:\s*none|aria-hidden\s*=\s*["']?true""", re.I)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
_WORD = re.compile(r"[a-z0-9]+")
_RUN = re.compile(r"\w+(?:['’.,-]\w+)*")
_WIDE = re.compile("[⺀-鿿가-힯豈-﫿]")
_LEGAL = re.compile(r"©|\(c\)|copyright|all rights reserved", re.I)

#: Elements whose content is no text of the page, and those that end at their own end tag only.
NO_TEXT = frozenset("script style title textarea xmp iframe noembed noframes template noscript svg canvas object select button datalist audio video head".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
CONTAINERS = NO_TEXT - RAW | frozenset("div section article main nav aside header footer form ul ol dl table figure blockquote dialog menu fieldset details center".split())
BREAKS = CONTAINERS - {"canvas", "object", "svg", "button", "select", "audio", "video", "noscript", "template"} | frozenset(
    "address body html p h1 h2 h3 h4 h5 h6 hr li dt dd tr caption pre figcaption legend summary hgroup thead tbody tfoot option".split()
)
SPACES = frozenset(("br", "td", "th"))
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
ITEMS = frozenset(("li", "dt", "dd", "tr", "option"))
#: Words in class, id and role that name what surrounds an article, whole or as beginnings.
AROUND = frozenset(
    "ad ads adbox adslot adsense nav menu header footer banner notice alert share sharing shares social tags tag meta byline toolbar"
    " search login complementary contentinfo status skip pager related teaser teasers promo form feedback".split()
)
AROUND_FROM = (
    "advert", "sponsor", "sidebar", "cookie", "consent", "gdpr", "newsletter", "subscri", "signup", "breadcrumb", "paginat", "navbar",
    "navigation", "masthead", "popup", "modal", "overlay", "recommend", "widget", "copyright", "promot",
)
APART_FROM = ("comment", "disqus", "replies", "reply", "respond")
WITHIN = frozenset("article articlebody post entry story content main maincontent prose".split())
NOT_APART = ("commentar",)


@dataclass(slots=True)
class Region:
    """What holds a block: 2 article, 1 named like one, 0 nothing known, -1 around the article; apart: an article inside is none."""

    name: str
    number: int
    level: int = 0
    apart: bool = False
    dropped: bool = False


def _place(tag: str, attrs: str, outer: Region, number: int) -> Region:
    """The region that an element opens."""
    level, apart, dropped = outer.level, outer.apart, outer.dropped
    names: set[str] = set()
    if attrs:
        dropped = dropped or bool(_HIDDEN.search(attrs))
        for value in _NAMED.findall(attrs):
            names.update(_WORD.findall(_CAMEL.sub(" ", value).lower()))
    with_ = names & {"with", "has", "no"}
    own_apart = tag in ("aside", "dialog") or any(n.startswith(APART_FROM) and not n.startswith(NOT_APART) for n in names)
    around = own_apart or tag in ("nav", "footer", "form", "menu") or (tag == "header" and outer.level < 2)
    around = around or (not with_ and any(n in AROUND or n.startswith(AROUND_FROM) for n in names))
    if tag == "main" or (names & {"main", "articlebody"} and not around):
        level, apart = 2, apart and tag != "main"
    elif tag == "article" and not apart and not own_apart:
        level = 2 if not around else -1
    elif around:
        level, apart = -1, apart or own_apart or "related" in names
    elif names & WITHIN and not apart and level >= 0:
        level = max(level, 1)
    return Region(tag, number, level, apart, dropped or tag in NO_TEXT)


@dataclass(slots=True)
class Block:
    text: str
    words: float
    linked: float
    level: int
    heading: bool
    item: bool
    container: int


def _count(text: str) -> float:
    return len(_RUN.findall(text)) + len(_WIDE.findall(text)) / 2


def text_blocks(page: str) -> list[Block]:
    """The flat blocks of a page in order: character references decoded, white space made one space, ends trimmed.

    Block-level tags end a block; other tags leave no trace, line breaks and cells a space. End tags that
    match nothing are ignored, open elements end with what holds them; a tag cut off by the end is dropped.
    """
    out: list[Block] = []
    parts: list[str] = []
    linked: list[str] = []
    top = Region("", 0)
    stack = [top]
    made, pos, link = 0, 0, False
    tag, own = "", None

    def flush() -> None:
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                region = own or stack[-1]
                item = tag in ITEMS or stack[-1].name in ("ul", "ol", "dl", "table", "menu")
                out.append(Block(text, _count(text), _count(" ".join(linked)) if linked else 0.0, region.level, tag in HEADINGS, item, stack[-1].number))
            parts.clear()
            linked.clear()

    def keep(raw: str) -> None:
        if raw and not (own or stack[-1]).dropped:
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if link:
                linked.append(text)

    n = len(page)
    while pos < n:
        m = _MARKUP.search(page, pos)
        if m is None:
            keep(page[pos:])
            break
        keep(page[pos : m.start()])
        pos = m.end()
        name = m[2]
        if name is None:
            continue
        name, closing = name.lower(), bool(m[1])
        if name in RAW:
            if not closing:
                end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, pos)
                pos = end.end() if end else n
            continue
        if name == "a":
            link = not closing
            continue
        if name in SPACES:
            keep(" ")
            continue
        if name in BREAKS:
            flush()
            tag, own = ("" if closing else name), None
        if name in CONTAINERS:
            if not closing:
                if not m[3].endswith("/") or name not in ("svg", "canvas", "object"):
                    made += 1
                    stack.append(_place(name, m[3], stack[-1], made))
            else:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].name == name:
                        del stack[i:]
                        break
                link = link and name not in ("div", "section", "article", "nav", "main")
        elif m[3] and not closing and name in BREAKS and name not in ("body", "html"):
            own = _place(name, m[3], stack[-1], stack[-1].number)
    flush()
    return out


def features(blocks: list[Block]) -> np.ndarray:
    """A row of ``FEATURES`` for each block of a page."""
    n = len(blocks)
    out = np.zeros((n, len(FEATURES)))
    if not n:
        return out
    words = np.array([b.words for b in blocks])
    linked = np.array([min(b.linked, b.words) for b in blocks])
    density = linked / np.maximum(words, 0.5)
    level = np.array([b.level for b in blocks], float)
    _, holder = np.unique([b.container for b in blocks], return_inverse=True)
    total = np.bincount(holder, words)
    out[:, 0], out[:, 1] = words, density
    out[1:, 2], out[1:, 3] = words[:-1], density[:-1]
    out[:-1, 4], out[:-1, 5] = words[1:], density[1:]
    out[:, 6], out[:, 7] = level, max(0.0, level.max()) - level
    out[:, 8], out[:, 9] = [b.heading for b in blocks], [b.item for b in blocks]
    out[:, 10], out[:, 11] = total[holder], (np.bincount(holder, linked) / np.maximum(total, 0.5))[holder]
    out[:, 12] = [b.words < 60 and bool(_LEGAL.search(b.text)) for b in blocks]
    return out


class Tree:
    """A fitted tree as arrays: feature and limit of inner nodes, children, class of leaves."""

    def __init__(self, root):
        rows: list[list] = []

        def add(node) -> int:
            i = len(rows)
            rows.append([-1, 0.0, i, i, float(node.prediction())])
            if node.getClass().getSimpleName() == "InternalNode":
                split = node.split()
                rows[i][:2] = split.featureIndex(), float(split.threshold())
                rows[i][2:4] = add(node.leftChild()), add(node.rightChild())
            return i

        add(root)
        self.feature, self.limit, self.left, self.right, self.value = (np.array(c) for c in zip(*rows, strict=True))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        at, row = np.zeros(len(x), np.int64), np.arange(len(x))
        while (self.feature[at] >= 0).any():  # a leaf is its own child
            at = np.where(x[row, self.feature[at]] <= self.limit[at], self.left[at], self.right[at])
        return self.value[at] > 0.5


def trained(spark: SparkSession, table: list[tuple[str, str]] | None = None, depth: int = DEPTH) -> Tree:
    """A tree learned from a small labelled table: pages, each with a 1 or 0 for each of its blocks."""
    if table is None:
        from sessionrank.llm.labelled_blocks import PAGES as table
    rows = []
    for page, labels in table:
        x, marks = features(text_blocks(page)), labels.split()
        if len(x) != len(marks):
            raise ValueError(f"{len(x)} blocks, {len(marks)} labels: {page[:80]}")
        rows += [(v, float(k)) for v, k in zip(x.tolist(), marks, strict=True)]
    known = spark.createDataFrame(rows, "x array<double>, label double").select(array_to_vector("x").alias("features"), "label").coalesce(1)
    model = DecisionTreeClassifier(maxDepth=depth, maxBins=64, seed=1).fit(known)
    return Tree(model._call_java("rootNode"))


def extracted(pages: DataFrame, tree: Tree | None = None, column: str = "html", name: str = "text") -> DataFrame:
    """Adds the main text of each page: the blocks that the tree keeps, in page order, joined by two line ends.

    A page becomes flat blocks (``text_blocks``), a block a row of word count and link density of itself, its
    neighbours and its container, and of what holds it: an article, something named like one, or what
    stands around one. Whole pages are read, and each in its row alone: no shuffle.

    Null, empty and text-free pages give the empty string. Text without any markup is one block. Repeated rows and
    other columns pass through; ``name`` gets underscores where the table has it; no rows give no rows.
    """
    name, tree = fresh(pages, name), tree or trained(pages.sparkSession)

    def kept(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            out: list[str] = []
            for a in range(0, len(batch), SLICE):
                found = [text_blocks(p or "") for p in batch.slice(a, SLICE).to_pylist()]
                cut = np.cumsum([0, *map(len, found)])
                good = tree(np.concatenate([features(b) for b in found])) if cut[-1] else np.zeros(0, bool)
                out += ["\n\n".join(b.text for b, k in zip(own, good[i:j].tolist(), strict=True) if k) for own, i, j in zip(found, cut[:-1], cut[1:], strict=True)]
            yield pa.array(out, pa.string())

    return pages.withColumn(name, arrow_udf(kept, "string")(F.col(column)))
