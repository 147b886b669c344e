"""Main text of web pages from flat text blocks and a decision tree.

A page is cut into flat text blocks at block-level tags. Each block has its word count and link density, those of its
neighbours and of the container it stands in, and what its tags say. A decision tree grown on a small table of labelled
blocks (:func:`labelled`, made of the pages in ``labelled_pages``) says which blocks belong to the main text. Class names are one
feature among others, and count only if a whole name is one that is used for such things (``sidebar``, not ``has-sidebar``). Half of the labelled pages have no article tags, so that
the tree has to go by the other features as well.

Defined results: null and empty html have the text ''; very long pages are read whole, in time that grows with their length whatever is nested or
left open in them; unclosed, stray and nested tags are taken as they come; only script, style, title and textarea run to the end of a page if they are not
closed; a link that is not closed before the next one is none; splits of equal worth go to the first feature and the least limit, a leaf with as many labels of either kind is main text; whatever is not a tag is text; repeated rows give equal results; an empty table gives an empty result; other columns stay, but for those named text and n_chars.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import boxed, scan, table, unboxed
from .labelled_pages import MAIN, pages

FEATURES = (
    "words", "links", "words_before", "links_before", "words_after", "links_after", "words_around", "links_around", "blocks_around",
    "heading", "item", "in_story", "in_side", "named_side", "page_words",
)


@dataclass
class Node:
    feature: int = -1
    limit: float = 0.0
    label: int = 0
    low: Node | None = None
    high: Node | None = None


def grow(x: np.ndarray, y: np.ndarray, depth: int = 8, least: int = 3) -> Node:
    """A tree of binary splits, each the one that lowers the Gini impurity most and leaves ``least`` rows on either side."""
    node = Node(label=int(2 * y.sum() >= len(y)))
    if depth == 0 or y.min() == y.max():
        return node
    impurity = lambda v: len(v) * (p := v.mean()) * (1 - p) if len(v) else 0.0
    best = impurity(y) - 1e-9
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        for limit in (values[1:] + values[:-1]) / 2:
            low = x[:, f] <= limit
            if min(low.sum(), (~low).sum()) >= least and (left := impurity(y[low]) + impurity(y[~low])) < best - 1e-12:
                best, node.feature, node.limit = left, f, float(limit)
    if node.feature >= 0:
        low = x[:, node.feature] <= node.limit
        node.low, node.high = grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1)
    return node


def says(node: Node, row: tuple[float, ...]) -> int:
    while node.feature >= 0:
        node = node.low if row[node.feature] <= node.limit else node.high
    return node.label


_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][\w:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
# Kinds of elements.
_RAW = frozenset("script style title textarea".split())
_DROPPED = frozenset("noscript template svg iframe object select button".split())
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr math mi mn mo ms mtext mrow mfrac msqrt mroot msub msup msubsup munder mover mspace semantics".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_SELF_ENDING = frozenset("p li dt dd tr td th option thead tbody tfoot caption h1 h2 h3 h4 h5 h6 pre".split())
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_ITEMS = frozenset("li dt dd td th option".split())
#: Items that may hold blocks.
_HOLDING = frozenset("li dt dd td th tr".split())
_SIDES = frozenset("nav aside form menu dialog fieldset head footer".split())
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert".split())
#: Whole class or id names of what is not main text.
_NAMED = re.compile(
    r"(?:ads?|advert(?:isement|ising)?s?|banner|sponsor(?:ed)?|promo(?:tion)?)(?:[-_](?:box|slot|unit|container|wrapper|banner|block|\d+))?"
    r"|comments?(?:[-_](?:list|section|form|thread|area|body|respond|reply|wrap(?:per)?|box|\d+))?|respond|repl(?:y|ies)|disqus_thread|sidebar(?:[-_]\w+)?|rail|related(?:[-_]\w+)?|recommend(?:ed|ations)"
    r"|menu|nav(?:bar|igation)?|breadcrumbs?|masthead|topbar|(?:site|page)[-_]?(?:header|footer|nav)|(?:cookies?|consent|gdpr)(?:[-_](?:notice|banner|bar|popup|consent|message))?|notice|disclaimer"
    r"|alert|popup|modal|(?:newsletter|subscri(?:be|ption))(?:[-_](?:signup|box|form|banner))?|signup|login|shar(?:e|ing)(?:[-_]\w+)?|social(?:[-_]\w+)?|widget|toolbar|pagination|pager|search(?:[-_]form)?|copyright|skip[-_]link",
    re.I,
)
_STORY = re.compile(r"(?:article|article-?body|post-?body|entry-?content|post-?content|main-?content|story-?body|story)", re.I)
_ATTRIBUTE = re.compile(r"(?<![\w-])(class|id|role|style|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_LINK = re.compile(r"<a[\s>]", re.I)
_WORD = re.compile(r"\S+")
PLAIN, STORY, SIDE, NAMED = range(4)


def _kind(name: str, attributes: str, in_story: bool) -> int:
    """What an element's tag says about the text in it."""
    if name in _SIDES or name == "header" and not in_story:
        return SIDE
    out = STORY if name in ("article", "main") else PLAIN
    if not attributes or name in ("body", "html"):
        return out
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), (m[2] or "").strip("\"'")
        unseen = key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and _UNSEEN.search(value)
        if unseen or key == "role" and value.lower() in _ROLES:
            return SIDE
        if key in ("class", "id"):
            names = value.split()
            if any(_STORY.fullmatch(x) for x in names) or key == "role" and value.lower() in ("main", "article"):
                out = STORY
            elif out != STORY and any(_NAMED.fullmatch(x) for x in names):
                out = NAMED
    return out


@dataclass
class Block:
    pieces: list[str] = field(default_factory=list)
    words: int = 0
    linked: int = 0
    tag: str = ""
    container: int = 0
    place: int = PLAIN

    @property
    def text(self) -> str:
        return " ".join("".join(self.pieces).split())


class _Closings:
    """Where each dropped element's closing tags are, found once for a page."""

    def __init__(self, page: str):
        self.page, self.at, self.links = page, {}, None

    def after(self, name: str, position: int) -> int | None:
        """The end of the next closing tag."""
        if name not in self.at:
            found = [(m.start(), m.end()) for m in re.finditer(rf"</{name}\s*>", self.page, re.I)]
            self.at[name] = ([s for s, _ in found], [e for _, e in found])
        starts, ends = self.at[name]
        k = bisect_left(starts, position)
        return ends[k] if k < len(ends) else None

    def closed(self, position: int) -> bool:
        """Whether a link that opens before ``position`` is closed before the next one opens: it may then hold whole blocks."""
        if self.links is None:
            self.links = [m.start() for m in _LINK.finditer(self.page)]
        k, end = bisect_left(self.links, position), self.after("a", position)
        return end is not None and (k == len(self.links) or end <= self.links[k])


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order. A container is the innermost element that is no paragraph, heading or item."""
    out: list[Block] = []
    stack: list[tuple[str, int, int]] = []  # name, kind with what is above, container
    opened: Counter = Counter()
    closings, containers = _Closings(page), 0
    now, link = Block(), 0
    held: tuple[str, int, int] | None = None  # an item or paragraph that says what its text is: name, kind, depth

    def end() -> None:
        nonlocal now
        if now.words:
            above = stack[-1] if stack else ("", PLAIN, 0)
            now.container, now.place = above[2], held[1] if held else above[1]
            out.append(now)
        now = Block()

    def add(raw: str) -> None:
        text = entities.unescape(raw) if "&" in raw else raw
        n = len(_WORD.findall(text))
        now.pieces.append(text)
        now.words += n
        now.linked += n if link else 0

    at, tag = 0, ""
    while m := _TAG.search(page, at):
        if m.start() > at:
            now.tag = now.tag or tag
            add(page[at : m.start()])
        at = m.end()
        name, closing = (m[2] or "").lower(), bool(m[1])
        if not name:
            continue
        if not closing and name in _RAW | _DROPPED and not m[3].rstrip().endswith("/"):
            until = closings.after(name, at)
            if until is not None or name in _RAW:
                at = len(page) if until is None else until
                now.pieces.append(" ")
            continue
        if name == "a":
            link = int(not closing and closings.closed(at))
        if name == "br":
            now.pieces.append(" ")
        if name in _INLINE or name in _DROPPED or name in _RAW:
            continue
        end()
        tag = "" if closing else name
        # it may never be closed: another one of its kind ends it, the end of what it stands in, and a paragraph any block
        if held and len(stack) <= held[2] and (held[0] == name or held[0] not in _HOLDING and name not in _VOID):
            held = None
        if name in _VOID:
            continue
        above = stack[-1] if stack else ("", PLAIN, 0)
        if name in _SELF_ENDING:
            if not closing and m[3] and not held and (said := _kind(name, m[3], True)) in (SIDE, NAMED):
                held = (name, said, len(stack))
            continue
        if closing:
            if opened[name]:
                while stack:
                    top = stack.pop()
                    opened[top[0]] -= 1
                    if top[0] == name:
                        break
                if held and len(stack) < held[2]:
                    held = None
        else:
            said = _kind(name, m[3], above[1] == STORY)
            kind = above[1] if said == PLAIN or above[1] == SIDE else said
            containers += 1
            stack.append((name, kind, containers))
            opened[name] += 1
    if at < len(page):
        now.tag = now.tag or tag
        add(page[at:])
    end()
    return out


def features(found: list[Block]) -> list[tuple[float, ...]]:
    """A row of :data:`FEATURES` for each block of a page."""
    words, linked, n = Counter(), Counter(), Counter()
    for b in found:
        words[b.container] += b.words
        linked[b.container] += b.linked
        n[b.container] += 1
    total = float(sum(b.words for b in found))
    share = [b.linked / b.words for b in found]
    rows = []
    for k, b in enumerate(found):
        before = (found[k - 1].words, share[k - 1]) if k else (0, 0.0)
        after = (found[k + 1].words, share[k + 1]) if k + 1 < len(found) else (0, 0.0)
        c = b.container
        rows.append((
            b.words, share[k], *before, *after, words[c], linked[c] / words[c], n[c], float(b.tag in _HEADINGS), float(b.tag in _ITEMS),
            float(b.place == STORY), float(b.place == SIDE), float(b.place == NAMED), total,
        ))
    return rows


@lru_cache(maxsize=1)
def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Features and labels of the labelled pages' blocks."""
    x, y = [], []
    for page in pages():
        found = blocks(page)
        x += features(found)
        y += [float(MAIN in b.text) for b in found]
    return np.array(x), np.array(y)


@lru_cache(maxsize=1)
def tree() -> Node:
    return grow(*labelled())


def main_text(page: str | None, judge: Node | None = None) -> str:
    """The blocks of main text, one a line."""
    if not page:
        return ""
    found, judge = blocks(page), judge or tree()
    return "\n".join(b.text for b, row in zip(found, features(found), strict=True) if says(judge, row))


def extracted(web: DataFrame) -> DataFrame:
    """``web`` (html and others) with text and n_chars in place of html; columns of those names are replaced."""
    judge = tree()  # some dozens of nodes, sent along with the tasks

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(x, judge) for x in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["row", "main", "n_chars"])

    rows = boxed(web, text="html")
    schema = T.StructType([rows.schema.fields[0], T.StructField("main", T.StringType()), T.StructField("n_chars", T.LongType())])
    out = scan(rows, read, schema).withColumnRenamed("main", "text")
    return unboxed(out, web, "text", "n_chars", without=("html", "text", "n_chars"), text="html")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extracted(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")
