"""Main text of web pages from flat text blocks and a decision tree.

A page is cut into flat blocks at block-level tags. Every block has its word count and link density,
those of its neighbours before and after, and what encloses it (an article or main element; a menu,
header, footer, side, form or comment element; a class or id that names one). A decision tree decides
which blocks are the article; it is grown from the small labelled table below, with thresholds chosen
by the largest drop in Gini impurity.

Scripts, styles, comments and other invisible content never become blocks. Character references are
decoded, white space within a block becomes one space. Nothing is cut off, however long a page is or
deep its elements are, and time grows in proportion to it, malformed or not.

Defined results: a null or empty page has the empty text; a page without any block-level tag is one
block; unclosed tags end with the element around them; a `<` that no `>` outside quotes follows is text;
end tags without a start are passed over; repeated rows get equal results.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.llm.common import pick

# Which elements begin a block, hold nothing visible, never have an end tag, or enclose furniture or articles.
BLOCK = set([
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "menu", "nav", "ol",
    "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
])
HIDDEN = set([
    "script", "style", "noscript", "template", "head", "title", "iframe", "object", "svg", "canvas", "math", "audio", "video", "select",
    "textarea", "button", "option",
])
VOID = set(["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"])
FURNITURE = set(["nav", "header", "footer", "aside", "form", "menu", "dialog"])
ARTICLE = set(["article", "main"])
RAW = set(["script", "style", "textarea", "title"])
_NAMED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|adbox|adsbygoogle|adslot|alert|breadcrumbs?|byline|comment\w*|consent|cookies?|copyright|disclaimer|disqus|dropdown|foot|footer|gdpr|hidden|login|menu|meta|modal"
    r"|nav|navbar|navigation|newsletter|notice|overlay|pagination|pager|popup|promo\w*|recommend\w*|related|replies|reply|respond|search|share|sharing|sidebar|signup|skip|social|sponsor\w*|subscribe|toolbar|topbar|widget)(?:$|[\s_-])",
    re.I,
)
# These name a page's head, but inside an article its own.
_HEAD = re.compile(r"(?:^|[\s_-])(?:banner|head|header|masthead)(?:$|[\s_-])", re.I)
_ROLES = set([
    "navigation", "banner", "contentinfo", "complementary", "search", "form", "menu", "menubar", "dialog", "alertdialog", "toolbar",
])
_MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)", re.S)
_NAME_END = re.compile(r"[\s/>]")
_SPECIAL = re.compile(r"[>\"']")
_TAG = re.compile(r"<(/?)([A-Za-z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>")
_ATTRIBUTE = re.compile(r"([^\s=\"'>/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_CLOSES = {
    "p": {"p"}, "li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
#: Block elements that end an open paragraph.
_ENDS_P = BLOCK - {"body", "html"}


@dataclass
class Block:
    text: str
    words: int
    linked: int
    article: bool
    furniture: bool

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


class _Element(NamedTuple):
    """An open element with what holds inside it, and what stands below it in the stack."""

    name: str
    hidden: bool
    furniture: bool
    article: bool
    # Block elements below, and the nearest places at or below that end the search for an open paragraph or list item.
    blocks: int
    ends_p: int
    ends_item: int


_OUTSIDE = _Element("", False, False, False, 0, -1, -1)
_STOPS_P = FURNITURE | ARTICLE | {"div", "td", "section", "body"}
_STOPS_ITEM = {"ul", "ol", "dl", "table", "select", "div", "section"} | FURNITURE | ARTICLE


class _Flat:
    """Collects blocks while tags open and close. Every element is pushed and popped once, so time is linear in the tags."""

    def __init__(self):
        self.blocks: list[Block] = []
        self.parts: list[tuple[str, bool]] = []
        self.open: list[_Element] = []
        self.closed: set[int] = set()
        # Places of the open elements by name; those closed below open blocks have left it for `closed`.
        self.places: dict[str, list[int]] = {}
        self.n_blocks = 0

    def state(self) -> _Element:
        return self.open[-1] if self.open else _OUTSIDE

    def flush(self) -> None:
        text = " ".join("".join(p for p, _ in self.parts).split())
        if text:
            linked = sum(len(p.split()) for p, in_link in self.parts if in_link)
            around = self.state()
            self.blocks.append(Block(text, len(text.split()), linked, around.article, around.furniture))
        self.parts = []

    def text(self, raw: str) -> None:
        if raw and not self.state().hidden:
            self.parts.append((_decoded(raw), bool(self.places.get("a"))))

    def start(self, name: str, attributes: str) -> None:
        if name == "br":
            self.text("\n")
            return
        if name in BLOCK:
            self.flush()
            if name in _ENDS_P:
                self._close_open({"p"}, self.state().ends_p)
        if name in _CLOSES:
            self._close_open(_CLOSES[name], self.state().ends_item)
        if name in VOID:
            return
        if name == "a" and self.places.get("a"):
            # Links don't nest: one that begins ends the one before, but nothing inside that.
            self.closed.add(self.places["a"].pop())
            self._pop_to(len(self.open))
        around = self.state()
        names = roles = ""
        invisible = False
        for m in _ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
            if key in ("class", "id"):
                names += " " + value
            elif key == "role":
                roles = value.lower()
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                invisible = True
        inside = name in ARTICLE or around.article or roles in ("main", "article")
        # A heading group inside an article belongs to it; a header or footer around pages doesn't.
        own = name in FURNITURE and not (name == "header" and around.article) or roles in _ROLES or bool(
            names and name not in ("html", "body", *ARTICLE) and (_NAMED.search(names) or not inside and _HEAD.search(names))
        )
        place = len(self.open)
        self.open.append(
            _Element(
                name, around.hidden or name in HIDDEN or invisible, around.furniture or own, inside, self.n_blocks,
                place if name in _STOPS_P else around.ends_p, place if name in _STOPS_ITEM else around.ends_item,
            )
        )
        self.places.setdefault(name, []).append(place)
        self.n_blocks += name in BLOCK

    def _pop_to(self, place: int) -> None:
        """Closes the element at a place and all above it, then those below that had been closed already."""
        while len(self.open) > place or len(self.open) - 1 in self.closed:
            gone = self.open.pop()
            if len(self.open) in self.closed:
                self.closed.remove(len(self.open))
            else:
                self.places[gone.name].pop()
                self.n_blocks -= gone.name in BLOCK

    def _close_open(self, names: set[str], stop: int) -> None:
        place = max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)
        if place > stop:
            self.flush()
            self._pop_to(place)

    def end(self, name: str) -> None:
        if name in BLOCK:
            self.flush()
        places = self.places.get(name)
        if not places:
            return
        # An inline end tag doesn't close the block elements opened since.
        if name not in BLOCK and self.n_blocks > self.open[places[-1]].blocks:
            self.closed.add(places.pop())
        else:
            self._pop_to(places[-1])


def _decoded(raw: str) -> str:
    """Character references decoded; numbers of any length, those beyond Unicode as the replacement character."""
    if "&#" in raw:
        raw = re.sub(r"&#0{8,}(?=[0-9])", "&#", raw)
        raw = re.sub(r"&#[0-9]{8,};?", "\ufffd", raw)
    return unescape(raw)


class _Tags:
    """Tags by the place of their `<`, in linear time for a whole page.

    A tag ends at the first `>` outside quotes; with none, its `<` is text. A match that succeeds is
    paid for by the text it passes. The first that fails has the ends after all quotes and `>` worked
    out once, from the back, so that no later one reads to the end of the page again.
    """

    def __init__(self, html: str):
        self.html = html
        self.name_end = -1
        self.at: list[int] | None = None
        self.end: list[int] = []

    def read(self, begin: int) -> tuple[bool, str, str, int] | None:
        """Whether it is an end tag, its name, its attributes and the place after it."""
        if self.at is None:
            m = _TAG.match(self.html, begin)
            if m:
                return m[1] == "/", m[2].lower(), m[3], m.end()
        closes = self.html.startswith("/", begin + 1)
        first = begin + 1 + closes
        letter = self.html[first : first + 1]
        if not (letter.isascii() and letter.isalpha()):
            return None
        if self.at is None:
            self._work_out(begin)
        if self.name_end < first:
            m = _NAME_END.search(self.html, first)
            self.name_end = m.start() if m else len(self.html)
        i = bisect_left(self.at, self.name_end)
        if self.end[i] < 0:
            return None
        return closes, self.html[first : self.name_end].lower(), self.html[self.name_end : self.end[i] - 1], self.end[i]

    def _work_out(self, begin: int) -> None:
        self.at = [m.start() for m in _SPECIAL.finditer(self.html, begin)]
        self.end = [-1] * (len(self.at) + 1)
        after = {'"': -1, "'": -1}
        for i in range(len(self.at) - 1, -1, -1):
            sign = self.html[self.at[i]]
            if sign == ">":
                self.end[i] = self.at[i] + 1
                continue
            if after[sign] >= 0:
                self.end[i] = self.end[after[sign] + 1]
            after[sign] = i


def blocks(html: str) -> list[Block]:
    """Flat text blocks of a page in page order."""
    flat = _Flat()
    tags = _Tags(html)
    at = 0
    while True:
        begin = html.find("<", at)
        if begin < 0:
            flat.text(html[at:])
            break
        if html.startswith(("<!", "<?"), begin):
            flat.text(html[at:begin])
            at = _MARKUP.match(html, begin).end()
            continue
        tag = tags.read(begin)
        if tag is None:
            flat.text(html[at : begin + 1])
            at = begin + 1
            continue
        flat.text(html[at:begin])
        closes, name, attributes, at = tag
        if closes:
            flat.end(name)
            continue
        flat.start(name, attributes)
        if attributes.endswith("/") and name in HIDDEN:
            flat.end(name)
        elif name in RAW:
            # Raw text has no tags; it ends with its own end tag, or with the page.
            closing = re.compile(rf"</{name}\b[^>]*>?", re.I).search(html, at)
            at = closing.end() if closing else len(html)
            flat.end(name)
    flat.flush()
    return flat.blocks


def features(page: list[Block]) -> np.ndarray:
    """Per block: article, furniture, then words and link density of the block before, itself and the next."""
    n = len(page)
    words = np.array([0, *[b.words for b in page], 0], dtype=float)
    density = np.array([0, *[b.density for b in page], 0], dtype=float)
    inside = np.array([[b.article, b.furniture] for b in page], dtype=float).reshape(n, 2)
    return np.column_stack([inside, words[:-2], words[1:-1], words[2:], density[:-2], density[1:-1], density[2:], np.full(n, float(any(b.article for b in page)))])


NAMES = ("in_article", "in_furniture", "words_before", "words", "words_after", "density_before", "density", "density_after", "page_has_article")

# Blocks labelled by hand, with the features above and whether they belong to the article.
LABELLED = [
    # Paragraphs, headings and short lines of pages with an article element.
    (1, 0, 0, 9, 60, 0.0, 0.0, 0.0, 1, 1), (1, 0, 9, 60, 45, 0.0, 0.0, 0.0, 1, 1), (1, 0, 60, 2, 45, 0.0, 0.0, 0.0, 1, 1),
    (1, 0, 45, 1, 0, 0.0, 0.0, 0.0, 1, 1), (1, 0, 3, 9, 2, 0.0, 0.0, 0.0, 1, 1), (1, 0, 80, 25, 12, 0.0, 0.2, 1.0, 1, 1),
    (1, 0, 12, 120, 4, 1.0, 0.05, 0.0, 1, 1), (1, 0, 1, 3, 1, 1.0, 0.0, 0.0, 1, 1), (1, 0, 40, 3, 40, 0.0, 1.0, 0.0, 1, 1),
    (1, 0, 7, 1, 90, 0.0, 0.0, 0.1, 1, 1), (1, 0, 10, 15, 10, 0.0, 0.5, 0.0, 1, 1),
    # Furniture, inside an article element or not.
    (1, 1, 40, 3, 3, 0.0, 1.0, 1.0, 1, 0), (1, 1, 40, 30, 25, 0.0, 0.0, 0.0, 1, 0), (0, 1, 0, 1, 1, 0.0, 1.0, 1.0, 1, 0),
    (0, 1, 1, 9, 10, 1.0, 0.0, 0.0, 1, 0), (0, 1, 70, 14, 0, 0.0, 0.0, 0.0, 1, 0), (1, 1, 50, 60, 60, 0.0, 0.0, 0.0, 1, 0),
    (0, 1, 5, 50, 5, 0.0, 0.1, 0.0, 0, 0), (0, 1, 2, 2, 2, 1.0, 1.0, 1.0, 0, 0), (0, 1, 90, 40, 0, 0.0, 0.0, 0.0, 0, 0),
    (0, 1, 30, 22, 30, 0.0, 0.0, 0.0, 0, 0), (0, 1, 60, 80, 60, 0.0, 0.0, 0.0, 0, 0),
    # Outside the article of a page that has one.
    (0, 0, 1, 10, 9, 1.0, 0.0, 0.0, 1, 0), (0, 0, 45, 20, 0, 0.0, 0.0, 0.0, 1, 0), (0, 0, 3, 2, 9, 1.0, 1.0, 0.0, 1, 0),
    (0, 0, 45, 60, 20, 0.0, 0.0, 0.0, 1, 0), (0, 0, 0, 5, 60, 0.0, 0.0, 0.0, 1, 0), (0, 0, 60, 40, 6, 0.0, 0.3, 1.0, 1, 0),
    # Pages without such an element: words and links of the block and its neighbours decide.
    (0, 0, 9, 60, 45, 0.0, 0.0, 0.0, 0, 1), (0, 0, 60, 45, 2, 0.0, 0.05, 0.0, 0, 1), (0, 0, 45, 12, 60, 0.0, 0.0, 0.0, 0, 1),
    (0, 0, 2, 30, 40, 1.0, 0.0, 0.0, 0, 1), (0, 0, 40, 3, 50, 0.0, 0.0, 0.0, 0, 1), (0, 0, 0, 8, 70, 0.0, 0.0, 0.0, 0, 1),
    (0, 0, 60, 25, 3, 0.0, 0.1, 1.0, 0, 1), (0, 0, 25, 20, 18, 0.0, 0.0, 0.0, 0, 1), (0, 0, 1, 100, 1, 1.0, 0.0, 1.0, 0, 1),
    (0, 0, 30, 1, 28, 0.0, 0.0, 0.0, 0, 1), (0, 0, 0, 40, 0, 0.0, 0.0, 0.0, 0, 1), (0, 0, 0, 15, 0, 0.0, 0.0, 0.0, 0, 1),
    (0, 0, 0, 6, 0, 0.0, 0.0, 0.0, 0, 1), (0, 0, 0, 2, 0, 0.0, 0.0, 0.0, 0, 1),
    (0, 0, 8, 11, 0, 0.8, 0.0, 0.0, 0, 1), (0, 0, 12, 14, 0, 0.9, 0.0, 0.0, 0, 1), (0, 0, 4, 9, 0, 1.0, 0.0, 0.0, 0, 1),
    (0, 0, 3, 12, 3, 1.0, 0.0, 1.0, 0, 1), (0, 0, 10, 18, 9, 0.7, 0.1, 0.8, 0, 1), (0, 0, 20, 4, 25, 0.6, 0.0, 0.6, 0, 1),
    (0, 0, 0, 2, 2, 0.0, 1.0, 1.0, 0, 0), (0, 0, 2, 2, 2, 1.0, 1.0, 1.0, 0, 0), (0, 0, 3, 4, 60, 1.0, 1.0, 0.0, 0, 0),
    (0, 0, 60, 5, 3, 0.0, 0.8, 1.0, 0, 0), (0, 0, 2, 8, 2, 1.0, 0.6, 1.0, 0, 0), (0, 0, 5, 20, 5, 1.0, 0.7, 1.0, 0, 0),
    (0, 0, 3, 3, 3, 1.0, 0.0, 1.0, 0, 0), (0, 0, 2, 6, 1, 1.0, 0.0, 1.0, 0, 0), (0, 0, 40, 12, 3, 0.0, 0.9, 1.0, 0, 0),
    (0, 0, 3, 3, 0, 1.0, 1.0, 0.0, 0, 0), (0, 0, 4, 30, 4, 0.9, 0.6, 0.9, 0, 0),
]


def grow(rows: np.ndarray, labels: np.ndarray, depth: int = 8) -> tuple:
    """A tree as (feature, threshold, left, right), or a leaf's label; left holds values up to the threshold."""
    if depth == 0 or labels.min() == labels.max():
        return (bool(labels.mean() >= 0.5),)
    best = None
    for f in range(rows.shape[1]):
        values = np.unique(rows[:, f])
        for t in (values[1:] + values[:-1]) / 2:
            low = rows[:, f] <= t
            n, k = low.sum(), len(low) - low.sum()
            p, q = labels[low].mean(), labels[~low].mean()
            impurity = n * p * (1 - p) + k * q * (1 - q)
            if best is None or impurity < best[0] - 1e-12:
                best = (impurity, f, float(t), low)
    if best is None:
        return (bool(labels.mean() >= 0.5),)
    _, f, t, low = best
    return f, t, grow(rows[low], labels[low], depth - 1), grow(rows[~low], labels[~low], depth - 1)


def classify(tree: tuple, rows: np.ndarray) -> np.ndarray:
    if len(tree) == 1:
        return np.full(len(rows), tree[0])
    f, t, low_tree, high_tree = tree
    out = np.zeros(len(rows), dtype=bool)
    low = rows[:, f] <= t
    out[low] = classify(low_tree, rows[low])
    out[~low] = classify(high_tree, rows[~low])
    return out


def train(labelled: list[tuple] = LABELLED) -> tuple:
    table = np.array(labelled, dtype=float)
    return grow(table[:, :-1], table[:, -1])


def main_text(html: str | None, tree: tuple) -> str:
    page = blocks(html or "")
    if not page:
        return ""
    keep = classify(tree, features(page))
    return "\n".join(b.text for b, k in zip(page, keep, strict=True) if k)


def extract(pages: DataFrame, tree: tuple | None = None) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""
    plain = pick(pages, "page_id", "url", "html").select(F.col("page_id").cast("bigint"), "url", "html")
    grown = tree or train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py(), grown) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return plain.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
