"""Main text of web pages from flat text blocks.

A page becomes a flat list of text blocks. A block is described by its own and its neighbours'
word counts and link densities, and by what it lies in: whether in an article, and how much the
elements around it look like menus, notices, adverts and the like. A decision tree, grown from the
small labelled table below, says which blocks are main text. No class word decides alone: a name is
as strong as the share of its words that speak for it, and names of paragraphs, headings and other
text elements say nothing.

Rows are independent: one narrow pass, no shuffle, one page in memory at a time, in time linear in
the page: paragraphs, list items and cells end where the next begins, and nothing walks the stack
of open elements but to close them.

Defined results: a null or empty page, and one without main text, gives ""; broken or cut
markup is read as far as it goes (an unclosed comment, script or tag runs to the end); pages
of any length are read whole; repeated rows stay; an empty table gives an empty table; other
columns are carried along, except ones named like a result, which are replaced.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lapforge.llm.arrow import texts, with_columns

# Element names by role, and words in class, id or role that mark what is not main text.
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr br".split()
)
VOID = set("area base br col embed hr img input link meta source track wbr param".split())
SILENT = set(
    "script style noscript template iframe object svg math canvas audio video select textarea button head title option".split()
)
OUTSIDE = set("nav footer aside form menu dialog fieldset".split())
MAIN = set("article main".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# Elements that hold text of their own; what they are called does not make them a menu or notice.
TEXTS = HEADINGS | set("p li blockquote pre td th tr tbody thead table dd dt figure figcaption html body".split())
# What ends an open paragraph; items and cells that end each other; what they are looked for in.
BREAKS = TEXTS - {"html", "body"} | OUTSIDE | MAIN | set("div section header hr address center details summary ul ol dl".split())
SIBLINGS = {"li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")}
SCOPES = set("ul ol dl table td th div section article main aside nav header footer form blockquote".split())
STRONG = set(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored nav navbar navigation menu menus masthead "
    "footer sidebar sharing social cookie cookies consent notice notices alert popup modal overlay newsletter subscribe signup "
    "login breadcrumb breadcrumbs pagination pager comment comments reply replies disqus gdpr contentinfo complementary".split()
)
WEAK = set(
    "promo promotion header side aside widget related recommended share toolbar skip copyright legal disclaimer search dialog".split()
)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*+)((?:\"[^\"]*\"|'[^']*'|[^'\">])*+)(?:>|\Z)|<(/?)([A-Za-z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.DOTALL,
)
_MARKS = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.IGNORECASE)
_HINT_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_EMPTY = re.compile(r"(?:^|[\s\"'])/$")
_BODY = re.compile(r"itemprop\s*=\s*[\"']?articleBody")
RAW = {
    t: re.compile(rf"</{t}\b[^>]*(?:>|\Z)", re.IGNORECASE) for t in "script style title textarea noscript template iframe".split()
}

FEATURES = ("hint", "inside", "heading", "words", "links", "words_before", "links_before", "words_after", "links_after")

# The labelled table: FEATURES, then 1 for main text. Examples of our own: blocks of articles,
# of pages without an article element, menus, notices, comments and adverts.
LABELLED = np.array(
    [
        # Text of an article, whatever stands before and after it.
        (0, 1, 1, 8, 0, 8, 0, 60, 0, 1), (0, 1, 0, 60, 0, 8, 0, 45, 0, 1), (0, 1, 0, 2, 0, 45, 0, 70, 0, 1),
        (0, 1, 0, 1, 0, 3, 1, 2, 0, 1), (0, 1, 0, 120, 0.1, 60, 0, 12, 0, 1), (0, 1, 0, 5, 0.2, 80, 0, 0, 0, 1),
        (0, 1, 1, 3, 0, 40, 0, 55, 0.1, 1), (0, 1, 0, 18, 0.4, 90, 0, 70, 0, 1), (0, 1, 0, 9, 0, 0, 0, 0, 0, 1),
        (0, 1, 0, 300, 0, 0, 0, 1, 1, 1), (0, 1, 0, 30, 0, 1, 1, 10, 0.5, 1), (0, 1, 0, 4, 1, 90, 0, 80, 0, 1),
        (0, 1, 0, 20, 0, 40, 0, 1, 1, 1), (0, 1, 0, 3, 0, 1, 1, 2, 1, 1), (0, 1, 1, 6, 0, 1, 1, 3, 1, 1),
        (0, 1, 0, 6, 0.5, 30, 0, 2, 1, 1), (0, 1, 0, 11, 0, 3, 1, 1, 1, 1), (0, 1, 0, 55, 0, 4, 0.9, 1, 1, 1),
        (0, 1, 0, 1, 0, 1, 0, 1, 0, 1), (0, 1, 0, 1, 0, 1, 1, 1, 1, 1), (0, 1, 1, 2, 0, 2, 1, 2, 1, 1),
        (0, 1, 0, 7, 1, 40, 0, 35, 0.1, 1), (0, 1, 0, 3, 1, 25, 0, 4, 0, 1), (0, 1, 1, 9, 1, 1, 1, 50, 0, 1),
        (0, 1, 0, 45, 0.5, 50, 0.2, 40, 0.3, 1), (0, 1, 0, 2, 0.5, 2, 0.5, 2, 0.5, 1), (0, 1, 0, 15, 0.9, 60, 0, 50, 0, 1),
        (0, 1, 0, 8, 1, 1, 1, 70, 0, 1), (0, 1, 0, 5, 1, 70, 0, 1, 1, 1), (0, 1, 0, 6, 0, 6, 1, 6, 1, 1),
        # A link by itself, where not both sides are links.
        (0, 1, 0, 1, 1, 1, 0, 1, 0, 1), (0, 1, 0, 2, 1, 3, 0, 2, 0, 1), (0, 1, 0, 3, 1, 8, 0, 0, 0, 1),
        (0, 1, 0, 4, 1, 6, 0, 5, 1, 1), (0, 1, 0, 2, 1, 5, 1, 4, 0, 1), (0, 1, 0, 6, 1, 2, 1, 9, 0.2, 1),
        (0, 1, 0, 1, 1, 0, 0, 3, 1, 1), (0, 1, 0, 9, 1, 12, 0.1, 8, 1, 1), (0, 1, 0, 5, 0.8, 4, 1, 15, 0, 1),
        (0, 1, 0, 12, 1, 30, 0, 25, 1, 1), (0, 1, 0, 7, 1, 9, 1, 30, 0, 1), (0, 1, 0, 2, 1, 2, 1, 0, 0, 1),
        # Rows of links inside an article: further reading, tags, tables of contents.
        (0, 1, 0, 3, 1, 2, 1, 4, 1, 0), (0, 1, 0, 1, 1, 2, 1, 1, 1, 0), (0, 1, 0, 2, 1, 1, 1, 1, 1, 0),
        (0, 1, 0, 6, 1, 5, 1, 6, 1, 0), (0, 1, 0, 9, 1, 8, 1, 7, 1, 0), (0, 1, 0, 4, 1, 6, 1, 5, 1, 0),
        (0, 1, 0, 5, 0.9, 4, 1, 3, 0.9, 0), (0, 1, 0, 2, 1, 3, 0.9, 2, 1, 0), (0, 1, 0, 12, 1, 10, 1, 9, 1, 0),
        # Menus, footers, forms, notices, adverts and comments by element or name, in an article or not.
        (1, 0, 0, 1, 1, 0, 0, 1, 1, 0), (1, 0, 0, 1, 1, 1, 1, 12, 0, 0), (1, 0, 0, 12, 0, 1, 1, 8, 0, 0),
        (1, 0, 0, 60, 0, 1, 1, 9, 0, 0), (1, 0, 1, 3, 0, 50, 0, 1, 1, 0), (1, 1, 0, 40, 0, 60, 0, 55, 0, 0),
        (1, 1, 0, 2, 1, 60, 0, 3, 1, 0), (1, 1, 1, 2, 0, 80, 0, 25, 0, 0), (1, 0, 0, 200, 0, 150, 0, 12, 0, 0),
        (1, 0, 0, 9, 0.1, 70, 0, 0, 0, 0), (1, 1, 0, 90, 0.1, 20, 0, 30, 0, 0), (1, 0, 0, 25, 0.3, 2, 1, 2, 1, 0),
        (1, 1, 0, 15, 0, 3, 0, 4, 0, 0), (1, 1, 0, 70, 0, 0, 0, 0, 0, 0), (1, 0, 0, 120, 0, 0, 0, 0, 0, 0),
        # Names that only half say so: what they hold decides.
        (0.5, 1, 0, 50, 0, 60, 0, 40, 0, 1), (0.5, 1, 0, 25, 0.1, 40, 0, 50, 0, 1), (0.5, 1, 1, 5, 0, 30, 0, 40, 0, 1),
        (0.6, 1, 0, 35, 0, 10, 0, 45, 0, 1), (0.4, 1, 0, 12, 0.2, 50, 0, 60, 0, 1), (0.3, 1, 0, 8, 0, 30, 0, 20, 0, 1),
        (0.5, 1, 0, 4, 1, 60, 0, 5, 1, 0), (0.5, 1, 0, 6, 1, 4, 1, 5, 1, 0), (0.5, 1, 0, 9, 0.9, 50, 0, 8, 1, 0),
        (0.6, 1, 0, 3, 0.8, 40, 0, 30, 0, 0), (0.5, 0, 0, 4, 0.8, 3, 1, 6, 0.9, 0), (0.5, 0, 0, 3, 0, 5, 1, 2, 1, 0),
        (0.5, 0, 0, 8, 0, 2, 1, 4, 1, 0), (0.5, 0, 1, 4, 0, 2, 1, 3, 1, 0), (0.5, 0, 0, 70, 0, 60, 0, 80, 0, 1),
        (0.4, 0, 0, 45, 0.1, 50, 0, 60, 0, 1), (0.5, 0, 0, 12, 0, 0, 0, 2, 1, 0), (0.5, 0, 0, 30, 0, 2, 1, 1, 1, 0),
        # Pages without an article element.
        (0, 0, 0, 60, 0, 8, 0, 45, 0, 1), (0, 0, 0, 35, 0.05, 50, 0, 70, 0, 1), (0, 0, 0, 90, 0.1, 2, 1, 3, 1, 1),
        (0, 0, 1, 6, 0, 3, 1, 60, 0, 1), (0, 0, 1, 9, 0, 40, 0, 55, 0, 1), (0, 0, 0, 12, 0, 50, 0, 60, 0, 1),
        (0, 0, 0, 6, 0, 45, 0.1, 30, 0, 1), (0, 0, 0, 22, 0, 30, 0, 4, 0.5, 1), (0, 0, 0, 150, 0.2, 0, 0, 0, 0, 1),
        (0, 0, 0, 1, 1, 1, 1, 1, 1, 0), (0, 0, 0, 2, 1, 0, 0, 2, 1, 0), (0, 0, 0, 3, 0, 1, 1, 2, 1, 0),
        (0, 0, 0, 5, 0, 4, 0, 3, 0, 0), (0, 0, 0, 40, 0.9, 3, 1, 5, 1, 0), (0, 0, 0, 25, 0.7, 60, 0, 3, 1, 0),
        (0, 0, 0, 8, 0, 2, 1, 1, 1, 0), (0, 0, 0, 6, 0.8, 70, 0, 60, 0, 0), (0, 0, 1, 2, 1, 5, 1, 3, 1, 0),
        (0, 0, 0, 4, 0, 0, 0, 2, 1, 0), (0, 0, 0, 7, 0, 5, 0.6, 0, 0, 0), (0, 0, 1, 3, 0, 2, 1, 2, 1, 0),
        (0, 0, 0, 32, 1, 90, 0, 96, 0, 0), (0, 0, 0, 28, 1, 60, 0, 50, 0, 0), (0, 0, 0, 12, 0.9, 40, 0, 35, 0, 0),
        (0, 0, 0, 40, 0.8, 70, 0, 60, 0, 0), (0, 0, 0, 15, 0.95, 20, 0, 80, 0.1, 0), (0, 0, 0, 50, 0.3, 70, 0, 60, 0, 1),
    ],
    float,
)


@dataclass
class Block:
    """One text block: its text, its words and linked words, and what it lies in."""

    parts: list[str] = field(default_factory=list)
    linked: int = 0
    hint: float = 0.0
    inside: bool = False
    heading: bool = False

    @property
    def text(self) -> str:
        return " ".join("".join(self.parts).split())


class Open(NamedTuple):
    """An open element: its name, what holds inside it, and whether a paragraph, an item or a cell is
    open that the next one of its kind ends."""

    tag: str = ""
    hint: float = 0.0
    inside: bool = False
    silent: bool = False
    ends: frozenset = frozenset()


def name_strength(attributes: str) -> float:
    """How much the class, id and role say that this is no main text: the largest share of a name's
    words that speak for it, weak words counting half."""
    best = 0.0
    for found in _MARKS.finditer(attributes):
        for name in (found[1] or found[2] or found[3] or "").split():
            words = [w.lower() for w in _HINT_WORD.findall(name)]
            if words:
                best = max(best, sum(1.0 if w in STRONG else 0.5 * (w in WEAK) for w in words) / len(words))
    return best


def _hint(tag: str, attributes: str, inside: bool) -> float:
    if tag in OUTSIDE or (tag == "header" and not inside):
        return 1.0
    return 0.0 if tag in TEXTS or not attributes else name_strength(attributes)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order; text that no reader sees is left out."""
    out: list[Block] = []
    now = Block()
    stack = [Open()]
    count: dict[str, int] = {}  # open elements by name
    headings = links = 0

    def close() -> None:
        nonlocal now
        if any(not p.isspace() for p in now.parts):
            out.append(now)
        now = Block()

    def say(raw: str) -> None:
        top = stack[-1]
        if not raw or top.silent:
            return
        if not now.parts:
            now.hint, now.inside, now.heading = top.hint, top.inside, headings > 0
        shown = html.unescape(raw)
        now.parts.append(shown)
        if links:
            now.linked += len(shown.split())

    def pop() -> str:
        nonlocal headings, links
        tag = stack.pop().tag
        count[tag] -= 1
        headings -= tag in HEADINGS
        links -= tag == "a"
        return tag

    def push(tag: str, attributes: str) -> None:
        nonlocal headings, links
        while (tag in BREAKS and "p" in stack[-1].ends) or any(t in stack[-1].ends for t in SIBLINGS.get(tag, ())):
            pop()
        above = stack[-1]
        inside = above.inside or tag in MAIN or "articleBody" in attributes and bool(_BODY.search(attributes))
        ends = frozenset() if tag in SCOPES else above.ends
        if tag == "p" or tag in SIBLINGS:
            ends = ends | {tag}
        silent = (above.silent or tag in SILENT or bool(_HIDDEN.search(attributes))) and tag != "body"
        stack.append(Open(tag, max(above.hint, _hint(tag, attributes, above.inside)), inside, silent, ends))
        count[tag] = count.get(tag, 0) + 1
        headings += tag in HEADINGS
        links += tag == "a"

    at, size = 0, len(page)
    while at < size:
        begin = page.find("<", at)
        if begin < 0:
            say(page[at:])
            break
        say(page[at:begin])
        found = _TOKEN.match(page, begin)
        if found is None:
            if page[begin + 1 : begin + 2] in ("/", ""):
                stop = page.find(">", begin)
                at = size if stop < 0 else stop + 1
            else:
                say("<")
                at = begin + 1
            continue
        at = found.end()
        name = found[2] or found[5]
        if name is None:
            continue
        tag, closing, attributes = name.lower(), found[1] or found[4], found[3] or found[6] or ""
        if tag == "br":
            say(" ")
            continue
        if tag not in INLINE:
            close()
        if closing:
            if count.get(tag):
                while pop() != tag:
                    pass
        elif _EMPTY.search(attributes):
            continue
        elif tag in RAW:
            # Their content is no markup.
            end = RAW[tag].search(page, at)
            at = end.end() if end else size
        elif tag not in VOID:
            push(tag, attributes)
    close()
    return out


def described(page_blocks: list[Block]) -> np.ndarray:
    """FEATURES of each block."""
    words = np.array([len(b.text.split()) for b in page_blocks], float)
    density = np.array([b.linked for b in page_blocks], float) / np.maximum(words, 1)
    ahead, behind = np.append(words[1:], 0), np.append(0, words[:-1])
    own = [(b.hint, b.inside, b.heading) for b in page_blocks]
    return np.column_stack(
        [np.array(own, float).reshape(-1, 3), words, density, behind, np.append(0, density[:-1]), ahead, np.append(density[1:], 0)]
    )


class Tree:
    """A binary decision tree by Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 1):
        self.share = float(y.mean())
        self.place = -1
        best = None
        if depth and 0 < self.share < 1:
            for place in range(x.shape[1]):
                values = np.unique(x[:, place])
                for cut in (values[:-1] + values[1:]) / 2:
                    low = x[:, place] <= cut
                    if min(low.sum(), (~low).sum()) < least:
                        continue
                    impurity = sum(m.sum() * y[m].mean() * (1 - y[m].mean()) for m in (low, ~low))
                    if best is None or impurity < best[0] - 1e-12:
                        best = impurity, place, float(cut), low
        if best is not None:
            _, self.place, self.cut, low = best
            self.low, self.high = (Tree(x[m], y[m], depth - 1, least) for m in (low, ~low))

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.place < 0:
            return np.full(len(x), self.share)
        return np.where(x[:, self.place] <= self.cut, self.low(x), self.high(x))


def trained(table: np.ndarray = LABELLED) -> Tree:
    return Tree(table[:, :-1], table[:, -1])


def main_text(page: str, tree: Tree) -> str:
    """The main text: its blocks in page order, one a line."""
    found = blocks(page)
    if not found:
        return ""
    return "\n".join(b.text for b, share in zip(found, tree(described(found)), strict=True) if share > 0.5)


def extracted(df: DataFrame, column: str = "html", keep: list[str] | None = None, table: np.ndarray = LABELLED) -> DataFrame:
    """Add `text`, the main text of each page, and `n_chars`, its code points."""
    tree = trained(table)
    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]

    def prepare():
        def make(piece: pa.RecordBatch) -> list[pa.Array]:
            out = [main_text(page, tree) for page in texts(piece.column(column))]
            return [pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())]

        return make

    return with_columns(df, column, fields, prepare, keep)
