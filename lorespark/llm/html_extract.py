"""Main text of web pages by tag-path ratios.

A page is read once into text nodes, each with the path of block elements from
the root to it. Text length, punctuation marks and characters inside links are
added up per path. A path's ratio is its text per node, weighted by its
punctuation per node and by the share of its text outside links, on a log
scale. Ratios are laid out in page order, smoothed over neighbouring nodes with
a Gaussian kernel and fused with the path's own ratio. A path is content if the
mean of its fused values reaches ``LAMBDA`` of the page's mean, each character
counting once; a heading follows the path after it. Items, cells, quotes and
short paragraphs are judged with the element that contains them: where most of
its text is content, so is all of it, save what is mostly links.

``article`` and ``main`` are a weight on the fused values, by the share of the
page's unlinked text that they hold: up to twice for paths inside them, and
down to ``OUTSIDE`` less for those outside. A page whose text stands in a
``div`` beside some teaser articles keeps it.

Elements that never hold an article's text are left out beforehand: scripts,
styles, forms, navigation, footers, asides, page headers, and elements whose
class, id or role names them as adverts, notices, menus, sidebars or comments.
A name does so if each of its parts is such a word or a word of layout:
``related-posts`` does, ``related-work`` does not. Names of a state
(``no-sidebar``, ``comments-open``) and those of html, body, main and article
drop nothing; paragraphs, headings, items and cells are dropped by a class that
is such a word alone, and nothing is dropped by name that holds half of the
page's unlinked text. A head that is not closed ends at the first tag or text
that cannot be in it.

Character references are decoded, white space and line breaks inside a block become one space,
blocks are trimmed and joined by two newlines. Nothing else is dropped.

Defined results: null or empty html, and pages without content, give ''; tags
that are never closed end with their parent or with the page; a tag cut off by
the page's end is no text; rows that repeat a page_id are each returned; other
columns are ignored.
"""

from __future__ import annotations

import html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorespark.llm.common import lean

LAMBDA, SIGMA, RADIUS = 0.6, 1.0, 2
#: What a path outside article and main loses where they hold all of the page's text.
OUTSIDE = 0.6

RAW = "script|style|textarea|title|iframe"
TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(?P<raw>{RAW})\b[^>]*+>.*?(?:</(?P=raw)\s*+>|\Z)|<[!?][^>]*+(?:>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-z][^\s/>]*+)(?P<attrs>[^>\"']*+(?:(?:\"[^\"]*+\"|'[^']*+')[^>\"']*+)*+)>|<(?:[a-z]|/[a-z])[^>]*+>|<[a-z/][^>]*+\Z",
    re.DOTALL | re.IGNORECASE,
)
BLOCK = frozenset("html body article main section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption header footer nav aside form fieldset address details summary center hgroup".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: What a start tag closes if it is open in the same parent: an unclosed paragraph, item or row.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "tbody": {"tr", "thead", "tbody"}, "td": {"td", "th"}, "th": {"td", "th"}}
ITEMS = frozenset("li dt dd tr thead tbody td th".split())
LISTS = frozenset("ul ol dl table".split())
DROPPED = frozenset("nav footer aside form button select option label fieldset menu dialog canvas audio video head noscript template svg object".split())
#: Start tags that leave an open head open; any other, and any text, ends it.
IN_HEAD = frozenset("base link meta basefont bgsound noscript template".split())
MARKED = frozenset(("article", "main"))
#: Words that name what is no article, and words of layout that may stand beside them.
NAMED = re.compile(
    r"(?:ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notices?|alert|sidebar|menu|nav|navbar|navigation|breadcrumbs?|masthead|footer|share|sharing|social|related"
    r"|recommend\w*|newsletter|subscribe|signup|login|comments?|commentlist|disqus|replies|respond|popup|modal|pagination|pager|toolbar|contentinfo|complementary|search)$",
    re.IGNORECASE,
)
LAYOUT = frozenset(
    """area articles bar bars bottom box boxes btn button buttons card cards col column container content contents desktop entry fixed form global grid group header heading holder icons inner
    item items layer left links list lists main mobile outer overlay page pane panel policy post posts primary region right row secondary section side site slot small stack sticky stories
    strip tablet teaser text thread title top trigger unit widget widgets wrap wrapper zone""".split()
)
#: Elements that no class drops, and class names that tell of a state or of something left out.
UNNAMED = frozenset("html body main article".split())
#: The share of a page's unlinked text that is not dropped by a name.
MOST = 0.75
#: Elements that only a class of one such word drops.
TEXTUAL = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th tr pre blockquote figcaption".split())
STATE = re.compile(r"^(?:no|not|without|hide|hidden|has|is|with)[_-]|[_-](?:open|opened|closed|enabled|disabled|hidden|visible|active|on|off|none)$", re.IGNORECASE)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
HEADING = re.compile(r"h[1-6]$")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？]")


def names_no_article(name: str, kind: str, element: str) -> bool:
    """Whether a class, id or role (``kind``) tells that an element is no part of an article."""
    if STATE.search(name):
        return False
    if element in TEXTUAL:
        return kind != "id" and bool(NAMED.match(name))
    parts = [p for p in re.split(r"[-_]+", name) if p and not (len(p) == 1 or p[0].isdigit())]
    return any(NAMED.match(p) for p in parts) and all(NAMED.match(p) or p.lower() in LAYOUT for p in parts)


class _Open:
    """An open element. ``block``, ``list`` and ``item``: where the innermost of each kind stands, itself included; ``named``: the element dropped by name that it is in."""

    __slots__ = ("name", "path", "dropped", "named", "marked", "link", "block", "list", "item")

    def __init__(self, name, path, dropped, named, marked, link):
        self.name, self.path, self.dropped, self.named, self.marked, self.link = name, path, dropped, named, marked, link
        self.block = self.list = self.item = 0


class _Stack:
    """The open elements, and how many there are of each name, so that a tag that ends none is passed over at once."""

    def __init__(self):
        self.open = [_Open("", 0, False, 0, False, False)]
        self.count: dict[str, int] = {}

    def push(self, element: _Open) -> None:
        top, at = self.open[-1], len(self.open)
        element.block = at if element.name in BLOCK else top.block
        element.list = at if element.name in LISTS else top.list
        element.item = at if element.name in ITEMS else top.item
        self.open.append(element)
        self.count[element.name] = self.count.get(element.name, 0) + 1

    def cut(self, at: int) -> None:
        for e in self.open[at:]:
            self.count[e.name] -= 1
        del self.open[at:]

    def end(self, name: str) -> None:
        """Ends the innermost open element of this name, and all inside it."""
        if self.count.get(name):
            at = len(self.open) - 1
            while self.open[at].name != name:
                at -= 1
            self.cut(at)

    def end_paragraph(self) -> None:
        """Ends an open paragraph unless another block is open inside it."""
        at = self.open[-1].block
        if at and self.open[at].name == "p":
            self.cut(at)

    def end_item(self, names) -> None:
        """Ends the innermost item of these names in the innermost list; at most one item of each kind is open there."""
        at, least = self.open[-1].item, self.open[-1].list
        while at > least:
            if self.open[at].name in names:
                self.cut(at)
                return
            at = self.open[at - 1].item


def nodes(page: str) -> tuple[list[tuple[int, int, str, bool, bool]], list[str], list[int]]:
    """(block number, path, text, inside marked content, inside a link) of the text nodes in page order; the last element's
    name and the parent of each path. Paths are numbers; each is known by its parent and last element alone."""
    stack = _Stack()
    found, block, at = [], 0, 0
    numbers: dict[tuple[int, str], int] = {}
    last, parent = [""], [0]
    named = 0  # elements dropped by name so far

    def text(end: int) -> None:
        if stack.open[-1].name == "head" and page[at:end].strip():
            stack.end("head")
        top = stack.open[-1]
        if end > at and not top.dropped:
            found.append((block, top.path, html.unescape(page[at:end]), top.marked, top.link, top.named))

    for m in TOKEN.finditer(page):
        text(m.start())
        at = m.end()
        name = m["name"]
        if name is None:
            continue
        name = name.lower()
        if m["close"]:
            if name in BLOCK or name in MARKED:
                block += 1
            stack.end(name)
            continue
        if stack.open[-1].name == "head" and name not in IN_HEAD:
            stack.end("head")
        if name in VOID:
            if name == "hr":
                block += 1
            elif name == "br" and found:
                top = stack.open[-1]
                found.append((block, top.path, " ", top.marked, False, top.named))
            continue
        blocked = name in BLOCK
        if blocked:
            block += 1
            stack.end_paragraph()
        if name in CLOSES:
            stack.end_item(CLOSES[name])
        top = stack.open[-1]
        attrs = m["attrs"]
        names = [(kind.lower(), a or b or c) for kind, a, b, c in ATTRIBUTE.findall(attrs)] if attrs and "=" in attrs else ()
        dropped = top.dropped or name in DROPPED or (name == "header" and not top.marked)
        inside = top.named
        if not inside and name not in UNNAMED and any(names_no_article(c, kind, name) for kind, n in names for c in n.split()):
            inside = named = named + 1
        if attrs.endswith("/") and name in BLOCK | {"a", "span", "svg"} and name not in ("p", "div", "a", "span"):
            continue
        path = top.path
        if blocked:
            path = numbers.setdefault((top.path, ".".join((name, *(n for _, n in names)))), len(last))
            if path == len(last):
                last.append(name)
                parent.append(top.path)
        stack.push(_Open(name, path, dropped, inside, top.marked or name in MARKED, top.link or name == "a"))
    text(len(page))
    held, article = [0] * (named + 1), 0
    for _, _, t, marked, link, by in found:
        held[by] += 0 if link else len(t.strip())
        article += len(t.strip()) if marked and not by else 0
    most = sum(held) * (MOST if not article else 1)
    return [x[:5] for x in found if not x[5] or held[x[5]] > most], last, parent


#: Elements that are judged with what contains them.
PARTS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th blockquote pre figure figcaption".split())
#: What is linked to more than this is left to its own ratio.
LINKED = 0.5


def content_paths(found: list[tuple[int, int, str, bool, bool]], last: list[str], parent: list[int]) -> set[int]:
    """The paths whose fused tag-path ratio reaches the threshold, and the parts beside them."""
    sums: dict[int, list[float]] = {}
    order: list[int] = []
    plain: list[int] = []
    for _, path, text, marked, link in found:
        size = len(text.strip())
        if not size:
            continue
        s = sums.setdefault(path, [0, 0, 0, 0, marked])
        s[0] += size
        s[1] += len(PUNCTUATION.findall(text))
        s[2] += size if link else 0
        s[3] += 1
        order.append(path)
        plain.append(size)
    if not sums:
        return set()
    ratio = {p: np.log2(1 + s[0] / s[3] * np.log2(2 + s[1] / s[3]) * (1 - s[2] / s[0])) for p, s in sums.items()}
    line = np.array([ratio[p] for p in order])
    kernel = np.exp(-0.5 * (np.arange(-RADIUS, RADIUS + 1) / SIGMA) ** 2)
    weight = np.convolve(np.ones(len(line)), kernel, "full")[RADIUS : RADIUS + len(line)]
    smooth = np.convolve(line, kernel, "full")[RADIUS : RADIUS + len(line)] / weight
    fused = np.sqrt(line * smooth)
    limit = LAMBDA * np.average(fused, weights=plain)
    unlinked = sum(s[0] - s[2] for s in sums.values())
    share = sum(s[0] - s[2] for s in sums.values() if s[4]) / unlinked if unlinked else 0.0
    total: dict[int, list[float]] = {}
    for path, value in zip(order, fused):
        total.setdefault(path, []).append(value)
    mean = {p: float(np.mean(v)) * (1 + share if sums[p][4] else 1 - OUTSIDE * share) for p, v in total.items()}
    chosen = {p for p, value in mean.items() if value >= limit and value > 0}
    chosen |= _beside(chosen, sums, last, parent)
    return chosen | {p for p, following in zip(order, order[1:]) if HEADING.match(last[p]) and following in chosen}


def _beside(chosen: set[int], sums: dict[int, list[float]], last: list[str], parent: list[int]) -> set[int]:
    """Parts of containers most of whose unlinked text is chosen, save lists and tables that are mostly links."""
    container, part = list(range(len(last))), list(range(len(last)))
    for p in range(1, len(last)):  # parents come first
        if last[p] in PARTS:
            container[p] = container[parent[p]]
            part[p] = p if container[parent[p]] == parent[p] else part[parent[p]]
    held: dict[int, list[float]] = {}
    linked: dict[int, list[float]] = {}
    for p, s in sums.items():
        h, k = held.setdefault(container[p], [0, 0]), linked.setdefault(part[p], [0, 0])
        h[0] += s[0] - s[2]
        h[1] += s[0] - s[2] if p in chosen else 0
        k[0] += s[0]
        k[1] += s[2]
    return {p for p in sums if last[p] in PARTS and 2 * held[container[p]][1] > held[container[p]][0] and linked[part[p]][1] <= LINKED * linked[part[p]][0]}


def extract(page: str | None) -> str:
    """The page's main text."""
    found, last, parent = nodes(page or "")
    chosen = content_paths(found, last, parent)
    blocks: dict[int, list[str]] = {}
    for block, path, text, _, _ in found:
        if path in chosen:
            blocks.setdefault(block, []).append(text)
    return "\n\n".join(t for b in blocks.values() if (t := " ".join("".join(b).split())))


def main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row; see the module's text."""

    def extracted(batches):
        for batch in batches:
            texts = [extract(x) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html")).mapInArrow(lean(extracted), "page_id long, url string, text string, n_chars long")
