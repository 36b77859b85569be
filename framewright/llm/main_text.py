"""Main text of web pages by line-block distribution.

Markup is stripped so that every block (paragraph, heading, list item, cell, ...) becomes a line, and what is marked as
furniture (menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, reader comments) becomes empty
lines. The lengths of the lines' own text, links not counted, are summed over sliding windows of ``WINDOW`` lines. Where the
sums surge, a text starts; where they dive, it ends. The article is the text with the most characters:

* Surges over ``SURGE`` characters a window, or the share ``LEAST`` of the page's fullest window if that is less, and the dives
  below it bound the spans of running text.
* The element that holds their text is the fullest ``article`` or ``main``, or else the last one on the way down from the
  body that holds ``MOST`` of them and loses no title.
* Inside that element the bounds are known, so there any own text is a surge, and only a window without any, such as a list
  of links, is a dive. Every line between surge and dive stays.
* Where no element narrower than the body holds the text, the spans are the text, with the headings right before them. Spans
  of less than ``LEAST`` of the fullest one are none.

If marks leave nearly nothing (a page inside a form, a class name misread), lines marked by class or id count again, then all.

Null and empty pages, and pages without text, give an empty string. Every page is parsed whole, in time proportional to its
length; a page cut off inside a tag loses that tag only. Nothing is shuffled.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .store import free_name

WINDOW, SURGE, LEAST, MOST = 3, 80, 0.2, 0.75
#: Shares of the running text: an article or main element with less doesn't hold the text, an article with less of its main
#: element's is one of several, and unmarked lines with less of the page's show that marks were misread.
ARTICLE, ALONE, UNMARKED = 0.3, 0.5, 0.05

#: Fixed values of HTML: elements that end a line, that have no content, whose content is not markup, and that close themselves.
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav noscript ol optgroup option p pre search section summary "
    "table tbody td tfoot th thead title tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that are no article text, by name, by role, and by a word of class or id.
FURNITURE = frozenset(
    "script style noscript template head title nav footer aside button select textarea label iframe object svg math "
    "audio video canvas dialog menu noembed noframes xmp search".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form toolbar".split())
WORDS = frozenset(
    "ad ads advert adverts advertisement advertising advertorial adsense sponsor sponsored sponsors promo promos promoted promotion "
    "banner cookie cookies consent gdpr notice notices notification alert popup modal overlay lightbox newsletter subscribe signup "
    "login sidebar sidebars aside menu menus nav navbar navigation breadcrumb breadcrumbs header masthead topbar footer copyright "
    "comment comments commentlist disqus reply replies respond related recommended recommendations share sharing social toolbar "
    "pagination pager skip hidden form search widget widgets".split()
)
#: An article's own header may hold its title.
HEADER = frozenset(["header", "masthead"])
#: Elements that can hold an article, and those that may stand in a page's head.
CONTAINERS = frozenset("html body div section article main center form fieldset table tbody tr td".split())
IN_HEAD = frozenset("title meta link script style base noscript template".split())
#: A class such as ``has-sidebar`` says what else the page has.
ABOUT = frozenset("has with no without".split())

_TAG = re.compile(r"<(/?+)([a-zA-Z][^\s/>]*+)((?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>")
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)\s*(?:=\s*(\"[^\"]*\"|'[^']*'|[^\s>]*))?")
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
#: An element of these closes an open one of those, as far up as the nearest of the last kind.
_CLOSES = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")), "tr": (("tr",), ("table", "tbody", "thead", "tfoot")), "option": (("option",), ("select",)),
    "a": (("a",), ("td", "table")),
}


@dataclass
class Line:
    """One block: its text, the characters of it that are not in links, the container around it, whether it is a heading
    (1 to 6, else 0), and how it was marked (0: not, 1: by a word of class or id or as a form, 2: otherwise)."""

    text: str
    own: int
    node: int
    heading: int
    mark: int


@dataclass
class Node:
    """A container: its element, the container around it (-1: none), and the last container inside it; numbers are in page order."""

    name: str
    above: int
    last: int


@dataclass
class _Open:
    name: str
    node: int
    mark: int
    heading: int
    header: bool
    link: bool


_PAGE = _Open("", -1, 0, 0, False, False)


@dataclass
class _Page:
    """Lines found so far and the elements open at this place; ``at``: the stack's places by name, ``blocks``: of blocks."""

    lines: list[Line] = field(default_factory=list)
    nodes: list[Node] = field(default_factory=list)
    stack: list[_Open] = field(default_factory=list)
    at: dict[str, list[int]] = field(default_factory=dict)
    blocks: list[int] = field(default_factory=list)
    parts: list[tuple[str, bool, int]] = field(default_factory=list)

    @property
    def top(self) -> _Open:
        return self.stack[-1] if self.stack else _PAGE

    def say(self, text: str) -> None:
        top = self.top
        if not top.header or top.heading:
            self.parts.append((html.unescape(text) if "&" in text else text, top.link and not top.heading, top.mark))

    def flush(self) -> None:
        """Ends the line: the parts of the least mark that it has."""
        mark = min((m for t, _, m in self.parts if not t.isspace()), default=None)
        if mark is not None:
            parts = [(t, linked) for t, linked, m in self.parts if m == mark]
            text = " ".join("".join(t for t, _ in parts).split())
            own = sum(len(w) for t, linked in parts if not linked for w in t.split())
            block = self.stack[self.blocks[-1]] if self.blocks else _PAGE
            self.lines.append(Line(text, own, block.node, block.heading, mark))
        self.parts = []

    def open(self, name: str, attributes: str) -> None:
        above, mark, header = self.top, *_mark(name, attributes)
        if header and not (self.at.get("article") or self.at.get("main")):
            mark, header = max(mark, 1 if name != "header" else 2), False
        node = above.node
        if name in CONTAINERS:
            self.nodes.append(Node(name, above.node, len(self.nodes)))
            node = len(self.nodes) - 1
        heading = int(name[1]) if name in HEADINGS else above.heading
        one = _Open(name, node, max(mark, above.mark), heading, header or above.header, name == "a" or above.link)
        self.at.setdefault(name, []).append(len(self.stack))
        if name in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append(one)

    def close(self, down_to: int) -> None:
        """Closes every element from this place of the stack on."""
        while len(self.stack) > down_to:
            top = self.stack.pop()
            self.at[top.name].pop()
            if top.name in BLOCKS:
                self.blocks.pop()
            if top.name in CONTAINERS:
                self.nodes[top.node].last = len(self.nodes) - 1

    def innermost(self, names: tuple[str, ...]) -> int:
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=-1)


def _mark(name: str, attributes: str) -> tuple[int, bool]:
    """(2 for an element, role or style that hides or sets apart, 1 for a word of class or id or a form, else 0; whether it is a
    header)."""
    if name in FURNITURE:
        return 2, False
    mark, header = int(name == "form"), name == "header"
    if not attributes or name in ("html", "body", "main"):
        return mark, header
    for key, value in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), value.strip("\"'")
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and _HIDDEN.search(value)):
            return 2, False
        if key == "role" and value.lower() in ROLES:
            return 2, False
        if key in ("class", "id") and name not in HEADINGS:
            words = [w.lower() for w in _WORD.findall(value)]
            told = {w for k, w in enumerate(words) if w in WORDS and not (k and words[k - 1] in ABOUT)}
            header = header or bool(told & HEADER)
            mark = max(mark, int(bool(told - HEADER)))
    return mark, header


def lines_of(page: str) -> tuple[list[Line], list[Node]]:
    """The page's lines in order, and its containers."""
    out, at, n = _Page(), 0, len(page)
    while at < n:
        begin = page.find("<", at)
        if begin != at:
            out.say(page[at:] if begin < 0 else page[at:begin])
        if begin < 0:
            break
        after = page[begin + 1 : begin + 2]
        if after == "/":
            letter = page[begin + 2 : begin + 3]
            if not letter:
                break
        else:
            letter = after
        if letter.isascii() and letter.isalpha():
            tag = _TAG.match(page, begin)
            if tag is None:  # cut off inside a tag
                break
            at, name = tag.end(), tag[2].lower()
            if tag[1]:
                _end(out, name)
                continue
            _start(out, name, tag[3])
            if name in RAW:
                found = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                at = found.start() if found else n
        elif after and after in "!?/":
            if page.startswith("<!--", begin):
                end = page.find("-->", begin + 2)  # <!--> is a whole comment
                at = n if end < 0 else end + 3
            else:
                end = page.find(">", begin)
                at = n if end < 0 else end + 1
        else:
            out.say("<")
            at = begin + 1
    out.flush()
    out.close(0)
    return out.lines, out.nodes


def _start(out: _Page, name: str, attributes: str) -> None:
    if name == "br":
        out.say(" ")
        return
    if name not in IN_HEAD and out.at.get("head"):
        out.flush()
        out.close(out.at["head"][-1])
    if name in BLOCKS:
        out.flush()
        if out.innermost(("p",)) > out.innermost(("table", "td", "th", "button", "object")):
            out.close(out.at["p"][-1])
        if name in HEADINGS and out.top.name in HEADINGS:
            out.close(len(out.stack) - 1)
    if name in _CLOSES:
        same, within = _CLOSES[name]
        place = out.innermost(same)
        if place > out.innermost(within):
            out.close(place)
    if name not in VOID:
        out.open(name, attributes)


def _end(out: _Page, name: str) -> None:
    if name in BLOCKS:
        out.flush()
    places = out.at.get(name)
    # an inline element's end doesn't reach out of its block
    if places and (name in BLOCKS or not out.blocks or places[-1] > out.blocks[-1]):
        out.close(places[-1])


def _sums(own: list[int]) -> list[int]:
    """Characters in the window that starts at each line."""
    total, out = sum(own[:WINDOW]), []
    for k in range(len(own)):
        out.append(total)
        total += (own[k + WINDOW] if k + WINDOW < len(own) else 0) - own[k]
    return out


def spans(own: list[int], least: float) -> list[tuple[int, int]]:
    """(first line, line after the last) from each surge of the window sums over ``least`` to the dive after it. The first and the
    last line of a span have text of their own; no two spans overlap."""
    sums, found, k = _sums(own), [], 0
    while k < len(own):
        if sums[k] <= least:
            k += 1
            continue
        begin = k
        while k < len(own) and sums[k] > least:
            k += 1
        end = min(k - 1 + WINDOW, len(own))
        if found and begin < found[-1][1]:
            begin = found.pop()[0]
        while not own[begin]:
            begin += 1
        while not own[end - 1]:
            end -= 1
        found.append((begin, end))
    return found


def _root(lines: list[Line], nodes: list[Node], held: list[int]) -> int:
    """The container of the running text, of which ``held`` has the characters by line; -1: the page."""
    size, title = [0] * len(nodes), [False] * len(nodes)
    for line, many in zip(lines, held):
        if line.node >= 0:
            size[line.node] += many
            title[line.node] |= line.heading == 1 and line.mark == 0
    for k in range(len(nodes) - 1, 0, -1):  # containers come after those around them
        if nodes[k].above >= 0:
            size[nodes[k].above] += size[k]
            title[nodes[k].above] |= title[k]
    total = sum(held)
    fullest = {}
    for kind in ("main", "article"):
        # of two that hold the same the outer one, which comes first
        fullest[kind] = max((k for k, x in enumerate(nodes) if x.name == kind), key=lambda k: (size[k], -k), default=None)
    article, main = fullest["article"], fullest["main"]
    if article is not None and size[article] >= ARTICLE * total and (main is None or size[article] >= ALONE * size[main]):
        return article
    if main is not None and size[main] >= ARTICLE * total:
        return main
    inside: dict[int, list[int]] = {}
    for k, x in enumerate(nodes):
        inside.setdefault(x.above, []).append(k)
    root = -1
    while inside.get(root):
        child = max(inside[root], key=lambda k: (size[k], -k))
        if size[child] < MOST * total or (root >= 0 and title[root] and not title[child]):
            break
        root = child
    return root


def main_text(page: str | None) -> str:
    """The article's blocks in page order, joined by one line break."""
    lines, nodes = lines_of(page or "")
    every = sum(x.own for x in lines if x.mark < 2)
    for allowed in (0, 1, 2):
        own = [x.own if x.mark <= allowed else 0 for x in lines]
        if sum(own) > UNMARKED * every:
            break
    least = min(SURGE, LEAST * max(_sums(own), default=0))
    found = spans(own, least)
    sizes = [sum(own[a:b]) for a, b in found]
    held = [0] * len(lines)
    for a, b in found:
        held[a:b] = own[a:b]
    root = _root(lines, nodes, held)
    if root >= 0 and nodes[root].name not in ("html", "body"):
        lines = [x for x in lines if root <= x.node <= nodes[root].last and x.mark <= allowed]
        found = spans([x.own for x in lines], 0)
        if found:  # fewer lines than a window at the ends are no dive
            found[0] = (0 if found[0][0] < WINDOW else found[0][0], found[0][1])
            found[-1] = (found[-1][0], len(lines) if len(lines) - found[-1][1] < WINDOW else found[-1][1])
    else:
        found = [(_from_heading(lines, a), b) for (a, b), size in zip(found, sizes) if size >= LEAST * max(sizes)]
        lines = [x if x.mark <= allowed else None for x in lines]
    return "\n".join(x.text for a, b in found for x in lines[a:b] if x is not None)


def _from_heading(lines: list[Line], begin: int) -> int:
    while begin and lines[begin - 1].heading and not lines[begin - 1].mark:
        begin -= 1
    return begin


def extract_main_text(pages: DataFrame, column: str = "html", name: str = "main_text") -> DataFrame:
    """All rows and columns, with the article of ``column`` in ``name`` (a column of that name is replaced)."""
    kept = pages.drop(name)
    page = free_name(kept, "_page")
    schema = StructType([*kept.schema.fields, StructField(name, StringType())])

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(x.as_py()) for x in batch.column(page)], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.drop_columns([page]).columns, texts], schema.names)

    return kept.withColumn(page, F.col(column).cast("string")).mapInArrow(extract, schema)
