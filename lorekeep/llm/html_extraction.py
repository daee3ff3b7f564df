"""Main text of web pages from parser events and text-to-tag ratios.

The standard library's streaming HTML parser turns a page into lines: a line is the text of one block
(a run of text between tags that start or end a block, ``br`` included), with the number of tags met
in it, the share of it that is link text, and the chain of elements it stands in.  The text-to-tag
ratio of each line is smoothed with a Gaussian over its neighbours; lines whose smoothed ratio
exceeds a threshold (``SPREAD`` standard deviations below the mean of the page, at least ``FLOOR``)
form clusters of content.  The region is every outermost ``article`` or ``main`` that has clustered text or much of the page's, if
these hold enough of it (``NAMED``); else the nearest section that holds all clusters, the ``h1`` of the page
and headings beside its content.  Inside the region a line stays if it is in a cluster, if less than ``LINKED`` of it is link
text (a short line or list of the text), or if it is an item of an article's list or table (its sources); any other line of links outside all clusters goes.  Elements only exclude: navigation, header,
footer, aside, form, script, style, roles of that kind, and elements whose class or id names an advert, notice, menu, sidebar,
sharing or comment box: ``PARTS`` count as a part of such a name (``side-menu``), ``NAMES`` only as a whole (``side``, not ``side-by-side``).
Text overrules such a name: an element with most of the page's text outside links (``MOST``) that holds the only article, main element or first
``h1``, or with nearly all of it (``NEARLY_ALL``), is not beside the text, whatever it is called (a form around the page, a menu that was never closed).

Character references are decoded, white space inside a line becomes one space, lines are trimmed,
empty ones dropped, and joined in page order by one newline.

Open elements are counted by tag, so that an end tag that nothing opened costs nothing, however deep the page is.

Defined results: a null or empty html gives an empty text of 0 characters; a null url or page_id is
passed through; repeated rows give equal results; an empty table gives no rows; pages of any length
are read whole; columns of other names are ignored, and kept columns named ``text`` or ``n_chars`` are replaced.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import table

SIGMA = 1.5
SPREAD = 0.5
FLOOR = 5.0
#: Share of the clustered text that articles must hold together to be the region; teasers beside other content hold less.
NAMED = 0.3
MOST = 0.5
NEARLY_ALL = 0.95
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: What may stand in a head; any other element ends it.
IN_HEAD = frozenset("base link meta noscript script style template title".split())
SKIPPED = frozenset("script style noscript template head title svg math iframe object canvas select textarea button".split())
BOILERPLATE = frozenset("nav footer aside form dialog menu".split())
PREFERRED = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that can be a region, besides the page; paragraphs, lists and tables are parts of one.
SECTIONS = frozenset("body html div section article main".split())
#: Elements that end an open paragraph when they start.
ENDS_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
ITEMS = frozenset("li dt dd td th h1 h2 h3 h4 h5 h6 figcaption caption".split())
#: Share of link text from which a line outside all clusters goes.
LINKED = 0.5
PARTS = frozenset(
    "ad ads advert adverts advertisement advertising adbox adsense sponsor sponsored promo promotion cookie cookies consent gdpr popup modal newsletter subscribe subscription signup login "
    "nav navbar navigation menu breadcrumb breadcrumbs sidebar sidebars share sharing social pagination pager footer masthead comment comments commentlist discussion disqus replies respond".split()
)
NAMES = frozenset("side aside widget widgets header site-header page-header top-header topbar toolbar banner notice notices alert overlay related recommended recommendations search searchform site-search skip skip-link reader-comments".split())
#: Such names tell of a neighbour, not of the element itself.
_ABOUT = ("has-", "with-", "no-", "without-")
_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())


def _dull_name(name: str) -> bool:
    """Whether a class or id names something beside the text."""
    return name in NAMES or not name.startswith(_ABOUT) and not PARTS.isdisjoint(re.split(r"[-_]+", name))


class _Lines(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        #: Open elements: (tag, number, skipped).
        self.stack: list[tuple[str, int, bool]] = [("", 0, False)]
        self.parent = [0]
        self.kind = [""]
        self.marked = [False]  # by its tag, role or name beside the text
        self.lines: list[tuple[str, int, int, int]] = []  # text, tags, characters in links, element
        self.open: Counter[str] = Counter()
        self.text: list[str] = []
        self.tags = self.linked = 0

    def end_line(self) -> None:
        if self.text:
            joined = " ".join("".join(self.text).split())
            if joined:
                self.lines.append((joined, self.tags, self.linked, self.stack[-1][1]))
            self.text.clear()
            self.tags = self.linked = 0

    def _close_head(self) -> None:
        for i, x in enumerate(self.stack):
            if x[0] == "head":
                self._cut(i)
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.open["head"] and tag not in IN_HEAD and not any(x[0] in SKIPPED and x[0] != "head" for x in self.stack):
            self._close_head()
        if tag in INLINE:
            self.tags += 1
            if tag not in VOID:
                self._push(tag, attrs)
            return
        self.end_line()
        self.tags += 1
        if tag in ENDS_P:
            self._close_p()
        elif tag in ("li", "dt", "dd", "tr", "td", "th", "option"):
            self._close_same(tag)
        if tag not in VOID:
            self._push(tag, attrs)

    def _push(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        _, number, skipped = self.stack[-1]
        if tag not in INLINE:
            marked = tag in BOILERPLATE or (tag == "header" and not any(self.open[x] for x in PREFERRED))
            if not marked and attrs and tag not in ("body", "html", "article", "main"):
                d = dict(attrs)
                marked = "hidden" in d or (d.get("role") or "").lower() in _ROLES or any(map(_dull_name, f"{d.get('class') or ''} {d.get('id') or ''}".lower().split()))
            self.parent.append(number)
            self.kind.append(tag)
            self.marked.append(marked)
            number = len(self.kind) - 1
        self.stack.append((tag, number, skipped or tag in SKIPPED))
        self.open[tag] += 1

    def _cut(self, at: int) -> None:
        """Closes the open elements from this one on."""
        for x in self.stack[at:]:
            self.open[x[0]] -= 1
        del self.stack[at:]

    def _close_p(self) -> None:
        if not self.open["p"]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i][0]
            if tag == "p":
                self._cut(i)
                return
            if tag not in INLINE:
                return

    def _close_same(self, name: str) -> None:
        if not self.open[name]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            tag = self.stack[i][0]
            if tag == name:
                self._cut(i)
                return
            if tag in ("ul", "ol", "dl", "table", "tbody", "select"):
                return

    def handle_endtag(self, tag: str) -> None:
        if tag not in INLINE:
            self.end_line()
        self.tags += 1
        if not self.open[tag]:
            return
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][0] == tag:
                self._cut(i)
                return
            if tag in INLINE and self.stack[i][0] not in INLINE:
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_data(self, data: str) -> None:
        if self.stack[-1][0] == "head" and data.strip():
            self._close_head()
        if self.stack[-1][2]:
            return
        self.text.append(data)
        if self.stack[-1][0] == "a" or any(x[0] == "a" for x in self.stack[-4:]):
            self.linked += len(data)


def smooth(values: list[float], sigma: float = SIGMA) -> list[float]:
    reach = max(1, math.ceil(2 * sigma))
    kernel = [math.exp(-(k * k) / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for i in range(len(values)):
        a, b = max(0, i - reach), min(len(values), i + reach + 1)
        own = kernel[a - i + reach : b - i + reach]
        out.append(sum([x * k for x, k in zip(values[a:b], own, strict=True)]) / sum(own))
    return out


def extract(html: str | None) -> str:
    """The main text of one page."""
    if not html:
        return ""
    parser = _Lines()
    parser.feed(html)
    parser.close()
    parser.end_line()
    lines = parser.lines
    if not lines:
        return ""
    dull_at = _dull(parser)
    bright = [not dull_at[number] for *_, number in lines]
    ratio = smooth([(len(text) - min(linked, len(text))) / max(1, tags) if kept else 0.0 for (text, tags, linked, _), kept in zip(lines, bright, strict=True)])
    mean = sum(ratio) / len(ratio)
    spread = math.sqrt(sum([(r - mean) ** 2 for r in ratio]) / len(ratio))
    threshold = max(FLOOR, mean - SPREAD * spread)
    clustered = [r >= threshold for r in ratio]
    there, mass = [0.0] * len(parser.parent), [0.0] * len(parser.parent)  # text of each element, and what of it is in clusters
    for (text, _, _, number), kept, inside in zip(lines, bright, clustered, strict=True):
        if kept:
            there[number] += len(text)
            mass[number] += len(text) if inside else 0
    if not any(mass):  # no cluster: every line that is not boilerplate votes
        mass = there.copy()
    for k in range(len(mass) - 1, 0, -1):  # children come after their parents
        mass[parser.parent[k]] += mass[k]
        there[parser.parent[k]] += there[k]
    outer, held = [], [False] * len(mass)  # such articles may stand side by side; of one inside another the outer one
    for k in range(1, len(mass)):
        held[k] = held[parser.parent[k]]
        if not held[k] and parser.kind[k] in PREFERRED and (mass[k] > 0 or there[k] >= NAMED * there[0] > 0):
            outer.append(k)
            held[k] = True
    named = sum([there[k] for k in outer]) >= NAMED * there[0] > 0
    regions = set(outer) if named else {_section(parser, mass, {number for (*_, number), kept in zip(lines, bright, strict=True) if kept})}
    known: dict[int, bool] = {}
    return "\n".join([text for (text, _, linked, number), kept, inside in zip(lines, bright, clustered, strict=True) if kept and (inside or linked < LINKED * len(text) or named and parser.kind[number] in ITEMS) and _holds(parser.parent, regions, known, number)])


def _dull(parser: _Lines) -> list[bool]:
    """Whether each element is, or stands in, something beside the text."""
    parent, kind, n = parser.parent, parser.kind, len(parser.parent)
    own = [0] * n  # text outside links
    for text, _, linked, number in parser.lines:
        own[number] += len(text) - min(linked, len(text))
    for k in range(n - 1, 0, -1):
        own[parent[k]] += own[k]
    head = next((k for k in range(n) if kind[k] == "h1"), 0)
    core = {k for k in range(1, n) if own[k] and (kind[k] in PREFERRED or k == head)}
    outside = [False] * n  # under a marked element
    for k in range(1, n):
        outside[k] = parser.marked[k] or outside[parent[k]]
    hold = [0] * n  # of the core
    for k in range(n - 1, 0, -1):
        hold[k] += k in core
        hold[parent[k]] += hold[k]
    bare = not any(not outside[k] for k in core)  # nothing of it would be left
    out = [False] * n
    for k in range(1, n):
        beside = parser.marked[k] and not (own[k] >= NEARLY_ALL * own[0] > 0 or own[k] >= MOST * own[0] > 0 and hold[k] and bare)
        out[k] = beside or (out[parent[k]] and kind[k] != "main")
    return out


def _section(parser: _Lines, mass: list[float], bright: set[int]) -> int:
    """The nearest section that holds all the mass and the headings that belong to it."""
    parent, kind = parser.parent, parser.kind
    region = max([k for k in range(len(mass)) if mass[k] == mass[0] > 0], default=0)
    while region and kind[region] not in SECTIONS:
        region = parent[region]
    above = {0}  # the region and what it stands in
    k = region
    while k:
        above.add(k)
        k = parent[k]
    heading = [0] * len(mass)  # that an element stands in
    for k in range(1, len(mass)):
        heading[k] = k if kind[k] in HEADINGS else heading[parent[k]]
    wanted = region
    for k in {heading[x] for x in bright}:  # of lines that are not boilerplate
        if k and (kind[k] == "h1" or parent[k] in above):
            wanted = _meet(parent, wanted, k)
    while wanted and kind[wanted] not in SECTIONS:
        wanted = parent[wanted]
    return wanted


def _meet(parent: list[int], a: int, b: int) -> int:
    """The nearest element that holds both; the number of a parent is below those of its children."""
    while a != b:
        if a > b:
            a = parent[a]
        else:
            b = parent[b]
    return a


def _holds(parent: list[int], regions: set[int], known: dict[int, bool], k: int) -> bool:
    """Whether element k is one of the regions or lies in one, without recursion."""
    path = []
    while k not in known:
        if k in regions or k == 0:
            known[k] = k in regions
            break
        path.append(k)
        k = parent[k]
    for x in path:
        known[x] = known[k]
    return known[k]


def extract_pages(pages: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``text`` and ``n_chars``, which replace columns of the same name."""
    keep = [c for c in dict.fromkeys(keep) if c not in ("text", "n_chars")]
    schema = ", ".join([f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in keep] + ["text string, n_chars long"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(h) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    return pages.select(*dict.fromkeys([*keep, "html"])).mapInArrow(run, schema)


def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"), ["page_id", "url"])
