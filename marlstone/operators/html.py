"""Elements of pages by CSS selectors: one pass over a page's tags with the stack of open elements.

Selectors are groups of compounds (tag, *, .class, #id, [name], [name=value])
joined by blanks (below) or > (right below). How far each selector is met is
carried down the stack, so a tag costs the same however deep it stands. Tags that
HTML closes by itself are closed, stray end tags are passed over, and what a page
leaves open ends with it; scripts, styles and comments are no text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions.batches import parts
from marlstone.operators import markdown

#: Elements without content, and by element the open ones that its start tag ends.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_BLOCKS = "address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split()
ENDS = {tag: ("p",) for tag in _BLOCKS} | {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements beyond which a start or end tag closes nothing.
WALLS = frozenset({"ul", "ol", "dl", "table", "select"})
HEADINGS = markdown.HEADINGS
_PIECE = re.compile(r"\s*(>)\s*|(\s+)|(\*|[A-Za-z][\w-]*)|\.([\w-]+)|#([\w-]+)|\[\s*([\w-]+)\s*(?:=\s*[\"']?([^\"'\]]*)[\"']?\s*)?\]")


@dataclass
class Compound:
    """What one element must be, and whether it must stand right below the one before."""

    child: bool = False
    tag: str | None = None
    has: list[tuple[str, str | None]] = field(default_factory=list)

    def meets(self, tag: str, attributes: dict[str, str | None], classes: frozenset[str]) -> bool:
        if self.tag not in (None, "*", tag):
            return False
        return all(value in classes if name == "." else name in attributes and value in (None, attributes[name] or "") for name, value in self.has)


def parse_selector(selector: str) -> list[list[Compound]]:
    """The alternatives of a selector; ValueError where it is none."""
    out = []
    for part in selector.split(","):
        chain, at, text = [Compound()], 0, part.strip()
        while at < len(text):
            m = _PIECE.match(text, at)
            if m is None:
                raise ValueError(f"not a selector: {selector}")
            child, blank, tag, cls, ident, name, value = m.groups()
            if child or blank:
                chain.append(Compound(child=bool(child)))
            elif tag:
                chain[-1].tag = tag.lower()
            else:
                chain[-1].has.append((".", cls) if cls else ("id", ident) if ident else (name.lower(), value))
            at = m.end()
        if any(c.tag is None and not c.has for c in chain):
            raise ValueError(f"not a selector: {selector}")
        out.append(chain)
    return out


class _Page(HTMLParser):
    """Elements met by chains of compounds: (chain, start and stop in the text, headings before, tag, number, first event and that after the last).

    With ``keep`` all headings are found too, of chain None, and the events and tables of layout that ``markdown.Writer`` reads are kept.
    """

    def __init__(self, chains: Sequence[Sequence[Compound]], keep: bool = False):
        super().__init__(convert_charrefs=True)
        self.chains = chains
        self.text: list[str] = []
        self.size, self.headings, self.elements = 0, 0, 0
        # of an open element: tag, how far each chain is met by it, and by it or any above it, and the finds it opened
        top = [0] * len(chains)
        self.open: list[tuple[str, list[int], list[int], list[list]]] = [("", top, top, [])]
        self.found: list[list] = []
        self.count: Counter[str] = Counter()
        self.skipped = 0
        self.keep = keep
        self.events: list[tuple] = []
        self.tables: list[int] = []
        self.layout: set[int] = set()

    def handle_starttag(self, tag, attrs):
        for end in ENDS.get(tag, ()):
            self._close(end)
        attributes = dict(attrs)
        classes = frozenset((attributes.get("class") or "").split())
        _, parent, above, _ = self.open[-1]
        # bit i of a number: the first i + 1 compounds are met, the last of them by this element
        own, finds = [], []
        for k, chain in enumerate(self.chains):
            bits = 0
            for i, compound in enumerate(chain):
                before = i == 0 or (parent[k] if compound.child else above[k]) >> i - 1 & 1
                if before and compound.meets(tag, attributes, classes):
                    bits |= 1 << i
            own.append(bits)
            if bits >> len(chain) - 1 & 1:
                finds.append([k, self.size, self.size, self.headings, tag, self.elements, len(self.events), len(self.events) + 1])
        if self.keep and tag in HEADINGS:
            finds.append([None, self.size, self.size, self.headings, tag, self.elements, len(self.events), len(self.events) + 1])
        self.elements += 1
        self.found += finds
        if tag in HEADINGS:
            self.headings += 1
        if tag not in VOID:
            self.open.append((tag, own, [a | b for a, b in zip(own, above, strict=True)], finds))
            self.count[tag] += 1
            self.skipped += tag in ("script", "style")
        if self.keep:
            if tag in markdown.LAYOUT and self.tables:
                self.layout.add(self.tables[-1])
            if tag == "table":
                self.tables.append(len(self.events))
            self.events.append((markdown.VOID if tag in VOID else markdown.START, tag, attributes))
        self._say(" ")

    def _close(self, tag: str) -> None:
        if not self.count[tag]:
            return
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] == tag:
                while len(self.open) > i:
                    name, _, _, finds = self.open.pop()
                    self.count[name] -= 1
                    self.skipped -= name in ("script", "style")
                    if self.keep:
                        self.events.append((markdown.END, name))
                        if name == "table":
                            self.tables.pop()
                    for f in finds:
                        f[2], f[7] = self.size, len(self.events)
                return
            if self.open[i][0] in WALLS:
                return

    def handle_endtag(self, tag):
        self._close(tag)
        self._say(" ")

    def handle_data(self, data):
        if not self.skipped:
            self._say(data)
            if self.keep:
                self.events.append((markdown.TEXT, data))

    def _say(self, data: str) -> None:
        self.text.append(data)
        self.size += len(data)


def _parsed(html: str, chains: Sequence[Sequence[Compound]], keep: bool = False) -> tuple[_Page, str]:
    """A page that is read to its end, and its text."""
    page = _Page(chains, keep)
    page.feed(html)
    page.close()
    while len(page.open) > 1:
        page._close(page.open[-1][0])
    return page, "".join(page.text)


def find_elements(html: str, chains: Sequence[Sequence[Compound]]) -> Iterator[tuple[int, int, str, int, str]]:
    """(chain, number of the element, tag, headings before, text) of a page's elements in their order; blanks of a text are joined."""
    page, text = _parsed(html, chains)
    for k, start, stop, headings, tag, number, _, _ in page.found:
        yield k, number, tag, headings, " ".join(text[start:stop].split())


def find_snippets(html: str, chains: Sequence[Sequence[Compound]]) -> Iterator[tuple[int | None, int, str, int, str]]:
    """As ``find_elements``, with the Markdown of each element; a page that has any begins with all its headings, of chain None and with their text."""
    page, text = _parsed(html, chains, keep=True)
    if all(f[0] is None for f in page.found):
        return
    for k, start, stop, headings, tag, number, _, _ in page.found:
        if k is None:
            yield k, number, tag, headings, " ".join(text[start:stop].split())
    for k, _, _, headings, tag, number, first, last in page.found:
        if k is not None:
            yield k, number, tag, headings, markdown.Writer().write(page.events, first, last, page.layout)


def _rows(df: DataFrame, id_col: str, html_col: str, selectors: Sequence[str], find: Callable[[str, Sequence[Sequence[Compound]]], Iterable[tuple]], last: str) -> DataFrame:
    """What ``find`` has for each page, elements numbered within their selector; what belongs to no chain is numbered by itself."""
    groups = [parse_selector(s) for s in selectors]
    chains = [c for g in groups for c in g]
    owner = [i for i, g in enumerate(groups) for _ in g]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # a part's rows leave before the next part is read
            for first, stop in parts(batch.column("html")):
                part, out = batch.slice(first, stop - first), []
                for i, html in enumerate(part.column("html").to_pylist()):
                    position: Counter[int | None] = Counter()
                    seen: dict[int | None, int] = {}
                    for k, number, tag, before, text in find(html or "", chains):
                        of = None if k is None else owner[k]
                        # alternatives of a selector meet an element once
                        if seen.get(of) == number:
                            continue
                        seen[of] = number
                        position[of] += 1
                        out.append((i, None if of is None else selectors[of], position[of], tag, before, text))
                page, *more = [pa.array([row[j] for row in out], t) for j, t in enumerate((pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column("id").take(page), *more], names=["id", "html_selector", "position", "tag", "n_headings", last])

    kind = dict(df.dtypes)[id_col]
    return df.select(F.col(id_col).alias("id"), F.col(html_col).alias("html")).mapInArrow(rows, f"id {kind}, html_selector string, position long, tag string, n_headings long, {last} string")


def elements(df: DataFrame, id_col: str, html_col: str, selectors: Sequence[str]) -> DataFrame:
    """A row for each selector and element that it meets: (id, html_selector, position, tag, n_headings, code), position from 1 within the selector.

    ``n_headings`` counts the headings that begin before the element. A null page has no elements.
    """
    return _rows(df, id_col, html_col, selectors, find_elements, "code")


def snippets(df: DataFrame, id_col: str, html_col: str, selectors: Sequence[str]) -> DataFrame:
    """As ``elements``, with the Markdown of each element as ``markdown``.

    Pages with such an element also have a row for each of their headings, with its text instead and no selector: what stands above an element are the first ``n_headings`` of them.
    """
    return _rows(df, id_col, html_col, selectors, find_snippets, "markdown")
