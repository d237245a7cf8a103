"""Markdown of an element, from the start tags, texts and end tags that a page's parser met.

Paragraphs, headings, lists, quotes, tables and fenced code; bold, italic, struck
and code words, links and images. What a text holds of Markdown's own marks is
escaped, so that a reader finds the blocks that the page has and no others.
Headings and code stand at the margin, also those of lists, quotes and tables, and
each heading has a line, a blank one that of its name.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Sequence

HEADINGS = frozenset({"h1", "h2", "h3", "h4", "h5", "h6"})
#: Tags at which a text ends.
BLOCKS = HEADINGS | set(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form head header hr html legend li main nav ol option p pre section select summary table tbody td tfoot th thead title tr ul".split()
)
#: What makes a table one of layout, whose cells are blocks.
LAYOUT = HEADINGS | set("blockquote dl ol pre table ul".split())
MARKS = {"b": "**", "strong": "**", "i": "*", "em": "*", "del": "~~", "s": "~~", "a": "[", "code": "`", "kbd": "`", "samp": "`"}
START, VOID, TEXT, END = range(4)

_SPACE = re.compile(r"[ \t\r\n\f]+")
_SPECIAL = re.compile(r"([\\`*_~\[\]<]|&(?=#?\w{1,32};))")
_LINE_MARK = re.compile(r"^(?:(?=[#>+=|-])|(\d+)(?=[.)](?:\s|$)))")
#: A line of code that would read as a fence has a backslash before it; ``extract.html_rows`` takes one off.
_FENCE = re.compile(r"^(?=\\*```)", re.M)


def _code(text: str) -> str:
    """Words as code; with two marks of code in a row they stay text, as a fence could not be told from longer marks."""
    if "``" in text:
        return _SPECIAL.sub(r"\\\1", text)
    mark, pad = ("``", " ") if "`" in text else ("`", "")
    return f"{mark}{pad}{text}{pad}{mark}"


def _address(url: str | None) -> str:
    url = _SPACE.sub("%20", (url or "").strip())
    return f"<{url.replace('<', '%3C').replace('>', '%3E')}>" if "(" in url or ")" in url else url


class Writer:
    """Markdown of one element. Events are (START, tag, attributes), (TEXT, text) and (END, tag), and (VOID, tag, attributes) of elements that have no end tag."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.words: list[str] = []  # of the block that is open; a break is a line end
        self.code: list[str] = []
        self.level = self.pre = self.paragraphs = self.quotes = 0
        self.lists: list[list] = []  # tag, items
        self.marker: str | None = None
        self.joined = False  # whether the last block belongs to the list that is open
        self.marks: list[list] = []  # mark, its address, first word
        self.table: list[list[str]] | None = None
        self.in_cell = False
        self.open: list[str | None] = []  # what the end tag of each open element does

    def write(self, events: Sequence[tuple], first: int, last: int, layout: Collection[int]) -> str:
        for i in range(first, last):
            kind, what, *more = events[i]
            if kind == TEXT:
                self._text(what)
            elif kind == START:
                self.open.append(self._start(what, more[0], i in layout))
            elif kind == VOID:
                self._void(what, more[0])
            elif (done := self.open.pop()) is not None:
                self._end(done)
        self._flush()
        return "\n".join(self.lines)

    def _text(self, data: str) -> None:
        if self.pre and not self.level:
            self.code.append(data)
        else:
            data = _SPACE.sub(" ", data)
            self.words.append(data if self._in_code() else _SPECIAL.sub(r"\\\1", data))

    def _in_code(self) -> bool:
        return any(m[0] == "`" for m in self.marks)

    def _start(self, tag: str, attributes: dict[str, str | None], layout: bool) -> str | None:
        """What the end tag of this element has to do."""
        done = None
        if tag in HEADINGS and not self.paragraphs and not self.in_cell:
            self._flush()
            self.level, done = int(tag[1]), "block"
        elif self.level or self.paragraphs or self.pre or self.in_cell:
            if tag in MARKS and (not self.pre or self.level):
                done = self._mark(tag, attributes)
            elif tag == "pre" and self.pre and not self.level:
                self.pre, done = self.pre + 1, "pre"
            elif tag in BLOCKS and (not self.pre or self.level):
                self.words.append(" ")
        elif tag in MARKS:
            done = self._mark(tag, attributes)
        elif tag in BLOCKS:
            self._flush()
            done = "block"
            if tag == "p":
                self.paragraphs, done = 1, "p"
            elif tag == "pre":
                self.pre, done = 1, "pre"
            elif tag == "blockquote":
                self.quotes, done = self.quotes + 1, "quote"
            elif tag in ("ul", "ol"):
                self.joined = self.joined and bool(self.lists)
                self.lists.append([tag, 0])
                done = "list"
            elif tag == "li":
                if self.lists:
                    self.lists[-1][1] += 1
                self.marker, done = f"{self.lists[-1][1]}. " if self.lists and self.lists[-1][0] == "ol" else "- ", "li"
            elif tag == "table" and not layout:
                self.table, done = [], "table"
            elif tag == "tr" and self.table is not None:
                self.table.append([])
            elif tag in ("td", "th") and self.table is not None:
                self.in_cell, done = True, "cell"
        return done

    def _void(self, tag: str, attributes: dict[str, str | None]) -> None:
        if tag == "br":
            (self.code if self.pre and not self.level else self.words).append("\n")
        elif tag == "hr" and not (self.level or self.paragraphs or self.pre or self.in_cell):
            self._flush()
        elif tag == "img" and (not self.pre or self.level) and not self._in_code():
            shown = _SPECIAL.sub(r"\\\1", _SPACE.sub(" ", attributes.get("alt") or ""))
            self.words.append(f"![{shown}]({_address(attributes.get('src'))})")

    def _mark(self, tag: str, attributes: dict[str, str | None]) -> str | None:
        mark, address = MARKS[tag], None
        if self._in_code() or any(m[0] == mark for m in self.marks) or mark == "[" and not attributes.get("href"):
            return None
        if mark == "[":
            address = _address(attributes["href"])
        self.marks.append([mark, address, len(self.words)])
        return "mark"

    def _close_mark(self, mark: str, address: str | None, first: int) -> None:
        inner = "".join(self.words[first:])
        del self.words[first:]
        left = inner.lstrip(" \n")
        core = left.rstrip(" \n")
        if core:
            if mark == "[" and inner == left and self.words and self.words[-1].endswith("!"):
                # a link is no image
                self.words[-1] = self.words[-1][:-1] + "\\!"
            put = _code(_SPACE.sub(" ", core)) if mark == "`" else f"[{core}]({address})" if mark == "[" else mark + core + mark
            inner = inner[: len(inner) - len(left)] + put + left[len(core) :]
        self.words.append(inner)

    def _end(self, done: str) -> None:
        if done == "mark":
            self._close_mark(*self.marks.pop())
            return
        if done == "cell":
            self.in_cell = False
            if not self.table:
                self.table = [[]]
            self.table[-1].append(" ".join(self._taken().split()).replace("|", "\\|"))
            return
        self._flush()
        if done == "p":
            self.paragraphs = 0
        elif done == "pre":
            self.pre -= 1
        elif done == "quote":
            self.quotes -= 1
        elif done == "li":
            self.marker = None
        elif done == "list":
            self.lists.pop()
            self.joined = self.joined and bool(self.lists)
        elif done == "table":
            rows, self.table = [r for r in self.table or [] if any(r)], None
            if rows:
                shown = ["| " + " | ".join(r) + " |" for r in rows]
                self._block([shown[0], "|" + " --- |" * len(rows[0]), *shown[1:]])

    def _taken(self) -> str:
        """The words of the open block, what is marked in them closed; the marks go on in the next block."""
        for m in reversed(self.marks):
            self._close_mark(*m)
        for m in self.marks:
            m[2] = 0
        text, self.words = "".join(self.words), []
        return re.sub(" ?\n ?", "\n", re.sub(" {2,}", " ", text)).strip(" \n")

    def _flush(self) -> None:
        """End the open block."""
        text = self._taken()
        if self.level:
            # other line ends than those of texts would end a heading
            self._block(["#" * self.level + " " + (" ".join(text.split()) or "Unnamed Section")], margin=True)
            self.level = 0
        elif text:
            lines = [_LINE_MARK.sub(r"\1\\", x) for x in text.split("\n")]
            self._block([x + "\\" for x in lines[:-1]] + lines[-1:])
        code, self.code = "".join(self.code).replace("\r\n", "\n").replace("\r", "\n").strip(), []
        if code:
            self._block(["```", *_FENCE.sub(r"\\", code).split("\n"), "```"], margin=True)

    def _block(self, lines: list[str], margin: bool = False) -> None:
        if self.lines and (margin or not self.joined):
            self.lines.append("")
        self.joined = bool(self.lists) and not margin
        if margin or not (self.quotes or self.lists or self.marker):
            self.lines += lines
            return
        before = "> " * self.quotes + "  " * (len(self.lists) - 1)
        first = self.marker or ("  " if self.lists else "")
        self.marker = None
        self.lines += [before + (first if i == 0 else " " * len(first)) + x for i, x in enumerate(lines)]
