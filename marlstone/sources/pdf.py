"""Text of PDF files with its place: objects, Flate streams and text operators, a file at a time.

Read are plain objects and those of object streams, pages in the order of their
tree, and strings shown by text operators, by a font's ToUnicode map where it has
one. Runs on one line are joined, lines near each other are a block. Boxes are
exact at their left and lower edge; a run's width is estimated at half its size
for each character. A file that can't be read gives one row that says why.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "page int, block int, size double, box array<double>, text string, error string"
_OBJECT = re.compile(rb"(?<!\d)(\d+)\s+\d+\s+obj\b")
_STREAM = re.compile(rb"\s*stream\r?\n")
_TOKEN = re.compile(rb"[\0\t\n\f\r ]+|%[^\r\n]*|(<<|>>|\[|\])|/([^\0\t\n\f\r ()<>\[\]{}/%]*)|<([0-9A-Fa-f\s]*)>|(\()|([+-]?(?:\d+\.?\d*|\.\d+))|([^\0\t\n\f\r ()<>\[\]{}/%]+)|(.)", re.DOTALL)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
#: Space between runs that parts words, and between lines that parts blocks, in sizes.
WORD_GAP, BLOCK_GAP, HALF = 0.25, 1.6, 0.5


class Name(str):
    """A name, as told from an operator."""


class Ref(int):
    """The number of another object."""


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in parentheses, which may be nested or escaped, from behind the first."""
    out, depth = bytearray(), 1
    while at < len(data):
        c = data[at : at + 1]
        at += 1
        if c == b"\\":
            if m := re.compile(rb"[0-7]{1,3}").match(data, at):
                out.append(int(m.group(), 8) & 255)
                at = m.end()
            else:
                follows = data[at : at + 1]
                out += b"" if follows in (b"\n", b"\r") else _ESCAPES.get(follows, follows)
                at += 1
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            break
        out += c
    return bytes(out), at


def values(data: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """Values and operators (as bytes) one after another, each with where it ends."""
    stack: list[list] = []
    while at < len(data) and (m := _TOKEN.match(data, at)):
        at = m.end()
        mark, name, hexed, paren, number, word, _ = m.groups()
        if mark in (b"<<", b"["):
            stack.append([])
            continue
        if mark:
            if not stack:
                continue
            own = stack.pop()
            value = own if mark == b"]" else dict(zip(own[::2], own[1::2]))
        elif name is not None:
            value = Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda x: bytes([int(x[1], 16)]), name).decode("latin-1"))
        elif hexed is not None:
            digits = re.sub(rb"\s", b"", hexed).decode()
            value = bytes.fromhex(digits + "0" * (len(digits) % 2))
        elif paren:
            value, at = _string(data, at)
        elif number:
            value = float(number) if b"." in number else int(number)
        elif word == b"R" and stack and len(stack[-1]) >= 2:
            stack[-1].pop()
            value = Ref(stack[-1].pop())
        elif word in (b"true", b"false", b"null"):
            value = {b"true": True, b"false": False, b"null": None}[word]
        elif word:
            value = word
        else:
            continue
        if stack:
            stack[-1].append(value)
        else:
            yield value, at


def _objects(data: bytes) -> dict[int, tuple[object, bytes | None]]:
    """All objects by number, with the bytes of their stream; a later one of the same number counts."""
    found: dict[int, tuple[object, bytes | None]] = {}
    at = 0
    while m := _OBJECT.search(data, at):
        stop = data.find(b"endobj", m.end())
        value, end = next(values(data[m.end() : stop if stop > 0 else len(data)]), (None, 0))
        stream, at = None, m.end() + end
        if isinstance(value, dict) and (s := _STREAM.match(data, at)):
            size = value.get("Length")
            close = s.end() + size if type(size) is int and data[s.end() + size : s.end() + size + 12].strip().startswith(b"endstream") else data.find(b"endstream", s.end())
            close = close if close >= 0 else len(data)
            stream, at = data[s.end() : close], close
        found[int(m[1])] = value, stream
    for value, stream in list(found.values()):
        if isinstance(value, dict) and value.get("Type") == "ObjStm":
            body, first = _decoded(value, stream), value["First"]
            head = [v for v, _ in values(body[:first])]
            for number, begin in zip(head[::2], head[1::2]):
                found.setdefault(number, (next(values(body, first + begin), (None, 0))[0], None))
    return found


def _decoded(value: dict, stream: bytes | None) -> bytes:
    filters = value.get("Filter") or []
    for f in filters if isinstance(filters, list) else [filters]:
        if f != "FlateDecode":
            raise ValueError(f"filter {f} is not read")
        stream = zlib.decompressobj().decompress(stream or b"")
    return stream or b""


def _times(a: tuple, b: tuple) -> tuple:
    return a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5]


class _Document:
    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise ValueError("no PDF header")
        self.objects = _objects(data)
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise ValueError("the file is encrypted")

    def get(self, value: object) -> object:
        for _ in range(32):
            if not isinstance(value, Ref):
                return value
            value = self.objects.get(value, (None, None))[0]
        return None

    def pages(self) -> list[tuple[dict, dict]]:
        """Pages in order, each with its resources, which it may have from above."""
        roots = [v for v, _ in self.objects.values() if isinstance(v, dict) and v.get("Type") == "Catalog"]
        todo: list[tuple[object, object]] = [(r.get("Pages"), None) for r in roots[-1:]]
        out, seen = [], set()
        while todo:
            ref, above = todo.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or id(node) in seen:
                continue
            seen.add(id(node))
            resources = node.get("Resources", above)
            if "Kids" in node:
                todo += [(k, resources) for k in reversed(self.get(node["Kids"]) or [])]
            else:
                out.append((node, self.get(resources) or {}))
        if not out:
            raise ValueError("no pages")
        return out

    def stream(self, ref: object) -> bytes:
        value, data = self.objects.get(ref, (None, None)) if isinstance(ref, Ref) else (None, None)
        if isinstance(value, list):
            return b"\n".join(self.stream(v) for v in value)
        return _decoded(value, data) if isinstance(value, dict) else b""

    def letters(self, font: object) -> tuple[int, dict[int, str]]:
        """Bytes of a code, and what codes stand for, by a font's ToUnicode map."""
        font = self.get(font)
        if not isinstance(font, dict) or "ToUnicode" not in font:
            return 1, {}
        known, width, given = {}, 1, []
        for v, _ in values(self.stream(font["ToUnicode"])):
            if not isinstance(v, bytes) or v not in (b"endbfchar", b"endbfrange", b"endcodespacerange", b"beginbfchar", b"beginbfrange", b"begincodespacerange"):
                given.append(v)
                continue
            if v == b"endcodespacerange" and given:
                width = len(given[0])
            of = lambda b: b.decode("utf-16-be", "replace")
            if v == b"endbfchar":
                known |= {int.from_bytes(a): of(b) for a, b in zip(given[::2], given[1::2])}
            if v == b"endbfrange":
                for a, b, c in zip(given[::3], given[1::3], given[2::3]):
                    for i, code in enumerate(range(int.from_bytes(a), int.from_bytes(b) + 1)):
                        known[code] = of(c[i]) if isinstance(c, list) else of(c[:-2]) + chr(int.from_bytes(c[-2:]) + i)
            given = []
        return width, known

    def runs(self, page: dict, resources: dict) -> list[tuple[float, float, float, str]]:
        """(x, y, size, text) of what a page shows."""
        content = page.get("Contents")
        data = b"\n".join(self.stream(r) for r in content) if isinstance(content, list) else self.stream(content)
        fonts = self.get(resources.get("Font")) or {}
        known = {name: self.letters(f) for name, f in fonts.items()}
        unit = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)
        state = {"ctm": unit, "font": (1, {}), "size": 0.0, "leading": 0.0}
        saved, args, line, text = [], [], unit, unit
        out = []

        def show(raw: object) -> None:
            nonlocal text
            if not isinstance(raw, bytes):
                return
            width, letters = state["font"]
            codes = [raw[i : i + width] for i in range(0, len(raw), width)]
            said = "".join(letters.get(int.from_bytes(c)) or c.decode("cp1252", "replace") for c in codes)
            place = _times(text, state["ctm"])
            size = state["size"] * (place[2] ** 2 + place[3] ** 2) ** 0.5
            out.append((place[4], place[5], size, said))
            text = _times((1, 0, 0, 1, HALF * state["size"] * len(said), 0), text)

        for v, _ in values(data):
            if not isinstance(v, bytes) or v not in _OPERATORS:
                # other operators end their operands as well
                args = [] if isinstance(v, bytes) and v.isalpha() and v in _OTHERS else [*args, v][-64:]
                continue
            numbers = [a for a in args if isinstance(a, int | float)]
            if v == b"q":
                saved.append(dict(state))
            elif v == b"Q" and saved:
                state = saved.pop()
            elif v == b"cm" and len(numbers) >= 6:
                state["ctm"] = _times(tuple(numbers[-6:]), state["ctm"])
            elif v == b"BT":
                line = text = unit
            elif v == b"Tf" and numbers:
                name = next((a for a in reversed(args) if isinstance(a, Name)), None)
                state["font"], state["size"] = known.get(name, (1, {})), float(numbers[-1])
            elif v == b"TL" and numbers:
                state["leading"] = numbers[-1]
            elif v in (b"Td", b"TD") and len(numbers) >= 2:
                state["leading"] = -numbers[-1] if v == b"TD" else state["leading"]
                line = text = _times((1, 0, 0, 1, *numbers[-2:]), line)
            elif v == b"Tm" and len(numbers) >= 6:
                line = text = tuple(numbers[-6:])
            elif v in (b"T*", b"'", b'"'):
                line = text = _times((1, 0, 0, 1, 0, -state["leading"]), line)
            if v in (b"Tj", b"'", b'"') and args:
                show(args[-1])
            elif v == b"TJ" and args and isinstance(args[-1], list):
                for a in args[-1]:
                    if isinstance(a, int | float):
                        text = _times((1, 0, 0, 1, -a / 1000 * state["size"], 0), text)
                    else:
                        show(a)
            args = []
        return [r for r in out if r[3]]


_OPERATORS = frozenset([b"q", b"Q", b"cm", b"BT", b"ET", b"Tf", b"TL", b"Td", b"TD", b"Tm", b"T*", b"'", b'"', b"Tj", b"TJ"])
_OTHERS = frozenset([b"m", b"l", b"c", b"v", b"y", b"h", b"re", b"S", b"s", b"f", b"F", b"B", b"b", b"n", b"W", b"w", b"J", b"j", b"M", b"d", b"ri", b"i", b"gs", b"CS", b"cs", b"SC", b"sc", b"SCN", b"scn", b"G", b"g", b"RG", b"rg", b"K", b"k", b"sh", b"Do", b"Tc", b"Tw", b"Tz", b"Tr", b"Ts", b"BDC", b"BMC", b"EMC"])


def _blocks(runs: list[tuple[float, float, float, str]]) -> Iterator[tuple[float, list[float], str]]:
    """(size, box, text) of blocks: runs of one height make a line, lines near each other and of one size a block."""
    lines: list[list] = []
    for x, y, size, said in runs:
        if lines and abs(lines[-1][0] - y) <= HALF * size and x >= lines[-1][2] - size:
            last = lines[-1]
            last[4] += (" " if x - last[2] > WORD_GAP * size and not last[4].endswith(" ") else "") + said
            last[2], last[3] = max(last[2], x + HALF * size * len(said)), max(last[3], size)
        else:
            lines.append([y, x, x + HALF * size * len(said), size, said])
    block: list[list] = []
    for line in [*lines, None]:
        if block and (line is None or abs(line[3] - block[-1][3]) > 0.5 or not 0 < block[-1][0] - line[0] <= BLOCK_GAP * line[3]):
            box = [min(b[1] for b in block), min(b[0] for b in block), max(b[2] for b in block), max(b[0] + b[3] for b in block)]
            yield block[0][3], box, "\n".join(b[4].strip() for b in block)
            block = []
        if line is not None:
            block.append(line)


def read_bytes(data: bytes | None) -> list[tuple]:
    """(page, block, size, box, text, error) of a file, pages and blocks from 1."""
    try:
        document = _Document(data or b"")
        return [(p, b, *found, None) for p, page in enumerate(document.pages(), 1) for b, found in enumerate(_blocks(document.runs(*page)), 1)]
    except Exception as e:  # whatever a broken file makes fail is told in its row
        return [(None, None, None, None, None, f"{type(e).__name__}: {e}")]


def elements(df: DataFrame, id_col: str, bytes_col: str) -> DataFrame:
    """The blocks of PDF files given as bytes: (id, page, block, size, box, text, error)."""

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for ident, data in zip(batch["id"], batch["data"], strict=True):
                yield pd.DataFrame([(ident, *r) for r in read_bytes(data)], columns=["id", *(c.split()[0] for c in SCHEMA.split(", "))]).astype({"page": "Int32", "block": "Int32"})

    return df.select(F.col(id_col).alias("id"), F.col(bytes_col).alias("data")).mapInPandas(rows, f"id {dict(df.dtypes)[id_col]}, {SCHEMA}")


def read(spark: SparkSession, path: str) -> DataFrame:
    """The blocks of all PDF files below a path; ``id`` is the file's."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[pP][dD][fF]").option("recursiveFileLookup", "true").load(path)
    return elements(files.select("path", "content"), "path", "content")
