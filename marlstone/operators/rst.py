"""Code of reStructuredText by its indentation: directives with options, literal blocks and doctests, in lists and in other directives."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Directives whose content is code.
CODE_DIRECTIVES = frozenset({"code-block", "code", "sourcecode", "parsed-literal", "testcode", "doctest", "highlight-block"})
BLOCKS = "array<struct<code:string,language:string,line:int,description:string>>"
_DIRECTIVE = re.compile(r"\.\.\s+([A-Za-z][\w:.-]*?)::(?:\s+(.*))?$")
_OPTION = re.compile(r":[\w -]+:(?:\s|$)")
_ITEM = re.compile(r"(?:[*+•-]|\(?(?:\d+|[A-Za-z#])[.)])\s+")


def _indent(line: str) -> int:
    return len(line) - len(line.lstrip())


def _body(lines: list[str], at: int, indent: int) -> int:
    """Behind the lines that are blank or stand further in than ``indent``, from ``at``."""
    last = at
    while at < len(lines) and (not lines[at].strip() or _indent(lines[at]) > indent):
        at += 1
        if lines[at - 1].strip():
            last = at
    return last


def _dedented(lines: list[str]) -> str:
    inner = min((_indent(x) for x in lines if x.strip()), default=0)
    out = [x[inner:].rstrip() for x in lines]
    while out and not out[0]:
        out.pop(0)
    while out and not out[-1]:
        out.pop()
    return "\n".join(out)


def code_blocks(text: str | None) -> list[dict]:
    """Blocks of code in order: code, language, line (from 1), and the paragraph that stands nearest before it."""
    lines = [x.expandtabs(8) for x in (text or "").splitlines()]
    out: list[dict] = []
    paragraph: list[str] = []
    told, at = "", 0

    def add(first: int, stop: int, language: str | None, line: int) -> None:
        if code := _dedented(lines[first:stop]):
            out.append({"code": code, "language": language or None, "line": line + 1, "description": " ".join(paragraph) or told})

    while at < len(lines):
        line = lines[at]
        bare = line.strip()
        if not bare:
            if paragraph:
                told, paragraph = " ".join(paragraph), []
            at += 1
            continue
        # a mark of a list is no part of what stands behind it; what belongs to it stands in as far
        inner, indent = bare, _indent(line)
        while m := _ITEM.match(inner):
            indent += m.end()
            inner = inner[m.end() :]
        if m := _DIRECTIVE.match(inner):
            stop = _body(lines, at + 1, indent)
            if m[1] in CODE_DIRECTIVES:
                first = at + 1
                while first < stop and _OPTION.match(lines[first].strip()):
                    first += 1
                add(first, stop, (m[2] or "").strip(), at)
                at = stop
            else:
                at += 1  # its content is read like all else
                while at < stop and _OPTION.match(lines[at].strip()):
                    at += 1
            continue
        if inner.startswith(".. ") or inner == "..":
            at = _body(lines, at + 1, indent)  # a comment or a target
            continue
        if inner.startswith(">>> "):
            stop = at
            while stop < len(lines) and lines[stop].strip():
                stop += 1
            add(at, stop, "pycon", at)
            at = stop
            continue
        paragraph.append(inner[:-1] if inner.endswith("::") else inner)
        if inner.endswith("::"):
            first = at + 1
            while first < len(lines) and not lines[first].strip():
                first += 1
            if first < len(lines) and first > at + 1 and _indent(lines[first]) > _indent(line):
                stop = _body(lines, first, min(indent, _indent(lines[first]) - 1))
                add(first, stop, None, first)
                at = stop
                continue
        at += 1
    return out


def blocks(text: Column) -> Column:
    """The blocks of each text, as an array of structs."""

    @F.pandas_udf(BLOCKS)
    def found(texts: pd.Series) -> pd.Series:
        return pd.Series([code_blocks(t) for t in texts], dtype=object)

    return found(text)
