"""JSON in running text: the first balanced value, and the repair of broken ones, each in one pass over the text."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bare words that stand for values of JSON.
BARE = {"true": "true", "false": "false", "null": "null", "True": "true", "False": "false", "None": "null", "undefined": "null", "NaN": "null"}
_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?\Z")
_MARK = re.compile(r'[\[\]{}"]')
_SKIP = re.compile(r"(?:\s+|//[^\n]*|/\*.*?(?:\*/|\Z))+", re.DOTALL)
_WORD = re.compile(r"[^\s,:\[\]{}\"']+")
_PLAIN = re.compile(r"[^\\\"'\x00-\x1f]+")
#: What may stand behind the quote that ends a string.
_AFTER = re.compile(r"\s*(?:[,:}\]]|\Z)|\s+[\"']")
CLOSES = {"{": "}", "[": "]"}


def _is_json(text: str) -> bool:
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return False
    return True


def spans(text: str) -> Iterator[tuple[int, int]]:
    """Balanced brackets and braces, the outermost ones in order; what is never closed ends with the text."""
    stack, start, in_string, at = [], 0, False, 0
    while m := _MARK.search(text, at):
        at, mark = m.end(), m.group()
        if mark == '"':
            if stack and (not in_string or _even(text, m.start())):
                in_string = not in_string
        elif in_string:
            continue
        elif mark in CLOSES:
            if not stack:
                start = m.start()
            stack.append(CLOSES[mark])
        elif stack and stack[-1] == mark:
            stack.pop()
            if not stack:
                yield start, at
    if stack:
        yield start, len(text)


def _even(text: str, at: int) -> bool:
    """Whether an even number of backslashes stands before a place."""
    n = 0
    while at - n > 0 and text[at - n - 1] == "\\":
        n += 1
    return n % 2 == 0


class _Repair:
    """Writes a value of JSON from what seems to be meant; a stack of what is open, no recursion."""

    def __init__(self, text: str):
        self.text, self.at, self.out = text, 0, []

    def _blank(self) -> None:
        if m := _SKIP.match(self.text, self.at):
            self.at = m.end()

    def _string(self) -> str:
        """A quoted string; a quote that no mark, end or opening quote follows belongs to it."""
        quote, parts, text = self.text[self.at], [], self.text
        self.at += 1
        while self.at < len(text):
            if m := _PLAIN.match(text, self.at):
                parts.append(m.group())
                self.at = m.end()
                continue
            c = text[self.at]
            self.at += 1
            if c == "\\":
                follows = text[self.at : self.at + 1]
                if follows == "u" and re.match(r"[0-9a-fA-F]{4}", text[self.at + 1 : self.at + 5]):
                    parts.append(text[self.at - 1 : self.at + 5])
                    self.at += 5
                else:
                    parts.append("\\" + follows if follows and follows in '"\\/bfnrt' else follows if follows == "'" else "\\\\")
                    self.at += 1 if follows and follows in "\"\\/bfnrt'" else 0
            elif c == quote and _AFTER.match(text, self.at):
                break
            elif c == '"':
                parts.append('\\"')
            elif c < " ":
                parts.append(json.dumps(c)[1:-1])
            else:
                parts.append(c)
        return '"' + "".join(parts) + '"'

    def _scalar(self) -> str | None:
        if self.text[self.at] in "\"'":
            return self._string()
        m = _WORD.match(self.text, self.at)
        if not m:
            self.at += 1
            return None
        self.at = m.end()
        word = m.group()
        return BARE.get(word) or (word if _NUMBER.match(word) else json.dumps(word, ensure_ascii=False))

    def value(self) -> str:
        """The first value that opens at the start of the text."""
        # of an open bracket: its kind, whether something stands in it, and whether a key waits for its value
        stack: list[list] = []
        text, n_open = self.text, {"}": 0, "]": 0}
        while True:
            self._blank()
            if self.at >= len(text):
                break
            c = text[self.at]
            if c in CLOSES:
                self._before(stack, False)
                self.out.append(c)
                stack.append([c, False, False])
                n_open[CLOSES[c]] += 1
                self.at += 1
            elif c in "]}":
                self.at += 1
                if n_open[c]:
                    while (closed := self._close(stack)) != c:
                        n_open[closed] -= 1
                    n_open[c] -= 1
                if not stack:
                    return "".join(self.out)
            elif c in ",:":
                if c == "," and stack[-1][2]:
                    self.out.append("null")
                    stack[-1][2] = False
                self.at += 1
            else:
                scalar = self._scalar()
                if scalar is not None:
                    is_key = stack[-1][0] == "{" and not stack[-1][2]
                    self._before(stack, is_key)
                    self.out.append(("" if not is_key else scalar if scalar[0] == '"' else json.dumps(scalar)) + ":" if is_key else scalar)
        while stack:
            self._close(stack)
        return "".join(self.out)

    def _before(self, stack: list[list], is_key: bool) -> None:
        """What must stand before a key or a value."""
        if not stack:
            return
        top = stack[-1]
        if top[2]:
            top[2] = False
            return
        if top[1]:
            self.out.append(",")
        top[1] = True
        if is_key:
            top[2] = True
        elif top[0] == "{":
            self.out.append('"":')  # a value without a key

    def _close(self, stack: list[list]) -> str:
        kind, _, waits = stack.pop()
        self.out.append(("null" if waits else "") + CLOSES[kind])
        return CLOSES[kind]


def first_value(text: str | None) -> str | None:
    """The first object or array of a text that is JSON; else the first one, repaired; None where nothing opens."""
    first = None
    for start, stop in spans(text or ""):
        if _is_json(text[start:stop]):
            return text[start:stop]
        if first is None:
            first = start
    return None if first is None else _Repair(text[first:]).value()


def first_json(text: Column) -> Column:
    """The first object or array of a text as JSON, repaired where none is whole; null where there is none."""

    @F.pandas_udf("string")
    def values(batch: pd.Series) -> pd.Series:
        return pd.Series([first_value(t) for t in batch], dtype=object)

    return values(text)
