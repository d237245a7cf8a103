"""Fuzzy ratio: twice the longest common subsequence over both lengths, in percent."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def common(a: str, b: str) -> int:
    """Length of the longest common subsequence, by bit-parallel rows."""
    at: dict[str, int] = {}
    for i, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << i
    row = full = (1 << len(a)) - 1
    for c in b:
        hit = row & at.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    return 100.0 * 2 * common(a, b) / (len(a) + len(b)) if a or b else 100.0


def _ratios(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for left, right in pairs:
        yield pd.Series([None if a is None or b is None else ratio(a, b) for a, b in zip(left, right, strict=True)], dtype="float64")


def _best_ratios(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for words, terms in pairs:
        out = []
        for ws, term in zip(words, terms, strict=True):
            best = 0.0
            for w in set(ws if ws is not None else ()):
                if 200.0 * min(len(w), len(term)) / max(1, len(w) + len(term)) > best:
                    best = max(best, ratio(w, term))
            out.append(best)
        yield pd.Series(out, dtype="float64")


def fuzzy_ratio(left: Column | str, right: Column | str) -> Column:
    """Ratio of two string columns; null where either is null."""
    return F.pandas_udf(_ratios, "double")(left, right)


def best_word_ratio(words: Column | str, term: Column | str) -> Column:
    """The best ratio of a term with any of the words of an array.

    A word whose length alone keeps the ratio below the best so far is passed over.
    """
    return F.pandas_udf(_best_ratios, "double")(words, term)
