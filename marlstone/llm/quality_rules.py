"""Quality rules by repetition coverage.

Words of a slice of texts are numbered; rolling hashes of several n-gram lengths
run over the numbers in numpy, and a cumulative sum over their ends gives the
words, and so the characters, that lie inside n-grams found more than once in
their document. Lines that repeat an earlier line are measured alike.

Edge cases: a null or empty text, or one without words, has zero counts and is
not kept (fewer than MIN_WORDS words). Repeated rows are judged each. Other
columns of the input are not read, so they cannot clash. Whole texts are judged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import slices

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SYMBOLS = "#*$%&|<>"
MIN_WORDS, BASE_NGRAM, BASE_PERCENT = 20, 8, 30
#: Lengths of n-grams whose duplicates are measured together, and of those measured by the most frequent one alone.
DUPLICATED, MOST_FREQUENT = (5, 6, 7, 8, 9, 10), (2, 3, 4)
#: The share of a document's characters that any of these, or repeated lines, may cover (the base rule's 30 %).
MOST_COVERED = 0.30

SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, dup_line_chars double, dup_ngram_chars double, top_ngram_chars double"
_ROLL = np.uint64(0x9E3779B97F4A7C15)


def _mixed(numbers: np.ndarray) -> np.ndarray:
    """Numbers spread over 64 bits (splitmix)."""
    x = (numbers.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _windows(spread: np.ndarray, n: int, known: dict[int, np.ndarray]) -> np.ndarray:
    """Hash of the n words from each place on, from that of n-1 words."""
    if n not in known:
        known[n] = spread if n == 1 else _windows(spread, n - 1, known)[:-1] * _ROLL + spread[n - 1 :]
    return known[n]


def _repeats(hashes: np.ndarray) -> np.ndarray:
    """For each place how often its hash occurs."""
    order = np.argsort(hashes)
    ordered = hashes[order]
    first = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
    size = np.diff(np.append(first, len(hashes)))
    count = np.empty(len(hashes), dtype=np.int64)
    count[order] = np.repeat(size, size)
    return count


def _covered(starts: np.ndarray, n: int, size: int) -> np.ndarray:
    """Which of ``size`` words lie in the n-grams that start at ``starts``."""
    change = np.zeros(size + 1, dtype=np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + n, -1)
    return np.cumsum(change)[:-1] > 0


def measure(texts: list[str]) -> pd.DataFrame:
    """The rules' figures and verdicts for a slice of texts."""
    words = [WORD.findall(text) for text in texts]
    n_words = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    flat = [w for ws in words for w in ws]
    chars = np.fromiter(map(len, flat), dtype=np.int64, count=len(flat))
    doc = np.repeat(np.arange(len(texts)), n_words)
    # a word's number differs from document to document, so equal hashes mean equal words of one document
    spread = _mixed(pd.factorize(np.array(flat, dtype=object))[0]) if flat else np.empty(0, np.uint64)
    spread = _mixed(spread ^ _mixed(doc))
    known: dict[int, np.ndarray] = {}
    total = np.maximum(np.bincount(doc, chars, len(texts)), 1)

    out = pd.DataFrame({"n_words": n_words, "word_chars": np.bincount(doc, chars, len(texts)).astype(np.int64)})
    out["n_symbols"] = [sum(map(text.count, SYMBOLS)) for text in texts]
    dup_lines, dup_line_chars = [], []
    for text in texts:
        seen: set[str] = set()
        again = [line for line in text.split("\n") if (line in seen or seen.add(line)) and WORD.search(line)]
        dup_lines.append(len(again))
        dup_line_chars.append(sum(len(w) for line in again for w in WORD.findall(line)))
    out["n_dup_lines"], out["dup_line_chars"] = np.array(dup_lines, np.int64), np.array(dup_line_chars) / total
    dup, top = np.zeros(len(texts)), np.zeros(len(texts))
    ends = np.concatenate(([0], np.cumsum(chars)))
    at = np.arange(len(doc))
    for n in range(2, max(DUPLICATED) + 1):
        # an n-gram that occurs twice starts where a shorter one does
        at = at[at + n <= len(doc)]
        at = at[doc[at] == doc[at + n - 1]]
        count = _repeats(_windows(spread, n, known)[at]) if len(at) else at
        at, count = at[count > 1], count[count > 1]
        if n in MOST_FREQUENT:
            np.maximum.at(top, doc[at], count * (ends[at + n] - ends[at]))
        if n in DUPLICATED:
            inside = _covered(at, n, len(doc))
            dup = np.maximum(dup, np.bincount(doc[inside], chars[inside], len(texts)))
            if n == BASE_NGRAM:
                out["n_repeat_words"] = np.bincount(doc[inside], minlength=len(texts)).astype(np.int64)
    dup, top = dup / total, top / total
    failed = (dup > MOST_COVERED) | (top > MOST_COVERED) | (out["dup_line_chars"].to_numpy() > MOST_COVERED)
    out["dup_ngram_chars"], out["top_ngram_chars"] = dup, top
    out["base_failed"] = (n_words < MIN_WORDS) | (100 * out["n_repeat_words"] > BASE_PERCENT * n_words)
    out["kept"] = ~out["base_failed"] & ~failed
    return out


def judge(df: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Per row the columns ``keep`` and the figures and verdicts of its text; one pass, nothing is shuffled."""

    @F.pandas_udf(SCHEMA)
    def rules(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [field.split()[0] for field in SCHEMA.split(", ")]
        for batch in batches:
            parts = [measure(part) for _, part in slices(batch)]
            yield pd.concat(parts, ignore_index=True)[names] if parts else pd.DataFrame(columns=names)

    inside = [f"_keep{i}" for i in range(len(keep))]
    measured = df.select(*(F.col(c).alias(i) for c, i in zip(keep, inside, strict=True)), rules(F.col(text_col)).alias("_rules"))
    return measured.select(*(F.col(i).alias(c) for c, i in zip(keep, inside, strict=True)), "_rules.*")
