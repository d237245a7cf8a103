"""English stems by the published Porter algorithm, for search over inflected words."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The suffix tables of the algorithm's second, third and fourth step.
SECOND = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate",
    "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
THIRD = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
FOURTH = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """c and v for consonants and vowels; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(word: str) -> int:
    return len(re.findall("v+c+", _shape(word)))


def _short(word: str) -> bool:
    return _shape(word).endswith("cvc") and word[-1] not in "wxy"


def stem(word: str) -> str:
    """The stem of a lower-case word."""
    if len(word) < 3:
        return word
    w = re.sub("sses$", "ss", word) if word.endswith("sses") else re.sub("ies$", "i", word) if word.endswith("ies") else word if word.endswith("ss") else re.sub("s$", "", word)
    if w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    elif (m := re.search("(ed|ing)$", w)) and "v" in _shape(w[: m.start()]):
        w = w[: m.start()]
        if w.endswith(("at", "bl", "iz")) or (_measure(w) == 1 and _short(w)):
            w += "e"
        elif len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c" and w[-1] not in "lsz":
            w = w[:-1]
    if w.endswith("y") and "v" in _shape(w[:-1]):
        w = w[:-1] + "i"
    for table in (SECOND, THIRD):
        for end in sorted(table, key=len, reverse=True):
            if w.endswith(end):
                w = w[: -len(end)] + table[end] if _measure(w[: -len(end)]) > 0 else w
                break
    for end in sorted((*FOURTH, "ion"), key=len, reverse=True):
        if w.endswith(end):
            base = w[: -len(end)]
            if _measure(base) > 1 and (end != "ion" or base.endswith(("s", "t"))):
                w = base
            break
    if w.endswith("e") and (_measure(w[:-1]) > 1 or (_measure(w[:-1]) == 1 and not _short(w[:-1]))):
        w = w[:-1]
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


def _stems(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    known: dict[str, str] = {}
    for batch in batches:
        if len(known) > 200_000:
            known.clear()
        yield pd.Series([None if ws is None else [known[w] if w in known else known.setdefault(w, stem(w)) for w in ws] for ws in batch], dtype=object)


def stems(words: Column | str) -> Column:
    """The stems of an array of words."""
    return F.pandas_udf(_stems, "array<string>")(words)
