"""Glossary terms in texts: the longest first, as whole words, without overlaps."""

from __future__ import annotations

from array import array
from collections.abc import Sequence
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.batches import parts

#: The colour terms that a new glossary starts with.
COLOURS = {
    "red": "the colour of blood", "green": "the colour of grass", "blue": "the colour of a clear sky", "yellow": "the colour of lemons", "orange": "between red and yellow",
    "purple": "between blue and red", "black": "the absence of light", "white": "all light together", "color": "how light of a wavelength looks",
    "primary color": "a colour that others are mixed from", "secondary color": "a mix of two primary colours", "RGB": "red, green and blue", "hue": "the pure form of a colour",
}
MATCHES = "array<struct<term:string,begin:int,stop:int>>"


def glossary(spark: SparkSession, terms: dict[str, str] | None = None) -> DataFrame:
    """(term, term_lower, definition, length) of the given terms, or of the colours."""
    rows = [(t, t.lower(), d, len(t)) for t, d in (COLOURS if terms is None else terms).items()]
    return spark.createDataFrame(rows, "term string, term_lower string, definition string, length int")


def add_terms(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """New terms are added; known ones (whatever their case) keep their spelling and take the new definition."""
    new = incoming.select("term", F.lower("term").alias("term_lower"), "definition", F.length("term").alias("length")).groupBy("term_lower").agg(F.max(F.struct("definition", "term", "length")).alias("n"))
    both = known.alias("k").join(new.alias("n"), "term_lower", "full_outer")
    return both.select(F.coalesce("k.term", "n.n.term").alias("term"), "term_lower", F.coalesce("n.n.definition", "k.definition").alias("definition"), F.coalesce("k.length", "n.n.length").alias("length"))


def terms_in_order(known: DataFrame) -> DataFrame:
    return known.orderBy("term_lower")


def _low(text: str) -> str:
    """Lower case, each character for itself, so that places stay."""
    low = text.lower()
    return low if len(low) == len(text) else "".join(x if len(x := c.lower()) == 1 else c for c in text)


class Finder:
    """An automaton of all terms: one pass over a text, however many there are."""

    def __init__(self, terms: Sequence[str]):
        self.ordered = sorted((t for t in dict.fromkeys(terms) if t), key=lambda t: (-len(t), t))
        self.automaton = ahocorasick.Automaton()
        for rank, term in enumerate(self.ordered):
            if (low := _low(term)) not in self.automaton:
                self.automaton.add_word(low, rank)
        if self.ordered:
            self.automaton.make_automaton()

    def places(self, text: str) -> list[tuple[str, int, int]]:
        """Matches of whole words, the longest first; what overlaps a longer one, or an earlier one of equal length, is none."""
        return [(self.ordered[rank], begin, stop) for rank, begin, stop in self.ranked(text)]

    def ranked(self, text: str) -> list[tuple[int, int, int]]:
        """The places, with the rank of the term in ``ordered``."""
        if not self.ordered:
            return []
        inside = lambda i: 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")
        found = []
        for last, rank in self.automaton.iter(_low(text)):
            begin, stop = last + 1 - len(self.ordered[rank]), last + 1
            if not inside(begin - 1) and not inside(stop):
                found.append((rank, begin, stop))
        taken, out = bytearray(len(text)), []
        for rank, begin, stop in sorted(found):
            # what is shorter than all that is placed overlaps one of them only with an end
            if not taken[begin] and not taken[stop - 1]:
                taken[begin:stop] = b"\x01" * (stop - begin)
                out.append((rank, begin, stop))
        return sorted(out, key=lambda x: x[1])


@lru_cache(4)
def _finder(terms: tuple[str, ...]) -> Finder:
    return Finder(terms)


def find_terms(df: DataFrame, terms: Sequence[str], text_col: str = "text", limit: int | None = None) -> Column:
    """A column with the matches of ``terms`` in the whole text, or in its first ``limit`` characters, in order of place.

    The terms are a glossary: they are part of the function that is sent out, and
    a worker makes its automaton once.
    """
    own = tuple(terms)

    @F.arrow_udf(MATCHES)
    def matches(texts: pa.Array) -> pa.Array:
        # places are kept as numbers, not as an object for each match
        finder, ranks, begins, stops, ends = _finder(own), array("i"), array("i"), array("i"), array("i", [0])
        for first, last in parts(texts):
            for text in texts.slice(first, last - first).to_pylist():
                for rank, begin, stop in finder.ranked((text or "")[:limit]):
                    ranks.append(rank)
                    begins.append(begin)
                    stops.append(stop)
                ends.append(len(ranks))
        numbers = lambda x: pa.array(np.frombuffer(x, np.int32) if x else [], pa.int32())
        found = pa.StructArray.from_arrays([pa.array(finder.ordered, pa.string()).take(numbers(ranks)), numbers(begins), numbers(stops)], ["term", "begin", "stop"])
        return pa.ListArray.from_arrays(numbers(ends), found)

    return matches(F.col(text_col))


def unique_terms(matches: Column, top_n: int | None = None) -> Column:
    """The terms found (the first ``top_n``, if that is given), each once, in order of their lower-case form."""
    pairs = F.array_sort(F.array_distinct(F.transform(matches, lambda m: F.struct(F.lower(m["term"]).alias("low"), m["term"].alias("term")))))
    terms = F.transform(pairs, lambda p: p["term"])
    return terms if top_n is None else F.slice(terms, 1, top_n)


def highlight(text: Column, matches: Column, begin: str = "**", stop: str = "**", limit: int | None = None) -> Column:
    """The text (its first ``limit`` characters, if that is given) with marks around the matches; pieces are joined once."""

    @F.arrow_udf("string")
    def marked(texts: pa.Array, found: pa.Array) -> pa.Array:
        done = []
        for first, last in parts(texts):
            places, out = found.slice(first, last - first), []
            ends = np.cumsum(pc.fill_null(pc.list_value_length(places), 0).to_numpy(zero_copy_only=False)).tolist()
            flat = places.flatten()
            begins, stops, i = flat.field("begin").to_pylist(), flat.field("stop").to_pylist(), 0
            for own, end in zip(texts.slice(first, last - first).to_pylist(), ends, strict=True):
                if own is None:
                    out.append(None)
                else:
                    own, at, pieces = own[:limit], 0, []
                    for x, y in zip(begins[i:end], stops[i:end], strict=True):
                        pieces += [own[at:x], begin, own[x:y], stop]
                        at = y
                    out.append("".join([*pieces, own[at:]]))
                i = end
            done.append(pa.array(out, pa.string()))
        return pa.concat_arrays(done) if done else pa.array([], pa.string())

    return marked(text, matches)


def create(spark: SparkSession, terms: DataFrame, known: DataFrame | None = None, truncate: bool = False) -> DataFrame:
    """A glossary (term, term_lower, definition, length) of unique terms; ValueError where a term comes twice. ``truncate`` drops what was there."""
    new = terms.select("term", F.lower("term").alias("term_lower"), "definition", F.length("term").alias("length"))
    if known is not None and not truncate:
        new = known.unionByName(new)
    if not new.groupBy("term").count().filter("count > 1").isEmpty():
        raise ValueError("a term comes twice")
    return new


def add_counted(known: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """As ``add_terms``, with one row that tells how many terms were added and how many took a new definition."""
    own = incoming.select(F.lower("term").alias("term_lower")).distinct().join(known.select("term_lower", F.lit(1).alias("old")), "term_lower", "left")
    return add_terms(known, incoming), own.agg(F.count_if(F.col("old").isNull()).alias("added"), F.count("old").alias("updated"))
