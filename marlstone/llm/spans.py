"""Regular-expression matches with their places, in DataFrame functions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,rank:int,kind:string,end:int>>"


def no_spans() -> Column:
    return F.array().cast(SPAN)


#: Elements that are folded together: arrays that grow one by one stay this short.
BLOCK = 128


def running(values: Column, add: Callable[[Column, Column], Column]) -> Column:
    """For each of an array of ints the fold of 0 and all before it. In blocks, so that long arrays take no quadratic time."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    step = lambda state, v: F.struct(add(state["at"], v).alias("at"), F.array_append(state["out"], state["at"]).alias("out"))
    before = lambda vs: F.aggregate(vs, start, step, lambda state: state["out"])

    def blocks(vs: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(vs) - 1) / BLOCK).cast("int")), lambda b: F.slice(vs, b * BLOCK + 1, F.lit(BLOCK)))

    def folded(bs: Column) -> Column:
        firsts = before(F.transform(bs, lambda block: F.aggregate(block, F.lit(0), add)))
        return F.flatten(F.zip_with(bs, firsts, lambda block, first: F.transform(before(block), lambda x: add(first, x))))

    # the values, then the blocks, are bound once, as the one element of an array
    some = F.filter(F.array(values), lambda vs: F.size(vs) > 0)
    return F.flatten(F.transform(some, lambda vs: F.flatten(F.transform(F.array(blocks(vs)), folded))))


def find(text: Column, kind: str, rank: int, pattern: str, valid: Callable[[Column], Column] | None = None, hint: str | None = None) -> Column:
    """Leftmost non-overlapping matches of a Java pattern as spans in code points; those that fail ``valid`` are dropped.

    A match's place is what stands before it: split() gives the gaps between the
    matches that regexp_extract_all() gives. ``hint`` is a cheap necessary pattern.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pairs = F.filter(F.zip_with(F.split(text, pattern, -1), matches, lambda gap, match: F.struct(F.length(gap).alias("gap"), match.alias("match"))), lambda pair: pair["match"].isNotNull())

    def place(own: Column) -> Column:
        before = running(F.transform(own, lambda pair: pair["gap"] + F.length(pair["match"])), lambda x, y: x + y)
        found = F.zip_with(own, before, lambda pair, at: F.struct(pair["match"].alias("match"), (at + pair["gap"]).alias("start")))
        good = F.filter(found, lambda x: valid(x["match"])) if valid else found
        return F.transform(good, lambda x: F.struct(x["start"].alias("start"), F.lit(rank).alias("rank"), F.lit(kind).alias("kind"), (x["start"] + F.length(x["match"])).alias("end")))

    return F.when(text.rlike(hint or pattern), F.flatten(F.transform(F.array(pairs), place))).otherwise(no_spans())


def joined(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined in the array's order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def by_start(spans: Column) -> Column:
    """Sorted by start, then rank (the order of the fields)."""
    return F.array_sort(spans)


def by_rank(spans: Column) -> Column:
    """Sorted by rank, then start."""
    turned = F.array_sort(F.transform(spans, lambda s: F.struct(s["rank"], s["start"], s["kind"], s["end"])))
    return F.transform(turned, lambda s: F.struct(s["start"].alias("start"), s["rank"].alias("rank"), s["kind"].alias("kind"), s["end"].alias("end")))
