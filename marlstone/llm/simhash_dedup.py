"""Near-duplicates by SimHash with a bit-sliced comparison.

Fingerprints are equal in at least two of RADIUS + 2 blocks of bits if they
differ in RADIUS bits, so each is dealt to a bucket for every pair of blocks.
In a task the fingerprints stand in blocks of 64 lanes as bit planes: word b of a
block has bit b of its 64 fingerprints. A fingerprint is compared with 64 others
at once: the planes in which they differ are added to bitwise counters with
carry-save steps, and blocks whose lanes all exceed the radius are abandoned.
Buckets beyond CELL fingerprints are cut to cells for every pair of their parts.

``deduplicate`` can also ask for an exact Jaccard similarity of shingle sets.
Fingerprints of 64 bits can't give that alone: at a similarity of 0.8 they differ
in 10 bits on average and in up to 18, a radius at which no blocks of bits stay
equal. So the fingerprints' links are candidates beside those of MinHash bands
(see ``shingles``), which reach the similarity with a probability of 0.999, and
the pairs within components of candidates are compared exactly, in cells of
bounded bytes.

Edge cases: a null or empty text, or one without words, has fingerprint zero and
is linked like any other. Fewer than SHINGLE words make one shingle. Repeated
rows and equal texts have equal fingerprints, which are compared once. Rows with
a null id take part; a component whose ids are all null has a null id. Empty
tables give empty results. Only the columns named are read; ``deduplicate``
keeps all columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm import shingles
from marlstone.llm.common import free_name, give_back, materialize, slices
from marlstone.llm.components import connected_components, unite

SHINGLE, RADIUS = 3, 3
#: Fingerprints in a part of a large bucket, and comparisons of a fingerprint with a block done at once.
CELL, AT_ONCE = 4096, 1 << 16
#: Bytes of texts in a part of a large component of candidates.
CELL_BYTES = 4_000_000
ALL = np.uint64(2**64 - 1)


def simhash(hashes: list[np.ndarray]) -> np.ndarray:
    """The fingerprints of texts, given the hashes of their shingles, repeats included; zero where there are none."""
    count = np.array([len(h) for h in hashes], dtype=np.int64)
    out = np.zeros(len(hashes), dtype=np.uint64)
    some = np.flatnonzero(count)
    if len(some):
        bits = np.unpackbits(np.concatenate(hashes).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        start = np.cumsum(count) - count
        ones = np.add.reduceat(bits, start[some], axis=0, dtype=np.int32)
        out[some] = np.packbits(ones * 2 > count[some, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def fingerprints(df: DataFrame, keep: list, text_col: str = "text") -> DataFrame:
    """Per row the columns ``keep`` and ``fp``, the fingerprint as a signed long; nothing is shuffled."""

    @F.pandas_udf("long")
    def fp(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(np.concatenate([np.empty(0, np.uint64), *(simhash([shingles.hashes(t, SHINGLE) for t in part]) for _, part in slices(batch, 1_000_000))]).view(np.int64))

    return df.select(*keep, fp(F.col(text_col)).alias("fp"))


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """Row k has the 64 planes of fingerprints 64k to 64k+63; the last block is filled with zeros."""
    lanes = np.concatenate((fps, np.zeros(-len(fps) % 64, np.uint64))).astype("<u8")
    bits = np.unpackbits(lanes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").reshape(-1, 64, 64)
    return np.packbits(np.ascontiguousarray(bits.transpose(0, 2, 1)), axis=2, bitorder="little").reshape(-1, 8).view("<u8").reshape(-1, 64)


def near(fps: np.ndarray, planes: np.ndarray, query: np.ndarray, block: np.ndarray, least: np.ndarray, most: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query and block, the places from least up to most that differ from it in ``radius`` bits or fewer."""
    lo, hi = np.clip(least - block * 64, 0, 64), np.clip(most - block * 64, 0, 64)
    below = lambda n: np.where(n >= 64, ALL, (np.uint64(1) << (n % 64).astype(np.uint64)) - np.uint64(1))
    over = ~(below(hi) & ~below(lo))
    item = np.arange(len(query))
    width = max(1, radius.bit_length())
    first = (1 << width) - radius - 1  # counters start here, so that radius + 1 differences overflow them
    counters = [np.full(len(item), ALL if first >> k & 1 else 0, dtype=np.uint64) for k in range(width)]
    own = fps[query]
    for b in range(64):
        carry = planes[block[item], b] ^ (np.uint64(0) - (own >> np.uint64(b) & np.uint64(1)))
        for k in range(width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if b % 8 == 7:
            on = over != ALL
            if not on.all():
                item, own, over, counters = item[on], own[on], over[on], [c[on] for c in counters]
    hit = np.unpackbits((~over).astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    at, lane = np.nonzero(hit)
    return query[item[at]], block[item[at]] * 64 + lane


def links_of(buckets: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links within sorted buckets: fingerprints and the least of their set."""
    n = len(fps)
    end = np.append(np.flatnonzero(buckets[1:] != buckets[:-1]) + 1, n)
    end = end[np.searchsorted(end, np.arange(n), side="right")]
    planes, label = bit_planes(fps), np.arange(n)
    query = np.flatnonzero(end > np.arange(n) + 1)
    blocks = (end[query] - 1) // 64 - (query + 1) // 64 + 1
    total = np.cumsum(blocks)
    for k in range(0, int(total[-1]) if len(total) else 0, AT_ONCE):
        item = np.arange(k, min(k + AT_ONCE, int(total[-1])))
        row = np.searchsorted(total, item, side="right")
        q = query[row]
        block = (q + 1) // 64 + item - (total[row] - blocks[row])
        label = unite(label, *near(fps, planes, q, block, q + 1, end[q], radius))
    linked = np.flatnonzero(label != np.arange(n))
    return fps[linked], fps[label[linked]]


def masks(radius: int) -> list[int]:
    """Bit masks of all pairs of radius + 2 blocks of the 64 bits, as signed longs."""
    cuts = [round(64 * k / (radius + 2)) for k in range(radius + 3)]
    blocks = [(1 << b) - (1 << a) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for x, y in combinations(blocks, 2) for m in [x | y]]


def links(distinct_fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) that join all fingerprints within ``radius`` bits: every such pair has a path of links.

    ``distinct_fps`` has the column fp, each once.
    """
    table = F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(m)) for m in masks(radius)))).alias("t", "key")
    keyed = distinct_fps.select("fp", table)
    large = keyed.groupBy("t", "key").count().filter(F.col("count") > CELL).select("t", "key", F.ceil(F.col("count") / CELL).cast("int").alias("parts"))
    large = materialize(large, "large-buckets")  # its size decides how it is joined
    parts = F.coalesce("parts", F.lit(1))
    own = F.pmod(F.xxhash64("fp"), parts).cast("int")
    cells = (
        keyed.join(large, ["t", "key"], "left")
        .select("fp", "t", "key", own.alias("own"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("other"))
        .select("fp", F.xxhash64("t", "key", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"))
    )

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        buckets, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            buckets = np.concatenate((buckets, batch["bucket"].to_numpy()))
            fps = np.concatenate((fps, batch["fp"].to_numpy().view(np.uint64)))
            if len(buckets) and (cut := int(np.searchsorted(buckets, buckets[-1]))):  # the last bucket may go on
                yield _frame(*links_of(buckets[:cut], fps[:cut], radius))
                buckets, fps = buckets[cut:], fps[cut:]
        if len(buckets):
            yield _frame(*links_of(buckets, fps, radius))

    return cells.repartition("bucket").sortWithinPartitions("bucket").select("bucket", "fp").mapInPandas(compare, "a long, b long")


def _frame(a: np.ndarray, b: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list | None = None) -> DataFrame:
    """Per row its id, ``keep``, the fingerprint in hexadecimal and component_id, the smallest id of its component."""
    rows = materialize(fingerprints(df, [F.col(id_col).alias("_id"), *(keep or [])], text_col), "fingerprints")
    classes = rows.groupBy("fp").agg(F.min("_id").alias("least"))
    roots = connected_components(links(classes.select("fp")))
    placed = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = materialize(placed, "classes")
    component = placed.join(placed.groupBy("root").agg(F.min("least").alias("component_id")), "root").select("fp", "component_id")
    names = [c for c in rows.columns if c not in ("_id", "fp")]
    return rows.join(component, "fp").select(F.col("_id").alias(id_col), *names, F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _clusters(df: DataFrame, id_col: str, text_col: str, row: Column, shingle: int, similarity: float) -> DataFrame:
    """Per row its digest ``_row``, ``_id``, and its cluster: texts of equal shingle sets, joined by links of that similarity.

    Sets are not kept: the few texts that are candidates are fetched by their digest and measured again.
    """

    @F.pandas_udf("struct<cls:long,fp:long,bands:array<long>>")
    def sketch(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            parts = [pd.DataFrame({"cls": [], "fp": [], "bands": []})]
            for _, texts in slices(batch, 1_000_000):
                hashes = [shingles.hashes(t, shingle) for t in texts]
                sets = [np.unique(h) for h in hashes]
                parts.append(pd.DataFrame({"cls": [shingles.class_of(s) for s in sets], "fp": simhash(hashes).view(np.int64), "bands": pd.Series([shingles.bands(s, similarity) for s in sets], dtype=object)}))
            yield pd.concat(parts[1:] or parts)
        give_back()

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("cls", ignore_index=True)
        label = shingles.clusters([np.unique(shingles.hashes(t, shingle)) for t in group["text"]], similarity)
        return pd.DataFrame({"root": group["root"], "cls": group["cls"], "cluster": group["cls"].to_numpy()[label]})

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = df.select(row.alias("_row"), F.col(id_col).alias("_id"), F.octet_length(text).cast("long").alias("size"), sketch(text).alias("s")).select("_row", "_id", "size", "s.*")
    rows = materialize(rows, "sketches")
    classes = materialize(rows.groupBy("cls").agg(F.first("fp").alias("fp"), F.min(F.struct("_row", "size")).alias("one")), "classes")
    # candidates: equal or near fingerprints, and equal bands
    by_fp = materialize(classes.groupBy("fp").agg(F.min("cls").alias("least")), "fingerprint-classes")
    near = links(by_fp.select("fp")).join(by_fp.select(F.col("fp").alias("a"), F.col("least").alias("x")), "a").join(by_fp.select(F.col("fp").alias("b"), F.col("least").alias("y")), "b").select("x", "y")
    same = classes.join(by_fp, "fp").select(F.col("cls").alias("x"), F.col("least").alias("y"))
    keyed = rows.select("cls", F.posexplode("bands").alias("t", "key")).distinct()
    least = keyed.groupBy("t", "key").agg(F.min("cls").alias("y"), F.count("*").alias("n")).filter("n > 1").select("t", "key", "y")
    banded = keyed.join(least, ["t", "key"]).select(F.col("cls").alias("x"), "y").filter("x <> y")
    roots = materialize(connected_components(near.unionByName(same).unionByName(banded), "x", "y"), "candidates")
    sets = classes.join(roots.withColumnRenamed("node", "cls"), "cls").select("cls", "root", "one.*")
    parts = sets.groupBy("root").agg(F.greatest(F.ceil(F.sum("size") / CELL_BYTES), F.lit(1)).cast("int").alias("parts"))
    parts = materialize(parts, "parts")
    own = F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int")
    cells = sets.join(parts, "root").select("cls", "root", "_row", own.alias("own"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("other"))
    cells = materialize(cells.select("cls", "root", "_row", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")), "cells")
    texts = df.select(row.alias("_row"), text.alias("text")).join(cells.select("_row").distinct(), "_row", "left_semi").dropDuplicates(["_row"])
    found = cells.join(texts, "_row").select("root", "low", "high", "cls", "text").groupBy("root", "low", "high").applyInPandas(compare, "root long, cls long, cluster long")
    found = materialize(found, "compared")
    split = found.join(parts.filter("parts > 1").select("root"), "root", "left_semi")
    joined = connected_components(split, "cls", "cluster").select(F.col("node").alias("cls"), F.col("root").alias("cluster"))
    placed = found.join(parts.filter("parts = 1").select("root"), "root", "left_semi").select("cls", "cluster").unionByName(joined)
    return rows.select("_row", "_id", "cls").join(placed, "cls", "left").select("_row", "_id", F.coalesce("cluster", "cls").alias("cluster"))


def deduplicate(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float | None = None) -> DataFrame:
    """``df`` with one row of each group: that of the smallest id, nulls last; of equal ids, the one of the least digest of id and text. All columns stay.

    Groups are the components of ``near_duplicates``, or with ``similarity`` those
    of texts whose sets of shingles of ``shingle`` words have that Jaccard
    similarity at least; a null text, or one without words, is the empty set.
    """
    digest = F.unhex(F.md5(F.concat_ws("|", F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col).isNull().cast("string"), F.col(text_col))))
    if similarity is None:
        placed = materialize(near_duplicates(df, id_col, text_col, [digest.alias("_row")]), "near-duplicates")
        # a component of nulls alone has no id: its fingerprint tells it apart, as the null text does
        placed = placed.select("_row", F.col(id_col).alias("_id"), F.coalesce(F.col("component_id").cast("string"), "fingerprint").alias("cluster"))
    else:
        placed = _clusters(df, id_col, text_col, digest, shingle, similarity)
    first = placed.groupBy("cluster").agg(F.min(F.struct(F.col("_id").isNull().alias("none"), F.col("_id").alias("id"), "_row")).alias("first"))
    row = free_name(df, "_row")
    return df.withColumn(row, digest).join(first.select(F.col("first._row").alias(row)), row, "left_semi").dropDuplicates([row]).select(*df.columns)
