"""Tables of documents as rows (doc, page, number, header, body, accuracy, whitespace, bbox): overlap, merging, quality, context."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.fuzzy import fuzzy_ratio, ratio


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes (x0, y0, x1, y1); 0 without overlap."""
    x = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    y = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    both = F.when((x > 0) & (y > 0), x * y).otherwise(0.0)
    size = lambda q: (q[2] - q[0]) * (q[3] - q[1])
    return F.coalesce(both / F.nullif(size(a) + size(b) - both, F.lit(0.0)), F.lit(0.0))


def overlapping(tables: DataFrame, boxes: DataFrame, least: float = 0.5) -> DataFrame:
    """``tables`` with ``valid``: whether any box (page, box) of the same page overlaps enough."""
    seen = tables.join(boxes, "page").filter(iou(F.col("bbox"), F.col("box")) >= least).select("doc", "page", "number").distinct().withColumn("_seen", F.lit(True))
    return tables.join(seen, ["doc", "page", "number"], "left").withColumn("valid", F.coalesce("_seen", F.lit(False))).drop("_seen")


def padded(rows: Column) -> Column:
    """(headers, rows) of a list of rows: the first is the header, the others are cut or filled to its width; all cells are trimmed."""

    def filled(x: Column) -> Column:
        width = F.size(x["headers"])
        wide = lambda r: F.transform(F.slice(F.concat(r, F.array_repeat(F.lit(""), width)), F.lit(1), width), lambda c: F.trim(c))
        return F.struct(x["headers"].alias("headers"), F.transform(F.slice(x["rows"], F.lit(2), F.size(x["rows"])), wide).alias("rows"))

    # the rows are bound once, as the one element of an array
    whole = F.struct(F.transform(F.get(rows, F.lit(0)), lambda c: F.trim(c)).alias("headers"), rows.alias("rows"))
    empty = F.struct(F.array().cast("array<string>").alias("headers"), F.array().cast("array<array<string>>").alias("rows"))
    return F.when(F.size(rows) >= 2, F.get(F.transform(F.array(whole), filled), F.lit(0))).otherwise(empty)


def cleaned(cell: Column) -> Column:
    return F.trim(F.regexp_replace(cell, r"[\r\n]+", " "))


def merged_runs(tables: DataFrame) -> DataFrame:
    """Consecutive tables of a document with one header (case aside) as one: (doc, run, first_page, last_page, header, body, parts)."""
    w = Window.partitionBy("doc").orderBy("page", "number")
    low = F.transform("header", F.lower)
    same = F.coalesce(low == F.lag(low).over(w), F.lit(False))
    runs = tables.withColumn("run", F.sum(F.when(same, 0).otherwise(1)).over(w))
    found = runs.groupBy("doc", "run").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.min_by("header", F.struct("page", "number")).alias("header"), F.array_sort(F.collect_list(F.struct("page", "number", "body"))).alias("parts"))
    return found.select("doc", "run", "first_page", "last_page", "header", F.flatten(F.transform("parts", lambda p: p["body"])).alias("body"), F.size("parts").alias("parts"))


def merge_pairs(tables: DataFrame, most_gap: float = 0.5) -> DataFrame:
    """Greedy pairs: a table joins the next one if headers match and the row counts are close; a joined pair is not joined again.

    Runs of tables that match their predecessor are cut into pairs from the run's start, which is what a greedy pass does.
    """
    w = Window.partitionBy("doc").orderBy("page", "number")
    rows, before = F.size("body"), F.lag(F.size("body")).over(w)
    close = (F.abs(rows - before) / F.greatest(rows, before) <= most_gap) | (before == 1)
    fits = F.coalesce((F.col("header") == F.lag("header").over(w)) & close, F.lit(False))
    runs = tables.withColumn("run", F.sum(F.when(fits, 0).otherwise(1)).over(w))
    place = F.row_number().over(Window.partitionBy("doc", "run").orderBy("page", "number")) - 1
    paired = runs.withColumn("pair", F.floor(place / 2))
    found = paired.groupBy("doc", "run", "pair").agg(F.array_sort(F.collect_list(F.struct("page", "number", "body"))).alias("parts"), F.first("header").alias("header"))
    return found.select("doc", F.transform("parts", lambda p: p["page"]).alias("pages"), F.transform("parts", lambda p: p["number"]).alias("numbers"), "header", F.flatten(F.transform("parts", lambda p: p["body"])).alias("body"))


def near_header(left: Column, right: Column, least: float = 80) -> Column:
    """Whether two headers of one width have nearly the same words, in any order."""
    words = lambda h: F.array_join(F.array_sort(F.split(F.lower(F.array_join(h, " ")), r"\s+")), " ")
    return (F.size(left) == F.size(right)) & (fuzzy_ratio(words(left), words(right)) > least)


def quality(tables: DataFrame) -> DataFrame:
    """``tables`` with accuracy, completeness, consistency and whitespace scores (0 to 1), quality and confidence (0 to 100).

    A column with numbers in over half of its cells and other text elsewhere costs a fifth of the accuracy.
    """
    cells = F.flatten("body")
    filled = F.size(F.filter(cells, lambda c: c.isNotNull() & (F.trim(c) != "")))
    complete = F.when(F.size(cells) > 0, filled / F.size(cells)).otherwise(0.0)
    consistent = F.when((F.size("body") > 0) & F.forall("body", lambda r: F.size(r) == F.size("header")), 1.0).otherwise(0.0)
    numeric = lambda c: c.rlike(r"^\s*-?[0-9]+(\.[0-9]+)?\s*$")

    def mixed(i: Column) -> Column:
        column = F.filter(F.transform("body", lambda r: F.get(r, i)), lambda c: c.isNotNull())
        numbers = F.size(F.filter(column, numeric))
        return (numbers * 2 > F.size(column)) & (numbers < F.size(column))

    any_mixed = F.when(F.size("header") > 0, F.exists(F.sequence(F.lit(0), F.size("header") - 1), mixed)).otherwise(False)
    accuracy = F.least(F.greatest(F.when(any_mixed, F.col("accuracy") * 0.8).otherwise(F.col("accuracy")) / 100, F.lit(0.0)), F.lit(1.0))
    white = (100 - F.least(F.greatest(F.col("whitespace"), F.lit(0.0)), F.lit(100.0))) / 100
    out = tables.withColumns({"accuracy_score": accuracy, "completeness": complete, "consistency": consistent, "whitespace_score": white})
    total = 0.4 * F.col("accuracy_score") + 0.3 * F.col("completeness")
    confidence = F.least(F.greatest(100 * (total + 0.1 * F.col("consistency") + 0.2 * F.col("whitespace_score")), F.lit(0.0)), F.lit(100.0))
    return out.withColumns({"quality": total + 0.3 * F.col("consistency"), "confidence": confidence})


def best_settings(runs: DataFrame) -> DataFrame:
    """Of several extractions (doc, page, settings, quality) of a page the best one; ties go to the least settings."""
    return runs.groupBy("doc", "page").agg(F.min_by("settings", F.struct(-F.col("quality"), "settings")).alias("settings"), F.max("quality").alias("quality"))


def settings_report(runs: DataFrame) -> DataFrame:
    """Mean quality of each setting, and how often it was used."""
    return runs.groupBy("settings").agg(F.avg("quality").alias("quality"), F.count("*").alias("uses"))


def context(tables: DataFrame, texts: DataFrame, n: int = 3, margin: float = 5.0) -> DataFrame:
    """The nearest ``n`` text blocks (page, top, bottom, content) above and below each table, in reading order, and a title such as ``Table 2``."""
    pairs = tables.select("doc", "page", "number", F.get("bbox", F.lit(1)).alias("t0"), F.get("bbox", F.lit(3)).alias("t1")).join(texts, ["doc", "page"])
    above, below = F.col("bottom") <= F.col("t0") - margin, F.col("top") >= F.col("t1") + margin
    side = F.when(above, "above").when(below, "below")
    far = F.when(above, F.col("t0") - F.col("bottom")).otherwise(F.col("top") - F.col("t1"))
    near = pairs.withColumn("side", side).filter("side IS NOT NULL").withColumn("_n", F.row_number().over(Window.partitionBy("doc", "page", "number", "side").orderBy(far, "content"))).filter(F.col("_n") <= n)
    told = near.groupBy("doc", "page", "number").agg(*(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct("top", "content")))), lambda x: x["content"]), "\n").alias(s) for s in ("above", "below")))
    title = F.regexp_extract(F.concat_ws("\n", "above", "below"), r"(?im)^\s*(table\s+\d+[^\n]*)", 1)
    return tables.join(told, ["doc", "page", "number"], "left").withColumns({"above": F.coalesce("above", F.lit("")), "below": F.coalesce("below", F.lit("")), "title": F.nullif(title, F.lit(""))})


def drop_repeated_text(texts: DataFrame, tables: DataFrame, least: float = 95) -> DataFrame:
    """Text blocks that are not nearly the text of a table of their page."""
    words = tables.select("doc", "page", F.array_join(F.flatten("body"), " ").alias("_table"))
    alike = texts.join(words, ["doc", "page"]).withColumn("_r", fuzzy_ratio("content", "_table")).filter(F.col("_r") >= least)
    return texts.join(alike.select("doc", "page", "content").distinct(), ["doc", "page", "content"], "left_anti")


def corrected(tables: DataFrame, corrections: DataFrame) -> DataFrame:
    """Tables (table_id, text) under people's corrections (table_id, status, text): rejected ones go, approved, edited and added ones win; ``needs_review`` marks the untouched."""
    good = corrections.filter(F.col("status").isin("approved", "edited", "added"))
    chosen = good.join(tables.select("table_id", F.col("text").alias("_own")), "table_id", "left").select("table_id", F.coalesce("text", "_own").alias("text"), "status", F.lit(False).alias("needs_review"))
    rest = tables.join(corrections, "table_id", "left_anti").select("table_id", "text", F.lit("extracted").alias("status"), F.lit(True).alias("needs_review"))
    return chosen.unionByName(rest)


def best_flavor(lattice: DataFrame, stream: DataFrame, least: float = 80) -> DataFrame:
    """Of two extractions (doc, page, number, accuracy) of a table the first, or the better one where the first is below ``least``; ``flavor`` tells which."""
    other = stream.select("doc", "page", "number", F.col("accuracy").alias("_other"))
    both = lattice.join(other, ["doc", "page", "number"], "left")
    again = (F.col("accuracy") < least) & (F.coalesce("_other", F.lit(-1.0)) > F.col("accuracy"))
    return both.withColumn("flavor", F.when(again, "stream").otherwise("lattice")).withColumn("accuracy", F.when(again, F.col("_other")).otherwise(F.col("accuracy"))).drop("_other")


def mergeable(tables: DataFrame, most_gap: float = 0.5) -> DataFrame:
    """Each table with whether it fits the one before it in its document: same columns and kinds of cells, row counts not too far apart; a table of one row may be a header and fits by its columns."""
    w = Window.partitionBy("doc").orderBy("page", "number")
    number = lambda c: c.rlike(r"^\s*-?[0-9]+(\.[0-9]+)?\s*$")
    column = lambda i: F.forall(F.filter(F.transform("body", lambda r: F.get(r, i)), lambda c: c.isNotNull()), number)
    kinds = F.when(F.size("header") > 0, F.transform(F.sequence(F.lit(0), F.size("header") - 1), column)).otherwise(F.array().cast("array<boolean>"))
    told = tables.withColumns({"_rows": F.size("body"), "_kinds": kinds})
    before = {c: F.lag(c).over(w) for c in ("header", "_rows", "_kinds")}
    filled = (F.col("_rows") > 0) & (before["_rows"] > 0)
    close = (F.abs(F.col("_rows") - before["_rows"]) / F.greatest("_rows", before["_rows"]) <= most_gap) & (F.col("_kinds") == before["_kinds"])
    fits = (F.col("header") == before["header"]) & filled & (close | (before["_rows"] == 1))
    return told.withColumn("fits", F.coalesce(fits, F.lit(False))).drop("_rows", "_kinds")


def page_geometry(blocks: DataFrame, buffer: float = 10.0) -> DataFrame:
    """Per page of blocks (doc, page, bbox, height): where its content begins and ends, and its margins with a buffer."""
    top, bottom = F.min(F.get("bbox", F.lit(1))), F.max(F.get("bbox", F.lit(3)))
    return blocks.groupBy("doc", "page").agg(top.alias("content_top"), bottom.alias("content_bottom"), (top - buffer).alias("top_margin"), (F.max("height") - bottom + buffer).alias("bottom_margin"))


def geometric_merges(tables: DataFrame, geometry: DataFrame, near_top: float = 20.0, gap_share: float = 0.2) -> DataFrame:
    """Each table with ``joins``: whether its place says that it goes on from the table before it.

    On one page: as many columns and a gap of less than ``gap_share`` of the
    content's height. On the next page: it starts within ``near_top`` of the
    content's top, or both pages are filled to their margins.
    """
    w = Window.partitionBy("doc").orderBy("page", "number")
    placed = tables.join(geometry, ["doc", "page"], "left")
    before = lambda c: F.lag(c).over(w)
    top = F.get("bbox", F.lit(1))
    height = F.abs(F.col("content_bottom") - F.col("content_top"))
    same = (F.size("header") == F.size(before("header"))) & (F.abs(top - F.get(before("bbox"), F.lit(3))) < gap_share * height)
    across = (F.abs(top - F.col("content_top")) < near_top) | ((before("content_bottom") > before("bottom_margin")) & (F.col("content_top") < F.col("top_margin")))
    joins = F.when(F.col("page") == before("page"), same).when(F.col("page") == before("page") + 1, across).otherwise(False)
    return placed.withColumn("joins", F.coalesce(joins, F.lit(False))).select(*tables.columns, "joins")


RUNS = "doc {doc}, number {number}, first {number}"


def merge_chain(tables: DataFrame, instructions: DataFrame | None = None, least: float = 80) -> DataFrame:
    """Tables joined to chains: (doc, first, first_page, last_page, numbers, header, body, source).

    What people say comes first: ``instructions`` (doc, source, target) join two
    tables, each taken once, into the earlier one. The others join the chain
    before them if they stand on its last page or the next and their header is
    nearly that of the chain's first table. Headers alone pass through Python.
    """
    kinds = dict(tables.dtypes)
    joined = None
    rest = tables
    if instructions is not None:
        places = tables.select("doc", "page", "number")
        one, two = places.select("doc", F.col("number").alias("source"), F.col("page").alias("p1")), places.select("doc", F.col("number").alias("target"), F.col("page").alias("p2"))
        pairs = instructions.join(one, ["doc", "source"]).join(two, ["doc", "target"])
        members = pairs.select("doc", F.when(F.struct("p1", "source") <= F.struct("p2", "target"), F.col("source")).otherwise(F.col("target")).alias("first"), F.explode(F.array("source", "target")).alias("number"))
        # a table that several instructions name belongs to the least of them
        joined = members.groupBy("doc", "number").agg(F.min("first").alias("first")).withColumn("source", F.lit("human_merged"))
        rest = tables.join(joined, ["doc", "number"], "left_anti")

    def chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come by document and place; what is kept from one to the next is the header of the chain's first table and the last page."""
        sorted_words = lambda words: " ".join(sorted(" ".join(words).split()))
        near_words = lru_cache(4096)(lambda a, b: ratio(sorted_words(a), sorted_words(b)) > least)
        begun, doc, head, last, first = False, None, None, None, None
        for batch in batches:
            firsts = []
            for own, page, number, header in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not begun or own != doc:
                    begun, doc, head, last = True, own, None, None
                words = tuple(str(h).lower() for h in header) if header is not None else ()
                near = head is not None and page is not None and last is not None and page <= last + 1 and len(words) == len(head) and near_words(words, head)
                if not near:
                    head, first = words, number
                firsts.append(first)
                last = page
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(firsts, batch.column(2).type)], names=["doc", "number", "first"])

    shape = RUNS.format(doc=kinds["doc"], number=kinds["number"])
    # a document's tables stand together in one task, in order; a group of its own for each document costs far more than its rows
    placed = rest.select("doc", "page", "number", "header").repartition("doc").sortWithinPartitions("doc", F.asc_nulls_last("page"), F.asc_nulls_last("number"))
    runs = placed.mapInArrow(chains, shape).select("doc", "number", "first", F.lit("extracted").alias("source"))
    runs = runs if joined is None else runs.unionByName(joined.select(runs.columns))
    parts = tables.join(runs, ["doc", "number"]).groupBy("doc", "first").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.array_sort(F.collect_list(F.struct("page", "number", "body"))).alias("parts"), F.min_by("header", F.struct("page", "number")).alias("header"), F.max("source").alias("source"))
    return parts.select("doc", "first", "first_page", "last_page", F.transform("parts", lambda p: p["number"]).alias("numbers"), "header", F.flatten(F.transform("parts", lambda p: p["body"])).alias("body"), "source")


def as_rows(tables: DataFrame, corrections: DataFrame | None = None) -> DataFrame:
    """Tables (doc, page, number, header, body) as JSON texts under people's corrections (table_id, status, text): (table_id, text, status, needs_review)."""
    own = tables.select(F.concat_ws("-", "doc", "page", "number").alias("table_id"), F.to_json(F.struct("header", "body")).alias("text"))
    empty = own.select("table_id", F.lit("").alias("status"), "text").limit(0)
    return corrected(own, empty if corrections is None else corrections)
