"""Sections, token-bounded chunks, digests and trees, as folds over arrays in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import count_tokens, sentences

HEADER = r"^\*\*(\d+(?:\.\d+)*)\.?\s+([A-Z0-9][^\n*]+?)\s*\*\*[ \t]*$"


def sections(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Parts that lines such as ``**4.1 Title**`` open: (id, position, number, title, content); text before the first is a part without number."""
    parts = F.filter(F.split(text_col, "(?m)(?=" + HEADER + ")"), lambda p: F.trim(p) != "")
    each = df.select(F.col(id_col).alias("id"), F.posexplode(parts).alias("position", "content"))
    return each.select("id", F.col("position").cast("long").alias("position"), F.regexp_extract("content", "(?m)" + HEADER, 1).alias("number"), F.trim(F.regexp_extract("content", "(?m)" + HEADER, 2)).alias("title"), "content")


def _packed(pieces: Column, limit: int, text: Callable, alone: Callable) -> Column:
    """Join pieces by blanks to chunks of at most ``limit`` tokens; those that stand alone are chunks of their own."""
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("now"))
    flushed = lambda s: F.when(s["now"] == "", s["out"]).otherwise(F.array_append(s["out"], s["now"]))

    def step(s: Column, p: Column) -> Column:
        t = text(p)
        joined = F.when(s["now"] == "", t).otherwise(F.concat(s["now"], F.lit(" "), t))
        own = F.struct(F.array_append(flushed(s), t).alias("out"), F.lit("").alias("now"))
        full = F.struct(flushed(s).alias("out"), t.alias("now"))
        return F.when(alone(p), own).when(count_tokens(joined) > limit, full).otherwise(F.struct(s["out"].alias("out"), joined.alias("now")))

    return F.aggregate(pieces, start, step, flushed)


def chunks(text: Column, limit: int = 500) -> Column:
    """Chunks (text, tokens) of whole sentences; a sentence beyond the limit is cut at blanks and shares no chunk with others. A longer word stays whole."""
    never = lambda _: F.lit(False)
    words = lambda s: _packed(F.split(s, " "), limit, lambda w: w, never)
    piece = lambda t, alone: F.struct(t.alias("text"), F.lit(alone).alias("alone"))
    parts = lambda s: F.when(count_tokens(s) > limit, F.transform(words(s), lambda c: piece(c, True))).otherwise(F.array(piece(s, False)))
    pieces = F.flatten(F.transform(sentences(text), parts))
    return F.transform(_packed(pieces, limit, lambda p: p["text"], lambda p: p["alone"]), lambda c: F.struct(c.alias("text"), count_tokens(c).alias("tokens")))


def chunk_rows(df: DataFrame, id_col: str, text_col: str, limit: int = 500, repo_link: str = "") -> DataFrame:
    """A row for each chunk of each section: (id, section, chunk, number, title, code, code_token_count, section_id, repo_link)."""
    parts = sections(df, id_col, text_col)
    each = parts.select("id", F.col("position").alias("section"), "number", "title", F.posexplode(chunks(F.col("content"), limit)).alias("chunk", "c"))
    return each.select("id", "section", F.col("chunk").cast("long").alias("chunk"), "number", "title", F.col("c.text").alias("code"), F.col("c.tokens").alias("code_token_count"), F.sha2("c.text", 256).alias("section_id"), F.lit(repo_link).alias("repo_link"))


def overlapping_chunks(parts: Column, limit: int, overlap: int | None = None) -> Column:
    """Arrays of sentences of at most ``limit`` tokens, each starting with the last ``overlap`` of the one before (by default a twentieth of all, 1 at least).

    A sentence beyond the limit is a chunk of its own, and the next one starts afresh.
    """
    none = F.array().cast("array<string>")
    start = F.struct(F.array().cast("array<array<string>>").alias("out"), none.alias("now"), F.lit(0).cast("long").alias("tokens"))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + count_tokens(x))
    flushed = lambda s: F.when(F.size(s["now"]) > 0, F.array_append(s["out"], s["now"])).otherwise(s["out"])

    def folded(all_parts: Column) -> Column:
        back = F.greatest(F.lit(1), F.floor(F.size(all_parts) / 20).cast("int")) if overlap is None else F.lit(overlap)

        def step(s: Column, x: Column) -> Column:
            n = count_tokens(x)
            tail = F.slice(s["now"], F.greatest(F.size(s["now"]) - back + 1, F.lit(1)), back)
            long = F.struct(F.array_append(flushed(s), F.array(x)).alias("out"), none.alias("now"), F.lit(0).cast("long").alias("tokens"))
            full = F.struct(flushed(s).alias("out"), F.array_append(tail, x).alias("now"), (total(tail) + n).alias("tokens"))
            fits = F.struct(s["out"].alias("out"), F.array_append(s["now"], x).alias("now"), (s["tokens"] + n).alias("tokens"))
            return F.when(n > limit, long).when(s["tokens"] + n > limit, full).otherwise(fits)

        return F.aggregate(all_parts, start, step, flushed)

    # the sentences are bound once, as the one element of an array
    return F.get(F.transform(F.array(parts), folded), F.lit(0))


def summarize(df: DataFrame, id_col: str, text_col: str, summarizer: Callable[[Column], Column], limit: int = 3500, threshold: int = 3800, levels: int = 3) -> DataFrame:
    """(id, summary): texts over ``threshold`` tokens are cut to chunks, each is summarized, and the joined summaries again, at most ``levels`` times."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    for _ in range(levels):
        parts = F.when(count_tokens(F.col("text")) > threshold, F.transform(chunks(F.col("text"), limit), lambda c: c["text"])).otherwise(F.array("text"))
        each = rows.select("id", F.size(parts).alias("n"), F.posexplode(parts).alias("k", "part"))
        done = each.select("id", "k", F.when(F.col("n") > 1, summarizer(F.col("part"))).otherwise(F.col("part")).alias("part"))
        rows = done.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "part"))), lambda x: x["part"]), "\n").alias("text"))
    return rows.select("id", summarizer(F.col("text")).alias("summary"))


def digest(files: DataFrame, group_col: str) -> DataFrame:
    """Per group of files (path, content): how many, and their bytes and tokens. The paths are rows of ``tree``, as a group may have any number."""
    return files.groupBy(group_col).agg(F.count("*").alias("files"), F.sum(F.octet_length("content")).alias("bytes"), F.sum(count_tokens(F.col("content"))).alias("tokens"))


def tree(files: DataFrame) -> DataFrame:
    """Folders and files as indented lines in order: (path, line)."""
    parts = F.split("path", "/")
    each = files.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("path"), n.alias("depth"), (n < F.size(parts)).alias("folder")))).alias("x"))
    name = F.element_at(F.split("x.path", "/"), -1)
    line = F.concat(F.repeat(F.lit("    "), F.col("x.depth") - 1), name, F.when(F.col("x.folder"), "/").otherwise(""))
    return each.select("x.path", line.alias("line")).distinct().orderBy("path")


def numbered(df: DataFrame, partition: str, order: str) -> DataFrame:
    """``df`` with a place in its partition."""
    return df.withColumn("position", F.row_number().over(Window.partitionBy(partition).orderBy(order)))


def whole(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Each text as one chunk: (id, code, code_token_count, section_id)."""
    return df.select(F.col(id_col).alias("id"), F.col(text_col).alias("code"), count_tokens(F.col(text_col)).alias("code_token_count"), F.sha2(text_col, 256).alias("section_id"))


def process(files: DataFrame, limit: int = 500) -> DataFrame:
    """Files (path, content) by their kind: (path, kind, parts). Markdown is cut to sections, other texts to chunks, the rest has metadata alone."""
    kind = F.when(F.lower("path").endswith(".md"), "sections").when(F.lower("path").rlike(r"\.(rst|txt)$"), "chunks").otherwise("metadata")
    rows = files.withColumn("kind", kind)
    cut = sections(rows.filter("kind = 'sections'"), "path", "content").groupBy(F.col("id").alias("path")).agg(F.count("*").alias("parts"))
    packed = rows.filter("kind = 'chunks'").select("path", F.size(chunks(F.col("content"), limit)).cast("long").alias("parts"))
    return rows.select("path", "kind").join(cut.unionByName(packed), "path", "left").select("path", "kind", F.coalesce("parts", F.when(F.col("kind") == "metadata", F.lit(1)).otherwise(F.lit(0)).cast("long")).alias("parts"))
