"""A stored inverted index: postings by bucket of their term, in blocks that a search can pass over.

A segment holds the documents of one build, numbered without gaps by where they stand, and
lies in the shared folder as four tables:

* ``blocks``: for a term and a field up to BLOCK postings of one chunk of
  documents, as distances from the first one, with how often the term occurs and
  how long the field is. ``max_tf`` and ``min_length`` bound what any posting of
  the block can score. Files are cut by bucket and sorted by term. Tasks invert
  their documents and hand on what belongs to a bucket as one value; the blocks
  of all tasks are joined there, for an era of documents at a time.
* ``documents``: number and key. ``fields``: rows and words of each field.
* ``words``: the vocabulary with the count of documents; where the index is
  built with ``fuzzy``, ``deletions``: all that is left of a word when up to
  DELETED letters are taken out.

A search reads the headers of its own terms' blocks, scores the ranges of
documents with the highest bounds, and then only those ranges whose bound
reaches the k-th best score found. Segments are never changed; ``extended`` adds
one. Statistics are those of all segments together.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.fuzzy import fuzzy_ratio
from marlstone.functions.text import tokens
from marlstone.operators import search
from marlstone.sources.shared import application_dir, delete, exists, scratch, source_version

BLOCK, CHUNK_BITS, RANGE_BITS = 128, 16, 12
#: Ranges that are scored first, for the score that others must reach; with no more than these there is nothing to pass over.
FIRST_RANGES = 64
#: Letters taken out of the words of the vocabulary, and the longest word for which that is done; longer ones are compared directly.
DELETED, LONGEST = 2, 24
#: Bytes of text to a bucket of the vocabulary, about.
BUCKET_BYTES, MOST_BUCKETS = 2 << 20, 1024
#: Words that a task inverts at once.
WORDS = 2_000_000
#: Documents whose postings are joined at once, as bits of their numbers; and bits of Spark's increasing numbers below that of the partition.
ERA_BITS, PARTITION_BITS = 20, 33
#: Stated, as an empty segment has no files to tell it. Lists of numbers are the bytes of 32-bit integers, which Parquet writes as one value.
BLOCKS = "term string, field string, first long, last long, n int, max_tf int, min_length int, apart binary, tf binary, length binary, bucket int"
_INTS = pa.list_(pa.int32())
SCHEMA = pa.schema({"term": pa.string(), "field": pa.string(), "first": pa.int64(), "last": pa.int64(), "n": pa.int32(), "max_tf": pa.int32(), "min_length": pa.int32(), "apart": _INTS, "tf": _INTS, "length": _INTS, "words": pa.int64()})
INVERTED = SCHEMA.names
#: Blocks of one task, bucket and era as a compressed value of that size; or, without a bucket, counts of a field.
DEALT = "bucket int, era long, field string, rows long, words long, size long, blocks binary"
LISTS = ("apart", "tf", "length")
JOINED = [c.split()[0] for c in BLOCKS.split(", ")]
PACKED = pa.schema([SCHEMA.field(name) for name in ("term", "field", "first", *LISTS)])


@dataclass(frozen=True)
class TextIndex:
    """Segments by their folders, the fields, and the number of buckets."""

    spark: SparkSession
    fields: tuple[str, ...]
    segments: tuple[str, ...]
    buckets: int
    fuzzy: bool = False

    def table(self, name: str) -> DataFrame:
        """A table of all segments, each row with the number of its segment."""
        read = self.spark.read.schema(BLOCKS) if name == "blocks" else self.spark.read
        parts = [read.parquet(f"{path}/{name}").withColumn("segment", F.lit(i)) for i, path in enumerate(self.segments)]
        return reduce(lambda a, b: a.unionByName(b), parts)


def deletions(word: Column, letters: int = DELETED) -> Column:
    """A word and all that is left of it when up to ``letters`` letters are taken out."""
    fewer = lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.concat(F.substring(w, F.lit(1), i - 1), F.substring(w, i + 1, F.length(w))))
    level = every = F.array(word)
    for _ in range(letters):
        level = F.array_distinct(F.flatten(F.transform(F.filter(level, lambda w: w != ""), fewer)))
        every = F.concat(every, level)
    return F.array_distinct(every)


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(buckets)).cast("int")


def _cut(code: np.ndarray, doc: np.ndarray, tf: np.ndarray, length: np.ndarray, block: int, chunk_bits: int) -> tuple[np.ndarray, list[pa.Array]]:
    """Blocks of postings that are sorted by the code of their word and document: where each begins, and its columns from ``first`` to ``length``."""
    chunk = doc >> chunk_bits
    begins = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (chunk[1:] != chunk[:-1])][: len(code)])
    within = np.arange(len(code)) - np.repeat(begins, np.diff(np.r_[begins, len(code)]))
    first = np.flatnonzero(within % block == 0)
    ends = np.r_[first, len(code)].astype(np.int32)
    n = np.diff(ends)
    least = lambda f, x: f.reduceat(x, first) if len(first) else x
    as_lists = lambda x: pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32)))
    return first, [
        pa.array(doc[first]), pa.array(doc[ends[1:] - 1]), pa.array(n.astype(np.int32)),
        pa.array(least(np.maximum, tf).astype(np.int32)), pa.array(least(np.minimum, length).astype(np.int32)), as_lists(doc - np.repeat(doc[first], n)), as_lists(tf), as_lists(length),
    ]


def _blocks_of(fields: Sequence[str], words: int, block: int, chunk_bits: int):
    """A function from batches of (doc, list of words for each field) to blocks of postings, and for each field a row without term that counts rows and words.

    So many words at most are inverted at once, or one document; what leaves the
    task is a row for each block, never one for each posting.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        """Tables of about that many words, from parts of batches or several of them."""
        held, size = [], 0
        for batch in batches:
            ends = np.cumsum(sum(pc.list_value_length(c).to_numpy(zero_copy_only=False) for c in batch.columns[1:]))
            at = 0
            while at < len(ends):
                before = int(ends[at - 1]) if at else 0
                stop = max(int(np.searchsorted(ends, before + words - size, "right")), at if held else at + 1)
                if stop > at:
                    held.append(batch.slice(at, stop - at))
                    size += int(ends[stop - 1]) - before
                    at = stop
                if at < len(ends):
                    yield pa.Table.from_batches(held)
                    held, size = [], 0
        if held:
            yield pa.Table.from_batches(held)

    def of_field(name: str, order: np.ndarray, docs: np.ndarray, lists: pa.ListArray) -> tuple[pa.RecordBatch, int]:
        """Blocks of a field, and its words; what is needed on the way is free after it."""
        lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        # one number for a word and the document it stands in; equal ones are counted
        pairs, tf = np.unique(coded.indices.to_numpy().astype(np.int64) * len(docs) + np.repeat(np.argsort(order), lengths), return_counts=True)
        code, place = np.divmod(pairs, len(docs))
        first, columns = _cut(code, docs[place], tf, lengths[order][place], block, chunk_bits)
        return pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[first])), pa.array([name] * len(first), pa.string()), *columns, pa.nulls(len(first), pa.int64())], names=INVERTED), int(lengths.sum())

    def inverted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in cut(batches):
            part = part.combine_chunks()
            docs = part.column(0).to_numpy()
            order = np.argsort(docs, kind="stable")
            docs = docs[order]
            for i, name in enumerate(fields, 1):
                blocks, words = of_field(name, order, docs, part.column(i).chunk(0))
                yield blocks
                counts = {"field": [name], "first": [len(docs)], "words": [words]}
                yield pa.RecordBatch.from_arrays([pa.array(counts.get(f.name, [None]), f.type) for f in SCHEMA], names=INVERTED)

    return inverted


def _packed(inverted, buckets: int, era_bits: int):
    """A function that gives the blocks of ``inverted`` as one value for each bucket and era, and its counts of rows and words."""
    names = [c.split()[0] for c in DEALT.split(", ")]

    def dealt(blocks: pa.RecordBatch) -> pa.RecordBatch:
        terms = blocks.column("term").dictionary_encode()
        of_term = np.array([zlib.crc32(t) % buckets for t in terms.dictionary.cast(pa.binary()).to_pylist()], np.int32)
        bucket, era = of_term[terms.indices.to_numpy()], blocks.column("first").to_numpy() >> era_bits
        order = np.lexsort((era, bucket))
        bucket, era, blocks = bucket[order], era[order], blocks.select(PACKED.names).take(pa.array(order))
        begins = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]) | (era[1:] != era[:-1])])
        sizes, values = [], []
        for i, j in zip(begins, np.r_[begins[1:], len(order)], strict=True):
            value = blocks.slice(i, j - i).serialize()
            sizes.append(value.size)
            values.append(pa.compress(value, "zstd", asbytes=True))
        none = pa.nulls(len(begins), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(bucket[begins]), pa.array(era[begins]), pa.nulls(len(begins), pa.string()), none, none, pa.array(sizes, pa.int64()), pa.array(values, pa.binary())], names=names)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for blocks in inverted(batches):
            field, first, words = (blocks.column(name) for name in ("field", "first", "words"))
            if words.null_count < len(words):
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), field, first, words, pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary())], names=names)
            elif len(blocks):
                yield dealt(blocks)
            # a worker that waits keeps little
            del blocks, field, first, words
            pa.default_memory_pool().release_unused()

    return packed


def _joined(block: int, chunk_bits: int):
    """A function that joins the packed blocks of a bucket and an era, so that each block but the last of a chunk is full."""

    def as_bytes(lists: pa.ListArray) -> pa.Array:
        return pa.Array.from_buffers(pa.binary(), len(lists), [None, pa.py_buffer(lists.offsets.to_numpy() * np.int32(4)), pa.py_buffer(lists.values.to_numpy())])

    def joined(group: pa.Table) -> pa.Table:
        read = [pa.ipc.read_record_batch(pa.decompress(value, size, "zstd"), PACKED) for value, size in zip(group.column("blocks").to_pylist(), group.column("size").to_pylist(), strict=True)]
        blocks = pa.Table.from_batches(read).combine_chunks().sort_by([(name, "ascending") for name in ("term", "field", "first")]).combine_chunks().to_batches()[0]
        term, field = (blocks.column(name).dictionary_encode().indices.to_numpy() for name in ("term", "field"))
        word = np.cumsum(np.r_[False, (term[1:] != term[:-1]) | (field[1:] != field[:-1])])
        n = pc.list_value_length(blocks.column("apart")).to_numpy()
        apart, tf, length = (blocks.column(name).flatten().to_numpy() for name in LISTS)
        code, doc = np.repeat(word, n), np.repeat(blocks.column("first").to_numpy(), n) + apart
        if not ((code[1:] != code[:-1]) | (doc[1:] > doc[:-1])).all():
            order = np.lexsort((doc, code))
            doc, tf, length = doc[order], tf[order], length[order]
        first, columns = _cut(code, doc, tf, length, block, chunk_bits)
        own = pa.array(np.searchsorted(word, code[first]))
        bucket = pa.array(np.full(len(first), group.column("bucket")[0].as_py(), np.int32))
        return pa.Table.from_arrays([blocks.column("term").take(own), blocks.column("field").take(own), *columns[:5], *map(as_bytes, columns[5:]), bucket], names=JOINED)

    return joined


def _write_segment(df: DataFrame, fields: Sequence[str], path: str, buckets: int | None, fuzzy: bool) -> int:
    """Tokenizes ``df`` once and writes the tables of a segment; returns the number of buckets."""
    spark = df.sparkSession
    texts = [search._as_text(df, f).alias(f"text{i}") for i, f in enumerate(fields)]
    size = reduce(lambda a, b: a + b, (F.coalesce(F.octet_length(search._as_text(df, f)), F.lit(0)).cast("long") for f in fields), F.lit(0).cast("long"))
    df.select(F.monotonically_increasing_id().alias("at"), F.col("_key"), size.alias("size"), *texts).write.parquet(f"{path}/texts")
    placed, part = spark.read.parquet(f"{path}/texts"), F.shiftright("at", PARTITION_BITS)
    parts = {r["part"]: r for r in placed.groupBy(part.alias("part")).agg(F.count("*").alias("rows"), F.sum("size").alias("size")).collect()}
    if buckets is None:
        buckets = max(1, min(MOST_BUCKETS, sum(r["size"] for r in parts.values()) // BUCKET_BYTES))
    # rows before each partition, so that chunks are filled over the partitions
    before = accumulate((parts[i]["rows"] if i in parts else 0 for i in range(max(parts, default=0))), initial=0)
    start = F.element_at(F.lit(list(before)).cast("array<long>"), (part + 1).cast("int"))
    numbered = placed.withColumn("doc", start + F.col("at").bitwiseAND(F.lit((1 << PARTITION_BITS) - 1)))
    numbered.select("doc", "_key").write.parquet(f"{path}/documents")
    words = numbered.select("doc", *(tokens(f"text{i}").alias(f"words{i}") for i in range(len(fields))))
    words.mapInArrow(_packed(_blocks_of(fields, WORDS, BLOCK, CHUNK_BITS), buckets, ERA_BITS), DEALT).write.parquet(f"{path}/packed")
    delete(spark, f"{path}/texts")
    packed = spark.read.parquet(f"{path}/packed")
    packed.filter("bucket IS NULL").groupBy("field").agg(F.sum("rows").alias("rows"), F.sum("words").alias("words")).write.parquet(f"{path}/fields")
    blocks = packed.filter("bucket IS NOT NULL").select("bucket", "era", "size", "blocks").groupBy("bucket", "era").applyInArrow(_joined(BLOCK, CHUNK_BITS), BLOCKS)
    blocks.sortWithinPartitions("bucket", "term", "field", "first").write.partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/blocks")
    delete(spark, f"{path}/packed")
    spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("term", "field").agg(F.sum("n").alias("documents")).write.parquet(f"{path}/words")
    if fuzzy:
        words = spark.read.parquet(f"{path}/words").select("term").distinct()
        words.filter(F.length("term") <= LONGEST).select("term", F.explode(deletions(F.col("term"))).alias("rest")).repartitionByRange("rest").sortWithinPartitions("rest").write.parquet(f"{path}/deletions")
    return buckets


def build(df: DataFrame, fields: Sequence[str] = search.FIELDS, fuzzy: bool = False) -> TextIndex:
    """An index of the rows of ``df`` (with ``_key``) over those of ``fields`` that it has."""
    fields = tuple(f for f in fields if f in df.columns)
    path = scratch(df.sparkSession, "text-index")
    return TextIndex(df.sparkSession, fields, (path,), _write_segment(df, fields, path, None, fuzzy), fuzzy)


def extended(index: TextIndex, df: DataFrame) -> TextIndex:
    """The index with a segment for the rows of ``df``, whose keys are new."""
    path = scratch(index.spark, "text-index")
    _write_segment(df, index.fields, path, index.buckets, index.fuzzy)
    return TextIndex(index.spark, index.fields, (*index.segments, path), index.buckets, index.fuzzy)


_KNOWN: dict[str, TextIndex] = {}


def stored(df: DataFrame, source: str, fields: Sequence[str] = search.FIELDS) -> TextIndex:
    """The index of ``df``, which is read from the files of ``source``: built once for an application, and anew when files or fields change or it was deleted."""
    name = hashlib.sha256("\0".join([application_dir(df.sparkSession), source_version(df.sparkSession, source), *df.columns, *fields]).encode()).hexdigest()
    if name not in _KNOWN or not exists(df.sparkSession, _KNOWN[name].segments[0]):
        _KNOWN[name] = build(df, fields)
    return _KNOWN[name]


def _numbers(name: str) -> Column:
    """A list of a block as an array of numbers."""

    def numbers(values: pa.Array) -> pa.Array:
        ends = np.cumsum(np.r_[0, pc.binary_length(values).to_numpy(zero_copy_only=False)]) // 4
        return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(np.frombuffer(b"".join(values.to_pylist()), np.int32)))

    return F.arrow_udf(numbers, "array<int>")(F.col(name)).alias(name)


def _own_blocks(index: TextIndex, terms: Sequence[str]) -> DataFrame:
    """The blocks of some terms; other buckets are not opened, other terms' row groups not read."""
    buckets = [r[0] for r in index.spark.createDataFrame([(t,) for t in terms], "term string").select(bucket_of(F.col("term"), index.buckets)).distinct().collect()]
    return index.table("blocks").filter(F.col("bucket").isin(buckets) & F.col("term").isin(list(terms)))


def _weights(index: TextIndex, blocks: DataFrame, boosts: Mapping[str, float] | None) -> tuple[dict[tuple[str, str], float], dict[str, float]]:
    """Of each term and field that occurs the weight by its rarity, and of each field the mean length; a few numbers for each term."""
    sizes = {r["field"]: (r["rows"], r["words"]) for r in index.table("fields").groupBy("field").agg(F.sum("rows").alias("rows"), F.sum("words").alias("words")).collect()}
    holding = blocks.groupBy("term", "field").agg(F.sum("n").alias("df")).collect()
    idf = lambda n, df: math.log(1 + (n - df + 0.5) / (df + 0.5))
    return {(r["term"], r["field"]): float((boosts or {}).get(r["field"], 1.0)) * idf(sizes[r["field"]][0], r["df"]) for r in holding}, {f: words / rows for f, (rows, words) in sizes.items() if rows}


def _score(tf: Column, length: Column, weights: Mapping[tuple[str, str], float], means: Mapping[str, float], k1: float, b: float) -> Column:
    """What a posting adds to the score of its document."""
    weight = F.create_map(*(F.lit(x) for (t, f), w in weights.items() for x in (f"{f}\0{t}", w)))[F.concat_ws("\0", "field", "term")]
    mean = F.create_map(*(F.lit(x) for f, m in means.items() for x in (f, m)))[F.col("field")]
    tf = tf.cast("double")
    return weight * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / mean))


def scores(index: TextIndex, query_text: str, fields: Sequence[str] | None = None, boosts: Mapping[str, float] | None = None, k1: float = search.K1, b: float = search.B, best: int | None = None) -> DataFrame:
    """(segment, doc, score): BM25 of all documents that hold a term; with ``best``, at least of those that can be among the ``best``."""
    terms = search.query_terms(query_text)
    none = index.spark.createDataFrame([], "segment int, doc long, score double")
    if not terms:
        return none
    blocks = _own_blocks(index, terms)
    if fields is not None:
        blocks = blocks.filter(F.col("field").isin(list(fields)))
    weights, means = _weights(index, blocks, boosts)
    if not weights:
        return none
    whole = lambda rows: rows.groupBy("segment", "doc").agg(F.sum("part").alias("score"))
    apart = F.inline(F.arrays_zip(*LISTS))
    postings = lambda rows, *more: rows.select("segment", "term", "field", "first", *more, *map(_numbers, LISTS)).select("segment", "term", "field", "first", *more, apart).select("segment", (F.col("first") + F.col("apart")).alias("doc"), *more, _score(F.col("tf"), F.col("length"), weights, means, k1, b).alias("part"))
    if best is None:
        return whole(postings(blocks))
    spread = blocks.withColumn("range", F.explode(F.sequence(F.shiftright("first", RANGE_BITS), F.shiftright("last", RANGE_BITS))))
    bound = _score(F.col("max_tf"), F.col("min_length"), weights, means, k1, b)
    bounds = spread.groupBy("segment", "range", "term", "field").agg(F.max(bound).alias("most")).groupBy("segment", "range").agg(F.sum("most").alias("most"))
    looked = max(FIRST_RANGES, best)
    if bounds.limit(looked + 1).count() <= looked:
        return whole(postings(blocks))
    of_ranges = lambda ranges: whole(postings(spread.join(ranges.select("segment", "range"), ["segment", "range"], "left_semi"), "range").filter(F.shiftright("doc", RANGE_BITS) == F.col("range")))
    head = of_ranges(bounds.orderBy(F.desc("most"), "segment", "range").limit(looked)).orderBy(F.desc("score")).limit(best)
    reached = head.agg(F.min("score").alias("least"), F.count("*").alias("n")).first()
    if reached["n"] < best:
        return whole(postings(blocks))
    # sums of bounds and of scores may differ in their last bits
    return of_ranges(bounds.filter(F.col("most") >= reached["least"] * (1 - 1e-9)))


def hits(index: TextIndex, query_text: str, min_score: float = 0.1, top_n: int = 10, offset: int = 0, fields: Sequence[str] | None = None, boosts: Mapping[str, float] | None = None, allowed: DataFrame | None = None) -> DataFrame:
    """A page of (_key, score) by score, then key; ``allowed`` (_key) leaves out all other documents before the page is cut."""
    found = scores(index, query_text, fields, boosts, best=None if allowed is not None else top_n + offset).filter(F.col("score") >= min_score)
    keyed = found.join(index.table("documents"), ["segment", "doc"]).select("_key", "score")
    if allowed is not None:
        keyed = keyed.join(allowed.select("_key"), "_key", "left_semi")
    return search.page(keyed, [F.desc("score"), F.asc("_key")], top_n, offset)


def total(index: TextIndex, query_text: str, min_score: float = 0.1) -> DataFrame:
    """How many documents a search has before paging."""
    return scores(index, query_text).filter(F.col("score") >= min_score).agg(F.count("*").alias("total"))


def near_words(index: TextIndex, term: str, threshold: float) -> DataFrame:
    """(term, ratio) of the words of the vocabulary whose fuzzy ratio with ``term``, in percent, reaches the threshold.

    A ratio allows so many letters to be taken out of both words. Where these are
    no more than DELETED and the index has deletions, words meet the term in what
    is left of both. Else, and for long words, the vocabulary's words of a length
    that allows the ratio are compared.
    """
    least, size = search.search_term_ratio(threshold), len(term)
    words = index.table("words").select("term").distinct()
    near = (F.length("term") >= size * least / (2 - least) - 1e-9) & (F.length("term") * least <= size * (2 - least) + 1e-9)
    # of both lengths together so many letters at most are not shared
    longest = int(size * (2 - least) / least + 1e-9) if least > 0 else None
    apart = None if longest is None else int((1 - least) * (size + longest) + 1e-9)
    if index.fuzzy and apart is not None and apart <= DELETED and size <= LONGEST:
        own = index.spark.createDataFrame([(term,)], "t string").select(F.explode(deletions(F.col("t"), apart)).alias("rest"))
        met = index.table("deletions").join(F.broadcast(own), "rest").select("term")  # the letters of one term taken out
        found = met.union(words.filter(F.length("term") > LONGEST)).distinct().filter(near)
    else:
        found = words.filter(near)
    return found.select("term", (fuzzy_ratio("term", F.lit(term)) / 100).alias("ratio")).filter(F.col("ratio") >= least)


def keyword_hits(index: TextIndex, search_term: str, similarity_threshold: float = 97.0, top_n: int = 10, docs: DataFrame | None = None) -> DataFrame:
    """(_key, keyword_score) of a keyword search: 1.0 as a part of a field, 0.9 as a word of it, else the best fuzzy ratio of a word.

    Words come from the vocabulary and documents from the postings of those that
    are near enough. Whether a term of several words is a part of a field is seen
    in the texts of the documents that hold its first word, from ``docs``.
    """
    if not search_term or not search_term.strip():
        raise ValueError("a search term is needed")
    term = search_term.strip().lower()
    first = (search.query_terms(term) or [term])[0]
    words = near_words(index, term, similarity_threshold).filter(F.col("term") != first)
    wanted = words.unionByName(index.spark.createDataFrame([(first, None)], "term string, ratio double"))
    own = index.table("blocks").join(wanted.withColumn("bucket", bucket_of(F.col("term"), index.buckets)), ["bucket", "term"])
    postings = own.select("segment", "first", "term", "ratio", _numbers("apart")).withColumn("apart", F.explode("apart")).select("segment", (F.col("first") + F.col("apart")).alias("doc"), "term", "ratio")
    best = postings.groupBy("segment", "doc").agg(F.max("ratio").alias("ratio"), F.bool_or(F.col("term") == first).alias("word")).join(index.table("documents"), ["segment", "doc"])
    if first == term:
        part = F.lit(True)
    else:
        if docs is None:
            raise ValueError("a term of several words needs the documents")
        texts = [F.lower(F.coalesce(search._as_text(docs, f), F.lit(""))) for f in index.fields]
        holding = docs.select("_key", reduce(lambda a, b: a | b, [t.contains(term) for t in texts]).alias("part")).filter("part")
        best = best.join(holding, "_key", "left")
        part = F.coalesce("part", F.lit(False))
    score = F.when(F.col("word") & part, 1.0).when(F.col("word"), 0.9).otherwise(F.col("ratio"))
    return search.page(best.select("_key", score.alias("keyword_score")), [F.desc("keyword_score"), F.asc("_key")], top_n)
