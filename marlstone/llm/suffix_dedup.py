"""Repeated passages by suffix arrays: every byte covered by a string of WINDOW bytes that also starts elsewhere.

Equal windows have equal least hashes of their short grams, so the starts of a
text fall into runs of one least hash, and equal windows lie in runs of one hash.
A run with the bytes its windows cover is a context. Least hashes that occur once
in the corpus hold no repeat. Contexts that occur twice are repeats as a whole.
Only where the contexts of a hash differ are their bytes compared: tasks put them
into blocks, build a suffix array by two-stage sorting (only suffixes smaller
than their successors are sorted directly, the rest is induced by scans over the
buckets) and take the common prefixes of neighbours. Hashes whose different
contexts have more than HOT_BYTES are not put into one task: their windows are
dealt out by two 64-bit hashes of their own.

Runs are those of windows of ``report`` bytes, which are not longer than the
windows that are cut: the common prefixes also show strings of that length that
start elsewhere, about forty words. They are counted, not cut.

Edge cases: a null or empty text, and one shorter than the window, is never cut
(null: empty). Repeats within a text count, also overlapping ones. Copies are
repeats of each other. Texts are told apart by their digest, so ids may be null
or repeated. Only the columns named are read, whatever the others are called;
matches never cross texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import free_name, materialize, slices

WINDOW, REPORT, GRAM = 400, 256, 32
#: Bytes of different contexts of a hash that a block may hold, and bytes of a block of several hashes.
HOT_BYTES, BLOCK = 4_000_000, 1_000_000
#: Places hashed at once, to stay in cache, and windows dealt out at once.
CHUNK, DEALT = 1 << 16, 1 << 18
#: Codes that are compared at once.
STEP = 7
_RNG = np.random.default_rng(20240401)
_BYTE = _RNG.integers(0, 2**64, (2, 256), dtype=np.uint64)
_A, _B = ([np.uint64(int(x) | 1) for x in _RNG.integers(0, 2**64, 2, dtype=np.uint64)] for _ in range(2))


def gram_hashes(codes: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """A hash of the ``size`` bytes from each place on, from hashes of powers of two."""

    def joined(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        h = x * _A[salt] + y * _B[salt]
        return h ^ (h >> np.uint64(29))

    n = len(codes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    part, width, out, done = _BYTE[salt][codes], 1, None, 0
    while True:
        if size & width:
            piece = part[done : done + n]
            out = piece if out is None else joined(out, piece)
            done += width
        width *= 2
        if width > size:
            return out
        part = joined(part[: len(part) - width // 2], part[width // 2 :])


def sliding_min(values: np.ndarray, size: int) -> np.ndarray:
    """The least of the ``size`` values from each place on."""
    width = 1
    while width * 2 <= size:
        values = np.minimum(values[: len(values) - width], values[width:])
        width *= 2
    rest = size - width
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def runs_of(texts: list[bytes], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """The runs of equal least hashes of all texts: text, first and last start in it, hash, whether its windows may repeat within it."""
    codes = np.frombuffer(b"".join(texts), dtype=np.uint8)
    size = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    end, n = np.cumsum(size), len(codes) - window + 1
    if n <= 0:
        none = np.empty(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(bool)
    width = window - gram + 1
    hashes, least = np.empty(n + width - 1, np.uint64), np.empty(n, np.uint64)
    for a in range(0, len(hashes), CHUNK):
        hashes[a : a + CHUNK] = gram_hashes(codes[a : a + CHUNK + gram - 1], gram)
    for a in range(0, n, CHUNK):
        least[a : a + CHUNK] = sliding_min(hashes[a : a + CHUNK + width - 1], width)
    inside = np.ones(n + 1, dtype=bool)  # starts of windows that end in their text
    inside[-1] = False
    for begin, stop in zip((end - size).tolist(), end.tolist(), strict=True):
        inside[max(begin, stop - window + 1) : stop] = False
    as_before = np.zeros(n + 1, dtype=bool)
    np.equal(least[1:], least[:-1], out=as_before[1:-1])
    as_before[1:] &= inside[:-1]
    as_before &= inside
    first, last = np.flatnonzero(inside & ~as_before), np.flatnonzero(inside[:-1] & ~as_before[1:])
    m, text = least[first], np.searchsorted(end, first, side="right")
    # a window can repeat within its run only if the run's least gram occurs twice in the text
    in_text = lambda h, t: h ^ t.astype(np.uint64) * _A[0]
    low = np.flatnonzero(hashes <= m.max(initial=0))
    key = np.sort(in_text(hashes[low], np.searchsorted(end, low, side="right")))
    within = np.isin(in_text(m, text), key[1:][key[1:] == key[:-1]])
    start = end[text] - size[text]
    return text, first - start, last - start, m, within


def smaller_than_next(codes: np.ndarray) -> np.ndarray:
    """Which suffixes are smaller than their successors; the last one counts as such."""
    n = len(codes)
    other = np.append(np.flatnonzero(codes[1:] != codes[:-1]), n - 1)  # the last place of each run of one code
    run_end = other[np.searchsorted(other, np.arange(n))]
    nxt = np.minimum(run_end + 1, n - 1)
    return (run_end == n - 1) | (codes[nxt] > codes)


def words_at(codes: np.ndarray, depth: int) -> np.ndarray:
    """The STEP codes (of 9 bits) from each place on as one number of that order; zeros follow the end for ``depth`` places."""
    n = len(codes)
    long = np.concatenate((codes, np.zeros(depth + STEP, np.uint16))).astype(np.uint64)
    words = np.zeros(n + depth, np.uint64)
    for k in range(STEP):
        words = words << np.uint64(9) | long[k : k + n + depth]
    return words


def sort_directly(places: np.ndarray, words: np.ndarray, depth: int) -> np.ndarray:
    """``places`` sorted by the ``depth`` codes from them on; only what is still tied is looked at again."""
    order = places[np.argsort(words[places], kind="stable")]
    tied, group, split = np.arange(len(order)), _groups(words[order]), True  # places in ``order`` that belong to ties, and to which
    for k in range(STEP, depth, STEP):
        if split:
            on = np.bincount(group)[group] > 1
            tied, group = tied[on], _groups(group[on])
            begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        if not len(tied):
            break
        word = words[order[tied] + k]
        differ = np.minimum.reduceat(word, begin) != np.maximum.reduceat(word, begin)
        split = differ.any()
        if split:
            part = np.flatnonzero(differ[group])
            by = np.lexsort((word[part], group[part]))
            order[tied[part]] = order[tied[part]][by]
            word[part] = word[part][by]
            group = np.cumsum(np.concatenate(([0], (group[1:] != group[:-1]) | (word[1:] != word[:-1]))))
    return order


def _groups(sorted_values: np.ndarray) -> np.ndarray:
    return np.cumsum(np.concatenate(([0], sorted_values[1:] != sorted_values[:-1]))) if len(sorted_values) else np.empty(0, np.int64)


def suffix_array(codes: np.ndarray, words: np.ndarray, depth: int, last: np.ndarray | None = None) -> np.ndarray:
    """All places sorted by the ``depth`` codes from them on, by two-stage sorting.

    ``last`` gives for each place the last one that is asked for in its part of
    the text: what stands behind the first direct suffix from there on induces
    nothing that is asked for and is left out.
    """
    direct = np.flatnonzero(smaller_than_next(codes))
    if last is not None:
        before = np.concatenate(([-1], direct[:-1]))
        direct = direct[before < last[direct]]
    direct = sort_directly(direct, words, depth)
    first = codes[direct]
    n_codes = int(codes.max()) + 1
    cut = np.searchsorted(first, np.arange(n_codes + 1))
    waiting: list[list[np.ndarray]] = [[] for _ in range(n_codes)]
    out = []

    def deal(before: np.ndarray, least: int) -> np.ndarray:
        """Put the places to the buckets of larger codes, in order; those of code ``least`` come back."""
        code = codes[before]
        for c in np.unique(code[code > least]).tolist():
            waiting[c].append(before[code == c])
        return before[code == least]

    for c in range(n_codes):
        wave = np.concatenate(waiting[c]) if waiting[c] else np.empty(0, np.int64)
        waiting[c] = []
        while len(wave):
            out.append(wave)
            before = wave[wave > 0] - 1
            wave = deal(before[codes[before] >= c], c)
        own = direct[cut[c] : cut[c + 1]]
        out.append(own)
        before = own[own > 0] - 1
        deal(before[codes[before] > c], c)
    return np.concatenate(out)


def common_prefix_reaches(a: np.ndarray, b: np.ndarray, words: np.ndarray, codes: np.ndarray, depth: int, known: int = 0) -> np.ndarray:
    """Whether the suffixes at a and b have ``depth`` codes in common; that they have ``known`` is known."""
    alive = np.arange(len(a))
    first = known - known % STEP
    whole = depth - depth % STEP
    for k in range(first, whole, STEP):
        alive = alive[words[a[alive] + k] == words[b[alive] + k]]
    for k in range(max(first, whole), depth):
        alive = alive[codes[a[alive] + k] == codes[b[alive] + k]]
    out = np.zeros(len(a), dtype=bool)
    out[alive] = True
    return out


def repeated_starts(contexts: list[bytes], window: int, report: int | None = None, asked: list[int] | None = None) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """For each context the starts whose windows also start elsewhere in the block: those of ``window`` bytes, and those of ``report``.

    Of each context the starts up to ``asked`` are looked at, by default all.
    """
    if not contexts:
        return [], []
    report = window if report is None else report
    size = np.array([len(c) for c in contexts])
    codes = np.zeros(int((size + 1).sum()), dtype=np.uint16)  # a zero ends each context
    begin = np.cumsum(size + 1) - size - 1
    body = np.ones(len(codes), dtype=bool)
    body[begin + size] = False
    codes[body] = np.frombuffer(b"".join(contexts), dtype=np.uint8).astype(np.uint16) + 1
    context = np.repeat(np.arange(len(contexts)), size + 1)
    last = size - report if asked is None else np.minimum(asked, size - report)
    last, end = (begin + last)[context], (begin + size)[context]
    words = words_at(codes, window)
    ordered = suffix_array(codes, words, window, last)
    ordered = ordered[ordered <= last[ordered]]
    a, b = ordered[:-1], ordered[1:]
    alike = np.flatnonzero(common_prefix_reaches(a, b, words, codes, report))
    more = alike[a[alike] + window <= end[a[alike]]]
    more = more[common_prefix_reaches(a[more], b[more], words, codes, window, report)]

    def starts(pairs: np.ndarray) -> list[np.ndarray]:
        hit = np.unique(np.concatenate((ordered[pairs], ordered[pairs + 1])))
        return np.split(hit - begin[context[hit]], np.searchsorted(hit, begin[1:]))

    return starts(more), starts(alike)


def spans_from(starts: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of the stretches that windows at sorted starts cover, those that touch joined."""
    if not len(starts):
        return starts, starts
    gap = np.flatnonzero(np.diff(starts) > window)
    return starts[np.append(0, gap + 1)], starts[np.append(gap, len(starts) - 1)] + window


def text_key(text: Column) -> Column:
    return F.unhex(F.md5(F.coalesce(text, F.lit(""))))


def _runs(texts: DataFrame, window: int, report: int, gram: int) -> DataFrame:
    """All runs of all texts: key of the text, hash, context, first and last start, end of the context, whether it may repeat within itself."""

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, part in slices(batch["text"], 1_000_000):
                raw = [t.encode() for t in part]
                text, lo, hi, m, within = runs_of(raw, report, gram)
                context = [hashlib.blake2b(raw[t][a : b + window], digest_size=8).digest() for t, a, b in zip(text.tolist(), lo.tolist(), hi.tolist(), strict=True)]
                stop = np.minimum(np.array([len(r) for r in raw], dtype=np.int64)[text], hi + window)
                yield pd.DataFrame({"text_key": batch["text_key"].to_numpy()[at + text], "m": m.view(np.int64), "context": np.frombuffer(b"".join(context), dtype=np.int64), "lo": lo.astype(np.int32), "hi": hi.astype(np.int32), "stop": stop.astype(np.int32), "within": within})

    return texts.mapInPandas(find, "text_key binary, m long, context long, lo int, hi int, stop int, within boolean")


def _with_bytes(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` contexts (text_key, m, context, n, hot, lo, hi, stop) with their bytes, from the texts of their keys."""
    lists = wanted.groupBy("text_key").agg(F.collect_list(F.struct("m", "context", "n", "hot", "lo", "hi", "stop")).alias("runs"))
    both = texts.dropDuplicates(["text_key"]).join(lists, "text_key")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at, part in slices(batch["text"], 1_000_000):
                rows = [
                    (key, r["m"], r["context"], r["n"], r["hot"], r["lo"], r["hi"] - r["lo"], raw[r["lo"] : r["stop"]])
                    for key, raw, runs in zip(batch["text_key"].iloc[at : at + len(part)], (t.encode() for t in part), batch["runs"].iloc[at : at + len(part)], strict=True)
                    for r in runs
                ]
                yield pd.DataFrame(rows, columns=["text_key", "m", "context", "n", "hot", "lo", "asked", "body"])

    return both.mapInPandas(cut, "text_key binary, m long, context long, n long, hot boolean, lo int, asked int, body binary")


COVER = "text_key binary, begin int, stop int, cut boolean"


def _cover_frame(keys: list, starts: list[np.ndarray], window: int, cut: bool) -> pd.DataFrame:
    """The stretches of windows at the given starts of the texts of ``keys``."""
    spans = [spans_from(s, window) for s in starts]
    flat = lambda xs: np.concatenate([np.empty(0, np.int64), *xs]).astype(np.int32)
    begins, stops = flat([s[0] for s in spans]), flat([s[1] for s in spans])
    return pd.DataFrame({"text_key": [k for k, s in zip(keys, spans, strict=True) for _ in range(len(s[0]))], "begin": begins, "stop": stops, "cut": np.full(len(begins), cut)})


def _compared(contexts: DataFrame, window: int, report: int) -> DataFrame:
    """What suffix arrays over blocks of whole hashes find in contexts that occur once."""

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block: list[tuple] = []
        size, last = 0, None

        def ended() -> pd.DataFrame:
            cut, short = repeated_starts([row[4] for row in block], window, report, [row[3] for row in block])
            once = [k for k, row in enumerate(block) if row[1] == 1]
            keys = [block[k][0] for k in once]
            return pd.concat([_cover_frame(keys, [starts[k] + block[k][2] for k in once], length, on) for starts, length, on in ((cut, window, True), (short, report, False))])

        for batch in batches:
            for key, m, n, lo, asked, body in zip(*(batch[c] for c in ("text_key", "m", "n", "lo", "asked", "body")), strict=True):
                if size > BLOCK and m != last:
                    yield ended()
                    block, size = [], 0
                block.append((key, n, lo, asked, body))
                size, last = size + len(body), m
        if block:
            yield ended()

    dealt = contexts.repartition("m").sortWithinPartitions("m", "context")
    return dealt.select("text_key", "m", "n", "lo", "asked", "body").mapInPandas(compare, COVER)


def _dealt_windows(contexts: DataFrame, window: int, report: int) -> DataFrame:
    """The same for hashes of many bytes: each window is dealt by its own hashes."""

    def windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, n, lo, asked, body in zip(*(batch[c] for c in ("text_key", "n", "lo", "asked", "body")), strict=True):
                codes = np.frombuffer(body, dtype=np.uint8)
                for length, on in ((window, True), (report, False)):
                    for at in range(0, min(asked + 1, len(codes) - length + 1), DEALT):
                        stop = min(at + DEALT, asked + 1, len(codes) - length + 1)
                        a, b = (gram_hashes(codes[at : stop + length - 1], length, salt).view(np.int64) for salt in (0, 1))
                        yield pd.DataFrame({"a": a, "b": b, "cut": on, "text_key": [key] * len(a), "at": np.arange(lo + at, lo + stop, dtype=np.int32), "once": n == 1})

    each = materialize(contexts.select("text_key", "n", "lo", "asked", "body").mapInPandas(windows, "a long, b long, cut boolean, text_key binary, at int, once boolean"), "windows")
    again = materialize(each.groupBy("a", "b", "cut").count().filter("count > 1").select("a", "b", "cut"), "windows-again")
    hits = each.filter("once").join(again, ["a", "b", "cut"], "left_semi")
    return hits.select("text_key", F.col("at").alias("begin"), (F.col("at") + F.when(F.col("cut"), window).otherwise(report)).alias("stop"), "cut")


def covered(texts: DataFrame, window: int = WINDOW, gram: int = GRAM, report: int | None = None) -> DataFrame:
    """Per text that has some, its repeated stretches: (text_key, cover), cover being an array of (begin, stop, cut) in bytes, in any order and overlapping.

    ``cut`` tells the stretches of windows from those of strings of ``report``
    bytes. ``texts`` has a row for each text, copies included: text_key and text.
    """
    report = min(REPORT, window) if report is None else report
    runs = materialize(_runs(texts.filter(F.octet_length("text") >= report), window, report, gram), "runs")
    by_hash = runs.groupBy("m").agg(F.count("*").alias("n"), F.min("context").alias("a"), F.max("context").alias("b"), F.max("within").alias("within"))
    alike = F.col("a") == F.col("b")
    repeated = materialize(by_hash.filter("n > 1 OR within").select("m", (alike & (F.col("n") > 1)).alias("alike")), "hashes")
    runs = materialize(runs.join(repeated, "m").select("text_key", "m", "context", "lo", "hi", "stop", "alike"), "repeated-runs")
    whole = runs.filter("alike")
    mixed = runs.filter("NOT alike")
    contexts = mixed.groupBy("m", "context").agg(F.count("*").alias("n"), F.min(F.struct("text_key", "lo", "hi", "stop")).alias("at"))
    contexts = materialize(contexts, "contexts")
    twice = mixed.join(contexts.filter("n > 1").select("m", "context"), ["m", "context"], "left_semi")
    size = F.sum((F.col("at.stop") - F.col("at.lo")).cast("long"))
    of_hash = contexts.groupBy("m").agg(size.alias("size"), F.min("n").alias("least")).filter("least = 1").select("m", (F.col("size") > HOT_BYTES).alias("hot"))
    wanted = contexts.join(of_hash, "m").select("m", "context", "n", "hot", "at.*")
    bodies = materialize(_with_bytes(texts, wanted), "bodies")
    both = whole.unionByName(twice)
    short = both.select("text_key", F.col("lo").alias("begin"), (F.col("hi") + report).alias("stop"), F.lit(False).alias("cut"))
    long = both.filter(F.col("stop") - F.col("lo") >= window).select("text_key", F.col("lo").alias("begin"), "stop", F.lit(True).alias("cut"))
    stretches = short.unionByName(long).unionByName(_compared(bodies.filter("NOT hot"), window, report)).unionByName(_dealt_windows(bodies.filter("hot"), window, report))
    return stretches.groupBy("text_key").agg(F.collect_set(F.struct("begin", "stop", "cut")).alias("cover"))


def _cut(raw: bytes, cover: list, cut: bool = True) -> tuple[list[bytes], int, int]:
    """What stays of a text without the stretches to cut, or without all others, the bytes removed and the maximal removed runs."""
    kept, at, removed, runs = [], 0, 0, 0
    for begin, stop in sorted((c["begin"], c["stop"]) for c in cover if c["cut"] == cut):
        if begin > at or not runs:
            kept.append(raw[at:begin])
            runs += 1
            removed += stop - begin
            at = stop
        elif stop > at:
            removed += stop - at
            at = stop
    return [*kept, raw[at:]], removed, runs


def summarize(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, gram: int = GRAM, report: int | None = None) -> DataFrame:
    """Per row its id, n_bytes, n_removed, n_spans, the digest of the bytes that stay, and n_repeated, the bytes that strings of ``report`` bytes cover that also start elsewhere."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    texts = df.select(text_key(text).alias("text_key"), text.alias("text"))
    cover = materialize(covered(texts, window, gram, report), "cover")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for key, text, stretches in zip(batch["text_key"], batch["text"], batch["cover"], strict=True):
                raw = text.encode()
                kept, removed, spans = _cut(raw, stretches)
                rows.append((key, removed, spans, hashlib.sha256(b"".join(kept)).hexdigest(), _cut(raw, stretches, False)[1]))
            yield pd.DataFrame(rows, columns=["text_key", "n_removed", "n_spans", "kept_sha256", "n_repeated"])

    changed = texts.dropDuplicates(["text_key"]).join(cover, "text_key").mapInPandas(cut, "text_key binary, n_removed long, n_spans long, kept_sha256 string, n_repeated long")
    changed = materialize(changed, "changed")
    rows = df.select(F.col(id_col).alias("_id"), text_key(text).alias("text_key"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.join(changed, "text_key", "left").select(F.col("_id").alias(id_col), "n_bytes", none("n_removed"), none("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"), none("n_repeated"))


def remove_repeats(df: DataFrame, text_col: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """``df`` with the repeated bytes cut out of its texts; bytes of a character cut in two are dropped. Null texts stay null, all columns stay."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    cover = materialize(covered(df.select(text_key(text).alias("text_key"), text.alias("text")), window, gram, window), "cover")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, covers: pd.Series) -> pd.Series:
        return pd.Series([t if t is None or c is None else b"".join(_cut(t.encode(), c)[0]).decode(errors="ignore") for t, c in zip(texts, covers, strict=True)], dtype=object)

    key, own = free_name(df, "_text_key"), free_name(df, "_cover")
    keyed = df.withColumn(key, text_key(text)).join(cover.select(F.col("text_key").alias(key), F.col("cover").alias(own)), key, "left")
    return keyed.withColumn(text_col, cut(text_col, own)).select(*df.columns)
