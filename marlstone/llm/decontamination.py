"""Benchmark decontamination by CGK embeddings and bit-sampling.

Words of a text are hashed and walked from every word on: at step j the walk
takes the word it stands on, and moves on if bit j of that word's random number
is set. Two windows at a small edit distance fall into step again soon, so their
walks agree in most places (the CGK embedding: edit distance becomes Hamming
distance). Tables sample a few places of the walk; windows that agree with one
of the item's windows in all samples of any table are candidates. Number and
width of the tables give the target recall. A longer item has several windows.

Walks over words do not see items in which many words have a changed letter.
So runs of letters are seeds besides: every run of some bytes of an item is
looked up at every place of a text, and a band of diagonals (places in the text
less places in the item) that holds enough seeds is a candidate too. An item of
fewer than TINY bytes has seeds so short that one of them must be whole.

Each candidate is verified by the exact edit distance between the whole item and
the text around the window or the band.

Edge cases: a null or empty text has no hits. Words are runs of letters, digits
and characters beyond ASCII, in lower case; what stands between words counts as
one space. Null items and items without a word are left out. Repeated items and
rows each give their rows. Only the columns named are read, whatever the others
are called; ``remove_contaminated`` keeps all columns. Whole texts are searched,
at every word. An empty benchmark gives no rows and removes none.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm.common import give_back, materialize, slices

SIMILARITY = 0.8
#: Independent walks, tables of each walk, places that a table samples.
WALKS, TABLES, SAMPLES = 2, 10, 6
#: Words of a window that is walked, and words from one window of an item to the next.
SPAN, APART, SEED = 8, 4, 20240229
#: Bytes of items that a task searches for at once; a larger benchmark is taken in so many blocks, one after another.
ITEM_BYTES = 16_000_000
#: Bytes of a seed by the bytes of its item: short items have few runs without an edit. Below TINY one seed is sure to be whole.
SEED_LETTERS, SHORT, SHORT_LETTERS, TINY = 8, 120, 6, 32
#: Seeds of an item, evenly spread. A band needs one seed, and one more for so many of the item; edits of a fifth leave a multiple of that.
MOST_SEEDS, FOR_A_SHORT_SEED, FOR_A_SEED = 120, 12, 24
#: Items' seeds held in one table, and matches of seeds taken at once.
SEEDS, MATCHES = 1 << 19, 1 << 21
#: Candidates verified at once.
PAIRS = 1 << 15
#: Windows walked at once, to stay in cache.
CHUNK = 1 << 15

_RNG = np.random.default_rng(SEED)
_BYTE_HASH = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_IS_WORD = np.zeros(256, dtype=bool)
_IS_WORD[[*range(48, 58), *range(97, 123), *range(128, 256)]] = True
_MIX = [np.uint64(int(x) | 1) for x in _RNG.integers(0, 2**64, WALKS + 1, dtype=np.uint64)]
_PLACE = [np.uint64(int(x) | 1) for x in _RNG.integers(0, 2**64, 8, dtype=np.uint64)]
_BASE = int(_RNG.integers(0, 2**63)) | 1
_BACK = pow(_BASE, -1, 2**64)


@functools.lru_cache
def _powers(base: int, n: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(n, base, np.uint64))))


def _mixed(x: np.ndarray, salt: np.uint64) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * salt
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Words:
    """The words of some texts, one row after another, each text ended by a pad that no walk leaves.

    ``letters`` has the bytes of all words, a space before each word and a line
    end after each text; ``begins`` is where each text begins in it.
    """

    def __init__(self, texts: list[str]):
        raw = [t.lower().encode() for t in texts]
        codes = np.frombuffer(b"\n".join(raw) + b"\n", dtype=np.uint8)
        text_end = np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)) + 1)
        keep = _IS_WORD[codes]
        before = np.flatnonzero(keep[1:] & ~keep[:-1])
        out = codes.copy()
        keep[before], out[before] = True, 32
        keep[text_end - 1], out[text_end - 1] = True, 10
        self.letters = letters = out[keep]
        self.raw = letters.tobytes()
        self.begins = np.concatenate(([0], np.flatnonzero(letters == 10) + 1))
        gap = letters <= 32
        start = np.flatnonzero(np.concatenate(([True], gap[:-1])) & ~gap)
        end = np.flatnonzero(np.concatenate((gap[1:], [True])) & ~gap) + 1
        owner = np.searchsorted(self.begins, start, side="right") - 1
        place = np.arange(len(start)) + owner  # a pad for each text before
        total = len(start) + len(texts)
        self.start, self.end, self.text = (np.zeros(total, np.int64) for _ in range(3))
        self.start[place], self.end[place], self.text[place] = start, end, owner
        value = np.zeros(total, np.uint64)
        if len(start):
            n = 1 << len(letters).bit_length()
            sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE_HASH[letters] * _powers(_BASE, n)[: len(letters)])))
            value[place] = _mixed((sums[end] - sums[start]) * _powers(_BACK, n)[start], _MIX[-1]) | np.uint64(1)
        self.hash, self.place = value, place
        self.count = np.bincount(owner, minlength=len(texts))
        self.first = np.cumsum(self.count + 1) - self.count - 1

    def bits(self, walk: int) -> np.ndarray:
        """64 random bits of each word; those of a pad are 0."""
        return np.where(self.hash == 0, np.uint64(0), _mixed(self.hash, _MIX[walk])).view(np.int64)

    def text_of(self, first: int, last: int) -> bytes:
        """The words at places first to last (exclusive) of one text, a space between."""
        return self.raw[self.start[first] : self.end[first:last].max(initial=0)]


def _walk(words: Words, at: np.ndarray, bits: np.ndarray, steps: list[int]) -> dict[int, np.ndarray]:
    """The words on which walks from ``at`` stand at the given steps."""
    seen, at = {}, at.copy()
    for j in range(steps[-1] + 1):
        if j in steps:
            seen[j] = words.hash[at]
        step = bits[at]
        step >>= j
        step &= 1
        at += step
    return seen


def _key(seen: dict[int, np.ndarray], places: tuple[int, ...]) -> np.ndarray:
    """One hash of the words at the sampled places; each place has its own odd factor."""
    key = seen[places[0]] * _PLACE[0]
    for p, factor in zip(places[1:], _PLACE[1:], strict=False):
        key ^= seen[p] * factor
    return key


def edit_distance_within(item: bytes, text: bytes) -> int:
    """The least edit distance between ``item`` and any part of ``text``, by bit-parallel dynamic programming."""
    if item in text:
        return 0
    m = len(item)
    match: dict[int, int] = {}
    for i, c in enumerate(item):
        match[c] = match.get(c, 0) | 1 << i
    top, full = 1 << (m - 1), (1 << m) - 1
    plus, minus, score, best = full, 0, m, m
    for c in text:
        x = match.get(c, 0)
        zero = (((x & plus) + plus) ^ plus) | x | minus
        up, down = minus | (full & ~(zero | plus)), plus & zero
        score += bool(up & top) - bool(down & top)
        best = min(best, score)
        up, down = up << 1 & full, down << 1 & full
        plus, minus = down | (full & ~(zero | up)), up & zero
    return best


def match_masks(items: list[bytes], width: int) -> np.ndarray:
    """For each of ``width`` words of 64 bits, and each item and byte, the places of the item that have the byte."""
    match = np.zeros((width, len(items) * 256), dtype=np.uint64)
    for k, item in enumerate(items):
        i = np.arange(len(item))
        np.bitwise_or.at(match, (i // 64, np.frombuffer(item, np.uint8).astype(np.int64) + k * 256), np.uint64(1) << (i % 64).astype(np.uint64))
    return match


def least_distances(items: list[bytes], number: np.ndarray, letters: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """``edit_distance_within`` of items[number] and letters[begin:stop]: the same steps on words of 64 bits, all pairs of a batch at once."""
    out = np.zeros(len(number), dtype=np.int64)
    size = np.array([len(x) for x in items], dtype=np.int64)
    long = np.concatenate((letters, np.full(1, 10, np.uint8)))
    widths = (size[number] + 63) // 64
    for width in np.unique(widths).tolist():
        rows = np.flatnonzero(widths == width)
        rows = rows[np.argsort(stop[rows] - begin[rows], kind="stable")]
        a = 0
        while a < len(rows):
            n = min(4096, max(1, (1 << 17) // width))
            while n > 1 and n * (stop - begin)[rows[min(len(rows), a + n) - 1]] > 1 << 22:
                n //= 2
            part = rows[a : a + n]
            own, of = np.unique(number[part], return_inverse=True)
            longest = int((stop - begin)[part].max(initial=0))
            # behind its end a text has line ends, which no item has: they never make a distance less
            places = begin[part] + np.arange(longest)[:, None]
            texts = long[np.where(places < stop[part], places, len(letters))]
            out[part] = _distances(match_masks([items[k] for k in own.tolist()], width), of * 256, size[number[part]], texts)
            a += n
    return out


def _distances(match: np.ndarray, base: np.ndarray, m: np.ndarray, texts: np.ndarray) -> np.ndarray:
    one, last = np.uint64(1), np.uint64(63)
    width = len(match)
    plus, minus = [np.full(len(m), ~np.uint64(0)) for _ in range(width)], [np.zeros(len(m), np.uint64) for _ in range(width)]
    top = ((m - 1) % 64).astype(np.uint64)
    score, best = m.copy(), m.copy()
    for row in texts:
        at = base + row
        carry = up_in = down_in = np.uint64(0)
        for w in range(width):
            x, p, q = match[w].take(at), plus[w], minus[w]
            zero = x & p
            zero += p
            if width > 1:
                over = zero < p
                if w:
                    zero += carry
                    over |= zero < carry
                carry = over.astype(np.uint64)
            zero ^= p
            zero |= x
            zero |= q
            up, down = zero | p, p & zero
            np.invert(up, out=up)
            up |= q
            if w == width - 1:
                score += (up >> top & one).view(np.int64)
                score -= (down >> top & one).view(np.int64)
            if width > 1:
                up_out, down_out = up >> last, down >> last
            up <<= one
            down <<= one
            if w:
                up |= up_in
                down |= down_in
            if width > 1:
                up_in, down_in = up_out, down_out
            np.bitwise_and(up, zero, out=minus[w])
            zero |= up
            np.invert(zero, out=zero)
            np.bitwise_or(down, zero, out=plus[w])
        np.minimum(best, score, out=best)
    return best


def _runs(letters: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as a number; the last places are filled up with line ends."""
    x = np.concatenate((letters, np.full(7, 10, np.uint8))).astype(np.uint64)
    for width in (1, 2, 4):
        x = x[:-width] | x[width:] << np.uint64(8 * width)
    return x


class Seeds:
    """Runs of letters of some items, and the bands of texts that hold enough of them."""

    def __init__(self, items: list[tuple[int, bytes]], size: int, sure: bool):
        self.mask = np.uint64((1 << 8 * size) - 1)
        self.number, self.length = np.array([k for k, _ in items]), np.array([len(item) for _, item in items])
        # bands overlap by half; a match whose letters drift further than half a band is spread over two
        self.half = np.maximum(8, self.length // 8)
        apart = np.where(sure, 1, np.maximum(1, self.length // MOST_SEEDS))
        runs = [_runs(np.frombuffer(item, np.uint8))[: len(item) - size + 1 : step] for (_, item), step in zip(items, apart.tolist(), strict=True)]
        count = np.array([len(r) for r in runs])
        self.need = np.where(sure, 1, 1 + count // np.where(self.length < SHORT, FOR_A_SHORT_SEED, FOR_A_SEED))
        keys = np.concatenate(runs) & self.mask
        owner = np.repeat(np.arange(len(items)), count)
        offset = (np.arange(len(keys)) - np.repeat(np.cumsum(count) - count, count)) * apart[owner]
        order = np.argsort(keys, kind="stable")
        self.owner, self.offset = owner[order], offset[order]
        self.keys, self.first, self.held = np.unique(keys[order], return_index=True, return_counts=True)
        self.shift = np.uint64(64 - min(26, max(16, len(keys).bit_length() + 4)))
        self.likely = np.zeros(1 << 64 - int(self.shift), dtype=bool)
        self.likely[self.keys * _PLACE[0] >> self.shift] = True

    def bands(self, runs: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, ...]:
        """Text, number of the item, first and last (exclusive) diagonal of each band in order, places counted from the text's begin."""
        keys, counts = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for a in range(0, len(runs), CHUNK * 4):
            run = runs[a : a + CHUNK * 4] & self.mask
            maybe = np.flatnonzero(self.likely[run * _PLACE[0] >> self.shift])
            at = np.minimum(np.searchsorted(self.keys, run[maybe]), len(self.keys) - 1)
            on = self.keys[at] == run[maybe]
            maybe, at = maybe[on], at[on]
            text, n = np.searchsorted(begins, maybe + a, side="right") - 1, self.held[at]
            place, total = maybe + a - begins[text], np.cumsum(n)
            for low, high in self._parts(total):
                m = n[low:high]
                row = np.repeat(np.arange(low, high), m)
                seed = np.arange(len(row)) + np.repeat(self.first[at[low:high]] - np.cumsum(m) + m, m)
                item = self.owner[seed]
                half = (place[row] - self.offset[seed] + self.length[item]) // self.half[item]
                key, count = np.unique(text[row] << 46 | item << 26 | half, return_counts=True)
                keys.append(key)
                counts.append(count)
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        count = np.bincount(back, weights=np.concatenate(counts), minlength=len(key))
        count[:-1] += count[1:] * (key[1:] == key[:-1] + 1)  # a band is a half and the next
        item = key >> 26 & ((1 << 20) - 1)
        enough = count >= self.need[item]
        key, item = key[enough], item[enough]
        first = (key & ((1 << 26) - 1)) * self.half[item] - self.length[item]
        return key >> 46, self.number[item], first, first + 2 * self.half[item]

    @staticmethod
    def _parts(total: np.ndarray) -> Iterator[tuple[int, int]]:
        """Cut rows, given their running total of matches, to parts of about MATCHES matches."""
        low = 0
        while low < len(total):
            before = total[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(total, before + MATCHES, side="right")))
            yield low, high
            low = high


class Searcher:
    """Tables of the items' windows, and the search of texts for them."""

    def __init__(self, items: list[tuple[int, str]], similarity: float = SIMILARITY):
        self.similarity = similarity
        words = Words([text for _, text in items])
        self.items = [(item_id, words.text_of(a, a + n), n) for (item_id, _), a, n in zip(items, words.first.tolist(), words.count.tolist(), strict=True)]
        self.length = np.array([len(item) for _, item, _ in self.items], dtype=np.int64)
        self.allowed = ((1 - similarity) * self.length + 1e-9).astype(np.int64)
        windows = [(k, o) for k, (_, _, n) in enumerate(self.items) if n for o in sorted({0, *range(0, n - SPAN + 1, APART), max(0, n - SPAN)})]
        rng = np.random.default_rng(SEED)
        # a sample from each part of a walk of 1.5 steps a word, so that they fall on different words
        part = 1.5 * SPAN / SAMPLES
        self.tables: list[tuple[list[int], list]] = []
        at = np.array([words.first[k] + o for k, o in windows], dtype=np.int64)
        #: Number of the item of each window, and where it begins in the item's letters.
        self.windows = np.array([(k, words.start[words.first[k] + o] - words.start[words.first[k]]) for k, o in windows], dtype=np.int64).reshape(-1, 2)
        for walk in range(WALKS if len(at) else 0):
            places = [tuple(int((k + rng.random()) * part) for k in range(SAMPLES)) for _ in range(TABLES)]
            steps = sorted({p for ps in places for p in ps})
            seen = _walk(words, at, words.bits(walk), steps)
            tables = []
            for ps in places:
                key = _key(seen, ps)
                order = np.argsort(key)
                likely = np.zeros(1 << 16, dtype=bool)
                likely[key >> np.uint64(48)] = True
                tables.append((ps, likely, key[order], order))
            self.tables.append((steps, tables))
        groups: dict[tuple[int, bool], list[tuple[int, bytes]]] = {}
        for k, (_, item, _) in enumerate(self.items):
            if m := len(item):
                size, sure = (m // (int(self.allowed[k]) + 1), True) if m < TINY else (SHORT_LETTERS if m < SHORT else SEED_LETTERS, False)
                groups.setdefault((min(size, 8), sure), []).append((k, item))
        self.seeds: list[Seeds] = []
        for (size, sure), members in sorted(groups.items()):
            part, held = [], 0
            for k, item in members:
                part.append((k, item))
                held += len(item)
                if held > SEEDS:
                    self.seeds.append(Seeds(part, size, sure))
                    part, held = [], 0
            if part:
                self.seeds.append(Seeds(part, size, sure))

    def candidates(self, words: Words) -> np.ndarray:
        """Text, number of the item, and first and last (exclusive) place of a stretch of letters of the text, around windows that agree in a table."""
        found = [np.empty(0, np.int64)]
        for walk, (steps, tables) in enumerate(self.tables):
            bits = words.bits(walk)
            for k in range(0, len(words.place), CHUNK):
                at = words.place[k : k + CHUNK]
                seen = _walk(words, at, bits, steps)
                for places, likely, keys, order in tables:
                    key = _key(seen, places)
                    maybe = np.flatnonzero(likely[key >> np.uint64(48)])
                    lo, hi = np.searchsorted(keys, key[maybe], "left"), np.searchsorted(keys, key[maybe], "right")
                    row, n = np.repeat(maybe, hi - lo), hi - lo
                    found.append(at[row] * len(self.windows) + order[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())])
        at, number = np.divmod(np.unique(np.concatenate(found)), max(1, len(self.windows)))
        k, offset = self.windows[number].T
        text = words.text[at]
        # where the item would begin in the letters; places near each other are verified once
        begin, room = words.start[at] - offset, np.maximum(8, self.allowed[k] // 2)
        band = begin - begin % room
        rows = np.unique(np.stack((text, k, band)), axis=1)
        text, k, band = rows
        slack = self.allowed[k] + 1
        a = np.maximum(words.begins[text], band - slack)
        b = np.minimum(words.begins[text + 1] - 1, band + np.maximum(8, self.allowed[k] // 2) + self.length[k] + slack)
        return np.stack((text, k, a, b))

    def stretches(self, words: Words) -> Iterator[np.ndarray]:
        """The same around bands of seeds."""
        runs = _runs(words.letters)
        for seeds in self.seeds:
            text, k, first, stop = seeds.bands(runs, words.begins)
            begin, slack = words.begins[text], self.allowed[k] + 1
            a, b = begin + first - slack, begin + stop + self.length[k] + slack
            yield np.stack((text, k, np.maximum(begin, a), np.minimum(words.begins[text + 1] - 1, b)))

    def search(self, texts: list[str]) -> list[list[tuple[int, int, float]]]:
        """For each text its hits by item: id, least edit distance, similarity."""
        words = Words(texts)
        best: list[dict[int, int]] = [{} for _ in texts]
        pairs = np.concatenate([self.candidates(words), *self.stretches(words)], axis=1)
        for at in range(0, pairs.shape[1], PAIRS):
            self._verify(words, *pairs[:, at : at + PAIRS], best)
        return [[(self.items[k][0], d, 1 - d / len(self.items[k][1])) for k, d in sorted(hits.items())] for hits in best]

    def _verify(self, words: Words, text: np.ndarray, k: np.ndarray, begin: np.ndarray, stop: np.ndarray, best: list[dict[int, int]]) -> None:
        """Keep the least distance of each text and item that is near enough.

        The distances of an item's pieces of 64 bytes, each from its own part of
        the stretch, add up to no more than that of the item: a pair is given up
        when they exceed the edits allowed. What is left is compared whole.
        """
        own, number = np.unique(k, return_inverse=True)
        items = [self.items[i][1] for i in own.tolist()]
        least = np.zeros(len(k), dtype=np.int64)
        for at in range(0, int(self.length[own].max()), 64):
            on = np.flatnonzero((least <= self.allowed[k]) & (self.length[k] > max(64, at)))
            if not len(on):
                break
            rest = np.maximum(0, self.length[k[on]] - at - 64)
            least[on] += least_distances([x[at : at + 64] for x in items], number[on], words.letters, begin[on] + at, np.maximum(begin[on] + at, stop[on] - rest))
        on = np.flatnonzero(least <= self.allowed[k])
        least = least_distances(items, number[on], words.letters, begin[on], stop[on])
        near = least <= self.allowed[k[on]]
        for t, i, d in zip(text[on][near].tolist(), k[on][near].tolist(), least[near].tolist(), strict=True):
            best[t][i] = min(d, best[t].get(i, d))


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> tuple[int, DataFrame]:
    """How many blocks of about ITEM_BYTES the items make, and the items (_id, _text) with the number of their block."""
    items = benchmark.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).filter("_text IS NOT NULL")
    size = items.agg(F.sum(F.octet_length("_text").cast("long"))).first()[0] or 0
    n = max(1, -(-size // ITEM_BYTES))
    return n, items.withColumn("_block", F.pmod(F.xxhash64("_id", "_text"), F.lit(n)))


def _hits(spark: SparkSession, items: DataFrame, block: int, similarity: float):
    """A function from a text to its hits in a block of items, and the broadcast that it holds; nothing is shuffled."""
    kind = items.schema["_id"].dataType.simpleString()
    shared = spark.sparkContext.broadcast([(row._id, row._text) for row in items.filter(F.col("_block") == block).select("_id", "_text").collect()])

    @F.pandas_udf(f"array<struct<item_id:{kind},edit_distance:int,similarity:double>>")
    def hits(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        searcher = Searcher(shared.value, similarity)
        for batch in batches:
            rows = [[{"item_id": i, "edit_distance": d, "similarity": s} for i, d, s in found] for _, part in slices(batch, 2_000_000) for found in searcher.search(part)]
            yield pd.Series(rows, dtype=object)
        give_back()

    return hits, shared


def find_contaminated(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """A row for each document and item found in it: both ids, the least edit distance in bytes and the similarity.

    The item's id is called ``item_id``, with underscores before it where the
    document's id is called so. One pass over the texts for a benchmark of up to
    ITEM_BYTES; a larger one takes a pass for each block, whose rows are written
    to the shared folder before the next block is sent.
    """
    blocks, items = _blocks(benchmark, item_id_col, item_text_col)
    texts = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = None
    for block in range(blocks):
        hits, shared = _hits(df.sparkSession, items, block, similarity)
        found = texts.select("_id", F.inline(hits("_text")))
        if blocks > 1:
            found = materialize(found, "hits")
            shared.destroy()
        out = found if out is None else out.unionByName(found)
    item = "item_id"
    while item.lower() == id_col.lower():
        item = "_" + item
    return out.select(F.col("_id").alias(id_col), F.col("item_id").alias(item), "edit_distance", "similarity")


def remove_contaminated(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """``df`` without the rows whose text holds an item; all columns stay. Blocks of a large benchmark are taken as above."""
    blocks, items = _blocks(benchmark, item_id_col, item_text_col)
    for block in range(blocks):
        hits, shared = _hits(df.sparkSession, items, block, similarity)
        df = df.filter(F.size(hits(F.col(text_col))) == 0)
        if blocks > 1:
            df = materialize(df, "uncontaminated")
            shared.destroy()
    return df
