"""Word shingles of texts: their hashes, MinHash bands, and exact Jaccard similarity of their sets."""

from __future__ import annotations

import re

import numpy as np
import xxhash

from marlstone.llm.components import unite

WORDS = re.compile(rb"[^\x20\x09-\x0D]+")
SEED = 42
#: Least hashes of a band, and the probability at which sets of the similarity asked for share a band.
ROWS, TARGET, MOST_BANDS = 8, 0.999, 512
_RNG = np.random.default_rng(SEED)
_FACTOR, _ADD = _RNG.integers(0, 2**64, (2, MOST_BANDS * ROWS), dtype=np.uint64) | np.uint64(1)


def hashes(text: str, shingle: int) -> np.ndarray:
    """The hash of each shingle of a text, in lower case, in order; fewer words make one shingle, none make none."""
    words = WORDS.findall(text.encode().lower())  # of bytes, lower() changes A-Z only
    if len(words) > shingle:
        parts = map(b" ".join, zip(*(words[k:] for k in range(shingle)), strict=False))
    else:
        parts = iter([b" ".join(words)] if words else [])
    return np.fromiter((xxhash.xxh64_intdigest(p, SEED) for p in parts), dtype=np.uint64)


def class_of(held: np.ndarray) -> int:
    """What tells sets apart, as a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(held.tobytes(), SEED)).view(np.int64))


def band_count(similarity: float) -> int:
    """Bands that sets of that similarity share one of with a probability of TARGET."""
    n = int(np.ceil(np.log(1 - TARGET) / np.log(1 - min(similarity, 0.999) ** ROWS)))
    if n > MOST_BANDS:
        raise ValueError(f"a similarity of {similarity} takes more than {MOST_BANDS} bands")
    return n


def bands(held: np.ndarray, similarity: float) -> np.ndarray:
    """A key for each band of a set's least hashes."""
    n = band_count(similarity)
    if not len(held):
        return np.zeros(n, np.int64)
    factor, add = _FACTOR[: n * ROWS], _ADD[: n * ROWS]
    least = np.full(n * ROWS, ~np.uint64(0))
    for k in range(0, len(held), 256):  # so that a long text takes no more memory
        x = held[k : k + 256, None] * factor + add
        x ^= x >> np.uint64(32)
        x *= factor
        least = np.minimum(least, (x ^ x >> np.uint64(29)).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(row.tobytes(), SEED) for row in least.reshape(n, ROWS)], dtype=np.uint64).view(np.int64)


def clusters(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set the least place of its cluster: the components of all pairs of that similarity.

    Of two such sets each has a shingle of the other among its rarest ones, those
    beyond the share asked for; so only these are looked up. Each set that is in
    no cluster yet is compared first, and sets near it join it. Then sets that
    share enough shingles with other clusters are compared with those. Pairs
    within a cluster need no more.
    """
    size = np.array([len(s) for s in sets], dtype=np.int64)
    end, owner = np.cumsum(size), np.repeat(np.arange(len(sets)), size)
    code, count = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_inverse=True, return_counts=True)[1:]
    rank = np.empty(len(count), dtype=np.int64)
    rank[np.argsort(count, kind="stable")] = np.arange(len(count))
    code = rank[code]
    code = code[np.lexsort((code, owner))]  # the rarest first
    begin = end - size
    rare = np.arange(len(code)) - begin[owner] <= (size - np.ceil(similarity * size - 1e-9).astype(np.int64))[owner]
    order = np.argsort(code[rare], kind="stable")
    holders, start = owner[rare][order], np.searchsorted(code[rare][order], np.arange(len(count) + 1))
    label, empty, mark = np.arange(len(sets)), np.flatnonzero(size == 0), np.zeros(len(count), dtype=bool)
    label[empty] = empty[:1].repeat(len(empty))

    def near(i: int) -> np.ndarray:
        own = code[begin[i] : end[i]]
        first = own[rare[begin[i] : end[i]]]
        n = start[first + 1] - start[first]
        other = np.unique(holders[np.repeat(start[first] - np.cumsum(n) + n, n) + np.arange(n.sum())])
        other = other[(size[other] >= similarity * size[i] - 1e-9) & (size[other] * similarity <= size[i] + 1e-9)]
        n = size[other]
        mark[own] = True
        both = np.add.reduceat(mark[code[np.repeat(begin[other] - np.cumsum(n) + n, n) + np.arange(n.sum())]], np.cumsum(n) - n, dtype=np.int64)
        mark[own] = False
        return other[both >= similarity * (n + size[i] - both) - 1e-9]

    placed = size == 0
    for i in range(len(sets)):
        if not placed[i]:
            hits = near(i)
            placed[hits] = True
            label = unite(label, np.full(len(hits), i), hits)
    # a shingle in several clusters has holders of different labels
    by_code = np.argsort(code, kind="stable")
    of, first = label[owner[by_code]], np.flatnonzero(np.diff(code[by_code], prepend=-1))
    mixed = np.zeros(len(count), dtype=bool)
    if len(first):
        mixed[code[by_code[first]]] = np.minimum.reduceat(of, first) != np.maximum.reduceat(of, first)
    shared = np.bincount(owner, weights=mixed[code], minlength=len(sets))
    for i in np.flatnonzero((size > 0) & (shared >= similarity * size - 1e-9)).tolist():
        hits = near(i)
        label = unite(label, np.full(len(hits), i), hits)
    return label
