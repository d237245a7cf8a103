"""Approximate vector search: cells around centroids, short codes for what is left after the centroid, exact scores for the best.

Vectors are taken at unit length. Centroids stand on two levels, about the square
root of the rows in all: some over all vectors, and within each one's part some
more. What a centroid leaves of a vector is cut into pieces of PIECE dimensions,
each written as the number of the nearest of 256 codewords. A search ranks the
cells, adds for each code of the nearest ones one number from a table for each
piece, and reads only the vectors of the best sums for their exact cosine.

Centroids and codewords are fitted on a sample of at most SAMPLE_BYTES, the rows
of the least hash of their key; every row is indexed. Codes are stored by cell,
vectors in small pages by their number, so that few of them can be read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions import vector
from marlstone.operators import search
from marlstone.sources.shared import application_dir, exists, scratch, source_version

LEAST_ROWS, SEED, WORDS, PIECE = 3, 11, 256, 4
#: Bytes of the sample, at 8 a component.
SAMPLE_BYTES = 64_000_000
#: The share of the cells whose codes are read.
PROBES = 0.9
#: Rows of a page of vectors.
PAGE_ROWS = 32


@dataclass(frozen=True)
class Index:
    """The folder of an index, its vectors and codes, their count, the centroids (of unit length), and the codewords of each piece."""

    path: str
    rows: DataFrame
    codes: DataFrame
    n: int
    centroids: np.ndarray
    words: list[np.ndarray]

    @property
    def dimensions(self) -> int:
        return self.centroids.shape[1]

    def ranked(self, top_n: int) -> int:
        """How many vectors are read for their exact scores: more for each one asked for, the more there are."""
        return round(top_n * max(4, self.n**0.25))


def _units(m: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(m, axis=1)
    return m / np.where(size == 0, 1, size)[:, None]


def _nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The number of the nearest centre of each point."""
    half = (centres * centres).sum(axis=1) / 2
    step = max(1, 4_000_000 // max(1, len(centres)))
    return np.concatenate([(points[a : a + step] @ centres.T - half).argmax(axis=1) for a in range(0, len(points), step)] or [np.zeros(0, np.int64)])


def _means(points: np.ndarray, n: int, rounds: int = 15) -> np.ndarray:
    """k-means of a bounded sample; an empty cell keeps its centre."""
    rng = np.random.default_rng(SEED)
    centres = points[rng.choice(len(points), min(n, len(points)), replace=False)]
    for _ in range(rounds):
        own = _nearest(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, points)
        count = np.bincount(own, minlength=len(centres))[:, None]
        moved = np.where(count > 0, sums / np.maximum(count, 1), centres)
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def _two_levels(points: np.ndarray, lists: int) -> np.ndarray:
    """About ``lists`` centroids of unit length: parts first, then within each as many as its share of the points asks for."""
    upper = _means(points, max(1, round(lists**0.5)))
    part = _nearest(points, upper)
    lower = [_means(points[part == k], max(1, round(lists * (part == k).mean()))) for k in range(len(upper)) if (part == k).any()]
    return _units(np.concatenate(lower))


def _pieces(dimensions: int) -> list[slice]:
    return [slice(a, min(a + PIECE, dimensions)) for a in range(0, dimensions, PIECE)]


def _matrix(batch: pd.Series) -> np.ndarray:
    return _units(np.stack(batch.to_numpy()).astype(np.float64))


def _coded(embedding: Column, centroids: np.ndarray, words: list[np.ndarray]) -> Column:
    """The cell of a vector and its code."""

    @F.pandas_udf("cell int, code binary")
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                yield pd.DataFrame({"cell": pd.Series([], dtype="int32"), "code": []})
                continue
            m = _matrix(batch)
            cell = (m @ centroids.T).argmax(axis=1)
            left = m - centroids[cell]
            codes = np.stack([_nearest(left[:, p], w) for p, w in zip(_pieces(m.shape[1]), words, strict=True)], axis=1).astype(np.uint8)
            yield pd.DataFrame({"cell": cell.astype(np.int32), "code": [c.tobytes() for c in codes]})

    return code(embedding)


def _sample(rows: DataFrame, embedding_field: str, n: int) -> np.ndarray:
    """Vectors of at most ``n`` rows as a matrix, by Arrow."""
    found = rows.select("_key", embedding_field).orderBy(F.xxhash64("_key"), "_key").limit(n).toArrow().column(1).combine_chunks()
    return _units(found.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(found), -1))


def build(df: DataFrame, lists: int | None = None, embedding_field: str = "embedding") -> Index | None:
    """An index over all rows with a finite vector of the most frequent length; None for fewer than LEAST_ROWS rows.

    Without ``lists`` there are about as many cells as the square root of the rows.
    """
    good = df.filter(vector.present(F.col(embedding_field)))
    size = good.groupBy(F.size(embedding_field).alias("n")).agg(F.count("*").alias("count")).orderBy(F.desc("count"), "n").first()
    if size is None or size["count"] < LEAST_ROWS:
        return None
    good = good.filter(vector.valid(F.col(embedding_field), size["n"]))
    points = _sample(good, embedding_field, max(1, SAMPLE_BYTES // (8 * size["n"])))
    centroids = _two_levels(points, min(lists or round(size["count"] ** 0.5), len(points)))
    left = points - centroids[(points @ centroids.T).argmax(axis=1)]
    words = [_means(left[:, p], WORDS) for p in _pieces(size["n"])]
    path = scratch(df.sparkSession, "vector-index")
    numbered = good.withColumn("_row", F.monotonically_increasing_id())
    numbered.write.option("parquet.page.row.count.limit", PAGE_ROWS).parquet(f"{path}/rows")
    rows = df.sparkSession.read.parquet(f"{path}/rows")
    coded = rows.select("_row", _coded(F.col(embedding_field), centroids, words).alias("c")).select("_row", "c.cell", "c.code")
    coded.repartitionByRange("cell", "_row").sortWithinPartitions("cell", "_row").write.parquet(f"{path}/codes")
    return Index(path, rows, df.sparkSession.read.parquet(f"{path}/codes"), rows.count(), centroids, words)


_KNOWN: dict[str, Index | None] = {}


def stored(df: DataFrame, source: str, lists: int | None = None, embedding_field: str = "embedding") -> Index | None:
    """The index of ``df``, which is read from the files of ``source``: built once for an application, and anew when files change or it was deleted."""
    name = hashlib.sha256("\0".join([application_dir(df.sparkSession), source_version(df.sparkSession, source), *df.columns, str(lists), embedding_field]).encode()).hexdigest()
    if name not in _KNOWN or (known := _KNOWN[name]) is not None and not exists(df.sparkSession, known.path):
        _KNOWN[name] = build(df, lists, embedding_field)
    return _KNOWN[name]


def candidates(index: Index, query: Sequence[float], n: int, probes: float = PROBES) -> list[int]:
    """Numbers of the ``n`` rows of the best sums of their codes, in the nearest share of the cells."""
    q = _units(np.asarray([query], dtype=np.float64))[0]
    near = index.centroids @ q
    cells = np.argsort(-near, kind="stable")[: max(1, round(probes * len(near)))]
    tables = [w @ q[p] for p, w in zip(_pieces(index.dimensions), index.words, strict=True)]

    @F.pandas_udf("double")
    def summed(cell: pd.Series, code: pd.Series) -> pd.Series:
        if not len(code):
            return pd.Series([], dtype="float64")
        codes = np.frombuffer(b"".join(code), np.uint8).reshape(len(code), -1)
        return pd.Series(near[cell.to_numpy()] + sum(t[codes[:, i]] for i, t in enumerate(tables)))

    own = index.codes if len(cells) == len(near) else index.codes.filter(F.col("cell").isin(cells.tolist()))
    best = own.select("_row", summed("cell", "code").alias("about")).orderBy(F.desc("about"), "_row").limit(n)
    return [r["_row"] for r in best.select("_row").collect()]


def nearest(index: Index, query: Sequence[float], top_n: int = 10, probes: float = PROBES, min_score: float = -2.0, embedding_field: str = "embedding", ranked: int | None = None, exact: bool = False) -> DataFrame:
    """The best rows by the codes of a share of the cells, with their exact scores; ``exact`` scores all rows.

    ``ranked`` vectors are read, so many as the index says if it is not given.
    """
    rows = index.rows
    if not exact:
        rows = rows.filter(F.col("_row").isin(candidates(index, query, ranked or index.ranked(top_n), probes)))
    return search.semantic_search(rows, query, embedding_field, min_score=min_score, top_n=top_n).drop("_row")


def search_or_exact(df: DataFrame, index: Index | None, query: Sequence[float], top_n: int = 10) -> DataFrame:
    """By the index where there is one for vectors of that length, else by exact scores of all rows."""
    if index is not None and index.dimensions == len(query):
        return nearest(index, query, top_n)
    return search.semantic_search(df, query, min_score=-2.0, top_n=top_n)


def recall(df: DataFrame, index: Index, queries: Sequence[Sequence[float]], top_n: int = 10, probes: float = PROBES, ranked: int | None = None) -> float:
    """Share of the exact nearest that the index finds, over some queries."""
    found = total = 0
    for q in queries:
        exact = {r._key for r in search.semantic_search(df, q, min_score=-2.0, top_n=top_n).select("_key").collect()}
        found += len(exact & {r._key for r in nearest(index, q, top_n, probes, ranked=ranked).select("_key").collect()})
        total += len(exact)
    return found / max(1, total)


def share_read(index: Index, top_n: int = 10, probes: float = PROBES, ranked: int | None = None) -> float:
    """Bytes of codes and of vectors that a search takes, to those of all vectors at 4 a component."""
    whole = 4 * index.dimensions
    return (probes * index.n * len(index.words) + (ranked or index.ranked(top_n)) * whole) / max(1, index.n * whole)
