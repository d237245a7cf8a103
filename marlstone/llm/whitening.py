"""Whitening of embeddings: the leading components of their covariance, each scaled to variance one.

Components are floored after scaling by 256, so that sums are whole numbers and
exact. A first pass over the different vectors sums them; a second one sums
outer products of what is left after the mean, one matrix product for each
batch. Matrices of tasks are merged in a tree, the symmetric eigenproblem is
solved once, and its leading vectors go out to project all rows. What the driver
holds is square in the length of a vector and does not grow with the rows.

Rows: vectors that are null, hold null or not finite components or have another
length than most are left out, as are those with components beyond about 2 ** 31
/ (256 * sqrt(length)). Repeated vectors count once in the statistics and have
rows of their own in the result. An empty table gives no rows. A direction
without variance has null as whitened value. Ties of eigenvalues are broken by
the solver. A deviation that a long can't hold is null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import materialize
from marlstone.llm.vectors import floored, length_of, usable

SCALE, COMPONENTS = 256, 4


@dataclass(frozen=True)
class Model:
    """What whitening learns: the count of different vectors, their sums, projections (a column each, scaled), shares of the variance, and how far the whitened covariance is from the identity."""

    n: int
    sums: list[int]
    projection: np.ndarray
    explained: list[float | None]
    identity_error: float | None


def _matrix(batch: pa.RecordBatch | pa.ChunkedArray, length: int) -> np.ndarray:
    return batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def _merged(rows: DataFrame, length: int, of_batch: Callable[[np.ndarray], Sequence[np.ndarray]], merge: Callable[[Sequence[np.ndarray], Sequence[np.ndarray]], Sequence[np.ndarray]]) -> list[np.ndarray] | None:
    """Arrays made of each batch of vectors, merged within tasks and then in a tree; None without rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                own = of_batch(_matrix(batch, length))
                total = own if total is None else merge(total, own)
        if total is not None:
            yield pa.RecordBatch.from_pydict({"parts": pa.array([[a.astype(np.float64 if a.dtype.kind == "f" else np.int64).tobytes() for a in total]], pa.list_(pa.binary())), "kinds": pa.array([[a.dtype.char for a in total]])})

    def arrays(row) -> list[np.ndarray]:
        # sums of whole numbers go on in Python's, which have no bound
        return [np.frombuffer(p, np.float64) if k == "d" else np.frombuffer(p, np.int64).astype(object) for p, k in zip(row["parts"], row["kinds"], strict=True)]

    sent = rows.mapInArrow(partial, "parts array<binary>, kinds array<string>").rdd
    both = lambda a, b: b if a is None else a if b is None else merge(a, b)
    return sent.treeAggregate(None, lambda total, row: both(total, arrays(row)), both)


def _add(a: Sequence[np.ndarray], b: Sequence[np.ndarray]) -> list[np.ndarray]:
    return [x + y for x, y in zip(a, b, strict=True)]


def _moments(x: np.ndarray) -> list[np.ndarray]:
    """Rows, mean and centred products of a batch."""
    mean = x.mean(axis=0)
    return [np.array([float(len(x))]), mean, ((x - mean).T @ (x - mean)).ravel()]


def _joined_moments(a: Sequence[np.ndarray], b: Sequence[np.ndarray]) -> list[np.ndarray]:
    """Moments of two batches together: products stay centred on their common mean."""
    n, apart = a[0] + b[0], b[1] - a[1]
    return [n, a[1] + apart * (b[0] / n), a[2] + b[2] + np.outer(apart, apart).ravel() * (a[0] * b[0] / n)]


def fit(different: DataFrame, length: int, components: int = COMPONENTS) -> Model | None:
    """The model of a table of different whole-number vectors ``x``; None without rows."""
    # sums of one task have too few rows to leave a long
    found = _merged(different, length, lambda x: [np.array([len(x)]), x.sum(axis=0)], _add)
    if found is None:
        return None
    n, sums = int(found[0][0]), [int(s) for s in found[1]]
    mean = np.array([s / n for s in sums])

    def products(x: np.ndarray) -> list[np.ndarray]:
        centred = x - mean
        return [(centred.T @ centred).ravel()]

    covariance = _merged(different, length, products, _add)[0].reshape(length, length) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    trace = float(np.trace(covariance))
    # below this an eigenvalue is rounding
    flat = values[order] <= np.finfo(float).eps * length * max(values.max(), 0.0)
    scale = np.where(flat, np.nan, 1 / np.sqrt(np.where(flat, 1.0, values[order])))
    projection = vectors[:, order] * scale
    steep = ~flat
    error = None
    if steep.any():
        own = projection[:, steep]
        rows, _, moments = _merged(different, length, lambda x: _moments((x - mean) @ own), _joined_moments)
        error = float(np.abs(moments.reshape(own.shape[1], -1) / rows[0] - np.eye(own.shape[1])).max())
    return Model(n, sums, projection, [float(v) / trace if trace > 0 else None for v in np.maximum(values[order], 0.0)], error)


def _projected(x: Column, model: Model) -> Column:
    """Per vector its exact deviation and whitened components."""
    n, sums, projection = model.n, model.sums, model.projection
    mean = np.array([s / n for s in sums])
    largest = max(map(abs, sums), default=0)

    @F.pandas_udf("deviation long, whitened array<double>")
    def project(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                yield pd.DataFrame({"deviation": pd.Series([], dtype="Int64"), "whitened": []})
                continue
            m = np.stack(batch.to_numpy()).astype(np.int64)
            # numbers of 64 bits where they surely do, else Python's
            small = (n * int(np.abs(m).max(initial=0)) + largest) ** 2 * m.shape[1] < 2**63
            apart = (m if small else m.astype(object)) * n - np.array(sums, dtype=np.int64 if small else object)
            deviation = [int(d) if d < 2**63 else None for d in (apart * apart).sum(axis=1)]
            yield pd.DataFrame({"deviation": pd.array(deviation, dtype="Int64"), "whitened": list((m - mean) @ projection)})

    return project(x)


def whiten(df: DataFrame, keep: Sequence[str] = ("vec_id",), vector_col: str = "embedding", components: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """A row for each usable vector and component: the columns ``keep``, component, n, deviation, whitened, explained, identity_error.

    One shuffle finds the different vectors, copies being merged before it; all else are passes over them or over ``df``.
    """
    inside = [f"_keep{i}" for i in range(len(keep))]
    length = length_of(df, vector_col)
    good = df.filter(usable(F.col(vector_col), length, scale)).select(*(F.col(c).alias(i) for c, i in zip(keep, inside, strict=True)), floored(F.col(vector_col), scale).alias("x"))
    model = fit(materialize(good.select("x").distinct(), "vectors"), length, components) if length else None
    if model is None:
        projected, shares, n, error = F.struct(F.lit(None).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened")), [], 0, None
    else:
        projected, shares, n, error = _projected(F.col("x"), model), model.explained, model.n, model.identity_error
    rows = good.withColumn("_p", projected).select(*inside, F.col("_p.deviation").alias("deviation"), F.posexplode("_p.whitened"))
    explained = F.get(F.lit(shares).cast("array<double>") if shares else F.array().cast("array<double>"), F.col("pos"))
    return rows.select(
        *(F.col(i).alias(c) for c, i in zip(keep, inside, strict=True)), (F.col("pos") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.nanvl("col", F.lit(None).cast("double")).alias("whitened"), explained.alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
