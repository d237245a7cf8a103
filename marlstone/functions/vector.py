"""Vector expressions over arrays of numbers, kept in the JVM."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DIMENSIONS = 1024


def literal(vector: Sequence[float]) -> Column:
    return F.lit([float(x) for x in vector])


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 where either norm is 0."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / F.nullif(size, F.lit(0.0)))


def cosine_to(a: Column, query: Sequence[float]) -> Column:
    """Cosine with a fixed vector, whose norm is known."""
    size = math.sqrt(sum(float(x) ** 2 for x in query))
    own = norm(a)
    return F.when((own == 0) | F.lit(size == 0), 0.0).otherwise(dot(a, literal(query)) / (F.nullif(own, F.lit(0.0)) * F.lit(size or 1.0)))


def negative_l2(a: Column, b: Column) -> Column:
    """Minus the sum of squared differences: larger is nearer."""
    return -F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def present(a: Column) -> Column:
    return a.isNotNull() & (F.size(a) > 0)


def valid(a: Column, dimensions: int = DIMENSIONS) -> Column:
    """A list of the right length without NaN or infinite values."""
    return F.coalesce((F.size(a) == dimensions) & ~F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))), F.lit(False))


def problem(a: Column, dimensions: int = DIMENSIONS) -> Column:
    """Why a vector is not valid; null where it is."""
    return (
        F.when(a.isNull(), "missing embedding")
        .when(F.size(a) != dimensions, F.concat(F.lit("dimension "), F.size(a), F.lit(f" instead of {dimensions}")))
        .when(~valid(a, dimensions), "NaN or infinite value")
    )


def normalized(a: Column) -> Column:
    """Unit length; a zero vector stays."""
    unit = lambda size: F.transform(a, lambda x: F.when(size == 0, x.cast("float")).otherwise((x / F.nullif(size, F.lit(0.0))).cast("float")))
    # the norm is bound once, as the one element of an array
    return F.get(F.transform(F.array(norm(a)), unit), F.lit(0))


def stats(a: Column) -> Column:
    """Least, largest, mean, population deviation and norm, as a struct."""
    n = F.size(a)
    mean = F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double")) / n
    spread = lambda m: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + (x.cast("double") - m) * (x.cast("double") - m)) / n)
    deviation = F.get(F.transform(F.array(mean), spread), F.lit(0))
    return F.struct(F.array_min(a).alias("min"), F.array_max(a).alias("max"), mean.alias("mean"), deviation.alias("std"), norm(a).alias("norm"))


def display(a: Column, items: int = 3, digits: int = 4) -> Column:
    """The first values and how many more there are."""
    shown = F.array_join(F.transform(F.slice(a, 1, items), lambda x: F.format_string(f"%.{digits}f", x.cast("double"))), ", ")
    return F.concat(F.lit("["), shown, F.when(F.size(a) > items, F.concat(F.lit(", ... +"), F.size(a) - items, F.lit(" more"))).otherwise(""), F.lit("]"))


def text_vector(text: str, dimensions: int = DIMENSIONS) -> list[float]:
    """A reproducible stand-in for a model: normal numbers seeded by the text's MD5, of unit length."""
    rng = np.random.RandomState(int(hashlib.md5(text.encode()).hexdigest(), 16) % 2**32)
    v = rng.normal(0, 1, dimensions)
    return (v / np.linalg.norm(v)).tolist()


def _vectors(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([None if t is None else text_vector(t) for t in batch], dtype=object)


def embed(text: Column | str) -> Column:
    """Vectors of texts by ``text_vector``; a null text has none."""
    return F.pandas_udf(_vectors, "array<double>")(text)


def encode(text: Column, encoder: Callable[[Sequence[str]], np.ndarray], prefix: str = "", dimensions: int | None = None) -> Column:
    """Vectors by an injected model, of unit length. ``encoder`` takes a batch of texts and gives a matrix.

    With ``dimensions`` a null text, and each text of a batch that the model
    raises an error for, gets zeros; without it a null text has no vector and
    errors end the task.
    """

    def encoded(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            out: list[list[float] | None] = [None if dimensions is None else [0.0] * dimensions] * len(batch)
            on = [i for i, t in enumerate(batch) if t is not None]
            try:
                m = np.asarray(encoder([prefix + batch.iloc[i] for i in on]), dtype=np.float64) if on else np.empty((0, 1))
            except Exception:
                if dimensions is None:
                    raise
                m, on = np.empty((0, 1)), []
            size = np.linalg.norm(m, axis=1, keepdims=True)
            for i, row in zip(on, m / np.where(size == 0, 1, size), strict=True):
                out[i] = row.tolist()
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(encoded, "array<double>")(text)
