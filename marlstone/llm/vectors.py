"""Vectors as whole numbers: the rows of a table whose components are floored after scaling."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def length_of(df: DataFrame, vector_col: str) -> int:
    """The most frequent length of the vectors that are there, the smaller of two; 0 where there is none."""
    row = df.filter(F.col(vector_col).isNotNull()).groupBy(F.size(vector_col).alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    return row["n"] if row else 0


def floored(vector: Column, scale: int) -> Column:
    """Each component times ``scale``, rounded down to a long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale))


def usable(vector: Column, length: int, scale: int) -> Column:
    """Whether a vector takes part: it has the table's length and only finite components, none so large that an inner product of two such vectors could leave a long."""
    most = math.sqrt(2.0**62 / max(1, length)) / scale
    return F.coalesce((F.size(vector) == length) & F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < most)), F.lit(False))
