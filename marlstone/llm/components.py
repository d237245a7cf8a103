"""Connected components of a graph of links: of a table by alternating large and small stars, of arrays by least labels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.common import materialize, release


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """The component of every node that has a link: (node, root), root being the least node.

    Each round links the larger neighbours of a node to its least neighbour, then
    the smaller ones too, until each component is a star around its least node.
    Rounds grow with the logarithm of the longest chain. Links stay in tables; no
    round gathers a node's neighbours. Nulls and links of a node to itself are left out.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    edges = materialize(edges, "links")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u AND v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "large-star")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        smaller = materialize(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "small-star")
        release(edges, large)
        edges = smaller
        before, state = state, _state(edges)
        if state == before:
            break
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _state(edges: DataFrame) -> tuple:
    """Count and checksum of the links, to see whether a round changed them."""
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels, each the least place of its set, after the sets of a and b are joined."""
    while True:
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (deeper := label[label]).tobytes() != label.tobytes():
            label = deeper
