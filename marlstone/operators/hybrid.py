"""Hybrid ranking: reciprocal rank fusion of ranked lists."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marlstone.operators import search, textindex
from marlstone.sources.shared import written

DEFAULT_WEIGHTS = {"bm25": 0.5, "semantic": 0.5}
#: Of a search that also walks the graph, and of fusing three ranked lists.
GRAPH_WEIGHTS = {"bm25": 0.3, "semantic": 0.5, "graph": 0.2}
THREE_WEIGHTS = {"bm25": 0.4, "semantic": 0.4, "graph": 0.2}


def scaled(weights: Mapping[str, float] | None, default: Mapping[str, float] = DEFAULT_WEIGHTS) -> dict[str, float]:
    """Weights that sum to 1; missing ones are 0, and none at all means the default."""
    weights = {k: float((weights or default).get(k, 0.0)) for k in default}
    total = sum(weights.values())
    return {k: w / total for k, w in weights.items()} if total else dict(default)


def ranked(df: DataFrame, score: str = "score") -> DataFrame:
    """(_key, rank) of a short list of candidates by score, then key; of rows with one key the last rank counts."""
    order = Window.orderBy(F.desc(score), F.asc("_key"))
    return df.withColumn("rank", F.row_number().over(order)).groupBy("_key").agg(F.max("rank").alias("rank"))


def fuse(lists: Mapping[str, DataFrame], weights: Mapping[str, float], rrf_k: int = 60) -> DataFrame:
    """(_key, rank of each list, hybrid_score): the sum of weight / (k + rank), best first.

    A key that a list lacks has the rank after its last. Equal scores go by the ranks of the lists in order, then the key.
    """
    sizes = {name: df.agg(F.count("*").alias(f"n_{name}")) for name, df in lists.items()}
    named = [df.select("_key", F.col("rank").alias(f"{name}_rank")) for name, df in lists.items()]
    merged = reduce(lambda a, b: a.join(b, "_key", "full_outer"), named)
    for one_row in sizes.values():
        merged = merged.crossJoin(F.broadcast(one_row))  # a single row
    parts = [F.lit(float(weights[name])) / (F.lit(float(rrf_k)) + F.coalesce(F.col(f"{name}_rank"), F.col(f"n_{name}") + 1)) for name in lists]
    scored = merged.withColumn("hybrid_score", reduce(lambda a, b: a + b, parts))
    return scored.select("_key", *(f"{name}_rank" for name in lists), "hybrid_score")


def fused_order(lists: Sequence[str]) -> list:
    return [F.desc("hybrid_score"), *(F.asc_nulls_last(f"{name}_rank") for name in lists), F.asc("_key")]


def hybrid_search(docs: DataFrame, vectors: DataFrame, query_text: str, query_vector: Sequence[float], filter_expr: str | None = None, tag_list: Sequence[str] | None = None, min_score: Mapping[str, float] | float | None = None, weights: Mapping[str, float] | None = None, top_n: int = 10, initial_k: int = 20, rrf_k: int = 60, require_all_tags: bool = False, search_fields: Sequence[str] = search.FIELDS, graph: DataFrame | None = None, index: textindex.TextIndex | None = None) -> DataFrame:
    """Documents by fused BM25 and semantic (and, given a ranked list of (_key, rank), graph) ranks.

    Tags and filter are applied to the documents first, as a semi-join for the
    vectors. With a stored ``index`` texts are not read; without tags and filter
    its own documents are those that vectors may belong to. The few rows of both
    lists are written, so that ranks and sizes don't compute them again.
    """
    least = min_score if isinstance(min_score, Mapping) else {"bm25": 0.1, "semantic": 0.7} if min_score is None else {"bm25": min_score, "semantic": min_score}
    narrowed = bool(filter_expr or tag_list)
    allowed = search.with_filters(docs, filter_expr, tag_list, require_all_tags)
    if index is not None:
        text = textindex.hits(index, query_text, least.get("bm25", 0.1), initial_k, fields=search_fields, allowed=allowed if narrowed else None)
        known = allowed if narrowed else index.table("documents")
    else:
        text = search.with_filters(search.bm25_scores(docs, query_text, search_fields), filter_expr, tag_list, require_all_tags)
        text = search.page(text.filter(F.col("score") >= least.get("bm25", 0.1)), [F.desc("score"), F.asc("_key")], initial_k)
        known = allowed
    near = search.semantic_search(vectors.join(known.select("_key"), "_key", "left_semi"), query_vector, min_score=least.get("semantic", 0.7), top_n=initial_k)
    lists = {name: written(ranked(df), name) for name, df in (("bm25", text), ("semantic", near))}
    if graph is not None:
        lists["graph"] = graph
    fused = fuse(lists, scaled(weights, GRAPH_WEIGHTS if graph is not None else DEFAULT_WEIGHTS), rrf_k)
    return fused.orderBy(*fused_order(list(lists))).limit(top_n)


def graph_candidates(seeds: DataFrame, related: DataFrame, factor: float = 0.8) -> DataFrame:
    """Seeds (_key, score) with their related vertices (seed, _key, position) at a share of the seed's score, each vertex once at its best place: (_key, rank)."""
    own = seeds.select("_key", F.col("score").alias("s"), F.col("_key").alias("seed"), F.lit(0).alias("position"))
    more = related.join(seeds.select(F.col("_key").alias("seed"), "score"), "seed").select(F.col("_key"), (F.col("score") * factor).alias("s"), "seed", "position")
    block = F.when(F.col("position") == 0, F.lit(0)).otherwise(1)
    best = own.unionByName(more).groupBy("_key").agg(F.max(F.struct("s", (-block).alias("b"), (-F.col("position")).alias("p"))).alias("x"))
    return best.select("_key", F.row_number().over(Window.orderBy(F.desc("x"), F.asc("_key"))).alias("rank"))
