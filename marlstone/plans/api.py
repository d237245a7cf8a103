"""Named operations over a registry of collections, with checked arguments: what a service or command line calls."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.functions import text, vector
from marlstone.operators import chunk, glossary, graph, hybrid, memory, search, store

#: Least and largest values of numeric arguments.
LIMITS = {"limit": (1, 1000), "top_n": (1, 1000), "max_depth": (1, 10), "min_depth": (0, 10), "similarity_threshold": (0, 100), "offset": (0, None)}
HANDLERS: dict[str, Callable[..., DataFrame]] = {}


def handler(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    HANDLERS[f.__name__] = f
    return f


def checked(params: Mapping[str, Any]) -> dict[str, Any]:
    """Arguments within their limits; ValueError names the first that is not."""
    for name, value in params.items():
        low, high = LIMITS.get(name, (None, None))
        if low is not None and (value < low or high is not None and value > high):
            raise ValueError(f"{name} is not within {low} and {high}")
        if name == "weights" and any(not 0 <= w <= 1 for w in value.values()):
            raise ValueError("weights lie between 0 and 1")
        if name == "tag_operator" and value not in ("AND", "OR"):
            raise ValueError("tag_operator is AND or OR")
    return dict(params)


def handle(registry: store.Registry, operation: str, **params: Any) -> DataFrame:
    """Run a named operation; an unknown one raises ValueError."""
    if operation not in HANDLERS:
        raise ValueError(f"unknown operation {operation}; there are {sorted(HANDLERS)}")
    return HANDLERS[operation](registry, **checked(params))


def envelope(results: DataFrame, query: str, engine: str, total: DataFrame | None = None) -> dict[str, Any]:
    """Results, a lazy total, the query and what answered it."""
    return {"results": results, "total": total if total is not None else results.agg(F.count("*").alias("total")), "query": query, "search_engine": engine}


@handler
def bm25(registry: store.Registry, collection: str, query: str, **kw: Any) -> DataFrame:
    return search.bm25_search(registry.collections[collection], query, **kw)


@handler
def semantic(registry: store.Registry, collection: str, query: str | list[float], **kw: Any) -> DataFrame:
    return search.semantic_search(registry.collections[collection], vector.text_vector(query) if isinstance(query, str) else query, **kw)


@handler
def hybrid_search(registry: store.Registry, collection: str, vectors: str, query: str, **kw: Any) -> DataFrame:
    return hybrid.hybrid_search(registry.collections[collection], registry.collections[vectors], query, vector.text_vector(query), **kw)


@handler
def tags(registry: store.Registry, collection: str, tags: list[str], tag_operator: str = "OR", **kw: Any) -> DataFrame:
    return search.tag_search(registry.collections[collection], tags, require_all_tags=tag_operator == "AND", **kw)


@handler
def keyword(registry: store.Registry, collection: str, term: str, **kw: Any) -> DataFrame:
    return search.keyword_search(registry.collections[collection], term, **kw)


@handler
def glossary_list(registry: store.Registry, collection: str = "glossary") -> DataFrame:
    return glossary.terms_in_order(registry.collections[collection])


@handler
def glossary_add(registry: store.Registry, term: str, definition: str, collection: str = "glossary") -> DataFrame:
    return registry.put(collection, glossary.add_terms(registry.collections[collection], registry.spark.createDataFrame([(term, definition)], "term string, definition string")))


@handler
def document_get(registry: store.Registry, collection: str, key: str) -> DataFrame:
    return store.get(registry.collections[collection], key)


@handler
def document_query(registry: store.Registry, collection: str, filter_expr: str | None = None, limit: int = 100, offset: int = 0) -> DataFrame:
    return store.query(registry.collections[collection], filter_expr, [F.asc("_key")], limit, offset)


@handler
def document_create(registry: store.Registry, collection: str, documents: DataFrame) -> DataFrame:
    return registry.put(collection, store.insert(registry.collections[collection], store.keyed(documents, collection)))


@handler
def document_update(registry: store.Registry, collection: str, documents: DataFrame) -> DataFrame:
    return registry.put(collection, store.update(registry.collections[collection], documents))


@handler
def document_delete(registry: store.Registry, collection: str, key: str) -> DataFrame:
    return registry.put(collection, registry.collections[collection].filter(F.col("_key") != key))


@handler
def related(registry: store.Registry, edges: str, vertex: str, collection: str | None = None, direction: str = "OUTBOUND", max_depth: int = 1) -> DataFrame:
    return graph.related_documents(registry.collections[edges], registry.spark.createDataFrame([(vertex,)], "_id string"), collection, direction, max_depth)


@handler
def traverse(registry: store.Registry, edges: str, vertex: str, min_depth: int = 1, max_depth: int = 1, direction: str = "OUTBOUND") -> DataFrame:
    return graph.traverse(registry.collections[edges], registry.spark.createDataFrame([(vertex,)], "_id string"), min_depth, max_depth, direction)


@handler
def conversation_get(registry: store.Registry, conversation_id: str, collection: str = "messages", limit: int | None = None) -> DataFrame:
    return memory.conversation_messages(registry.collections[collection], conversation_id, limit=limit)


@handler
def conversation_delete(registry: store.Registry, conversation_id: str, collection: str = "messages", edges: str = "relationships") -> DataFrame:
    kept, rest, gone = memory.without_conversation(registry.collections[collection], registry.collections[edges], conversation_id, collection)
    registry.put(collection, kept)
    registry.put(edges, rest)
    return gone


@handler
def lessons(registry: store.Registry, collection: str, query: str | list[float], top_k: int = 3) -> DataFrame:
    """The lessons nearest to a question."""
    return search.semantic_search(registry.collections[collection], vector.text_vector(query) if isinstance(query, str) else query, min_score=-2.0, top_n=top_k)


@handler
def edge_create(registry: store.Registry, edges: str, source: str, target: str, kind: str, rationale: str = "") -> DataFrame:
    pair = registry.spark.createDataFrame([(source, target)], "_from string, _to string")
    return registry.put(edges, store.insert(registry.collections[edges], graph.new_edges(pair, kind, rationale)))


@handler
def edge_delete(registry: store.Registry, edges: str, key: str) -> DataFrame:
    return registry.put(edges, graph.without_edge(registry.collections[edges], key))


@handler
def repository_info(registry: store.Registry, collection: str) -> DataFrame:
    """Per kind of file of a repository (path, content): files, bytes and tokens."""
    files = registry.collections[collection].withColumn("kind", text.extension(F.col("path")))
    return chunk.digest(files, "kind")


def as_json(results: DataFrame) -> DataFrame:
    """Each row as one JSON text, as a service answers."""
    return results.select(F.to_json(F.struct(*results.columns)).alias("row"))
