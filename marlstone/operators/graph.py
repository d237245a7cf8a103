"""Traversal and edges of graphs given as DataFrames of vertices (_id) and edges (_key, _from, _to, ...)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions.text import collection_of
from marlstone.sources.shared import bucketed, written

DIRECTIONS = ("OUTBOUND", "INBOUND", "ANY")


@dataclass(frozen=True)
class GraphDef:
    """A named graph: its edges and the collections that they join."""

    name: str
    edges: DataFrame
    from_collections: Sequence[str]
    to_collections: Sequence[str]

    def checked(self) -> DataFrame:
        """The edges whose ends lie in the collections that the graph joins."""
        return self.edges.filter(collection_of(F.col("_from")).isin(list(self.from_collections)) & collection_of(F.col("_to")).isin(list(self.to_collections)))


def oriented(edges: DataFrame, direction: str) -> DataFrame:
    """Edges as steps: (src, dst, edge), in the direction asked for."""
    out = edges.select(F.col("_from").alias("src"), F.col("_to").alias("dst"), F.col("_key").alias("edge"))
    back = edges.select(F.col("_to").alias("src"), F.col("_from").alias("dst"), F.col("_key").alias("edge"))
    return {"OUTBOUND": out, "INBOUND": back, "ANY": out.unionByName(back)}[direction.upper()]


#: Edges of a vertex that meet its walks in one task; a vertex with more is dealt out in parts.
HUB = 100_000


def dealt(steps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Steps with a part (0 but for vertices of over HUB steps), and those vertices with the number of their parts (src, parts)."""
    hubs = steps.groupBy("src").agg(F.count("*").alias("n")).filter(F.col("n") > HUB).select("src", F.ceil(F.col("n") / HUB).cast("int").alias("parts"))
    hubs = written(hubs, "hubs")
    # hubs are at most one of HUB steps, and all but a few graphs have none: the join sends what the planner finds small
    own = steps.join(hubs, "src", "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("edge", "dst"), F.col("parts")).cast("int"), F.lit(0)))
    # each step of a walk joins by these keys: the steps are shuffled here and not again
    return bucketed(own.select("src", "part", "dst", "edge"), "steps", "src", "part"), hubs


def stepped(frontier: DataFrame, steps: DataFrame, hubs: DataFrame | None = None) -> DataFrame:
    """``frontier`` joined with the steps from its ``vertex``; walks that stand on a hub meet each of its parts."""
    if hubs is None:
        return frontier.join(steps, F.col("vertex") == F.col("src"))
    parts = frontier.join(hubs, F.col("vertex") == F.col("src"), "left").drop("src")
    parts = parts.withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    return parts.join(steps, (F.col("vertex") == F.col("src")) & (F.col("_part") == F.col("part"))).drop("_part", "part")


def levels(edges: DataFrame, starts: DataFrame, max_depth: int, direction: str = "OUTBOUND") -> list[DataFrame]:
    """Breadth first, a vertex once for a start: for each depth from 0 on what is new there, (start, vertex, edge, parent, depth).

    A level holds no paths, only the vertex before and the least edge to it, so a
    row has the same size at any depth. Candidates are aggregated before they are
    shuffled. Walks of more than two steps write the steps, dealt out at hubs, and
    each level, and end where a level is empty.
    """
    none = F.lit(None).cast("string")
    found = [starts.select(F.col("_id").alias("start"), F.col("_id").alias("vertex"), none.alias("edge"), none.alias("parent"), F.lit(0).alias("depth")).distinct()]
    steps, hubs = oriented(edges, direction), None
    deep = max_depth > 2
    if deep:
        steps, hubs = dealt(steps)
    for depth in range(1, max_depth + 1):
        reached = stepped(found[-1].select("start", "vertex"), steps, hubs).groupBy("start", "dst").agg(F.min(F.struct("edge", "vertex")).alias("by"))
        new = reached.select("start", F.col("dst").alias("vertex"), "by.edge", F.col("by.vertex").alias("parent"), F.lit(depth).alias("depth"))
        known = reduce(DataFrame.unionByName, (level.select("start", "vertex") for level in found))
        new = new.join(known, ["start", "vertex"], "left_anti")
        if deep:
            new = written(new, "level")
            if new.isEmpty():
                break
        found.append(new)
    return found


def reached(edges: DataFrame, starts: DataFrame, min_depth: int = 1, max_depth: int = 1, direction: str = "OUTBOUND") -> DataFrame:
    """Vertices that can be reached from those of ``starts``, once for a start at their least depth: (start, vertex, edge, parent, depth).

    A direction or range that makes no sense gives no rows.
    """
    if direction.upper() not in DIRECTIONS or not 0 <= min_depth <= max_depth:
        return levels(edges, starts.limit(0), 0, "ANY")[0]
    found = levels(edges, starts, max_depth, direction)
    return reduce(DataFrame.unionByName, found[min_depth:], found[0].limit(0))


def with_paths(found: DataFrame, tree: Sequence[DataFrame]) -> DataFrame:
    """``found``, rows of the levels in ``tree``, with vertices and edges of their paths, walked back along the parents level by level."""
    empty = F.array().cast("array<string>")
    own = F.when(F.col("edge").isNull(), empty).otherwise(F.array("edge"))
    out = found.withColumn("vertices", F.array("vertex")).withColumn("edges", own).withColumn("_at", F.col("parent"))
    for level in reversed(tree[:-1]):
        before = level.select("start", F.col("vertex").alias("_at"), F.col("edge").alias("_edge"), F.col("parent").alias("_parent"), F.lit(True).alias("_on"))
        # a path has one vertex of each level above its own, so rows that are not below this level match nothing
        out = out.join(before, ["start", "_at"], "left").select(
            *found.columns,
            F.when(F.col("_on"), F.concat(F.array("_at"), "vertices")).otherwise(F.col("vertices")).alias("vertices"),
            F.when(F.col("_on") & F.col("_edge").isNotNull(), F.concat(F.array("_edge"), "edges")).otherwise(F.col("edges")).alias("edges"),
            F.when(F.col("_on"), F.col("_parent")).otherwise(F.col("_at")).alias("_at"),
        )
    return out.drop("_at")


def traverse(edges: DataFrame, starts: DataFrame, min_depth: int = 1, max_depth: int = 1, direction: str = "OUTBOUND", unique: str = "path") -> DataFrame:
    """Walks from the vertices of ``starts`` (_id): (start, vertex, edge, depth, vertices, edges).

    One join per step on the frontier's vertex; walks of more than two steps write
    each frontier and end where there is none. ``unique``: an edge once on a
    path ("path", the default of graph query languages), or a vertex once for a
    start at its least depth ("global", breadth first, by ``levels``; of several
    last edges the least, whose path is rebuilt from parents). Depth 0 is the start
    itself with a null edge. A direction or range that makes no sense gives no rows.
    """
    sense = direction.upper() in DIRECTIONS and 0 <= min_depth <= max_depth
    paths = starts.select(
        F.col("_id").alias("start"), F.col("_id").alias("vertex"), F.lit(None).cast("string").alias("edge"), F.lit(0).alias("depth"),
        F.array("_id").alias("vertices"), F.array().cast("array<string>").alias("edges"),
    )
    if not sense:
        return paths.limit(0)
    if unique == "global":
        tree = levels(edges, starts, max_depth, direction)
        return with_paths(reduce(DataFrame.unionByName, tree[min_depth:], tree[0].limit(0)), tree).select(paths.columns)
    steps, hubs = oriented(edges, direction), None
    deep = max_depth > 2
    if deep:
        steps, hubs = dealt(steps)
    out = paths
    for depth in range(1, max_depth + 1):
        walked = stepped(paths.drop("edge", "depth"), steps, hubs).filter(~F.array_contains("edges", F.col("edge")))
        paths = walked.select("start", F.col("dst").alias("vertex"), "edge", F.lit(depth).alias("depth"), F.concat("vertices", F.array("dst")).alias("vertices"), F.concat("edges", F.array("edge")).alias("edges"))
        if deep and depth < max_depth:
            # a level starts from what the one before it wrote, not from the start
            paths = written(paths, "frontier")
            if paths.isEmpty():
                break
        out = out.unionByName(paths)
    return out.filter(F.col("depth") >= min_depth)


def relationships(edges: DataFrame, vertex: str, relationship_type: str | None = None, direction: str = "ANY") -> DataFrame:
    """The edges at a vertex."""
    out, into = F.col("_from") == vertex, F.col("_to") == vertex
    found = edges.filter({"OUTBOUND": out, "INBOUND": into}.get(direction.upper(), out | into))
    return found if relationship_type is None else found.filter(F.col("type") == relationship_type)


def related_documents(edges: DataFrame, vertex: DataFrame, collection: str | None = None, direction: str = "OUTBOUND", max_depth: int = 1) -> DataFrame:
    """Vertices within ``max_depth`` steps of those in ``vertex`` (_id), each once at its least depth, of one collection where it is given."""
    direction = direction if direction.upper() in DIRECTIONS else "OUTBOUND"
    found = reached(edges, vertex, 1, max_depth, direction)
    return found if collection is None else found.filter(collection_of(F.col("vertex")) == collection)


def graph_rag(edges: DataFrame, seeds: DataFrame, max_depth: int = 3, direction: str = "ANY", types: Sequence[str] | None = None, per_seed: int | None = 100) -> DataFrame:
    """For each seed (_id) its related vertices, breadth first and each once: (seed, vertex, edge, depth, position).

    At most ``per_seed`` of a seed are shown, all of them where it is None. Types filter what is shown by its last edge, not the walk.
    """
    found = reached(edges, seeds, 1, max_depth, direction)
    if types:
        found = found.join(edges.filter(F.col("type").isin(list(types))).select(F.col("_key").alias("edge")), "edge", "left_semi")
    place = Window.partitionBy("start").orderBy("depth", "vertex")
    shown = found.withColumn("position", F.row_number().over(place))
    if per_seed is not None:
        shown = shown.filter(F.col("position") <= per_seed)
    return shown.select(F.col("start").alias("seed"), "vertex", "edge", "depth", "position")


def related_stats(related: DataFrame, seeds: DataFrame) -> DataFrame:
    """One row: seeds, and the sum, largest and mean number of vertices related to one."""
    counts = related.groupBy(F.col("seed").alias("_id")).agg(F.count("*").alias("n"))
    every = seeds.select("_id").join(counts, "_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return every.agg(F.count("*").alias("seeds"), F.sum("n").alias("related"), F.max("n").alias("most"), F.avg("n").alias("mean"))


def documents_for(edges: DataFrame, docs: DataFrame, vertex: Column | str, collection: str | None = None) -> DataFrame:
    """Documents that a vertex's edges lead to; one that is missing gives a null row unless a collection is asked for."""
    own = edges.filter(F.col("_from") == vertex)
    if collection is not None:
        own = own.filter(collection_of(F.col("_to")) == collection)
    found = own.select(F.col("_key").alias("edge"), F.col("_to").alias("_id")).join(docs, "_id", "left" if collection is None else "inner")
    return found


def messages_for(edges: DataFrame, messages: DataFrame, document: str, collection: str = "messages") -> DataFrame:
    """Messages whose edges lead to a document."""
    own = edges.filter((F.col("_to") == document) & (collection_of(F.col("_from")) == collection))
    return own.select(F.col("_key").alias("edge"), F.col("_from").alias("_id")).join(messages, "_id", "left")


def new_edges(pairs: DataFrame, kind: str, rationale: str = "") -> DataFrame:
    """Edge rows for pairs (_from, _to), keyed by their content, so that a job that runs again makes the same rows."""
    key = F.substring(F.sha2(F.concat_ws("|", "_from", "_to", F.lit(kind)), 256), 1, 32)
    return pairs.select(key.alias("_key"), "_from", "_to", F.lit(kind).alias("type"), F.lit(rationale).alias("rationale"))


def without_edge(edges: DataFrame, key: str) -> DataFrame:
    return edges.filter(F.col("_key") != key)


def without_edges_between(edges: DataFrame, source: str, target: str) -> DataFrame:
    return edges.filter(~((F.col("_from") == source) & (F.col("_to") == target)))


def without_vertex(edges: DataFrame, vertex: str) -> DataFrame:
    return edges.filter((F.col("_from") != vertex) & (F.col("_to") != vertex))


def insert_checked(edges: DataFrame, incoming: DataFrame, vertices: DataFrame) -> DataFrame:
    """``edges`` with those incoming ones whose ends both exist and whose key is new."""
    ids = vertices.select("_id")
    good = incoming.join(ids.withColumnRenamed("_id", "_from"), "_from", "left_semi").join(ids.withColumnRenamed("_id", "_to"), "_to", "left_semi")
    return edges.unionByName(good.join(edges.select("_key"), "_key", "left_anti"), allowMissingColumns=True)


def stix_graph(objects: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges of STIX objects (id, type, source_ref, target_ref, relationship_type); incomplete ones are left out."""
    ident = lambda c: F.concat_ws("/", F.split_part(c, F.lit("--"), F.lit(1)), c)
    vertices = objects.filter("id IS NOT NULL AND type <> 'relationship'").select(ident(F.col("id")).alias("_id"), "type")
    complete = objects.filter("type = 'relationship' AND source_ref IS NOT NULL AND target_ref IS NOT NULL")
    return vertices, complete.select(F.col("id").alias("_key"), ident(F.col("source_ref")).alias("_from"), ident(F.col("target_ref")).alias("_to"), F.col("relationship_type").alias("type"))


def around(edges: DataFrame, start: str, min_depth: int = 1, max_depth: int = 1, direction: str = "ANY", limit: int = 10) -> DataFrame:
    """A page of the walks from one vertex, nearer ones first."""
    one = edges.sparkSession.createDataFrame([(start,)], "_id string")
    return traverse(edges, one, min_depth, max_depth, direction).orderBy("depth", "vertex", "edge").limit(limit)


def link(edges: DataFrame, pairs: DataFrame, kind: str = "relates_to", **properties: float | str) -> DataFrame:
    """``edges`` with new ones for pairs (_from, _to), which may have properties."""
    new = new_edges(pairs, kind)
    for name, value in properties.items():
        new = new.withColumn(name, F.lit(value))
    return edges.unionByName(new, allowMissingColumns=True)


def documents_within(edges: DataFrame, docs: DataFrame, vertex: str, max_depth: int = 1, relationship_type: str | None = None) -> DataFrame:
    """Documents that edges (of one type, where it is given) lead to in ``max_depth`` steps at most: (edge, depth, and the document)."""
    own = edges if relationship_type is None else edges.filter(F.col("type") == relationship_type)
    one = edges.sparkSession.createDataFrame([(vertex,)], "_id string")
    return reached(own, one, 1, max_depth, "OUTBOUND").select("edge", "depth", F.col("vertex").alias("_id")).join(docs, "_id")
