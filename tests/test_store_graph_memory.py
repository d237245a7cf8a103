import random

import pytest
from pyspark.sql import functions as F

from marlstone.operators import graph, memory, store


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([("1", "Doc 1", "A", 10), ("2", "Doc 2", "B", 20), ("3", "Doc 3", "A", 30), ("4", "Doc 4", "C", 40), ("5", "Doc 5", "B", 50)], "_key string, name string, category string, value int").cache()


def test_queries(items):
    assert store.query(items, "category = 'A'").count() == 2 and store.query(items, "value > 25").count() == 3
    assert [r.value for r in store.query(items, None, [F.desc("value")], 3).collect()] == [50, 40, 30]
    assert store.get(items, "3").first().name == "Doc 3" and store.get(items, "9").count() == 0


def test_upsert_update_delete(spark, items):
    new = spark.createDataFrame([("1", None, 11), ("9", "Doc 9", 90), ("9", "Doc 9", 90)], "_key string, name string, value int")
    after = {r["_key"]: (r.name, r.category, r.value) for r in store.upsert(items, new).collect()}
    assert after["1"] == ("Doc 1", "A", 11) and after["9"] == ("Doc 9", None, 90) and len(after) == 6
    assert "9" not in {r["_key"] for r in store.update(items, new).collect()}
    assert store.delete(items, new).count() == 4
    replaced = {r["_key"]: r for r in store.upsert(items, new, replace=True).collect()}
    assert replaced["1"].name is None and replaced["1"].category == "A"


def test_bulk_import(spark, items):
    new = items.filter("_key = '1'").unionByName(spark.createDataFrame([("7", "x", "Z", 1)], items.schema))
    with pytest.raises(ValueError):
        store.bulk_import(items, new)
    assert store.bulk_import(items, new, "ignore").count() == 6 and store.bulk_import(items, new, "replace").count() == 6
    assert store.bulk_import(items.limit(0), new).count() == 2


def test_registry_and_revision(spark, items):
    registry = store.Registry(spark).bootstrap()
    assert registry.collections["messages"].count() == 0 and "glossary" in registry.collections
    registry.put("items", items)
    assert not registry.truncate(["items"]) and registry.collections["items"].count() == 5
    assert registry.truncate(["items"], force=True) and registry.collections["items"].count() == 0
    assert store.revision(items).select("_rev").distinct().count() == 5


def test_embedding_checks(spark):
    df = spark.createDataFrame([("1", "text", None), ("2", None, [3.0, 4.0]), ("3", None, None)], "_key string, content string, embedding array<double>")
    rows = {r["_key"]: r for r in store.with_embedding(df, generate=False, dimensions=2).collect()}
    assert [round(x, 6) for x in rows["2"].embedding] == [0.6, 0.8] and rows["1"].embedding_error == "missing embedding"
    made = {r["_key"]: r for r in store.with_embedding(df.filter("_key <> '2'")).collect()}
    assert len(made["1"].embedding) == 1024 and made["3"].embedding is None


@pytest.fixture(scope="module")
def chain(spark):
    return spark.createDataFrame([("e1", "d/root", "d/one", "LINK"), ("e2", "d/one", "d/two", "LINK"), ("e3", "d/two", "d/root", "BACK")], "_key string, _from string, _to string, type string").cache()


def start(spark, v="d/root"):
    return spark.createDataFrame([(v,)], "_id string")


def test_traversal(spark, chain):
    assert [r.vertex for r in graph.traverse(chain, start(spark)).collect()] == ["d/one"]
    assert sorted(r.vertex for r in graph.traverse(chain, start(spark), 1, 2).collect()) == ["d/one", "d/two"]
    round_trip = graph.traverse(chain, start(spark), 0, 5).collect()
    assert sorted((r.depth, r.vertex) for r in round_trip) == [(0, "d/root"), (1, "d/one"), (2, "d/two"), (3, "d/root")]
    assert graph.traverse(chain, start(spark), 2, 1).count() == 0 and graph.traverse(chain, start(spark), 1, 1, "UP").count() == 0
    assert [r.vertex for r in graph.traverse(chain, start(spark), 1, 1, "INBOUND").collect()] == ["d/two"]
    assert sorted(r.vertex for r in graph.traverse(chain, start(spark), 1, 3, "ANY", "global").collect()) == ["d/one", "d/two"]


def test_deep_walks_equal_brute_force(spark):
    rnd = random.Random(8)
    links = [(f"e{i}", f"d/{rnd.randint(0, 3) if i % 4 == 0 else rnd.randint(0, 60)}", f"d/{rnd.randint(0, 60)}", "LINK") for i in range(110)]  # four hubs
    edges = spark.createDataFrame(links, "_key string, _from string, _to string, type string")
    starts = ["d/0", "d/17", "d/99"]
    near = {}
    for s in starts:
        depth, level = {s: 0}, [s]
        for k in range(1, 7):
            level = sorted({b for _, a, b, _ in links if a in level} - set(depth))
            depth |= dict.fromkeys(level, k)
        near |= {(s, v): k for v, k in depth.items()}
    df = spark.createDataFrame([(s,) for s in starts], "_id string")
    assert {(r.start, r.vertex): r.depth for r in graph.traverse(edges, df, 0, 6, unique="global").collect()} == near

    def walks(v, used):
        yield tuple(used)
        if len(used) < 4:
            for key, a, b, _ in links:
                if a == v and key not in used:
                    yield from walks(b, [*used, key])

    one = spark.createDataFrame([("d/17",)], "_id string")
    assert sorted(tuple(r.edges) for r in graph.traverse(edges, one, 0, 4).collect()) == sorted(walks("d/17", []))
    assert graph.traverse(edges, one.limit(0), 0, 9).collect() == []


def test_hubs_are_dealt_out_and_paths_rebuilt_from_parents(spark, monkeypatch):
    monkeypatch.setattr(graph, "HUB", 4)
    rnd = random.Random(3)
    links = [(f"e{i:03}", f"d/{rnd.choice([0, 1, rnd.randint(0, 40)])}", f"d/{rnd.randint(0, 40)}", "LINK") for i in range(150)]
    edges = spark.createDataFrame(links, "_key string, _from string, _to string, type string")
    steps, hubs = graph.dealt(graph.oriented(edges, "ANY"))
    degree = {}
    for _, a, b, _ in links:
        for v in (a, b):
            degree[v] = degree.get(v, 0) + 1
    assert {r.src: r.parts for r in hubs.collect()} == {v: -(-n // 4) for v, n in degree.items() if n > 4}
    assert steps.count() == 300 and steps.select("src", "part").distinct().count() > len(degree) + 20
    ends = {key: (a, b) for key, a, b, _ in links}
    for direction in ("OUTBOUND", "ANY"):
        rows = graph.traverse(edges, start(spark, "d/7"), 0, 5, direction, "global").collect()
        near, level = {"d/7": 0}, {"d/7"}
        for k in range(1, 6):
            level = ({b for _, a, b, _ in links if a in level} | {a for _, a, b, _ in links if b in level and direction == "ANY"}) - set(near)
            near |= dict.fromkeys(level, k)
        assert {r.vertex: r.depth for r in rows} == near and len(rows) == len(near)
        for r in rows:
            assert len(r.edges) == r.depth and len(r.vertices) == r.depth + 1 and r.vertices[0] == "d/7" and r.vertices[-1] == r.vertex
            assert (r.edges[-1] if r.edges else None) == r.edge
            for a, b, key in zip(r.vertices, r.vertices[1:], r.edges, strict=False):
                assert (a, b) == ends[key] or (direction == "ANY" and (b, a) == ends[key])
    whole = graph.traverse(edges, start(spark, "d/7"), 1, 3).count()
    monkeypatch.setattr(graph, "HUB", 1000)
    assert graph.traverse(edges, start(spark, "d/7"), 1, 3).count() == whole
    assert graph.reached(edges, start(spark), 1, 2, "UP").count() == 0 and graph.reached(edges, start(spark), 3, 2).count() == 0


def test_edges(spark, chain):
    assert graph.relationships(chain, "d/root").count() == 2 and graph.relationships(chain, "d/root", "LINK", "OUTBOUND").count() == 1
    assert graph.without_vertex(chain, "d/root").count() == 1 and graph.without_edge(chain, "e1").count() == 2
    assert graph.graph_rag(chain, start(spark), 3, types=["BACK"]).count() == 1
    docs = spark.createDataFrame([("d/one", "One")], "_id string, name string")
    assert [r.name for r in graph.documents_for(chain, docs, "d/one").collect()] == [None]
    assert graph.documents_for(chain, docs, "d/root", "d").first().name == "One"
    objects = spark.createDataFrame([("malware--1", "malware", None, None, None), ("relationship--1", "relationship", "malware--1", "tool--2", "uses"), ("relationship--2", "relationship", None, "tool--2", "uses")], "id string, type string, source_ref string, target_ref string, relationship_type string")
    vertices, links = graph.stix_graph(objects)
    assert vertices.first()["_id"] == "malware/malware--1" and links.count() == 1


def test_memory(spark):
    turns = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "q" * 80), (1, 2, "assistant", "a" * 80), (1, 3, "user", "last"), (2, 0, "user", "x"), (2, 1, "assistant", "y")], "conv_id long, turn long, role string, text string")
    memories = {r["_key"]: r for r in memory.memories(turns).collect()}
    assert set(memories) == {"1-1", "2-0"} and memories["2-0"].content == "User: x\nAgent: y" and memories["2-0"].summary == "x y"
    assert len(memories["1-1"].summary) == 100 and memories["1-1"].summary.endswith("...")
    edges = memory.memory_edges(turns).collect()
    assert ("messages/2-1", "messages/2-0", "RESPONSE_TO") in [tuple(e) for e in edges] and len(edges) == 6
    messages = memory.messages(turns)
    assert [r["_key"] for r in memory.conversation_messages(messages, "1", "turn", "DESC", 2).collect()] == ["1-3", "1-2"]
    assert [r["_key"] for r in memory.conversation_messages(messages, "1", "turn", "odd").collect()] == ["1-0", "1-1", "1-2", "1-3"]
    kept, _, gone = memory.without_conversation(messages, spark.createDataFrame([], "_key string, _from string, _to string"), "1")
    assert kept.count() == 2 and gone.first().deleted == 4
    with pytest.raises(ValueError):
        memory.conversation_messages(messages, "1", "content")
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0])], "_key string, embedding array<double>")
    close = memory.similarity_edges(vectors.filter("_key = 'a'"), vectors).collect()
    assert [(e["_to"], e.type) for e in close] == [("b", "strong_similar")]


def test_similarity_edges_in_many_blocks_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(memory, "ASKED", 7)
    monkeypatch.setattr(memory, "KNOWN", 20)
    rnd = random.Random(4)
    rows = [(f"v{i}", [rnd.gauss(0, 1) for _ in range(3 if i % 10 else 2)]) for i in range(90)]
    rows += [("copy", rows[1][1]), ("zero", [0.0, 0.0, 0.0]), ("none", None), ("gap", [1.0, None, 2.0]), ("v3", rows[5][1])]  # a key that comes twice
    df = spark.createDataFrame(rows, "_key string, embedding array<double>")
    asked = df.filter("_key IN ('zero', 'copy', 'none', 'gap') OR substring(_key, 2) % 3 = 0")
    want = set()
    names = {r["_key"] for r in asked.collect()}
    usable = [(k, v) for k, v in rows if v is not None and None not in v]
    for k in names:
        near = []
        for mine, v in usable:
            for other, w in usable:
                if mine == k and other != k and len(v) == len(w) and any(v) and any(w):
                    score = sum(x * y for x, y in zip(v, w, strict=True)) / (sum(x * x for x in v) * sum(x * x for x in w)) ** 0.5
                    near.append((-round(score, 12), other))
        near = sorted(x for x in near if -x[0] > 0.3)[:4]
        want |= {(k, other, round(-score, 9)) for score, other in near}
    got = memory.similarity_edges(asked, df, 0.3, 0.9, 4).collect()
    assert {(e["_from"], e["_to"], round(e.score, 9)) for e in got} == want
    assert memory.similarity_edges(asked.limit(0), df).count() == 0 and memory.similarity_edges(asked, df.limit(0)).count() == 0
