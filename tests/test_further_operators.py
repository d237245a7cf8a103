"""Index, keyword search, similarity, table chains, retries and nested texts, against results worked out by hand or by brute force."""

import os
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.functions.fuzzy import ratio
from marlstone.operators import batch, extract, glossary, graph, ivf, memory, search, store, tables
from marlstone.sources import files


def test_index_recall_and_fallback(spark):
    rng = np.random.default_rng(3)
    points = rng.normal(size=(3000, 32))
    df = spark.createDataFrame([(str(i), p.tolist()) for i, p in enumerate(points)], "_key string, embedding array<double>").cache()
    index = ivf.build(df)
    assert index.n == index.rows.count() == index.codes.count() == 3000 and 40 < len(index.centroids) < 70
    queries = points[::300].tolist()
    assert ivf.recall(df, index, queries) >= 0.9 and ivf.share_read(index) <= 0.3
    nearest = [r._key for r in ivf.nearest(index, queries[1], exact=True).collect()]
    assert nearest == [r._key for r in search.semantic_search(df, queries[1], min_score=-2.0).collect()]
    exact = [r._key for r in search.semantic_search(df, queries[0], min_score=-2.0).collect()]
    assert [r._key for r in ivf.search_or_exact(df, None, queries[0]).collect()] == exact
    assert ivf.build(df.limit(2)) is None and len(ivf.build(df.limit(3)).centroids) <= 3 and ivf.build(df, lists=5).n == 3000 and ivf.search_or_exact(df, index, [1.0, 2.0]).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables here")
def test_index_of_the_given_vectors_reads_a_tenth(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").withColumn("_key", F.col("vec_id").cast("string"))
    index = ivf.build(df)
    queries = [r.embedding for r in df.filter("vec_id % 100 = 0").select("embedding").collect()]
    assert ivf.recall(df, index, queries) >= 0.9 and ivf.share_read(index) < 0.1


def test_keyword_search_equals_brute_force(spark):
    rnd = random.Random(4)
    words = ["stand", "strand", "stands", "sand", "understand", "island", "other", "É"]
    rows = [(str(i), " ".join(rnd.choices(words, k=rnd.randint(0, 4))), rnd.choice([None, "a Stand here", "no"])) for i in range(80)]
    got = {r._key: round(r.keyword_score, 6) for r in search.keyword_search(spark.createDataFrame(rows, "_key string, title string, content string"), " Stand ", 75.0, 100).collect()}
    want = {}
    for key, title, content in rows:
        ws = [w for t in (title, content) for w in re.findall(r"\w+", (t or "").lower())]
        best = 1.0 if "stand" in ws else max((ratio(w, "stand") / 100 for w in ws), default=0)
        if best >= 0.75:
            want[key] = round(best, 6)
    assert got == want


def test_similarity_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(memory, "ASKED", 7)
    monkeypatch.setattr(memory, "KNOWN", 16)
    rng = np.random.default_rng(5)
    points = rng.normal(size=(60, 8))
    points[50:] = points[:10]  # ties
    rows = [(f"m{i:02d}", p.tolist()) for i, p in enumerate(points)] + [("none", None), ("short", [1.0])]
    df = spark.createDataFrame(rows, "_key string, embedding array<double>")
    got = {(r._from, r._to) for r in memory.similarity_edges(df, df, 0.2, 0.9, 3).collect()}
    unit = points / np.linalg.norm(points, axis=1)[:, None]
    scores, want = np.round(unit @ unit.T, 12), set()
    for i in range(60):
        near = sorted((j for j in range(60) if j != i and scores[i, j] > 0.2), key=lambda j: (-scores[i, j], f"m{j:02d}"))[:3]
        want |= {(f"m{i:02d}", f"m{j:02d}") for j in near}
    assert got == want


def test_related_vertices_come_once(spark):
    edges = spark.createDataFrame([("e1", "a/1", "b/1"), ("e2", "a/1", "b/2"), ("e3", "b/1", "c/1"), ("e4", "b/2", "c/1")], "_key string, _from string, _to string")
    found = graph.related_documents(edges, spark.createDataFrame([("a/1",)], "_id string"), max_depth=3).collect()
    assert sorted((r.vertex, r.depth) for r in found) == [("b/1", 1), ("b/2", 1), ("c/1", 2)]


def test_table_chains(spark):
    schema = "doc string, page int, number int, header array<string>, body array<array<string>>"
    head = ["Part", "Qty"]
    rows = [("d", 1, 1, head, [["a", "1"]]), ("d", 2, 2, ["QTY", "part"], [["b", "2"]]), ("d", 4, 3, head, [["c", "3"]]), ("d", 4, 4, ["x", "y"], []), ("d", 9, 5, head, [["e", "5"]])]
    df = spark.createDataFrame(rows, schema)
    got = {tuple(r.numbers): (r.first_page, r.last_page, r.source, len(r.body)) for r in tables.merge_chain(df).collect()}
    assert got == {(1, 2): (1, 2, "extracted", 2), (3,): (4, 4, "extracted", 1), (4,): (4, 4, "extracted", 0), (5,): (9, 9, "extracted", 1)}
    told = spark.createDataFrame([("d", 5, 3), ("d", 8, 1)], "doc string, source int, target int")
    got = {tuple(r.numbers): r.source for r in tables.merge_chain(df, told).collect()}
    assert got == {(1, 2): "extracted", (3, 5): "human_merged", (4,): "extracted"}
    assert tables.merge_chain(df.limit(0)).count() == 0


def test_retries_and_backoff(spark):
    def call(messages):
        if messages[0]["content"] == "broken":
            raise RuntimeError("no line")
        return "{}" if len(messages) > 1 else "words"

    tasks = spark.createDataFrame([(1, "ask"), (2, "broken"), (3, None)], "task_id long, question string")
    got = {r.task_id: (r.status, r.result, r.retry_count) for r in batch.call_with_retries(tasks, call, [batch.validator("json")]).collect()}
    assert got == {1: ("success", "{}", 1), 2: ("error", "Max retries (3) exceeded.", 3), 3: ("success", "{}", 1)}
    waited = []

    def never():
        raise batch.ServiceError(503)

    with pytest.raises(batch.ServiceError):
        batch.with_backoff(never, 4, sleep=waited.append)
    assert waited == [1.0, 2.0, 4.0] and batch.delays(6) == [1.0, 2.0, 4.0, 8.0, 10.0]


def test_nested_json_and_nodes(spark):
    df = spark.createDataFrame([('{"the_title": {"part_one": 1, "list": [1, "x"]}}',), ("no",), (None,)], "j string")
    got = [r.m for r in df.select(files.json_markdown(F.col("j")).alias("m")).collect()]
    assert got == ["# The Title\n\n## Part One\n\n1\n\n## List\n\n- 1\n\n- x\n\n", None, None]
    text = spark.createDataFrame([(1, "# A\n## B\nx\n# C\n### D\ny")], "id long, t string")
    nodes = {r.content: r.parent for r in extract.nodes(extract.blocks(text, "id", "t")).collect()}
    assert nodes == {"A": None, "B": 0, "x": 1, "C": None, "D": 3, "y": 4}


def test_unique_terms_and_required_documents(spark):
    terms = spark.createDataFrame([("a", "x"), ("a", "y")], "term string, definition string")
    with pytest.raises(ValueError):
        glossary.create(spark, terms)
    with pytest.raises(KeyError):
        store.required(spark.createDataFrame([("1",)], "_key string"), "2")
