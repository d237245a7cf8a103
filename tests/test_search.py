import math

import pytest
from pyspark.sql import functions as F

from marlstone.functions import fuzzy, vector
from marlstone.operators import hybrid, search

DOCS = [
    ("1", "Python Error Handling", "This document covers Python error handling using try/except blocks.", ["python", "error", "programming"]),
    ("2", "JavaScript Promises", "Learn about JavaScript promises and async/await syntax.", ["javascript", "programming", "async"]),
    ("3", "Python Generators", "Understanding Python generators and yield statements.", ["python", "programming", "advanced"]),
    ("4", "Graph Tutorial", "Getting started with a graph store and the Python driver.", ["database", "graph", "python"]),
    ("5", None, None, None),
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(DOCS, "_key string, title string, content string, tags array<string>").cache()


def keys(df):
    return [r["_key"] for r in df.collect()]


def test_bm25_finds_any_term_in_any_field(docs):
    rows = search.bm25_search(docs, "python", min_score=0.0).collect()
    assert {r["_key"] for r in rows} == {"1", "3", "4"}
    assert any("Python" in r.title for r in rows)
    assert [r.score for r in rows] == sorted((r.score for r in rows), reverse=True)


def test_bm25_score_by_hand(docs):
    n, df, lengths = 5, 2, [3, 2, 2, 2, 0]
    row = search.bm25_scores(docs, "error", ["title"]).collect()
    idf = math.log(1 + (n - 1 + 0.5) / (1 + 0.5))
    expected = idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * 3 / (sum(lengths) / n)))
    assert [(r["_key"], round(r.score, 9)) for r in row] == [("1", round(expected, 9))] and df == 2


def test_bm25_filters_pages_and_edge_cases(docs):
    assert set(keys(search.bm25_search(docs, "programming", tag_list=["python"], min_score=0.0))) == {"1", "3"}
    every = keys(search.bm25_search(docs, "python programming", min_score=0.0))
    assert keys(search.bm25_search(docs, "python programming", min_score=0.0, top_n=2, offset=1)) == every[1:3]
    assert keys(search.bm25_search(docs, "")) == [] and keys(search.bm25_search(docs, "absent")) == []
    assert keys(search.bm25_search(docs.limit(0), "python")) == []
    assert search.bm25_total(docs, "python", min_score=0.0).first().total == 3


def test_view_gives_the_same_scores(docs):
    direct = {r["_key"]: round(r.score, 9) for r in search.bm25_scores(docs, "python error").collect()}
    view = {r["_key"]: round(r.score, 9) for r in search.search_view(*search.build_view(docs), "python error").collect()}
    assert direct == view


def test_tags(docs):
    assert keys(search.tag_search(docs, ["python", "advanced"], require_all_tags=True)) == ["3"]
    rows = search.tag_search(docs, ["python", "ASYNC"]).collect()
    assert [r["_key"] for r in rows] == ["1", "3", "4"] and rows[0].tag_match_score == 0.5
    assert "2" in keys(search.tag_search(docs, ["async"]))


def test_keyword(docs):
    rows = {r["_key"]: r.keyword_score for r in search.keyword_search(docs, "generators").collect()}
    assert rows == {"3": 1.0}
    assert search.keyword_search(docs, "generator", 90).first()["_key"] == "3"
    with pytest.raises(ValueError):
        search.keyword_search(docs, "  ")


def test_fuzzy_ratio():
    assert fuzzy.ratio("abcd", "abcd") == 100 and fuzzy.ratio("", "") == 100 and fuzzy.ratio("ab", "xy") == 0
    assert abs(fuzzy.ratio("kitten", "sitting") - 100 * 2 * 4 / 13) < 1e-9


def test_vectors(spark):
    rows = [("a", [1.0, 0.0]), ("b", [1.0, 1.0]), ("c", [0.0, 0.0]), ("d", [1.0]), ("e", None)]
    df = spark.createDataFrame(rows, "_key string, embedding array<double>")
    assert keys(search.semantic_search(df, [1.0, 0.0], min_score=0.5)) == ["a", "b"]
    assert keys(search.semantic_search(df, [1.0, 0.0], min_score=-10, metric="l2")) == ["a", "b", "c"]
    checked = {r["_key"]: r.p for r in df.select("_key", vector.problem(F.col("embedding"), 2).alias("p")).collect()}
    assert checked["a"] is None and checked["d"].startswith("dimension") and checked["e"] == "missing embedding"
    unit = df.select(vector.norm(vector.normalized(F.col("embedding"))).alias("n")).collect()
    assert [None if r.n is None else round(r.n, 6) for r in unit] == [1.0, 1.0, 0.0, 1.0, None]


def test_embedder_is_reproducible(spark):
    a, b = (r.v for r in spark.createDataFrame([("x",), ("x",)], "t string").select(vector.embed("t").alias("v")).collect())
    assert a == b and len(a) == 1024 and abs(sum(x * x for x in a) - 1) < 1e-9


def test_fusion_ranks_missing_keys_after_the_list(spark):
    one = spark.createDataFrame([("a", 1), ("b", 2)], "_key string, rank int")
    two = spark.createDataFrame([("b", 1), ("c", 2)], "_key string, rank int")
    got = hybrid.fuse({"bm25": one, "semantic": two}, {"bm25": 0.5, "semantic": 0.5}).orderBy(*hybrid.fused_order(["bm25", "semantic"])).collect()
    assert [r["_key"] for r in got] == ["b", "a", "c"]
    assert abs(got[1].hybrid_score - (0.5 / 61 + 0.5 / 63)) < 1e-12
    assert hybrid.scaled({"bm25": 0, "semantic": 0}) == hybrid.DEFAULT_WEIGHTS
