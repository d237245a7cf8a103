"""The stored text index against scans of the texts, with blocks passed over, segments and fuzzy words."""

import random
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.functions.fuzzy import ratio
from marlstone.operators import hybrid, search, textindex
from marlstone.sources import shared

FIELDS = ["title", "content"]


def rows(n, seed=0, first=0):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["stand", "strand", "sand", "Übung", "a" * 40]
    weights = [1 / (i + 1) for i in range(len(words))]
    text = lambda most: " ".join(rnd.choices(words, weights, k=rnd.randint(0, most)))
    return [(str(first + i), rnd.choice([None, "", text(4)]), text(60)) for i in range(n)]


def table(spark, data):
    return spark.createDataFrame(data, "_key string, title string, content string").repartition(5, "_key")


def same(got, want):
    return [(r[0], round(r[1], 9)) for r in got.collect()] == [(r[0], round(r[1], 9)) for r in want.collect()]


@pytest.fixture(scope="module")
def collection(spark):
    return table(spark, rows(3000)).cache()


@pytest.fixture(scope="module")
def index(collection):
    return textindex.build(collection, FIELDS, fuzzy=True)


@pytest.mark.parametrize("query", ["w3 w50 stand", "w0", "Übung a", "nothing here", "", "w7 w7 W7", "a" * 40])
@pytest.mark.parametrize(("top_n", "offset"), [(10, 0), (25, 40), (5000, 1500)])
def test_pages_equal_those_of_a_scan(collection, index, query, top_n, offset):
    assert same(textindex.hits(index, query, top_n=top_n, offset=offset), search.bm25_search(collection, query, FIELDS, top_n=top_n, offset=offset).select("_key", "score"))


def test_ranges_are_passed_over_without_loss(spark, collection, monkeypatch):
    monkeypatch.setattr(textindex, "RANGE_BITS", 3)
    monkeypatch.setattr(textindex, "CHUNK_BITS", 5)
    monkeypatch.setattr(textindex, "BLOCK", 4)
    monkeypatch.setattr(textindex, "FIRST_RANGES", 6)
    # long runs of dull documents with a few good ones
    data = [(f"{i:05d}", None, "stand " * 9 + "w1" if i % 211 == 0 else "w1 " * 30 + ("stand" if i % 3 == 0 else "w2")) for i in range(4000)]
    df = table(spark, data)
    own = textindex.build(df, FIELDS)
    for query in ("stand", "stand w2", "w1"):
        assert same(textindex.hits(own, query), search.bm25_search(df, query, FIELDS).select("_key", "score"))
    assert textindex.scores(own, "stand", best=3).count() < textindex.scores(own, "stand").count() / 4
    assert textindex.total(own, "stand").first()["total"] == search.bm25_total(df, "stand", FIELDS).first()["total"]


def test_fields_boosts_and_allowed_documents(collection, index):
    assert same(textindex.hits(index, "w3 sand", 0.0, 20, fields=["title"]), search.bm25_search(collection, "w3 sand", ["title"], min_score=0.0, top_n=20).select("_key", "score"))
    assert same(textindex.hits(index, "w3 sand", boosts={"title": 3.0}), search.bm25_search(collection, "w3 sand", FIELDS, boosts={"title": 3.0}).select("_key", "score"))
    allowed = collection.filter("_key % 7 = 1")
    assert same(textindex.hits(index, "w3 sand", allowed=allowed), search.bm25_search(collection, "w3 sand", FIELDS, filter_expr="_key % 7 = 1").select("_key", "score"))


def test_segments_are_searched_together(spark, collection, index):
    more = table(spark, rows(400, 9, 10_000))
    both = textindex.extended(index, more)
    assert same(textindex.hits(both, "w3 stand", top_n=50), search.bm25_search(collection.unionByName(more), "w3 stand", FIELDS, top_n=50).select("_key", "score"))
    assert len(index.segments) == 1 and len(both.segments) == 2


@pytest.mark.parametrize(("term", "threshold"), [("Stand", 80.0), ("stand", 97.0), ("strand", 60.0), ("sta", 75.0), ("a" * 39, 95.0), ("w1", 0.0), ("stand w1", 80.0), (" übung ", 90.0)])
def test_keyword_search_equals_that_of_a_scan(collection, index, term, threshold):
    assert same(textindex.keyword_hits(index, term, threshold, 4000, collection), search.keyword_search(collection, term, threshold, 4000).select("_key", "keyword_score"))


@pytest.mark.parametrize("threshold", [70.0, 80.0, 97.0])
def test_words_met_by_deletions_equal_brute_force(spark, threshold):
    rnd = random.Random(int(threshold))
    words = sorted({"".join(rnd.choices("abcde", k=rnd.randint(1, 8))) for _ in range(2500)} | {"b" * 30})
    index = textindex.build(spark.createDataFrame([("1", " ".join(words))], "_key string, content string"), fuzzy=True)
    plain = textindex.TextIndex(spark, index.fields, index.segments, index.buckets)
    for term in ("abcd", "a", "edcba", "bbbbbbbb"):
        want = {w: round(ratio(w, term), 6) for w in words if ratio(w, term) >= threshold - 1e-9}
        for own in (index, plain):
            assert {r["term"]: round(100 * r["ratio"], 6) for r in textindex.near_words(own, term, threshold).collect()} == want


def test_empty_tables_and_changed_sources(spark, tmp_path):
    none = textindex.build(table(spark, []), FIELDS)
    assert textindex.hits(none, "w1").count() == 0 and textindex.keyword_hits(none, "w1").count() == 0 and textindex.total(none, "w1").first()["total"] == 0
    path = str(tmp_path / "docs")
    read = lambda: spark.read.parquet(path)
    spark.createDataFrame([("1", "one")], "_key string, content string").write.parquet(path)
    first = textindex.stored(read(), path)
    assert textindex.stored(read(), path) is first
    shared.delete(spark, first.segments[0])
    assert textindex.stored(read(), path) is not first
    first = textindex.stored(read(), path)
    spark.createDataFrame([("2", "one more")], "_key string, content string").write.mode("append").parquet(path)
    assert textindex.hits(textindex.stored(read(), path), "one", 0.0).count() == 2
    assert {r["_key"] for r in textindex.hits(first, "one", 0.0).collect()} == {"1"}


def test_hybrid_search_by_index(spark, collection, index):
    vectors = spark.createDataFrame([(str(i), [1.0, i / 100]) for i in range(0, 6000, 3)], "_key string, embedding array<double>")
    for extra in ({}, {"filter_expr": "_key % 2 = 0"}):
        by_scan = hybrid.hybrid_search(collection, vectors, "w3 stand", [1.0, 0.5], search_fields=FIELDS, **extra).collect()
        assert hybrid.hybrid_search(collection, vectors, "w3 stand", [1.0, 0.5], search_fields=FIELDS, index=index, **extra).collect() == by_scan


def test_weights_with_a_graph_list():
    assert hybrid.scaled(None, hybrid.GRAPH_WEIGHTS) == {"bm25": 0.3, "semantic": 0.5, "graph": 0.2}
    assert hybrid.scaled(None, hybrid.THREE_WEIGHTS) == {"bm25": 0.4, "semantic": 0.4, "graph": 0.2}


def test_deletions(spark):
    got = spark.sql("SELECT 'abca' AS w").select(textindex.deletions(F.col("w"))).first()[0]
    assert sorted(got) == sorted({"abca", "bca", "aca", "aba", "abc", "ca", "ba", "bc", "aa", "ac", "ab"})
    assert spark.sql("SELECT '' AS w").select(textindex.deletions(F.col("w"))).first()[0] == [""]


@pytest.mark.parametrize("words", [1, 7, 1000])
def test_a_task_gives_blocks_and_never_a_row_for_each_posting(words):
    texts = [(8, ["a", "b", "a"]), (3, []), (5, ["b"] * 9), (70, ["a"]), (6, ["b", "c"])]
    batches = [pa.RecordBatch.from_arrays([pa.array([d for d, _ in part], pa.int64()), pa.array([w for _, w in part], pa.list_(pa.string()))], ["doc", "words0"]) for part in (texts[:3], texts[3:], [])]
    got = [r for b in textindex._blocks_of(["content"], words, 2, 5)(iter(batches)) for r in b.to_pylist()]
    postings = sorted((r["term"], r["first"] + a, tf, n) for r in got if r["term"] for a, tf, n in zip(r["apart"], r["tf"], r["length"], strict=True))
    assert postings == [("a", 8, 2, 3), ("a", 70, 1, 1), ("b", 5, 9, 9), ("b", 6, 1, 2), ("b", 8, 1, 3), ("c", 6, 1, 2)]
    for r in got:
        if r["term"]:
            assert r["n"] == len(r["tf"]) <= 2 and r["last"] == r["first"] + r["apart"][-1] and r["first"] >> 5 == r["last"] >> 5 and r["max_tf"] == max(r["tf"]) and r["min_length"] == min(r["length"])
    assert sum(r["first"] for r in got if r["term"] is None) == 5 and sum(r["words"] for r in got if r["term"] is None) == 15
    if words == 1000:
        assert len([r for r in got if r["term"]]) == 5  # a twice for its chunks, b twice for its three postings, c


@pytest.mark.parametrize("era_bits", [7, 20])
def test_blocks_are_full_over_batches_and_partitions(spark, monkeypatch, era_bits):
    for name, value in {"WORDS": 50, "BLOCK": 8, "CHUNK_BITS": 7, "ERA_BITS": era_bits, "BUCKET_BYTES": 1000}.items():
        monkeypatch.setattr(textindex, name, value)
    data = rows(300, 3)
    own = textindex.build(table(spark, data), FIELDS)
    assert own.buckets > 5
    keys = {r["doc"]: r["_key"] for r in own.table("documents").collect()}
    assert sorted(keys) == list(range(300))  # no gaps between partitions
    blocks = own.table("blocks").select("term", "field", "first", "last", "n", "max_tf", "min_length", *map(textindex._numbers, textindex.LISTS)).collect()
    got, held = {}, Counter()
    for r in blocks:
        assert r["n"] == len(r["apart"]) == len(r["tf"]) == len(r["length"]) <= 8 and r["first"] >> 7 == r["last"] >> 7
        assert r["last"] == r["first"] + r["apart"][-1] and r["max_tf"] == max(r["tf"]) and r["min_length"] == min(r["length"])
        held[r["term"], r["field"], r["first"] >> 7] += 1
        got |= {(r["term"], r["field"], keys[r["first"] + a]): (tf, n) for a, tf, n in zip(r["apart"], r["tf"], r["length"], strict=True)}
    words = {(f, k): (t or "").lower().split() for k, title, content in data for f, t in (("title", title), ("content", content))}
    assert got == {(w, f, k): (n, len(ws)) for (f, k), ws in words.items() for w, n in Counter(ws).items()}
    doc = {k: d for d, k in keys.items()}
    postings = Counter((w, f, doc[k] >> 7) for w, f, k in got)
    assert held == {x: -(-n // 8) for x, n in postings.items()}


def test_blocks_that_interleave_are_joined_in_order():
    texts = [(8, ["a", "b", "a"]), (3, ["é", "a"]), (5, ["b"] * 9), (70, ["a"]), (6, ["b", "c", "a"])]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array([d for d, _ in part], pa.int64()), pa.array([w for _, w in part], pa.list_(pa.string()))], ["doc", "words0"])
    packed = [r for part in (texts[::2], texts[1::2]) for b in textindex._packed(textindex._blocks_of(["content"], 1000, 2, 5), 1, 20)(iter([batch(part)])) for r in b.to_pylist()]
    assert sum(r["rows"] for r in packed if r["blocks"] is None) == 5 and sum(r["words"] for r in packed if r["blocks"] is None) == 18
    joined = textindex._joined(2, 5)(pa.Table.from_pylist([r for r in packed if r["blocks"] is not None])).to_pylist()
    ints = lambda b: [int.from_bytes(b[i : i + 4], "little") for i in range(0, len(b), 4)]
    assert [(r["term"], [r["first"] + a for a in ints(r["apart"])], ints(r["tf"]), ints(r["length"])) for r in joined] == [
        ("a", [3, 6], [1, 1], [2, 3]), ("a", [8], [2], [3]), ("a", [70], [1], [1]), ("b", [5, 6], [9, 1], [9, 3]), ("b", [8], [1], [3]), ("c", [6], [1], [3]), ("é", [3], [1], [2]),
    ]
