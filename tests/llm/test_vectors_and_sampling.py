"""Resampling, whitening and top-k search against brute force, with edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from marlstone.llm import resampling, top_k, whitening

INF, NAN = float("inf"), float("nan")
TEXTS = "doc_id long, text string, rank string, _row int"  # the last two clash with names inside
ODD_TEXTS = [(1, None, "x", 1), (None, "", "x", 1), (3, " \t\n-", "x", 1), (4, "tie " * 30, "x", 1), (4, "tie " * 30, "x", 1), (5, "w" * 200_000, "x", 1), (6, "A b " * 40_000, "x", 1), (None, "é日 x" * 50, None, None)]
VECTORS = "vec_id long, embedding array<double>, x string"
ODD_VECTORS = [(0, [1.0, 2.0], "a"), (0, [1.0, 2.0], "a"), (2, None, "a"), (3, [1.0, NAN], "a"), (4, [INF, 1.0], "a"), (5, [1.0, None], "a"), (6, [3.0], "a"), (None, [3.0, 4.0], None), (7, [1e300, 1.0], "x"), (8, [], "x"), (40, [-1.0, -5e4], "x"), (41, [1e6, -5.0], "x")]


# ---- resampling


def expected(docs, target, runs=1, percent=10, least=20):
    def found(text):
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        return [zlib.crc32(" ".join(words[i : i + n]).encode()) % 10000 for n in range(1, runs + 1) for i in range(len(words) - n + 1)], len(words)

    own = [(k, *found(t)) for k, t in docs]
    s, t = Counter(b for _, f, _ in own for b in f), Counter(b for x in target for b in found(x)[0])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000))))
    rows = []
    for k, f, words in own:
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'null' if k is None else k}".encode()).hexdigest()[:8], 16)
        rows.append([k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, words])
    drawn = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for place, r in enumerate(drawn[: percent * len(drawn) // 100]):
        r[4] = place + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize(("runs", "percent"), [(1, 10), (3, 50), (2, 100)])
def test_resampling_equals_brute_force(spark, runs, percent):
    rnd = random.Random(runs)
    words = [f"w{i}" for i in range(300)]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 60)))) for i in range(-150, 250)]
    docs += [(7, docs[157][1])] * 40  # a key of many rows, at whatever side of the cut
    target = [" ".join(rnd.choices(words[:40], k=30)) for _ in range(20)]
    out = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(t,) for t in target], "text string"), runs=runs, percent=percent)
    assert sorted((tuple(r) for r in out.collect()), key=repr) == expected(docs, target, runs, percent)


def test_resampling_of_odd_rows_and_empty_tables(spark):
    docs = spark.createDataFrame(ODD_TEXTS, TEXTS)
    target = docs.limit(2).select("text")
    out = resampling.resample(docs, target, keep=["rank", "_row"], percent=50)
    assert out.columns == ["rank", "_row", "n_features", "weight", "score", "rank"]
    assert out.count() == len(ODD_TEXTS)
    own = resampling.resample(docs, target, percent=50)
    assert sorted((tuple(r) for r in own.collect()), key=repr) == expected([(r[0], r[1]) for r in ODD_TEXTS], [r[1] for r in ODD_TEXTS[:2]], percent=50)
    assert resampling.resample(docs.limit(0), target).collect() == []
    assert resampling.resample(docs, docs.limit(0)).filter("rank IS NOT NULL").count() == 0


@pytest.mark.parametrize("k", [0, 1, 2, 3, 50, 333, 998, 999, 1000, 2000])
def test_radix_selection_takes_exactly_k_rows(spark, k):
    rnd = random.Random(5)
    rows = [(rnd.choice([-(2**63), -5, -4, 0, 7, 2**62, 2**63 - 1]), rnd.randint(-3, 3), i) for i in range(1000)]
    df = spark.createDataFrame(rows, "a long, b long, c long")
    assert sorted(map(tuple, df.filter(resampling.smallest(df, ["a", "b", "c"], k)).collect())) == sorted(rows)[:k]


def test_ranks_follow_the_order(spark):
    df = spark.range(0, 1000, 1, 7).select((F.col("id") * 7919 % 1000).alias("v"))
    assert all(r["rank"] == r["v"] + 1 for r in resampling.ranked(df, [F.col("v")]).collect())


# ---- whitening


def test_whitening_equals_a_dense_solution(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(400, 9)) @ np.diag([5, 4, 3, 2, 1, 1, 1, 0.5, 0.1])
    m = np.concatenate([m, m[:150], np.repeat(m[:1], 200, axis=0)])  # copies count once
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>").repartition(5)
    out = {(r["vec_id"], r["component"]): r for r in whitening.whiten(df).collect()}
    x = np.floor(256 * m).astype(np.int64)
    different = np.unique(x, axis=0)
    n, sums = len(different), different.sum(axis=0)
    centred = different - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    assert len(out) == 4 * len(m)
    for c in range(1, 5):
        v = vectors[:, -c] / np.sqrt(values[-c])
        own, want = np.array([out[i, c]["whitened"] for i in range(len(m))]), (x - sums / n) @ v
        assert np.allclose(own, want if np.dot(own, want) > 0 else -want, atol=1e-9)
        assert out[0, c]["explained"] == pytest.approx(values[-c] / values.sum(), rel=1e-9)
    assert all(r["deviation"] == int(((n * x[i] - sums) ** 2).sum()) and r["n"] == n and r["identity_error"] < 1e-9 for (i, _), r in out.items())


def test_whitening_of_odd_rows_and_empty_tables(spark):
    df = spark.createDataFrame(ODD_VECTORS, VECTORS)
    out = whitening.whiten(df, ["vec_id", "x"]).collect()
    assert sorted((r["vec_id"] for r in out if r["component"] == 1), key=repr) == sorted([0, 0, None, 40, 41], key=repr)
    assert whitening.whiten(df.limit(0)).collect() == []
    same = whitening.whiten(df.filter("vec_id = 0")).collect()
    assert [(r["n"], r["deviation"], r["whitened"], r["explained"]) for r in same] == [(1, 0, None, None)] * 4
    assert whitening.whiten(df.filter("vec_id = 2")).collect() == []


def test_deviations_are_exact_or_null_beyond_a_long(spark):
    rows = [(i, [float(2**22 * (i % 2)), 1.0 * i]) for i in range(2000)]
    out = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).filter("component = 1").collect()
    x = np.array([[256 * int(v) for v in r[1]] for r in rows], dtype=object)
    sums = x.sum(axis=0)
    for r in out:
        want = int(((2000 * x[r["vec_id"]] - sums) ** 2).sum())
        assert r["deviation"] == (want if want < 2**63 else None)
    assert {r["deviation"] is None for r in out} == {True}


# ---- top-k search


def nearest(rows, k):
    x = np.array([[math.floor(64 * c) for c in v] for _, v in rows])
    out = []
    for i, (q, _) in enumerate(rows):
        if q % 20 == 0:
            best = sorted((j for j in range(len(rows)) if j != i), key=lambda j: (-int(x[i] @ x[j]), rows[j][0], j))[:k]
            out += [(q, place + 1, rows[j][0], int(x[i] @ x[j])) for place, j in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize(("rows", "dims", "scale", "lists", "k"), [(2500, 8, 1.0, 2, 20), (2500, 7, 1.0, 3, 5), (600, 1, 40.0, 4, 20), (15, 6, 1.0, 2, 20), (900, 16, 1e5, 2, 20)])
def test_top_k_equals_brute_force(spark, rows, dims, scale, lists, k):
    rng = np.random.default_rng(rows)
    m = (rng.normal(size=(rows, dims)) * scale).tolist()
    table = [(i, m[i % 7] if i % 3 == 0 else m[i]) for i in range(rows)]  # a third of the rows are copies of seven: ties
    df = spark.createDataFrame(table, "vec_id long, embedding array<double>").repartition(6)
    out = top_k.top_k(df, F.col("vec_id") % 20 == 0, k, lists=lists)
    assert sorted(map(tuple, out.collect())) == nearest(table, k)


def test_top_k_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(top_k, "QUERY_ROWS", 11)
    monkeypatch.setattr(top_k, "CANDIDATE_ROWS", 70)
    rng = np.random.default_rng(1)
    table = [(i, rng.normal(size=4).tolist()) for i in range(700)]
    out = top_k.top_k(spark.createDataFrame(table, "vec_id long, embedding array<double>"), F.col("vec_id") % 20 == 0)
    assert sorted(map(tuple, out.collect())) == nearest(table, 20)


def test_top_k_of_odd_rows_and_empty_tables(spark):
    df = spark.createDataFrame(ODD_VECTORS, VECTORS)
    asks = F.col("vec_id") % 20 == 0
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in top_k.top_k(df, asks).collect()) == [(0, 1, 41), (0, 1, 41), (0, 2, 0), (0, 2, 0), (0, 3, 40), (0, 3, 40), (40, 1, 0), (40, 2, 0), (40, 3, 41)]
    for none in (df.limit(0), df.filter("vec_id = 2"), df.filter("vec_id = 41")):
        assert top_k.top_k(none, asks).collect() == []
