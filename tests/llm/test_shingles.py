"""Near-duplicates by shingles, against brute force."""

import random

import corpus_pipeline
import numpy as np
import pytest

from marlstone.llm import shingles, simhash_dedup


def brute_clusters(texts):
    words = [(t or "").lower().split() for t in texts]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in words]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            either = len(sets[i] | sets[j])
            if root[i] != root[j] and (not either or len(sets[i] & sets[j]) >= 0.8 * either):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return set(root)


@pytest.mark.parametrize("cell", [simhash_dedup.CELL_BYTES, 2000])
def test_stage_drops_edited_copies(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash_dedup, "CELL_BYTES", cell)
    rnd = random.Random(11)
    texts = [None, "", "One", "one two"]
    for _ in range(60):
        words = [f"w{rnd.randint(0, 3000)}" for _ in range(rnd.randint(40, 300))]
        texts.append(" ".join(words))
        for _ in range(3):
            copy = list(words)
            for _ in range(rnd.randint(1, max(1, len(words) // 35))):
                copy[rnd.randrange(len(copy))] = "edit"
            texts.append(" ".join(copy))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()}
    assert kept == brute_clusters(texts)


def test_edge_cases(spark):
    rows = [(1, None, 1), (None, "", 1), (4, "tie tie", 1), (4, "tie tie", 1), (5, "a b c d " * 20_000, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _ROW int")
    dedup = lambda table: simhash_dedup.deduplicate(table, shingle=5, similarity=0.8)
    kept = dedup(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect()), key=repr) == sorted([rows[0], rows[2], rows[4]], key=repr)
    assert dedup(df.limit(0)).count() == 0


def test_clusters_join_by_chains():
    rnd = random.Random(12)
    for _ in range(60):
        base = [set(rnd.sample(range(60), 20)) for _ in range(3)]
        sets = []
        for _ in range(30):
            one = set(rnd.choice(base))
            for _ in range(rnd.randint(0, 4)):
                one ^= {rnd.randrange(60)}
            sets.append(one if rnd.random() < 0.95 else set())
        want = list(range(len(sets)))
        for i in range(len(sets)):
            for j in range(i):
                if want[i] != want[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                    a, b = sorted((want[i], want[j]))
                    want = [a if w == b else w for w in want]
        got = shingles.clusters([np.array(sorted(s), dtype=np.uint64) for s in sets], 0.8)
        assert got.tolist() == want
