"""The operators that compare texts or learn from a corpus, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash

from marlstone.llm import components, decontamination, pii, quality_classifier, simhash_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, fp int, root string, cover string"
EDGES = [(1, None, 1, "x", "y"), (None, "", 1, "x", "y"), (None, "z" * 100_000, 1, "x", "y"), (4, "tie tie", 1, "x", "y"), (4, "tie tie", 1, "x", "y"), (5, "a b c d " * 20_000, None, None, None)]


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame(EDGES, SCHEMA).cache()


def frame(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


# ---- components


def test_components(spark):
    rnd = random.Random(1)
    links = [(i, i + 1) for i in range(0, 40)] + [(rnd.randint(100, 130), rnd.randint(100, 130)) for _ in range(20)] + [(500, i) for i in range(501, 520)] + [(7, 7)]
    parent = {x: x for ab in links for x in ab}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[x] == root(x) for x in got) and {x for a, b in links if a != b for x in (a, b)} == set(got)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- SimHash


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_equals_brute_force(spark, edges):
    rnd = random.Random(2)
    texts = [None, "", "One", "one", "İ É É", "a b", "A B c"]
    base = [[f"w{rnd.randint(0, 400)}" for _ in range(rnd.randint(5, 120))] for _ in range(25)]
    for words in base:
        for _ in range(rnd.randint(1, 5)):
            copy = list(words)
            copy[rnd.randrange(len(copy))] = "edit"
            texts.append(" ".join(copy))
    fps = [brute_fingerprint(t) for t in texts]
    parent = list(range(len(texts)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3 and root(i) != root(j):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    rows = simhash_dedup.near_duplicates(frame(spark, texts)).collect()
    assert all(r.fingerprint == f"{fps[r.doc_id]:016x}" and r.component_id == root(r.doc_id) for r in rows) and len(rows) == len(texts)
    kept = sorted(r.doc_id for r in simhash_dedup.deduplicate(frame(spark, texts)).collect())
    assert kept == sorted({root(i) for i in range(len(texts))})
    assert simhash_dedup.near_duplicates(edges).count() == len(EDGES) and simhash_dedup.near_duplicates(edges.limit(0)).count() == 0
    once = simhash_dedup.deduplicate(edges)
    assert once.columns == edges.columns and sorted(once.collect(), key=repr) == sorted(set(once.collect()), key=repr)


@pytest.mark.parametrize("radius", [0, 1, 3, 4])
def test_bit_sliced_links(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    near = base[rng.integers(0, 40, 1500)]
    for _ in range(4):
        near ^= np.uint64(1) << rng.integers(0, 64, len(near)).astype(np.uint64)
    fps = np.unique(np.concatenate((base, near)))
    buckets = np.sort(rng.integers(0, 6, len(fps)))
    a, b = simhash_dedup.links_of(buckets, fps, radius)
    where = {int(v): i for i, v in enumerate(fps)}
    got = simhash_dedup.unite(np.arange(len(fps)), np.array([where[int(v)] for v in a], int), np.array([where[int(v)] for v in b], int))
    want = np.arange(len(fps))
    for i in range(len(fps)):
        hits = np.flatnonzero((np.bitwise_count(fps ^ fps[i]) <= radius) & (buckets == buckets[i]))
        want = simhash_dedup.unite(want, np.full(len(hits), i), hits)
    assert (got == want).all()


def test_large_buckets_are_cut_to_cells(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "CELL", 8)
    rng = np.random.default_rng(9)
    fps = np.unique(np.concatenate([np.uint64(1 << 40) ^ (np.uint64(1) << rng.integers(0, 30, 80).astype(np.uint64)) for _ in range(1)] + [rng.integers(0, 2**62, 20, dtype=np.uint64)]))
    df = spark.createDataFrame([(int(v),) for v in fps.view(np.int64)], "fp long")
    got = {r.node: r.root for r in components.connected_components(simhash_dedup.links(df, 2)).collect()}
    near = [int(v) for v in fps if bin(int(v) ^ (1 << 40)).count("1") == 1]
    assert len({got[v] for v in near}) == 1


# ---- decontamination


def test_edit_distance():
    rnd = random.Random(3)
    for _ in range(200):
        a, b = (bytes(rnd.choices(b"abc", k=rnd.randint(1, 14))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert decontamination.edit_distance_within(a, b) == min(row)


def test_decontamination_recall(spark, edges):
    rnd = random.Random(4)
    word = lambda: "".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(2, 8)))
    vocabulary = [word() for _ in range(3000)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice((6, 12, 25, 40, 90))))) for i in range(60)]
    exact, edited, clean = [], [], []
    for i, text in items:
        around = lambda: " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 60)))
        words = text.split()
        for k in range(len(words)):
            if rnd.random() < 0.06:
                words[k] = rnd.choice(vocabulary)
        exact.append((i, f"{around()} {text.upper()}. {around()}"))
        edited.append((100 + i, f"{around()} {' '.join(words)} {around()}"))
        clean.append((200 + i, " ".join(rnd.choices(vocabulary, k=150))))
    docs = spark.createDataFrame(exact + edited + clean, "doc_id long, text string")
    bench = spark.createDataFrame([*items, (900, None), (901, "four words are few")], "item_id long, text string")
    found = {(r.doc_id, r.item_id) for r in decontamination.find_contaminated(docs, bench).collect()}
    assert all((i, i) in found for i, _ in items) and not any(d >= 200 for d, _ in found)
    norm = lambda t: decontamination.Words([t]).text_of(0, 10**6)
    close = [i for i, t in items if 1 - decontamination.edit_distance_within(norm(t), norm(edited[i][1])) / len(norm(t)) >= 0.9]
    assert sum((100 + i, i) in found for i in close) >= 0.9 * len(close)
    kept = {r.doc_id for r in decontamination.remove_contaminated(docs, bench).collect()}
    assert kept == {d for d, _ in exact + edited + clean} - {d for d, _ in found}
    assert decontamination.find_contaminated(edges, bench).count() == 0 and decontamination.remove_contaminated(edges, bench.limit(0)).count() == len(EDGES)


def _edited(rnd, text, kind, share):
    """``text`` with that share of its letters, or of its words' letters by one a word, or of its words replaced."""
    other = lambda: rnd.choice("qrstuvwxyz")
    if kind == "letters":
        return "".join(other() if c != " " and rnd.random() < share else c for c in text)
    words = text.split()
    for k, word in enumerate(words):
        if rnd.random() < share:
            i = rnd.randrange(len(word))
            words[k] = word[:i] + other() + word[i + 1 :] if kind == "one a word" else "".join(other() for _ in word)
    return " ".join(words)


@pytest.mark.parametrize("kind, shares", [("letters", (0.05, 0.12, 0.16)), ("one a word", (0.4, 0.8, 1.0)), ("words", (0.05, 0.12, 0.16))])
def test_decontamination_recall_by_kind_of_edit(kind, shares):
    rnd = random.Random(8)
    vocabulary = ["".join(rnd.choices("abcdefghijklmnop", k=rnd.randint(3, 9))) for _ in range(3000)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice((8, 12, 20, 40))))) for i in range(80)]
    around = lambda: " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 60)))
    texts = [(i, f"{around()} {_edited(rnd, text, kind, share)} {around()}") for i, text in items for share in shares]
    hits = decontamination.Searcher(items).search([t for _, t in texts])
    near = {0.9: [0, 0], 0.8: [0, 0]}
    for (i, text), found in zip(texts, hits, strict=True):
        similarity = 1 - decontamination.edit_distance_within(items[i][1].encode(), text.strip().encode()) / len(items[i][1])
        assert {k for k, _, _ in found} <= {i}
        if similarity >= 0.8:
            near[0.9 if similarity >= 0.9 else 0.8][0] += 1
            near[0.9 if similarity >= 0.9 else 0.8][1] += any(k == i for k, _, _ in found)
    assert all(n >= 40 and found >= 0.97 * n for n, found in near.values()), near


def test_edit_distances_at_once():
    rnd = random.Random(9)
    pairs = [(bytes(rnd.choices(b"abcd", k=rnd.choice((1, 63, 64, 65, 128, 130, 200)))), bytes(rnd.choices(b"abcd", k=rnd.randint(0, 300)))) for _ in range(300)]
    letters = np.frombuffer(b"\n".join(b for _, b in pairs), np.uint8)
    stop = np.cumsum([len(b) + 1 for _, b in pairs]) - 1
    got = decontamination.least_distances([a for a, _ in pairs], np.arange(len(pairs)), letters, stop - [len(b) for _, b in pairs], stop)
    assert got.tolist() == [decontamination.edit_distance_within(a, b) for a, b in pairs]


def test_short_items_blocks_and_names(spark, monkeypatch):
    docs = spark.createDataFrame([("a", "Yes: the answer IS forty-two, they say", 1), ("b", "nothing like it", 2), ("c", None, 3)], "item_id string, text string, r int")
    bench = spark.createDataFrame([("x", "answer is"), ("y", "forty two"), ("z", "anser is"), ("w", "absent words"), ("v", "!!"), ("u", None)], "id string, text string")
    want = [("a", "x", 0), ("a", "y", 0), ("a", "z", 1)]
    for size in (decontamination.ITEM_BYTES, 10):
        monkeypatch.setattr(decontamination, "ITEM_BYTES", size)
        found = decontamination.find_contaminated(docs, bench, "item_id", item_id_col="id")
        assert found.columns == ["item_id", "_item_id", "edit_distance", "similarity"]
        assert sorted((r[0], r[1], r[2]) for r in found.collect()) == want
        kept = decontamination.remove_contaminated(docs, bench, item_id_col="id")
        assert kept.columns == docs.columns and sorted(r.item_id for r in kept.collect()) == ["b", "c"]
    assert decontamination.find_contaminated(docs.select(docs.r, docs.text), bench.limit(0), "r", item_id_col="id").count() == 0


# ---- classifier


def test_classifier_on_held_out_rows(spark, edges):
    rnd = random.Random(5)
    rows, labels = [], []
    for i in range(1200):
        good = rnd.random() < 0.8
        words = ["".join(rnd.choices("abcdefgh", k=rnd.randint(2, 9))) for _ in range(rnd.randint(20, 120))]
        rows.append((i, " ".join(words) if good else " ".join(w.upper() + "!!" for w in words)))
        labels.append((i, int(good)))
    table = spark.createDataFrame(labels + [(5, None), (9999, 1)], "doc_id long, quality int")
    got = {r.doc_id: r for r in quality_classifier.classify(spark.createDataFrame(rows, "doc_id long, text string"), table).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for i, r in got.items())
    held = [i for i, r in got.items() if r.held_out]
    assert sum(got[i].predicted == labels[i][1] for i in held) > 0.97 * len(held)
    none = quality_classifier.classify(edges, table.limit(0)).collect()
    assert len(none) == len(EDGES) and {r.score for r in none} == {0.5}
    assert quality_classifier.keep_good(edges, table.limit(0)).columns == edges.columns
    assert quality_classifier.classify(edges.limit(0), table).count() == 0


def test_classifier_equals_a_dense_solution(spark):
    rnd = random.Random(15)
    texts = [" ".join("".join(rnd.choices("abcdefgh!A", k=rnd.randint(1, 9))) for _ in range(rnd.randint(1, 80))) for _ in range(400)]
    labels = spark.createDataFrame([(i, i % 3 % 2) for i in range(400)], "doc_id long, quality int")
    df = frame(spark, texts).repartition(5)
    stats = quality_classifier.with_statistics(df, [df.doc_id.alias("_id")])
    model = quality_classifier.fit(stats.join(quality_classifier.training_rows(labels), "_id").select("stats", "y", "fold"))
    known = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 not in (quality_classifier.HELD_OUT, quality_classifier.CALIBRATE)]
    z = model.features(np.array([quality_classifier.statistics(texts[i]) for i in known]))
    y = np.array([i % 3 % 2 for i in known], dtype=float)
    ridge = quality_classifier.RIDGE * len(known) * np.diag(np.append(np.full(quality_classifier.FEATURES, 1 / quality_classifier.FEATURES), 1e-9))
    dense = np.linalg.solve(z.T @ z + ridge, z.T @ y)
    assert np.allclose(z @ dense, model.raw(np.array([quality_classifier.statistics(texts[i]) for i in known])), atol=1e-6)
    # the bound keeps the rows of the least hashes, whatever the labels' order is
    few = {r._id for r in quality_classifier.training_rows(labels, rows=50).collect()}
    assert len(few) == 50 and few == {r._id for r in quality_classifier.training_rows(labels.orderBy("quality"), rows=50).collect()}


def test_isotonic():
    assert quality_classifier.isotonic([0, 3, 1, 4], [4, 4, 4, 4]) == [0, 0.5, 0.5, 1]
    assert quality_classifier.isotonic([2, 0], [2, 2]) == [0.5, 0.5]


# ---- suffix arrays


def test_suffix_array_equals_sorting():
    rnd = random.Random(6)
    for _ in range(200):
        text = bytes(rnd.choices(rnd.choice([b"ab", b"abc", b"abcdefgh"]), k=rnd.randint(1, 70)))
        codes = np.append(np.frombuffer(text, np.uint8).astype(np.uint16) + 1, np.uint16(0))
        depth = rnd.choice((4, 7, 100))
        order = suffix_dedup.suffix_array(codes, suffix_dedup.words_at(codes, depth), depth).tolist()
        prefixes = [tuple(codes[i : i + depth].tolist()) for i in order]
        assert sorted(order) == list(range(len(codes))) and prefixes == sorted(prefixes)


def brute_repeats(texts, window):
    count = Counter(t[i : i + window] for t in texts for i in range(len(t) - window + 1))
    out = []
    for t in texts:
        inside = np.zeros(len(t), bool)
        for i in range(len(t) - window + 1):
            if count[t[i : i + window]] > 1:
                inside[i : i + window] = True
        starts = int((np.diff(np.concatenate(([0], inside.astype(int)))) == 1).sum())
        out.append((len(t), int(inside.sum()), starts, hashlib.sha256(bytes(b for b, x in zip(t, inside, strict=True) if not x)).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [suffix_dedup.HOT_BYTES, 40])
def test_repeats_equal_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", hot)
    monkeypatch.setattr(suffix_dedup, "DEALT", 50)
    rnd = random.Random(7)
    base = ["".join(rnd.choices("abcdé ", k=200)) for _ in range(5)]
    texts = [None, "", "short", "a" * 200, "ab" * 90]
    for _ in range(50):
        parts = []
        for _ in range(rnd.randint(0, 5)):
            a = rnd.randint(0, 190)
            parts += [rnd.choice(base)[a : rnd.randint(a, 200)], rnd.choice("ab") * rnd.randint(0, 50), "".join(rnd.choices("xyz", k=rnd.randint(0, 30)))]
        texts.append("".join(parts))
    texts += texts[6:9]
    want = brute_repeats([(t or "").encode() for t in texts], 24)
    for report in (24, 15):
        rows = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.summarize(frame(spark, texts), window=24, gram=4, report=report).collect()}
        assert [rows[i][:4] for i in range(len(texts))] == want
        assert [rows[i][4] for i in range(len(texts))] == [w[1] for w in brute_repeats([(t or "").encode() for t in texts], report)]
    cut = {r.doc_id: r.text for r in suffix_dedup.remove_repeats(frame(spark, texts), window=24, gram=4).collect()}
    assert cut[0] is None and all(len(cut[i].encode()) <= w[0] - w[1] for i, w in enumerate(want) if i)


def test_repeats_edge_cases(spark, edges):
    rows = suffix_dedup.summarize(edges).collect()
    assert len(rows) == len(EDGES) and {r.n_bytes for r in rows if r.doc_id == 4} == {7}
    assert suffix_dedup.summarize(edges.limit(0)).count() == 0


@pytest.mark.parametrize("n, hot", [(2000, suffix_dedup.HOT_BYTES), (200, 50_000)])
def test_many_long_texts_of_one_character(spark, monkeypatch, n, hot):
    """The different contexts of one hash are compared in blocks of bounded bytes, or dealt out."""
    monkeypatch.setattr(suffix_dedup, "HOT_BYTES", hot)
    texts = ["a" * (400 + i) for i in range(n)] + ["b" * 300, "b" * 300]
    for r in suffix_dedup.summarize(frame(spark, texts)).collect():
        assert (r.n_removed, r.n_repeated) == ((0, 300) if r.doc_id >= n else (r.n_bytes, r.n_bytes))


def test_helper_columns_of_repeats_do_not_clash(spark):
    rows = [(1, "x" * 900, "k", "c"), (2, "tail", "k2", None), (3, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, _text_key string, _COVER string")
    clean = suffix_dedup.remove_repeats(df)
    assert clean.columns == df.columns and sorted(map(tuple, clean.collect())) == [(1, "", "k", "c"), *rows[1:]]
    assert suffix_dedup.summarize(df, "_text_key").columns[0] == "_text_key"


def test_helper_columns_do_not_clash(spark):
    schema = "doc_id long, text string, _ROW string, _pii_key string, _pii_learned string"
    rows = [(1, "mail x@y.com now", "a", "b", "c"), (2, "mail x@y.com now", "d", "e", "f"), (3, None, None, None, None)]
    df = spark.createDataFrame(rows, schema)
    kept = simhash_dedup.deduplicate(df)
    assert kept.columns == df.columns and sorted(map(tuple, kept.collect())) == [rows[0], rows[2]]
    clean = pii.redact(df)
    assert clean.columns == df.columns
    assert sorted(map(tuple, clean.collect())) == [(i, t and "mail [EMAIL] now", *rest) for i, t, *rest in rows]
