"""Work in parts of batches and along sorted rows, against plain Python."""

import random

import pyarrow as pa

from marlstone.functions.batches import parts
from marlstone.functions.fuzzy import ratio
from marlstone.operators import glossary, graph, html, tables


def test_parts_hold_few_bytes_and_all_rows():
    texts = pa.array(["a" * 5, None, "é" * 4, "", "b" * 50, "c", "d"])
    assert list(parts(texts, 10)) == [(0, 2), (2, 4), (4, 5), (5, 7)]
    assert list(parts(texts.slice(2, 3), 10)) == [(0, 2), (2, 3)] and list(parts(texts.slice(0, 0), 10)) == []


def test_chains_follow_sorted_rows_without_a_group_for_each_document(spark):
    rnd = random.Random(4)
    heads = [["part", "qty"], ["Qty", "PART"], ["part", "qty", "price"], ["zz", "yy"], None]
    data = [(rnd.choice([None, *range(30)]), rnd.choice([None, 1, 2, 3, 5]), n, rnd.choice(heads), [[str(n)]]) for n in range(400)]
    df = spark.createDataFrame(data, "doc int, page int, number int, header array<string>, body array<array<string>>")
    found = tables.merge_chain(df)
    assert "FlatMapGroupsInPandas" not in found._jdf.queryExecution().toString()
    want = set()
    words = lambda h: sorted(" ".join(x.lower() for x in h or []).split())
    for doc in {r[0] for r in data} - {None}:
        chain, head, last = [], None, None
        for r in sorted((r for r in data if r[0] == doc), key=lambda r: (r[1] is None, r[1] or 0, r[2])):
            near = head is not None and None not in (r[1], last) and r[1] <= last + 1 and len(r[3] or []) == len(head) and ratio(" ".join(words(r[3])), " ".join(words(head))) > 80
            if not near:
                want |= {(doc, chain[0], tuple(sorted(chain)))} if chain else set()
                chain, head = [], r[3] or []
            chain.append(r[2])
            last = r[1]
        want.add((doc, chain[0], tuple(sorted(chain))))
    assert {(r["doc"], r["first"], tuple(sorted(r["numbers"]))) for r in found.collect()} == want


def test_glossary_and_pages_over_several_parts(spark):
    texts = ["The hue of " + "x" * 900_000 + " RED hue", None, "", *("red, hue red " * 60_000 for _ in range(4)), "no"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").coalesce(1)
    found = glossary.find_terms(df, ["red", "hue"])
    finder = glossary.Finder(["red", "hue"])
    marked = df.select("i", found.alias("m"), glossary.highlight(df.text, found).alias("marked")).collect()
    for r in marked:
        own = finder.places(texts[r["i"]] or "")
        assert [tuple(m) for m in r["m"]] == own
        assert r["marked"] == (None if texts[r["i"]] is None else texts[r["i"]].replace("hue", "**hue**").replace("red", "**red**").replace("RED", "**RED**"))
    pages = spark.createDataFrame([(i, None if i == 3 else "<p>" + "y" * 900_000 + f"</p><p>{i}</p>") for i in range(8)], "i int, page string").coalesce(1)
    got = html.elements(pages, "i", "page", ["p"]).collect()
    assert sorted((r["id"], r["position"], len(r["code"]), r["tag"]) for r in got) == sorted((i, k, n, "p") for i in range(8) if i != 3 for k, n in ((1, 900_000), (2, 1)))


def test_steps_of_a_walk_are_shuffled_once(spark):
    edges = spark.createDataFrame([(f"e{i}", f"v/{i % 50}", f"v/{i * 7 % 50}", "t") for i in range(200)], "_key string, _from string, _to string, type string")
    steps, hubs = graph.dealt(graph.oriented(edges, "OUTBOUND"))
    frontier = spark.createDataFrame([("v/1", "v/1")], "start string, vertex string")
    joined = graph.stepped(frontier, steps.hint("merge"), hubs)
    plan = joined._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert "Bucketed: true" in plan and len(exchanges) == 1, plan  # that of the frontier
    assert sorted(r["edge"] for r in joined.collect()) == ["e1", "e101", "e151", "e51"]
