"""Whole results: nothing is cut at a length, a count of rows or a depth that the caller did not ask for."""

from pyspark.sql import functions as F

from marlstone.operators import batch, extract, graph, search, tables


def test_long_answers_are_put_in_whole(spark):
    long = "x<&" * 8000  # 24,000 characters before they are escaped
    df = spark.createDataFrame([(1, "say {{ a.result }} twice {a_result}", {"a": long})], "id int, question string, results map<string,string>")
    put = df.select(batch.substitute(F.col("question"), F.col("results")).alias("q")).first().q
    escaped = "x&lt;&amp;" * 8000
    assert put == f"say {escaped} twice {escaped}"
    tasks = spark.createDataFrame([("a", [], long), ("b", ["a"], "{{ a.result }}")], "task_id string, dependencies array<string>, question string")
    done = {r.task_id: r.result for r in batch.run(tasks).collect()}
    assert done["b"] == "answer: answer: " + escaped


def test_tables_of_over_a_million_rows(spark):
    n = 1_000_001
    rows = spark.range(1).select(F.concat(F.array(F.array(F.lit("h"))), F.array_repeat(F.array(F.lit("1")), n)).alias("r"))
    assert rows.select(F.size(tables.padded(F.col("r"))["rows"]).alias("n")).first().n == n
    text = spark.range(1).select(F.concat(F.lit("| h |\n|---|\n"), F.repeat(F.lit("| 1 |\n"), n)).alias("t"))
    assert text.select(F.size(extract.markdown_table(F.col("t"))["rows"]).alias("n")).first().n == n
    none = spark.sql("SELECT CAST(NULL AS ARRAY<ARRAY<STRING>>) AS r, CAST(NULL AS STRING) AS t")
    assert none.select(F.size(tables.padded(F.col("r"))["rows"]).alias("n"), extract.markdown_table(F.col("t")).alias("t")).first() == (0, None)


def test_walks_as_deep_and_as_many_as_asked(spark):
    chain = spark.createDataFrame([(f"e{i}", f"d/{i}", f"d/{i + 1}", "LINK") for i in range(6)], "_key string, _from string, _to string, type string")
    seed = spark.createDataFrame([("d/0",)], "_id string")
    assert {r.vertex: r.depth for r in graph.graph_rag(chain, seed, 5, "OUTBOUND").collect()} == {f"d/{i}": i for i in range(1, 6)}
    assert graph.graph_rag(chain, seed, direction="OUTBOUND").count() == 3
    star = spark.range(300).select(F.concat(F.lit("s"), "id").alias("_key"), F.lit("d/0").alias("_from"), F.concat(F.lit("d/x"), "id").alias("_to"), F.lit("LINK").alias("type"))
    assert graph.graph_rag(star, seed, 1).count() == 100 and graph.graph_rag(star, seed, 1, per_seed=None).count() == 300


def test_long_fence_languages(spark):
    text = "```" + "l" * 3000 + "\ncode\n```"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    assert len(extract.blocks(df, "id", "text").filter("type = 'code'").first().language) == 3000


def test_pages_beyond_a_thousand(spark):
    df = spark.range(3000).select(F.format_string("%04d", "id").alias("_key"), F.lit("same words").alias("content"))
    assert [r._key for r in search.bm25_search(df, "same", ["content"], min_score=0.0, top_n=1000, offset=2000).select("_key").collect()] == [f"{i:04d}" for i in range(2000, 3000)]


def test_depths_of_many_paths_and_of_circles(spark):
    # a ladder of diamonds: a path for each choice at each of them
    rows = [("0", [])]
    for i in range(0, 40, 2):
        rows += [(f"{i + 1}a", [f"{i}"]), (f"{i + 1}b", [f"{i}"]), (f"{i + 2}", [f"{i + 1}a", f"{i + 1}b", f"{i}"])]
    rows += [("x", ["y"]), ("y", ["x", "0"]), ("behind", ["x", "4"]), ("odd", ["elsewhere", "2", "2"])]
    tasks = spark.createDataFrame(rows, "task_id string, dependencies array<string>")
    got = {r.task_id: r.depth for r in batch.depths(tasks, 40).collect()}
    assert len(got) == len(rows) and all(got[str(i)] == i for i in range(0, 41, 2)) and all(got[f"{i}b"] == i for i in range(1, 40, 2))
    assert got["x"] is got["y"] is got["behind"] is None and got["odd"] == 3
    near = {r.task_id: r.depth for r in batch.depths(tasks, 5).collect()}
    assert near["6"] == 6 and near["4"] == 4 and near["7a"] is None
    assert batch.depths(tasks.limit(0)).collect() == []
