import json

import pytest
from pyspark.sql import functions as F

from marlstone.functions import text
from marlstone.operators import batch, chunk, extract, glossary, tables
from marlstone.sources import files
from marlstone.streaming import ingest

MARKDOWN = "# Title\n\nFirst words\nof two lines.\n\n## Sub\n\nBefore code.\n\n```python\nx = 1\n\ny = 2\n```\n\n### 4.2 Named\n\nlast"


def one(spark, value, schema="id int, text string"):
    return spark.createDataFrame([(1, value)], schema)


def test_blocks_and_sections(spark):
    rows = extract.blocks(one(spark, MARKDOWN), "id", "text").orderBy("first_line").collect()
    assert [r.type for r in rows] == ["heading", "paragraph", "heading", "paragraph", "code", "heading", "paragraph"]
    assert rows[1].content == "First words\nof two lines." and rows[4].content == "x = 1\n\ny = 2" and rows[4].language == "python"
    found = extract.sections(extract.blocks(one(spark, MARKDOWN), "id", "text")).orderBy("first_line").collect()
    assert [(r.number, r.title) for r in found] == [("1", "Title"), ("1.1", "Sub"), ("4.2", "Named")]
    assert found[2].path == ["Title", "Sub", "Named"]
    code = extract.code_rows(one(spark, MARKDOWN), "id", "text", "repo").first()
    assert code.description == "Before code." and code.code_type == "python" and code.section_path == ["Title", "Sub"]
    assert extract.blocks(one(spark, None), "id", "text").count() == 0


def test_small_parsers(spark):
    df = one(spark, "Title: A Tale\nAuthor: Ann\nkey one: v1\nkey one: v2\nplain")
    m = df.select(extract.metadata(F.col("text")).alias("m")).first().m
    assert m["title"] == "A Tale" and m["author"] == "Ann" and m["key_one"] == "v2"
    t = one(spark, "| A | B |\n|---|---|\n| 1 | 2 |\n| 3 |\n").select(extract.markdown_table(F.col("text")).alias("t")).first().t
    assert t.headers == ["A", "B"] and t.rows == [["1", "2"]]
    i = one(spark, "see ![alt text](a/b.png) there").select(extract.image(F.col("text")).alias("i")).first().i
    assert (i.alt, i["src"]) == ("alt text", "a/b.png")
    rst = "Intro::\n\n    literal = 1\n\nText\n\n.. code-block:: python\n\n    def f():\n        pass\n\nEnd\n"
    code = one(spark, rst).select(extract.rst_code(F.col("text")).alias("c")).first().c
    assert code == ["literal = 1", "def f():\n    pass"]
    nb = json.dumps({"cells": [{"cell_type": "markdown", "source": ["about"]}, {"cell_type": "code", "source": ["a = 1\n", "b"]}]})
    cell = extract.notebook_cells(one(spark, nb), "id", "text").first()
    assert (cell.code, cell.description) == ("a = 1\nb", "about")
    html = "<h1>One</h1><p>x</p><pre>code &lt;1&gt;</pre><h2>Two</h2><pre>more</pre><script>no</script>"
    rows = extract.html_code(one(spark, html), "id", "text").orderBy("position").collect()
    assert [(r.code, r.headings) for r in rows] == [("code <1>", ["One"]), ("more", ["One", "Two"])]
    parts = one(spark, "x ### [FILENAME: a.md]\nA\n### [FILENAME: b.md]\nB").select(extract.task_files(F.col("text")).alias("p")).first().p
    assert [(p.name, p.content) for p in parts] == [("a.md", "A"), ("b.md", "B")]
    assert one(spark, "a data:image/png;base64," + "A" * 50).select(text.truncate_value(F.col("text")).alias("x")).first().x.endswith(",...")


def test_chunks(spark):
    words = "One two three four. Five six seven eight! " * 20 + "x" * 40 + " y" * 200
    rows = one(spark, words).select(F.explode(chunk.chunks(F.col("text"), 30)).alias("c")).select("c.*").collect()
    assert all(r.tokens <= 30 for r in rows) and " ".join(r.text for r in rows).split() == words.split()
    got = one(spark, "aaaa. " * 10).select(chunk.overlapping_chunks(text.sentences(F.col("text")), 3, 1).alias("c")).first().c
    assert got[0] == ["aaaa."] * 3 and all(len(c) <= 3 for c in got) and len(got) == 5
    parts = chunk.sections(one(spark, "intro\n**4. Design**\nbody\n**4.1 More**\nend"), "id", "text").orderBy("position").collect()
    assert [(p.number, p.title) for p in parts] == [("", ""), ("4", "Design"), ("4.1", "More")]
    assert chunk.chunk_rows(one(spark, ""), "id", "text").count() == 0
    tree = [r.line for r in chunk.tree(spark.createDataFrame([("a/b.txt",), ("c.md",)], "path string")).collect()]
    assert tree == ["a/", "    b.txt", "c.md"]
    long = chunk.summarize(one(spark, "word " * 4000), "id", "text", lambda c: text.shorten(c, 60), 500, 600).first().summary
    assert len(long) <= 60


def test_glossary(spark):
    df = one(spark, "Primary color and Color; RGB, colored. A primary color")
    m = glossary.find_terms(df, list(glossary.COLOURS))
    found = df.select(m.alias("m"), "text").select(glossary.unique_terms(F.col("m")).alias("t"), glossary.highlight(F.col("text"), F.col("m")).alias("h")).first()
    assert found.t == ["color", "primary color", "RGB"]
    assert found.h == "**Primary color** and **Color**; **RGB**, colored. A **primary color**"
    known = glossary.glossary(spark)
    after = glossary.add_terms(known, spark.createDataFrame([("rgb", "new"), ("Teal", "blue green")], "term string, definition string"))
    assert known.count() == 13 and after.count() == 14 and after.filter("term = 'RGB'").first().definition == "new"


def test_batches(spark):
    rows = [("a", [], "q"), ("b", ["a"], "see {{ a.result }}"), ("c", [], "fail"), ("d", ["c"], "q"), ("e", ["d"], "q"), ("x", ["y"], "q"), ("y", ["x"], "q"), ("z", ["a", "b"], "{a_result}")]
    tasks = spark.createDataFrame(rows, "task_id string, dependencies array<string>, question string")
    got = {r.task_id: (r.status, r.result) for r in batch.run(tasks).collect()}
    assert got["b"] == ("success", "answer: see answer: q") and got["z"] == ("success", "answer: answer: q")
    assert got["c"][0] == "error" and got["d"] == ("dependency_failed", "Dependency c failed.")
    assert got["e"][0] == got["x"][0] == got["y"][0] == "error"
    assert {r.task_id: r.depth for r in batch.depths(tasks).collect()}["e"] == 2
    long = spark.createDataFrame([(str(i), [str(i - 1)] if i else [], "q") for i in range(22)], tasks.schema)
    with pytest.raises(ValueError):
        batch.run(long)


def test_tables(spark):
    schema = "doc int, page int, number int, header array<string>, body array<array<string>>, accuracy double, whitespace double, bbox array<double>"
    rows = [(1, 1, 1, ["A", "B"], [["1", "2"]], 90.0, 10.0, [0.0, 0.0, 2.0, 2.0]), (1, 2, 2, ["a", "b"], [["3", "4"]], 80.0, 10.0, [1.0, 1.0, 3.0, 3.0]), (1, 2, 3, ["C"], [["5"], ["x"], ["6"]], 100.0, 0.0, [0.0, 5.0, 1.0, 6.0])]
    df = spark.createDataFrame(rows, schema)
    merged = tables.merged_runs(df).orderBy("run").collect()
    assert [(r.first_page, r.last_page, r.body) for r in merged] == [(1, 2, [["1", "2"], ["3", "4"]]), (2, 2, [["5"], ["x"], ["6"]])]
    scores = {r.number: r for r in tables.quality(df).collect()}
    assert scores[1].accuracy_score == 0.9 and abs(scores[3].accuracy_score - 0.8) < 1e-9
    box = F.array(F.lit(0.0), F.lit(0.0), F.lit(2.0), F.lit(2.0))
    assert [round(r.i, 4) for r in df.orderBy("number").select(tables.iou(F.col("bbox"), box).alias("i")).collect()] == [1.0, 0.1429, 0.0]
    texts = spark.createDataFrame([(1, 1, 2.5, 3.0, "note"), (1, 1, 8.0, 9.0, "Table 1: things"), (1, 1, 1.0, 1.5, "inside")], "doc int, page int, top double, bottom double, content string")
    seen = tables.context(df, texts, margin=0.2).filter("number = 1").first()
    assert seen.below == "note\nTable 1: things" and seen.title == "Table 1: things"
    near = df.limit(1).select(tables.near_header(F.array(F.lit("Unit Price"), F.lit("Qty")), F.array(F.lit("qty"), F.lit("Price unit"))).alias("n")).first().n
    assert near


def test_files(spark, tmp_path):
    for name in ("file1.txt", "file2.md", "dir1/file3.py", "dir2/file4.TXT", ".git/x.txt", "a/node_modules/b.js"):
        path = tmp_path / "repo" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("content of " + name)
    root = str(tmp_path / "repo")
    assert [r.path for r in files.find_files(spark, root, ["txt"]).collect()] == ["dir2/file4.TXT", "file1.txt"]
    assert [r.path for r in files.find_files(spark, root, dirs=["dir1"]).collect()] == ["dir1/file3.py"]
    assert "a/node_modules/b.js" not in [r.path for r in files.relevant_files(spark, root).collect()]
    assert files.total_bytes(spark, root).first().within and files.small(files.find_files(spark, root, ["md"])).count() == 1
    files.save_csv(spark.range(2), str(tmp_path / "out"))
    files.save_csv(spark.range(5), str(tmp_path / "out"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "out")).count() == 2


def test_streams(spark, tmp_path):
    spark.createDataFrame([("a", "x"), ("b", "y")], "_key string, content string").write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.store(ingest.read(spark, str(tmp_path / "in"), "_key string, content string"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_glossary_reads_whole_texts(spark):
    words = [f"w{i:03}" for i in range(150)]
    body = "x " * 6000 + " ".join(words) + " end"
    df = one(spark, body)
    found = df.select("text", glossary.find_terms(df, words).alias("m"))
    r = found.select(glossary.unique_terms(F.col("m")).alias("t"), glossary.highlight(F.col("text"), F.col("m")).alias("h"), glossary.highlight(F.col("text"), F.col("m"), limit=None).alias("n")).first()
    assert r.t == words and r.h == r.n == "x " * 6000 + " ".join(f"**{w}**" for w in words) + " end"
    assert df.select(glossary.find_terms(df, words, limit=10_000).alias("m")).select(glossary.unique_terms(F.col("m")).alias("t")).first().t == []
    assert found.select(glossary.unique_terms(F.col("m"), 2).alias("t")).first().t == words[:2]
