"""Further registered queries: the clauses and variants of the inventory that the other modules do not name."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from marlstone.functions import images, text, vector
from marlstone.functions.stem import stems
from marlstone.operators import batch, chunk, code, extract, glossary, graph, hybrid, memory, rst, search, store, tables
from marlstone.plans.content_queries import TABLES, _tables, marked_sql
from marlstone.plans.core_queries import ASK, COS, FIELDS, GRAPH_LIST, PAIRS, TERMS, fused_sql, graph_list, ranked_lists, text_list, vector_list
from marlstone.plans.fixtures import ASKED, DOCS, PLACES, TURNS, VECTORS, bm25_sql, docs, place_edges, plain_docs, query_vector, table, text_index, turn_edges, vectors

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query of that name."""

    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


rounded = lambda df, c, digits=6: df.withColumn(c, F.round(c, digits))

# ---- clauses of searches

query("SRT-01", f"WITH {DOCS}, {bm25_sql(TERMS, ['content'])} SELECT _key, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, _key LIMIT 7 OFFSET 7")(
    lambda s, d: rounded(search.bm25_search(plain_docs(s, d), ASK, ["content"], min_score=0.0, top_n=7, offset=7).select("_key", "score"), "score")
)
query("SRT-02", f"WITH {DOCS} SELECT _key FROM docs WHERE list_contains(tags, 'fr') ORDER BY _key LIMIT 15 OFFSET 2")(lambda s, d: search.tag_search(docs(s, d), ["fr"], limit=15, offset=2).select("_key"))
query("SRT-07", "SELECT p_name AS term, length(p_name)::INT AS size FROM part ORDER BY size DESC, term LIMIT 50")(lambda s, d: table(s, d, "part").select(F.col("p_name").alias("term"), F.length("p_name").alias("size")).orderBy(F.desc("size"), "term").limit(50))
query("SRT-08", f"WITH {VECTORS}, {ASKED} SELECT _key, round({COS}, 6) AS score FROM vectors, asked ORDER BY {COS} DESC, _key LIMIT 12")(
    lambda s, d: rounded(search.semantic_search(vectors(s, d), query_vector(s, d), min_score=-2, top_n=12).select("_key", "score"), "score")
)
query("FLT-03", f"WITH {VECTORS}, {ASKED} SELECT _key FROM vectors, asked WHERE {COS} >= 0.15")(lambda s, d: vectors(s, d).filter(vector.cosine_to(F.col("embedding"), query_vector(s, d)) >= 0.15).select("_key"))
query("FLT-04", "SELECT vec_id FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0")(lambda s, d: vectors(s, d).filter(vector.present(F.col("embedding"))).select("vec_id"))
query("FLT-06", f"WITH {DOCS} SELECT d.item_id FROM benchmark d WHERE d.item_id::VARCHAR IN (SELECT _key FROM docs WHERE list_has_all(tags, ['en', 'q1']))")(
    lambda s, d: table(s, d, "benchmark").withColumn("_key", F.col("item_id").cast("string")).join(search.with_filters(docs(s, d), None, ["en", "q1"]), "_key", "left_semi").select("item_id")
)
query("TXT-08", f"WITH {DOCS} SELECT _key FROM docs WHERE list_has_all(tags, ['en', 'q1', 'tox0']) AND n_chars > 1000 ORDER BY _key LIMIT 30")(
    lambda s, d: search.tag_search(docs(s, d), ["en", "q1", "tox0"], "n_chars > 1000", True, 30).select("_key")
)
query("TXT-05", "SELECT item_id::VARCHAR AS _key, 1.0::DOUBLE AS keyword_score FROM benchmark WHERE list_contains(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), 'the') ORDER BY _key LIMIT 20".replace("\\\\", "\\"))(
    lambda s, d: search.keyword_search(table(s, d, "benchmark").select(F.col("item_id").cast("string").alias("_key"), "text"), "the", 100.0, 20, ["text"]).select("_key", "keyword_score")
)
query("DDL-07")(lambda s, d: table(s, d, "benchmark").select("item_id", F.array_join(stems(text.tokens("text")), " ").alias("stems")))
query("TXT-11", "SELECT item_id, len(list_filter(['the', 'and', 'eren'], lambda t: regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])' || t || '($|[^\\p{L}\\p{N}_])')))::INT AS terms FROM benchmark")(lambda s, d: table(s, d, "benchmark").select("item_id", F.size(glossary.unique_terms(glossary.find_terms(table(s, d, "benchmark"), ["the", "and", "eren"]))).alias("terms")))
query("TXT-17", f"SELECT item_id, array_to_string({marked_sql(['the', 'and', 'eren'])}, '') AS marked, len(list_filter({marked_sql(['the', 'and', 'eren'])}, lambda x: starts_with(x, '**') AND length(x) > 4 AND x[3] <> '*'))::INT AS n FROM benchmark")(lambda s, d: (b := table(s, d, "benchmark")).select("item_id", "text", glossary.find_terms(b, ["the", "and", "eren"]).alias("m")).select("item_id", glossary.highlight(F.col("text"), F.col("m")).alias("marked"), F.size("m").alias("n")))
query("TXT-16", "SELECT 13::BIGINT AS terms")(lambda s, d: glossary.glossary(s).agg(F.count("*").alias("terms")))
query("VEC-12", "SELECT a.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")(
    lambda s, d: rounded(vectors(s, d).alias("a").join(vectors(s, d).select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("e2")), "vec_id").select("vec_id", vector.cosine(F.col("embedding"), F.col("e2")).alias("score")), "score")
)
query("VEC-17", "SELECT min(item_id) AS first, count(*) AS same, 1024::INT AS dims, 1.0::DOUBLE AS norm, NULL::VARCHAR AS embedding_error FROM benchmark GROUP BY trim(text, ' ')")(
    # equal texts have equal vectors, others have not
    lambda s, d: store.with_embedding(table(s, d, "benchmark"))
    .groupBy(F.sha2(F.to_json(F.array("embedding")), 256).alias("digest"), "embedding_error")
    .agg(F.min("item_id").alias("first"), F.count("*").alias("same"), F.max(F.size("embedding")).alias("dims"), F.round(F.avg(vector.norm(F.col("embedding"))), 5).alias("norm"))
    .drop("digest")
)
_SIZE = "sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]))"
query("VEC-17-given", f"SELECT vec_id, CASE vec_id % 4 WHEN 0 THEN 'missing embedding' WHEN 1 THEN 'dimension 63 instead of 64' END AS embedding_error, CASE WHEN vec_id % 4 > 1 THEN round((embedding[1] / {_SIZE})::FLOAT::DOUBLE, 5) END AS first FROM embeddings")(
    lambda s, d: store.with_embedding(vectors(s, d).withColumn("embedding", F.when(F.col("vec_id") % 4 == 1, F.slice("embedding", 1, 63)).when(F.col("vec_id") % 4 > 1, F.col("embedding"))), generate=False, dimensions=64).select(
        "vec_id", "embedding_error", F.round(F.get("embedding", F.lit(0)).cast("double"), 5).alias("first")
    )
)
query("AGG-05", f"WITH {VECTORS}, {ASKED}, top AS (SELECT label, {COS} AS score FROM vectors, asked ORDER BY score DESC, _key LIMIT 25) SELECT label, round(sum(score * score), 6) AS votes FROM top WHERE score > 0 GROUP BY label")(
    lambda s, d: rounded(search.semantic_search(vectors(s, d), query_vector(s, d), min_score=-2, top_n=25).filter("score > 0").groupBy("label").agg(F.sum(F.col("score") * F.col("score")).alias("votes")), "votes")
)
query("AGG-06", "SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 5) AS size FROM embeddings")(lambda s, d: vectors(s, d).select("vec_id", F.round(vector.dot(F.col("embedding"), F.col("embedding")), 5).alias("size")))
query("AGG-09", "SELECT count(*) AS n FROM embeddings WHERE label = 3 AND len(embedding) > 0")(lambda s, d: vectors(s, d).filter(vector.present(F.col("embedding")) & (F.col("label") == 3)).agg(F.count("*").alias("n")))
query("AGG-10", "SELECT array_to_string(list_sort(list_distinct(list(len(embedding)))), ',') AS dims FROM embeddings")(
    lambda s, d: vectors(s, d).agg(F.array_join(F.array_sort(F.collect_set(F.size("embedding").cast("string"))), ",").alias("dims"))
)
query("AGG-01", f"WITH {DOCS} SELECT count(*) AS n FROM docs WHERE list_contains(tags, 'en')")(lambda s, d: search.with_filters(docs(s, d), None, ["en"]).agg(F.count("*").alias("n")))
query("SET-01", "SELECT DISTINCT source FROM documents")(lambda s, d: table(s, d, "documents").select("source").distinct())
query("SET-04", "SELECT DISTINCT p_partkey % 50 AS k FROM part WHERE p_partkey % 3 = 0 OR p_partkey % 5 = 0 EXCEPT SELECT p_partkey % 50 FROM part WHERE p_partkey % 50 < 9")(
    lambda s, d: (p := table(s, d, "part").select((F.col("p_partkey") % 50).alias("k"), "p_partkey")).filter("p_partkey % 3 = 0").unionByName(p.filter("p_partkey % 5 = 0")).dropDuplicates(["k"]).join(p.filter("k < 9").select("k"), "k", "left_anti").select("k")
)

# ---- ranking

query("HYB-02", f"WITH {DOCS}, {VECTORS}, {ASKED}, {ranked_lists(10)} SELECT _key, round({fused_sql(bm=0.7, sem=0.3)}, 9) AS hybrid_score FROM bm FULL JOIN sem USING (_key)")(
    lambda s, d: rounded(hybrid.fuse({"bm25": text_list(s, d, 10), "semantic": vector_list(s, d, 10)}, {"bm25": 0.7, "semantic": 0.3}).select("_key", "hybrid_score"), "hybrid_score", 9)
)
query("HYB-05", f"WITH {VECTORS}, {ASKED}, {GRAPH_LIST} SELECT _key, r::INT AS rank FROM gr")(lambda s, d: graph_list(s, d).select("_key", F.col("rank").cast("int").alias("rank")))
_tagged = f"""{bm25_sql(TERMS, FIELDS)}, bm AS (SELECT _key, row_number() OVER (ORDER BY score DESC, _key) AS r FROM scored WHERE list_contains(tags, 'en') AND score >= 0 QUALIFY r <= 20),
sem AS (SELECT _key, row_number() OVER (ORDER BY {COS} DESC, _key) AS r FROM vectors, asked WHERE _key IN (SELECT _key FROM docs WHERE list_contains(tags, 'en')) AND {COS} >= 0 QUALIFY r <= 20)"""
_rrf = fused_sql(bm=0.3, sem=0.5, gr=0.2)
query("HYB-03", f"WITH {DOCS}, {VECTORS}, {ASKED}, {_tagged}, {GRAPH_LIST} SELECT _key, round({_rrf}, 9) AS hybrid_score FROM bm FULL JOIN sem USING (_key) FULL JOIN gr USING (_key) ORDER BY {_rrf} DESC, bm.r NULLS LAST, sem.r NULLS LAST, gr.r NULLS LAST, _key LIMIT 10")(
    lambda s, d: hybrid.hybrid_search(docs(s, d), vectors(s, d), ASK, query_vector(s, d), tag_list=["en"], min_score={"bm25": 0.0, "semantic": 0.0}, graph=graph_list(s, d), index=text_index(s, d)).select("_key", F.round("hybrid_score", 9).alias("hybrid_score"))
)
query("HYB-08", "SELECT 'documents/' || doc_id AS _from, 'related_topics/' || (doc_id % 3) AS _to, 'RELATED' AS type FROM documents")(
    lambda s, d: graph.new_edges(table(s, d, "documents").select(F.concat(F.lit("documents/"), "doc_id").alias("_from"), F.concat(F.lit("related_topics/"), F.col("doc_id") % 3).alias("_to")), "RELATED").select("_from", "_to", "type")
)
query("VEC-25", f"WITH {DOCS}, {bm25_sql(TERMS, FIELDS)} SELECT _key FROM scored WHERE _key IN (SELECT vec_id::VARCHAR FROM embeddings) ORDER BY score DESC, _key LIMIT 5")(
    lambda s, d: search.bm25_scores(plain_docs(s, d), ASK, FIELDS).join(vectors(s, d).select("_key"), "_key", "left_semi").orderBy(F.desc("score"), "_key").limit(5).select("_key")
)

# ---- joins, graph and memory

query("JON-05", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")(
    lambda s, d: table(s, d, "orders").join(table(s, d, "customer").filter("c_nationkey = 3"), F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey")
)
query("JON-06", "SELECT coalesce(a.k, b.k) AS k, a.n AS left_n, b.n AS right_n FROM (SELECT n_nationkey AS k, n_name AS n FROM nation WHERE n_nationkey % 2 = 0) a FULL JOIN (SELECT n_nationkey AS k, n_name AS n FROM nation WHERE n_nationkey % 3 = 0) b ON a.k = b.k")(
    lambda s, d: (n := table(s, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("n"))).filter("k % 2 = 0").withColumnRenamed("n", "left_n").join(n.filter("k % 3 = 0").withColumnRenamed("n", "right_n"), "k", "full_outer").select("k", "left_n", "right_n")
)
query("GRF-06", f"WITH {PLACES}, one AS (SELECT _to AS vertex, 1 AS depth FROM edges WHERE _from = 'region/3'), two AS (SELECT e._to AS vertex, 2 AS depth FROM edges e JOIN one ON e._from = one.vertex) SELECT vertex, depth FROM (SELECT * FROM one UNION ALL SELECT * FROM two) ORDER BY depth, vertex LIMIT 12")(
    lambda s, d: graph.traverse(place_edges(s, d), s.createDataFrame([("region/3",)], "_id string"), 1, 2).orderBy("depth", "vertex").limit(12).select("vertex", "depth")
)
query("PRJ-03", f"WITH {PLACES} SELECT e._to AS vertex, e._key AS edge, 1 AS depth, 'region/0>' || e._to AS path FROM edges e WHERE e._from = 'region/0'")(
    lambda s, d: graph.traverse(place_edges(s, d), s.createDataFrame([("region/0",)], "_id string")).select("vertex", "edge", "depth", F.array_join("vertices", ">").alias("path"))
)
query("GRF-14", "SELECT 'nation/nation--' || n_nationkey AS _from, 'region/region--' || n_regionkey AS _to, 'in' AS type FROM nation WHERE n_nationkey % 2 = 0")(
    lambda s, d: graph.stix_graph(table(s, d, "nation").select(F.concat(F.lit("relationship--"), "n_nationkey").alias("id"), F.lit("relationship").alias("type"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("nation--"), "n_nationkey")).alias("source_ref"), F.concat(F.lit("region--"), "n_regionkey").alias("target_ref"), F.lit("in").alias("relationship_type")))[1].select("_from", "_to", "type")
)
query("MEM-08", "WITH p AS (SELECT n.vec_id AS a, k.vec_id AS b, list_cosine_similarity(n.embedding::DOUBLE[], k.embedding::DOUBLE[]) AS score FROM embeddings n, embeddings k WHERE n.vec_id % 100 = 0 AND n.vec_id <> k.vec_id) SELECT 'm' || a AS _from, count(*) AS links FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, 'm' || b) AS r FROM p WHERE score > 0.1) WHERE r <= 5 GROUP BY a")(
    lambda s, d: memory.similarity_edges(*((v := vectors(s, d).select(F.concat(F.lit("m"), "vec_id").alias("_key"), "embedding", "vec_id")).filter("vec_id % 100 = 0"), v), 0.1, 0.85).groupBy("_from").agg(F.count("*").alias("links"))
)
query("MEM-09", f"WITH {PAIRS}, docs AS (SELECT conv_id || '-' || turn AS _key, 'User: ' || u || chr(10) || 'Agent: ' || a AS content, CASE WHEN length(u || ' ' || a) > 100 THEN substr(u || ' ' || a, 1, 97) || '...' ELSE u || ' ' || a END AS summary FROM x), {bm25_sql(['the', 'und', 'que'], ['content', 'summary'])} SELECT _key, round(score, 6) AS score FROM scored WHERE score >= 0.01 ORDER BY scored.score DESC, _key LIMIT 5")(lambda s, d: search.bm25_search((m := memory.memories(table(s, d, "conversations"))), "the und que", ["content", "summary"], min_score=0.01, top_n=5).select("_key", F.round("score", 6).alias("score")))
query("MEM-03-edges", f"WITH {TURNS} SELECT _key FROM edges WHERE _from <> 'messages/3-1' AND _to <> 'messages/3-1'")(lambda s, d: memory.without_message(memory.messages(table(s, d, "conversations")), turn_edges(s, d), "3-1")[1].select("_key"))

# ---- content

query("CHK-02", "SELECT doc_id AS id, n AS position, number, title, length(text)::INT AS size FROM documents, (VALUES (0, '', ''), (1, '4.1', 'First Part'), (2, '4.1.2', '2nd Part')) v(n, number, title)")(
    # the text before all headers, and below each of two
    lambda s, d: chunk.sections(table(s, d, "documents").select("doc_id", F.concat("text", F.lit("\n**4.1 First Part**\n"), "text", F.lit("\n**4.1.2. 2nd Part**\n"), "text").alias("t")), "doc_id", "t").select(
        "id", F.col("position").cast("int").alias("position"), "number", "title", F.length(F.regexp_replace(F.regexp_replace("content", r"^\*\*4[^\n]*\n", ""), r"\n\z", "")).alias("size")
    )
)
query("CHK-11", "SELECT doc_id, least(length(text), 100)::DOUBLE / greatest(length(text), 1) <= 0.4 AS compressed FROM documents")(
    lambda s, d: table(s, d, "documents").select("doc_id", (F.length(text.shorten(F.col("text"))) / F.greatest(F.length("text"), F.lit(1)) <= 0.4).alias("compressed"))
)
LINES = "(1 + length(text) - length(replace(text, chr(10), '')))"
query("EXT-01", f"SELECT doc_id AS id, CASE n WHEN 0 THEN 0 WHEN 1 THEN 1 + {LINES} WHEN 2 THEN 2 + 2 * {LINES} ELSE 3 + 3 * {LINES} END::INT AS first_line, number, title FROM documents, (VALUES (0, '1', 'A'), (1, '1.1', 'B'), (2, '7.3', 'Own number'), (3, '2', 'C')) v(n, number, title)")(
    # the whole text below each of four headings
    lambda s, d: extract.sections(extract.blocks(table(s, d, "documents").select("doc_id", F.concat(F.lit("# A\n"), "text", F.lit("\n## B\n"), "text", F.lit("\n## 7.3 Own number\n"), "text", F.lit("\n# C")).alias("t")), "doc_id", "t")).select("id", "first_line", "number", "title")
)
query("SRC-15", "SELECT doc_id AS file_path, text AS code, 'about ' || source AS description, 'python' AS code_type FROM documents")(
    # the whole text as code
    lambda s, d: extract.code_rows(table(s, d, "documents").select("doc_id", F.concat(F.lit("# A\nother words\n\nabout "), "source", F.lit("\n\n```python\n"), "text", F.lit("\n```\nend")).alias("t")), "doc_id", "t").select("file_path", "code", "description", "code_type")
)
query("EXT-07", "SELECT n_nationkey, 'f' || n_nationkey AS name, 'x: int = ' || n_regionkey AS parameters FROM nation")(
    lambda s, d: table(s, d, "nation").select("n_nationkey", code.metadata(F.concat(F.lit("def f"), "n_nationkey", F.lit("(x: int = "), "n_regionkey", F.lit("):\n    return x\n"))).alias("m")).select("n_nationkey", F.col("m.functions")[0]["name"].alias("name"), F.array_join(F.col("m.functions")[0]["parameters"], ",").alias("parameters"))
)
query("SRC-20", "SELECT n_nationkey AS id, 1 AS cell, n_name AS code, 'about ' || n_regionkey AS description FROM nation")(
    lambda s, d: extract.notebook_cells(table(s, d, "nation").select("n_nationkey", F.to_json(F.struct(F.array(F.struct(F.lit("markdown").alias("cell_type"), F.array(F.concat(F.lit("about "), "n_regionkey")).alias("source")), F.struct(F.lit("code").alias("cell_type"), F.array("n_name").alias("source"))).alias("cells"))).alias("j")), "n_nationkey", "j")
)
query("SRC-21", "SELECT n_nationkey, 'x = ' || n_regionkey AS code FROM nation")(
    lambda s, d: table(s, d, "nation").select("n_nationkey", extract.rst_code(F.concat(F.lit("Text::\n\n    x = "), "n_regionkey", F.lit("\n\nEnd\n")))[0].alias("code"))
)
query("SRC-21-nested", r"""SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS code FROM documents WHERE trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') <> ''""")(
    # each text as a line of code in a note in a list
    lambda s, d: (t := table(s, d, "documents").select("doc_id", F.trim(F.regexp_replace("text", r"\s+", " ")).alias("line")).filter("line <> ''"))
    .select("doc_id", F.inline(rst.blocks(F.concat(F.lit("* item\n\n  .. note::\n\n     .. code-block:: text\n        :linenos:\n\n        "), "line", F.lit("\n\nEnd ")))))
    .select("doc_id", "code")
)
query("EXT-24", f"WITH {TABLES} SELECT number, round(least(greatest(accuracy / 100, 0), 1), 6) AS accuracy_score, 1.0::DOUBLE AS completeness, two::INT::DOUBLE AS consistency, round((100 - whitespace) / 100, 6) AS whitespace_score FROM t")(
    lambda s, d: tables.quality(_tables(s, d)).select("number", F.round("accuracy_score", 6).alias("accuracy_score"), "completeness", "consistency", F.round("whitespace_score", 6).alias("whitespace_score"))
)
query("EXT-40", f"WITH {TABLES} SELECT number FROM t WHERE 100 * (0.4 * least(greatest(accuracy / 100, 0), 1) + 0.3 + 0.1 * two::INT + 0.2 * (100 - whitespace) / 100) >= 80")(lambda s, d: tables.quality(_tables(s, d)).filter("round(confidence, 9) >= 80").select("number"))
query("EXT-27", f"WITH {TABLES} SELECT number, 'over ' || number AS above, 'Table ' || number AS below, 'Table ' || number AS title FROM t")(
    lambda s, d: tables.context((t := _tables(s, d).withColumn("page", F.col("number"))), t.select("doc", "page", F.explode(F.array(*(F.struct((F.get("bbox", F.lit(side)) + off - 1).alias("top"), (F.get("bbox", F.lit(side)) + off).alias("bottom"), F.concat(F.lit(word), "number").alias("content")) for side, off, word in ((1, -10.0, "over "), (3, 10.0, "Table "))))).alias("x")).select("doc", "page", "x.*")).select("number", "above", "below", "title")
)
query("EXT-35", f"WITH {TABLES}, b AS (SELECT number, two, lag(two) OVER (PARTITION BY doc ORDER BY page, number) AS q FROM t) SELECT number, two = q AS near FROM b WHERE q IS NOT NULL")(lambda s, d: (t := _tables(s, d)).withColumn("_before", F.lag("header").over(Window.partitionBy("doc").orderBy("page", "number"))).filter("_before IS NOT NULL").select("number", tables.near_header(F.col("_before"), F.col("header")).alias("near")))
query("EXT-26", f"WITH {TABLES} SELECT doc, number AS page, 'other text' AS content FROM t")(lambda s, d: tables.drop_repeated_text((t := _tables(s, d).withColumn("page", F.col("number"))).select("doc", "page", F.array_join(F.flatten("body"), " ").alias("content")).unionByName(t.select("doc", "page", F.lit("other text").alias("content"))), t).select("doc", "page", "content"))
query("DAG-09", "SELECT n_nationkey, 'n' || n_nationkey || '.md' AS name, n_name AS content FROM nation")(
    lambda s, d: table(s, d, "nation").select("n_nationkey", F.explode(extract.task_files(F.concat(F.lit("### [FILENAME: n"), "n_nationkey", F.lit(".md]\n"), "n_name"))).alias("f")).select("n_nationkey", "f.name", "f.content")
)
query("DAG-05", "SELECT item_id, 'Q: ' || replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') AS filled FROM benchmark")(
    lambda s, d: table(s, d, "benchmark").select("item_id", batch.substitute(F.lit("Q: {Q1_result}"), F.create_map(F.lit("Q1"), "text")).alias("filled"))
)
query("IMG-01", "SELECT p_partkey, floor(p_size * 40 * least(1.0::DOUBLE, 640.0::DOUBLE / (p_size * 40), 640.0::DOUBLE / (p_size * 30)))::BIGINT AS width, floor(p_size * 30 * least(1.0::DOUBLE, 640.0::DOUBLE / (p_size * 40), 640.0::DOUBLE / (p_size * 30)))::BIGINT AS height FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", images.fitted(F.col("p_size") * 40, F.col("p_size") * 30).alias("f")).select("p_partkey", "f.width", "f.height")
)
query("IMG-03", "SELECT p_partkey, (p_size - 3 >= 0 AND p_size > 10) AS valid FROM part")(lambda s, d: table(s, d, "part").select("p_partkey", images.valid_region(F.col("p_size") - 3, F.lit(0), F.col("p_size") - 10, F.lit(5)).alias("valid")))
query("FLT-12", "SELECT 5 AS top_n, 20 AS initial_k")(lambda s, d: s.createDataFrame([search.search_params(0, -1)], "top_n int, initial_k int"))
query("DDL-02", "SELECT 0::BIGINT AS rows, 7 AS collections")(lambda s, d: (r := store.Registry(s).bootstrap()).collections["messages"].agg(F.count("*").alias("rows")).withColumn("collections", F.lit(len(r.collections))))
query("DDL-10", "SELECT 0::BIGINT AS rows")(lambda s, d: _emptied(s, d))


def _emptied(s, d):
    registry = store.Registry(s)
    registry.put("docs", plain_docs(s, d))
    registry.truncate(["docs"], force=True)
    return registry.collections["docs"].agg(F.count("*").alias("rows"))
