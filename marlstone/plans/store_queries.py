"""Registered queries of sources and sinks, definitions, indexes, and the further forms of searches, edges and changes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from marlstone.functions import text, vector
from marlstone.operators import chunk, extract, glossary, graph, hybrid, ivf, memory, search, store, tables
from marlstone.plans import api
from marlstone.plans.content_queries import INTER, TABLES, _tables, chunks_sql
from marlstone.plans.core_queries import COS, NATIONS, PAIRS, _changes, _nations, fused_sql, ranked_lists, rounded, text_list, vector_list
from marlstone.plans.fixtures import ASKED, DOCS, PLACES, VECTORS, as_pdf, bm25_sql, docs, place_edges, plain_docs, query_vector, table, vectors
from marlstone.sources import files, pdf
from marlstone.sources.shared import scratch

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


# ---- sources

query("SRC-02", f"WITH {DOCS} SELECT _key, lang FROM docs WHERE _key = '23'")(lambda s, d: store.required(plain_docs(s, d), "23").select("_key", "lang"))


@query("SRC-05", "SELECT lang, count(*) AS n FROM documents WHERE n_chars >= 500 GROUP BY lang")
def _profiled(s, d):
    table(s, d, "documents").createOrReplaceTempView("profiled_documents")
    return store.profiled(s, "SELECT lang, count(*) AS n FROM profiled_documents WHERE n_chars >= :least GROUP BY lang", {"least": 500})[0]


query("SRC-06", "SELECT doc_id, n_chars FROM documents WHERE source = 'src0' ORDER BY n_chars, doc_id LIMIT 20 OFFSET 5")(
    lambda s, d: store.query(table(s, d, "documents"), "source = 'src0'", [F.asc("n_chars"), F.asc("doc_id")], 20, 5).select("doc_id", "n_chars")
)


@query("SRC-09", """SELECT 'bench_item_' || item_id AS _key, text AS lesson, CASE WHEN vec_id IS NULL THEN 1024 ELSE len(embedding) END::INT AS dims, embedding[1]::DOUBLE AS given, CASE WHEN vec_id IS NULL THEN 1.0::DOUBLE END AS made
FROM benchmark LEFT JOIN embeddings ON vec_id = item_id AND vec_id % 2 = 0 WHERE trim(text) <> ''""")
def _seeded(s, d):
    # every other lesson brings its vector, the others have one made
    own = vectors(s, d).filter("vec_id % 2 = 0").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("lesson_embedding"))
    lessons = table(s, d, "benchmark").join(own, "item_id", "left").select(F.lit("bench").alias("role"), F.lit("item").alias("category"), F.col("item_id").alias("identifier"), F.col("text").alias("lesson"), "lesson_embedding")
    known = lessons.limit(3).select(text.lesson_key(F.col("role"), F.col("category"), F.col("identifier").cast("string")).alias("_key"), F.lit("old").alias("lesson"), F.array(F.lit(0.0)).alias("lesson_embedding"))
    e = F.col("lesson_embedding")
    brought = F.size(e) != vector.DIMENSIONS
    return store.seed(known, lessons).select("_key", "lesson", F.size(e).alias("dims"), F.when(brought, F.get(e, F.lit(0))).alias("given"), F.when(~brought, F.round(vector.norm(e), 6)).alias("made"))


def _tree(s, d):
    """The documents as text files in a folder for each language."""
    path = scratch(s, "tree")
    table(s, d, "documents").select("lang", "text").write.partitionBy("lang").text(path)
    return path


_folder = lambda: F.split_part("path", F.lit("/"), F.lit(1)).alias("folder")


@query("SRC-12", "SELECT sum(strlen(html) + 1)::BIGINT AS bytes, true AS within FROM pages")
def _size(s, d):
    path = scratch(s, "pages")
    table(s, d, "pages").select("html").write.text(path)
    return files.total_bytes(s, path, 100.0)


query("SRC-13", "SELECT DISTINCT 'lang=' || lang AS folder FROM documents")(lambda s, d: files.find_files(s, _tree(s, d), [".TXT"]).select(_folder()).distinct())
query("SRC-14", "SELECT DISTINCT 'lang=' || lang AS folder FROM documents WHERE lang <> 'de'")(lambda s, d: files.relevant_files(s, _tree(s, d), ["lang=de/*", "*.png"]).select(_folder()).distinct())
query("SRC-25", "SELECT 'lang=' || lang AS folder, sum(1 + length(text) - length(replace(text, chr(10), '')))::BIGINT AS lines FROM documents GROUP BY lang")(
    lambda s, d: files.texts(s, _tree(s, d)).groupBy(_folder()).agg(F.sum(F.size(F.split("content", "\n")) - 1).alias("lines"))
)


@query("SRC-18", "SELECT page_id, len(regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>', 0))::BIGINT AS headings FROM pages WHERE regexp_matches(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>')")
def _html_files(s, d):
    path = scratch(s, "html")
    # rows of pages, many to a file
    table(s, d, "pages").select("page_id", "html").write.json(path)
    return extract.html_headings(s.read.schema("page_id long, html string").json(path), "page_id", "html").groupBy(F.col("id").alias("page_id")).agg(F.count("*").alias("headings"))


query("SRC-22", "SELECT item_id AS id, 1::INT AS pages, text FROM benchmark")(
    lambda s, d: pdf.elements(table(s, d, "benchmark").select("item_id", as_pdf(F.col("text")).alias("file")), "item_id", "file").groupBy("id").agg(F.max("page").alias("pages"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page", "block", "text"))), lambda b: b["text"]), "\n").alias("text"))
)
query("SRC-23", f"WITH {TABLES}, s AS (SELECT number, accuracy, (70.0 + number % 25)::DOUBLE AS other FROM t) SELECT number, CASE WHEN accuracy >= 80 OR accuracy >= other THEN 'lattice' ELSE 'stream' END AS flavor, CASE WHEN accuracy >= 80 THEN accuracy ELSE greatest(accuracy, other) END AS accuracy FROM s")(
    lambda s, d: tables.best_flavor((t := _tables(s, d).select("doc", "page", "number", "accuracy")), t.withColumn("accuracy", (F.lit(70.0) + F.col("number") % 25).cast("double"))).select("number", "flavor", "accuracy")
)


@query("SRC-24", "SELECT count(*) FILTER (event_id % 2 = 0) AS good, count(*) FILTER (event_id % 2 = 1) AS bad FROM events")
def _json(s, d):
    path = scratch(s, "json")
    table(s, d, "events").select(F.when(F.col("event_id") % 2 == 0, F.col("props")).otherwise("no JSON").alias("value")).write.text(path)
    return files.read_json(s, path, "k long").agg(F.count("k").alias("good"), F.count_if(F.col("k").isNull()).alias("bad"))


query("SRC-26", f"WITH {VECTORS}, {ASKED} SELECT _key, round({COS}, 6) AS score FROM vectors, asked ORDER BY {COS} DESC, _key LIMIT 3")(
    lambda s, d: rounded(api.handle(_registry(s, d), "lessons", collection="vectors", query=query_vector(s, d)).select("_key", "score"), "score")
)
query("UDF-02", "SELECT page_id, '<p>' || url || '</p>' AS content FROM pages")(
    lambda s, d: files.fetched(table(s, d, "pages").select("page_id", "url"), "url", lambda u: F.concat(F.lit("<p>"), u, F.lit("</p>"))).select("page_id", "content")
)

# ---- sinks


@query("SNK-02", "SELECT doc_id, quality, toxic FROM labels")
def _saved_json(s, d):
    path = scratch(s, "labels")
    files.save_json((labels := table(s, d, "labels")), path)
    return files.read_json(s, path, ", ".join(f"{c} {t}" for c, t in labels.dtypes)).select("doc_id", "quality", "toxic")


@query("SNK-03", "SELECT source AS kind, count(*) AS n FROM documents GROUP BY source")
def _layout(s, d):
    path = scratch(s, "layout")
    files.save_layout(table(s, d, "documents").select(F.col("source").alias("kind"), "doc_id"), path)
    return s.read.parquet(path).groupBy("kind").agg(F.count("*").alias("n"))


@query("SNK-04", "SELECT DISTINCT sha256(text) AS section_id, n_chars FROM documents")
def _upserted(s, d):
    rows = table(s, d, "documents").select(F.sha2("text", 256).alias("section_id"), "n_chars", "lang")
    known = rows.filter("lang = 'en'").drop("lang").distinct()
    return store.upsert(known, rows.drop("lang"), "section_id")


query("SNK-05", "SELECT event_id, '# K' || chr(10) || chr(10) || json_extract_string(props, '$.k') || chr(10) || chr(10) AS text FROM events")(lambda s, d: table(s, d, "events").select("event_id", files.json_markdown(F.col("props")).alias("text")))
query("SNK-06", """SELECT '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '"}' AS row FROM nation""")(lambda s, d: api.as_json(table(s, d, "nation").select("n_nationkey", "n_name")))


@query("SNK-07", "SELECT n_nationkey, n_name FROM nation")
def _saved_csv(s, d):
    path, nation = scratch(s, "csv"), table(s, d, "nation").select("n_nationkey", "n_name")
    files.save_csv(nation, path)
    files.save_csv(nation.filter("n_nationkey = 3"), path)  # what is there stays
    return s.read.option("header", "true").schema("n_nationkey long, n_name string").csv(path)


# ---- definitions


def _registry(s, d):
    registry = store.Registry(s)
    registry.put("vectors", vectors(s, d))
    registry.put("docs", docs(s, d))
    registry.put("edges", place_edges(s, d))
    return registry


@query("DDL-01", "SELECT 'marlstone_lessons' AS namespace")
def _database(s, d):
    store.Registry(s).ensure_database("marlstone_lessons")
    return s.sql("SHOW DATABASES LIKE 'marlstone_lessons'")


def _shapes(s, registry, names):
    return s.createDataFrame([(n, ",".join(registry.collections[n].columns)) for n in names], "name string, columns string")


EDGE = "'_key,_from,_to,type,rationale,timestamp,attributes'"
query("DDL-03", f"SELECT * FROM (VALUES ('prerequisites', {EDGE}), ('related_topics', {EDGE})) v(name, columns)")(lambda s, d: _shapes(s, r := store.Registry(s), r.edge_collections()))
query("DDL-04", f"SELECT * FROM (VALUES ('messages', '_key,conversation_id,message_type,content,timestamp,metadata,previous_message_key'), ('memories', '_key,conversation_id,content,summary,embedding,timestamp'), ('relationships', {EDGE})) v(name, columns)")(
    lambda s, d: _shapes(s, r := store.Registry(s), r.memory_collections())
)


@query("DDL-06", f"WITH {DOCS}, {bm25_sql(['the', 'la'], ['title'])} SELECT _key, round(score, 6) AS score FROM scored")
def _rebuilt(s, d):
    views, rows = search.Views(), plain_docs(s, d)
    first = views.ensure("docs", rows, ["content"])
    if views.ensure("docs", rows, ["content"]) is not first:
        raise AssertionError("a view of the same fields is kept")
    return rounded(search.search_view(*views.ensure("docs", rows, ["title"]), "the la"), "score")


def _index(s, d):
    """The stored vector index, built when it is first asked for."""
    return ivf.stored(vectors(s, d), f"{d}/embeddings.parquet")


query("DDL-08", "SELECT count(*) AS rows, count(DISTINCT vec_id) AS keys FROM embeddings WHERE len(embedding) > 0")(
    lambda s, d: (index := _index(s, d)).rows.join(index.codes, "_row").agg(F.count("*").alias("rows"), F.countDistinct("_key").alias("keys"))
)
query("DDL-09", f"WITH {PLACES} SELECT _key, _from, _to FROM edges WHERE split_part(_from, '/', 1) = 'region' AND split_part(_to, '/', 1) = 'nation'")(
    lambda s, d: graph.GraphDef("places", place_edges(s, d), ["region"], ["nation"]).checked().select("_key", "_from", "_to")
)


@query("DDL-11", "SELECT * FROM (VALUES (0, 'database', 1), (1, 'collections', 7), (2, 'graph', 0), (3, 'edges', 2), (4, 'seed', (SELECT count(*) FROM benchmark)), (5, 'view', 1), (6, 'index', (SELECT count(*) FROM benchmark))) v(step, what, rows)")
def _initialized(s, d):
    lessons = table(s, d, "benchmark").select(F.lit("bench").alias("role"), F.lit("item").alias("category"), F.col("item_id").cast("string").alias("identifier"), F.col("text").alias("lesson"))
    return s.createDataFrame(store.Registry(s).initialize(lessons), "step int, what string, rows long")


query("DDL-12", "SELECT count(*) AS terms, count(DISTINCT n_name) AS different FROM nation")(
    lambda s, d: glossary.create(s, table(s, d, "nation").select(F.col("n_name").alias("term"), F.lit("a nation").alias("definition")), glossary.glossary(s), True).agg(F.count("*").alias("terms"), F.countDistinct("term").alias("different"))
)

# ---- searches

HITS = f"hits AS (SELECT v._key, {COS} AS score FROM vectors v, asked)"
query("PRJ-02", f"WITH {DOCS}, {VECTORS}, {ASKED}, {HITS} SELECT d._key, d._id, d.title, d.content, array_to_string(d.tags, ',') AS tags, round(score, 6) AS score FROM hits JOIN docs d USING (_key) WHERE list_contains(d.tags, 'en') AND score >= 0.05 ORDER BY hits.score DESC, _key LIMIT 10")(
    lambda s, d: rounded(
        search.semantic_search(docs(s, d).join(vectors(s, d).select("_key", "embedding"), "_key"), query_vector(s, d), tag_list=["en"], min_score=0.05).select(*search.SEMANTIC_FIELDS).withColumn("tags", F.array_join("tags", ",")), "score"
    )
)
query("VEC-01", f"WITH {VECTORS}, {ASKED} SELECT _key, round({COS}, 6) AS score FROM vectors, asked WHERE label >= 2 AND {COS} >= 0.05 ORDER BY {COS} DESC, _key LIMIT 8")(
    lambda s, d: rounded(api.handle(_registry(s, d), "semantic", collection="vectors", query=query_vector(s, d), filter_expr="label >= 2", min_score=0.05, top_n=8).select("_key", "score"), "score")
)
query("VEC-04")(lambda s, d: rounded(ivf.nearest(_index(s, d), query_vector(s, d)).select("_key", "score"), "score"))
query("VEC-04-all", f"WITH {VECTORS}, {ASKED} SELECT _key, round({COS}, 6) AS score FROM vectors, asked ORDER BY {COS} DESC, _key LIMIT 10")(
    lambda s, d: rounded(ivf.nearest(_index(s, d), query_vector(s, d), exact=True).select("_key", "score"), "score")
)
query("VEC-07", f"WITH {VECTORS}, {ASKED} SELECT _key, round({COS}, 6) AS score FROM vectors, asked ORDER BY {COS} DESC, _key LIMIT 6")(
    lambda s, d: rounded(ivf.search_or_exact(vectors(s, d), None, query_vector(s, d), 6).select("_key", "score"), "score")
)
query("VEC-09", f"WITH {VECTORS}, {ASKED} SELECT _key, round({COS}, 6) AS score FROM vectors, asked WHERE {COS} >= 0.1 ORDER BY {COS} DESC, _key LIMIT 4")(
    lambda s, d: rounded(search.semantic_search(vectors(s, d), query_vector(s, d), min_score=0.1, top_n=4).select("_key", "score"), "score")
)
query("VEC-11", f"WITH {VECTORS}, {ASKED}, h AS (SELECT _key, {COS} AS score FROM vectors, asked WHERE {COS} >= 0.15 ORDER BY {COS} DESC, _key LIMIT 30) SELECT _key, round(score, 6) AS score, count(*) OVER () AS total FROM h")(
    lambda s, d: rounded(search.exact_search(vectors(s, d), query_vector(s, d), 30, 0.15).select("_key", "score", "total"), "score")
)
_lengths = lambda texts: np.array([[len(t), 1.0] for t in texts])
query("VEC-13", "SELECT item_id, round(length(text) / sqrt(length(text)::DOUBLE * length(text) + 1), 9) AS first FROM benchmark")(
    lambda s, d: table(s, d, "benchmark").select("item_id", F.round(F.get(vector.encode(F.col("text"), _lengths), F.lit(0)), 9).alias("first"))
)
query("VEC-26", "SELECT item_id, CASE WHEN item_id % 3 = 0 THEN 0.0::DOUBLE ELSE round((length(text) + 7) / sqrt((length(text) + 7)::DOUBLE * (length(text) + 7) + 1), 9) END AS first FROM benchmark")(
    lambda s, d: table(s, d, "benchmark").select("item_id", F.round(F.get(vector.encode(F.when(F.col("item_id") % 3 != 0, F.col("text")), _lengths, "query: ", 2), F.lit(0)), 9).alias("first"))
)
query("SRT-06", f"WITH {VECTORS}, {ASKED} SELECT _key, round({COS}, 6) AS score FROM vectors, asked ORDER BY {COS} DESC, _key LIMIT 10 OFFSET 5")(
    lambda s, d: rounded(search.page(vectors(s, d).withColumn("score", vector.cosine_to(F.col("embedding"), query_vector(s, d))), [F.desc("score"), F.asc("_key")], 10, 5).select("_key", "score"), "score")
)
query("UDF-01", "SELECT doc_id FROM documents WHERE n_chars % 7 = 3")(lambda s, d: store.filtered(table(s, d, "documents"), lambda t: t["n_chars"] % 7 == 3).select("doc_id"))

# ---- glossary

KNOWN = "k AS (SELECT lower(n_name) AS term_lower FROM nation WHERE n_nationkey % 2 = 0), i AS (SELECT DISTINCT lower(n_name) AS term_lower FROM nation WHERE n_nationkey % 3 = 0)"


def _terms(s, d, every):
    return table(s, d, "nation").filter(F.col("n_nationkey") % every == 0).select(F.col("n_name").alias("term"), F.lower("n_name").alias("term_lower"), F.lit(f"every {every}").alias("definition"), F.length("n_name").alias("length"))


query("TXT-14", f"WITH {KNOWN} SELECT count(*) FILTER (term_lower NOT IN (SELECT term_lower FROM k)) AS added, count(*) FILTER (term_lower IN (SELECT term_lower FROM k)) AS updated FROM i")(lambda s, d: glossary.add_counted(_terms(s, d, 2), _terms(s, d, 3))[1])
query("TXT-15", "SELECT lower(p_name) AS term_lower, max(p_brand) AS definition FROM part GROUP BY 1")(
    lambda s, d: glossary.add_terms(_terms(s, d, 2).limit(0), table(s, d, "part").select(F.col("p_name").alias("term"), F.col("p_brand").alias("definition"))).select("term_lower", "definition")
)
query("TXT-18", """SELECT '{"term":"' || n_name || '","definition":"every 2"}' AS row FROM nation WHERE n_nationkey % 2 = 0""")(lambda s, d: api.as_json(glossary.terms_in_order(_terms(s, d, 2)).select("term", "definition")))
query("TWN-05", "SELECT upper(n_name) AS term, lower(n_name) AS term_lower FROM nation ORDER BY term_lower")(
    lambda s, d: glossary.terms_in_order(glossary.create(s, table(s, d, "nation").select(F.upper("n_name").alias("term"), F.lit("").alias("definition")))).select("term", "term_lower")
)

# ---- joins and edges

query("JON-04", f"WITH {VECTORS}, {ASKED}, {HITS}, top AS (SELECT * FROM hits ORDER BY score DESC, _key LIMIT 12) SELECT _key, d.lang, d.n_chars FROM top JOIN documents d ON d.doc_id::VARCHAR = _key")(
    lambda s, d: search.semantic_search(vectors(s, d), query_vector(s, d), min_score=-2.0, top_n=12).select("_key").join(plain_docs(s, d), "_key").select("_key", "lang", "n_chars")
)
query("JON-09", f"WITH {TABLES}, o AS (SELECT number, {INTER} / (8.0 + 8.0 - {INTER}) AS near FROM t) SELECT number, near >= 0.5 AS valid FROM o")(
    lambda s, d: tables.overlapping(t := _tables(s, d), t.select("page").distinct().select("page", F.explode(F.array(*(F.array(*map(F.lit, b)) for b in ((1.0, 1.0, 5.0, 3.0), (90.0, 90.0, 91.0, 91.0))))).alias("box")), 0.5).select("number", "valid")
)
query("JON-10", f"WITH {PLACES}, hop AS (SELECT e._key AS edge, 1 AS depth, e._to AS _id FROM edges e WHERE e._from = 'region/1' UNION ALL SELECT b._key, 2, b._to FROM edges a JOIN edges b ON b._from = a._to WHERE a._from = 'region/1') SELECT edge, depth, _id, c.c_name FROM hop JOIN (SELECT 'customer/' || c_custkey AS _id, c_name FROM customer) c USING (_id)")(
    lambda s, d: graph.documents_within(place_edges(s, d), table(s, d, "customer").select(F.concat(F.lit("customer/"), "c_custkey").alias("_id"), "c_name"), "region/1", 2).select("edge", "depth", "_id", "c_name")
)
query("GRF-05", f"WITH {PLACES} SELECT CASE WHEN _from = 'nation/3' THEN _to ELSE _from END AS vertex, _key AS edge, 1 AS depth FROM edges WHERE 'nation/3' IN (_from, _to) ORDER BY vertex, edge LIMIT 10")(
    lambda s, d: graph.around(place_edges(s, d), "nation/3").select("vertex", "edge", "depth")
)
query("GRF-09", f"WITH {PLACES} SELECT _from, _to, type, NULL::DOUBLE AS relevance FROM edges UNION ALL SELECT 'messages/' || conv_id || '-' || turn, 'documents/' || conv_id, 'relates_to', 0.9::DOUBLE FROM conversations")(
    lambda s, d: graph.link(place_edges(s, d), table(s, d, "conversations").select(F.concat(F.lit("messages/"), F.concat_ws("-", "conv_id", "turn")).alias("_from"), F.concat(F.lit("documents/"), "conv_id").alias("_to")), relevance=0.9).select("_from", "_to", "type", "relevance")
)


@query("GRF-13", f"WITH {PLACES} SELECT _from, _to, type FROM edges WHERE _key <> 'n4' UNION ALL SELECT 'nation/1', 'nation/2', 'NEXT_TO'")
def _cli_edges(s, d):
    registry = _registry(s, d)
    api.handle(registry, "edge_create", edges="edges", source="nation/1", target="nation/2", kind="NEXT_TO")
    return api.handle(registry, "edge_delete", edges="edges", key="n4").select("_from", "_to", "type")


# ---- changes

query("DML-02", f"WITH {NATIONS} SELECT _key, coalesce(c.name, n.name) AS name, c._key IS NOT NULL AS stamped FROM n FULL JOIN c USING (_key)".replace("SELECT _key, coalesce(c.name", "SELECT coalesce(n._key, c._key) AS _key, coalesce(c.name").replace("FULL JOIN c USING (_key)", "FULL JOIN c ON n._key = c._key"))(
    lambda s, d: store.create(_nations(s, d), _changes(s, d), "update").select("_key", "name", (F.col("created_at").isNotNull() & F.col("updated_at").isNotNull() & F.col("uuid").isNotNull()).alias("stamped"))
)
query("DML-07", "SELECT count(*) FILTER (vec_id % 5 <> 0) AS created, count(*) FILTER (vec_id % 5 = 0) AS failed FROM embeddings")(
    lambda s, d: store.create_checked((v := vectors(s, d)).limit(0), v.withColumn("embedding", F.when(F.col("vec_id") % 5 != 0, F.col("embedding"))), 64)[1]
)
query("DML-08", "SELECT vec_id, CASE WHEN vec_id % 2 = 0 THEN 99 ELSE label END AS label, round(CASE WHEN vec_id % 4 = 0 THEN 0.5 ELSE embedding[1] END::DOUBLE, 6) AS first FROM embeddings")(
    lambda s, d: store.replace_keeping_vector((v := vectors(s, d).select("_key", "vec_id", "label", "embedding")), v.filter("vec_id % 2 = 0").withColumns({"label": F.lit(99), "embedding": F.when(F.col("vec_id") % 4 == 0, F.array(F.lit(0.5).cast("float")))})).select("vec_id", F.col("label").cast("int").alias("label"), F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("first"))
)
query("DML-09", "SELECT vec_id::VARCHAR AS _key, label::INT AS label, embedding[1]::DOUBLE AS first, embedding[-1]::DOUBLE AS last FROM embeddings WHERE vec_id % 5 <> 0")(
    # of five vectors one has lost an entry, and is not created
    lambda s, d: store.create_checked((v := vectors(s, d)).limit(0), v.withColumn("embedding", F.when(F.col("vec_id") % 5 == 0, F.slice("embedding", 1, 63)).otherwise(F.col("embedding"))), 64)[0]
    .select("_key", F.col("label").cast("int").alias("label"), F.get("embedding", F.lit(0)).cast("double").alias("first"), F.element_at("embedding", -1).cast("double").alias("last"))
)
query("DML-10", f"WITH {NATIONS} SELECT _key, coalesce(c.name, n.name) AS name FROM n LEFT JOIN c USING (_key) WHERE _key <> '3' UNION ALL SELECT 'new', 'NEW'")(
    lambda s, d: store.delete(store.update(store.insert(_nations(s, d), s.createDataFrame([("new", "NEW")], "_key string, name string")), _changes(s, d)), s.createDataFrame([("3",)], "_key string")).select("_key", "name")
)

# ---- services and twins

query("SRV-01", f"WITH {DOCS} SELECT _key, lang FROM docs WHERE lang = 'fr' ORDER BY _key LIMIT 25 OFFSET 2")(lambda s, d: api.handle(_registry(s, d), "document_query", collection="docs", filter_expr="lang = 'fr'", limit=25, offset=2).select("_key", "lang"))


@query("SRV-02", "SELECT CASE doc_id % 3 WHEN 0 THEN 'md' WHEN 1 THEN 'py' ELSE 'txt' END AS kind, count(*) AS files, sum(strlen(text))::BIGINT AS bytes, sum(length(text) // 4)::BIGINT AS tokens FROM documents GROUP BY 1")
def _repository(s, d):
    registry = store.Registry(s)
    ending = F.when(F.col("doc_id") % 3 == 0, ".md").when(F.col("doc_id") % 3 == 1, ".py").otherwise(".txt")
    registry.put("files", table(s, d, "documents").select(F.concat("source", F.lit("/"), "doc_id", ending).alias("path"), F.col("text").alias("content")))
    return api.handle(registry, "repository_info", collection="files")


query("TWN-01", f"WITH {VECTORS}, {ASKED}, {HITS} SELECT b.text AS question, round(score, 6) AS score FROM hits JOIN benchmark b ON b.item_id::VARCHAR = _key WHERE score >= 0.0 ORDER BY hits.score DESC, _key LIMIT 5")(
    lambda s, d: rounded(search.semantic_search(vectors(s, d).join(table(s, d, "benchmark").select(F.col("item_id").cast("string").alias("_key"), F.col("text").alias("question")), "_key"), query_vector(s, d), min_score=0.0, top_n=5).select("question", "score"), "score")
)
query("TWN-02", f"WITH {DOCS}, {VECTORS}, {ASKED}, {ranked_lists(8)} SELECT _key, round({fused_sql(bm=0.5, sem=0.5)}, 9) AS hybrid_score FROM bm FULL JOIN sem USING (_key)")(
    lambda s, d: rounded(hybrid.fuse({"bm25": text_list(s, d, 8), "semantic": vector_list(s, d, 8)}, hybrid.scaled(None)).select("_key", "hybrid_score"), "hybrid_score", digits=9)
)
query("TWN-03", f"WITH {PAIRS} SELECT conv_id || '-' || turn AS _key, length('User: ' || u || chr(10) || 'Agent: ' || a)::INT AS size FROM x")(lambda s, d: memory.memories(table(s, d, "conversations")).select("_key", F.length("content").alias("size")))
query("TWN-04", "SELECT conv_id || '-' || turn AS _key, role AS message_type FROM conversations WHERE conv_id = 4 AND turn = 2")(lambda s, d: store.get(memory.messages(table(s, d, "conversations")), "4-2").select("_key", "message_type"))
query("TWN-06", f"WITH {chunks_sql(500)} SELECT id, section, chunk, tokens AS code_token_count FROM chunked")(lambda s, d: chunk.chunk_rows(table(s, d, "documents"), "doc_id", "text").select("id", "section", "chunk", "code_token_count"))
query("TWN-07", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k FROM events")(lambda s, d: table(s, d, "events").select("event_id", F.try_variant_get(text.first_json(F.concat(F.lit("said: "), "props", F.lit(" end"))), "$.k", "long").alias("k")))
