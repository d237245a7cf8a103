"""Registered queries of search, vectors, ranking, joins, graph, stores and conversations, each with DuckDB's SQL where that can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import text, vector
from marlstone.operators import graph, hybrid, memory, search, store, textindex
from marlstone.plans.fixtures import ASKED, DOCS, PLACES, TRADE, TURNS, VECTORS, bm25_sql, docs, place_edges, plain_docs, query_vector, table, text_index, trade_edges, turn_edges, vectors

ASK, TERMS, FIELDS = "thinghat eren stand that", ["thinghat", "eren", "stand", "that"], ["title", "content"]
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


def rounded(df, *columns: str, digits: int = 6):
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ---- scans, projections, predicates

query("SRC-01", f"WITH {DOCS} SELECT _key, title, n_chars FROM docs WHERE _key = '17'")(lambda s, d: store.get(plain_docs(s, d), "17").select("_key", "title", "n_chars"))
query("SRC-03", f"WITH {DOCS} SELECT _key, lang, n_chars FROM docs WHERE lang = 'en' AND n_chars > 500 ORDER BY n_chars DESC, doc_id LIMIT 50 OFFSET 10")(
    lambda s, d: store.query(plain_docs(s, d), "lang = 'en' AND n_chars > 500", [F.desc("n_chars"), F.asc("doc_id")], 50, 10).select("_key", "lang", "n_chars")
)


@query("SRC-04", "SELECT source, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM documents WHERE n_chars >= 1000 GROUP BY source")
def _raw(s, d):
    table(s, d, "documents").createOrReplaceTempView("raw_documents")
    return store.raw(s, "SELECT source, count(*) AS n, sum(n_chars) AS chars FROM raw_documents WHERE n_chars >= :least GROUP BY source", {"least": 1000})


query("SRC-07", "SELECT vec_id, label, len(embedding)::BIGINT AS dims FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0")(
    lambda s, d: vectors(s, d).filter(vector.present(F.col("embedding"))).select("vec_id", "label", F.size("embedding").cast("long").alias("dims"))
)
query("SRC-08", "SELECT item_id AS question_id, (len(text) % 10 / 10.0::DOUBLE >= 0.5)::INT AS label FROM benchmark WHERE text IS NOT NULL")(
    lambda s, d: store.labelled_questions(table(s, d, "benchmark").select(F.col("item_id").alias("question_id"), F.col("text").alias("question"), (F.length("text") % 10 / 10).alias("rating"))).select("question_id", "label")
)
query("PRJ-01", f"WITH {DOCS} SELECT _key, _id, array_to_string(tags, ',') AS tags, title, NULL::VARCHAR AS absent FROM docs")(
    lambda s, d: store.keep(docs(s, d), ["title", "tags", "absent"]).withColumn("tags", F.array_join("tags", ","))
)
query("FLT-01", f"WITH {DOCS} SELECT _key, n_chars FROM docs WHERE n_chars > 800 AND list_has_all(tags, ['en', 'src0'])")(
    lambda s, d: search.with_filters(docs(s, d), "n_chars > 800", ["en", "src0"]).select("_key", "n_chars")
)
query("FLT-02", f"WITH {DOCS} SELECT _key FROM docs WHERE list_has_any(tags, ['fr', 'src3'])")(lambda s, d: search.with_filters(docs(s, d), None, ["fr", "src3"], False).select("_key"))
query("FLT-05", "SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 0)")(
    lambda s, d: table(s, d, "documents").join(table(s, d, "labels").filter("quality = 0"), "doc_id", "left_semi").select("doc_id", "lang")
)
query("FLT-07", "SELECT doc_id, lang, source FROM documents WHERE lang = 'de' AND source = 'src3'")(lambda s, d: search.matching(table(s, d, "documents"), lang="de", source="src3", text=None).select("doc_id", "lang", "source"))
query("FLT-08", "SELECT item_id::VARCHAR AS _key, text FROM benchmark WHERE contains(lower(text), 'tion') OR contains(lower(text), '50%') ORDER BY _key LIMIT 10")(
    lambda s, d: search.any_keyword(table(s, d, "benchmark").select(F.col("item_id").cast("string").alias("_key"), "text"), ["TION", "50%"], ["text"], 10)
)
query("FLT-10", f"WITH {PLACES} SELECT _key, _to FROM edges WHERE split_part(_to, '/', 1) = 'nation'")(lambda s, d: place_edges(s, d).filter(text.collection_of(F.col("_to")) == "nation").select("_key", "_to"))
query("FLT-11", "SELECT doc_id::VARCHAR AS _key, round(4.0::DOUBLE / length(text), 9) AS relevance FROM documents WHERE contains(lower(text), 'ther')")(
    lambda s, d: rounded(search.substring_search(plain_docs(s, d), "Ther").select("_key", "relevance"), "relevance", digits=9)
)
query("FLT-13", "SELECT doc_id FROM documents WHERE starts_with(text, 'The')")(lambda s, d: table(s, d, "documents").filter(F.startswith("text", F.lit("The"))).select("doc_id"))

# ---- full-text search

query("TXT-01", f"WITH {DOCS}, {bm25_sql(TERMS, FIELDS)} SELECT _key, round(score, 6) AS score FROM scored WHERE score >= 0.1 ORDER BY scored.score DESC, _key LIMIT 10")(
    lambda s, d: rounded(textindex.hits(text_index(s, d), ASK), "score")
)
query("TXT-02", f"WITH {DOCS}, {bm25_sql(TERMS, ['content'])} SELECT _key, round(score, 6) AS score FROM scored WHERE n_chars > 500 AND list_contains(tags, 'en') ORDER BY scored.score DESC, _key LIMIT 20 OFFSET 5")(
    lambda s, d: rounded(textindex.hits(text_index(s, d), ASK, 0.0, 20, 5, ["content"], allowed=search.with_filters(docs(s, d), "n_chars > 500", ["en"])), "score")
)
query("TXT-03", f"WITH {DOCS}, {bm25_sql(TERMS, FIELDS)} SELECT count(*) AS total FROM scored WHERE score >= 0.1")(lambda s, d: textindex.total(text_index(s, d), ASK))
query("DDL-05", f"WITH {DOCS}, {bm25_sql(TERMS, FIELDS)} SELECT _key, round(score, 6) AS score FROM scored")(
    lambda s, d: rounded(textindex.scores(index := text_index(s, d), ASK).join(index.table("documents"), ["segment", "doc"]).select("_key", "score"), "score")
)
query("TXT-04")(lambda s, d: textindex.keyword_hits(text_index(s, d), "Stand", 80.0, 20).select("_key", F.round("keyword_score", 6).alias("keyword_score")))
query("TXT-07", f"""WITH {DOCS} SELECT _key, array_to_string(tags, ',') AS tags, round((list_contains(tags, 'en')::INT + list_contains(tags, 'src0')::INT + list_contains(tags, 'q0')::INT) / 3.0::DOUBLE, 6) AS tag_match_score
FROM docs WHERE list_has_any(tags, ['en', 'src0', 'q0']) ORDER BY _key LIMIT 40 OFFSET 3""")(
    lambda s, d: rounded(search.tag_search(docs(s, d), ["en", "src0", "q0"], limit=40, offset=3, fields=["tags"]).withColumn("tags", F.array_join("tags", ",")), "tag_match_score")
)

# ---- vectors

COS = "list_cosine_similarity(embedding::DOUBLE[], q::DOUBLE[])"
query("VEC-02", f"WITH {VECTORS}, {ASKED} SELECT _key, round({COS}, 6) AS score FROM vectors, asked WHERE {COS} >= 0.1 ORDER BY {COS} DESC, _key LIMIT 10")(
    lambda s, d: rounded(search.semantic_search(vectors(s, d), query_vector(s, d), min_score=0.1).select("_key", "score"), "score")
)
query("VEC-03", f"WITH {VECTORS}, {ASKED} SELECT _key, label, round({COS}, 6) AS score FROM vectors, asked WHERE label < 4 AND {COS} >= 0.05 ORDER BY {COS} DESC, _key LIMIT 15")(
    lambda s, d: rounded(search.semantic_search(vectors(s, d), query_vector(s, d), filter_expr="label < 4", min_score=0.05, top_n=15).select("_key", "label", "score"), "score")
)
query("VEC-05", f"WITH {VECTORS}, {ASKED} SELECT _key, round({COS}, 6) AS score FROM vectors, asked")(
    lambda s, d: vectors(s, d).select("_key", F.round(vector.cosine_to(F.col("embedding"), query_vector(s, d)), 6).alias("score"))
)
query("VEC-06", f"WITH {VECTORS}, {ASKED} SELECT _key, round({COS}, 6) AS score FROM vectors, asked WHERE {COS} > 0 ORDER BY {COS} DESC, _key LIMIT 25")(
    lambda s, d: rounded(search.simple_vector_search(vectors(s, d), query_vector(s, d), limit=25).select("_key", "score"), "score")
)
for _name, _metric, _sql in (("VEC-10-dot", "dot", "list_inner_product(embedding::DOUBLE[], q::DOUBLE[])"), ("VEC-10-l2", "l2", "-pow(list_distance(embedding::DOUBLE[], q::DOUBLE[]), 2)")):
    query(_name, f"WITH {VECTORS}, {ASKED} SELECT _key, round({_sql}, 5) AS score FROM vectors, asked ORDER BY {_sql} DESC, _key LIMIT 10")(
        lambda s, d, m=_metric: rounded(search.semantic_search(vectors(s, d), query_vector(s, d), min_score=-1e9, metric=m).select("_key", "score"), "score", digits=5)
    )
query("VEC-14")(lambda s, d: table(s, d, "benchmark").select("item_id", F.transform(F.slice(vector.embed("text"), 1, 3), lambda x: F.round(x, 9)).alias("head")))
query("VEC-15", "SELECT vec_id, (len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0) AS valid FROM embeddings")(
    lambda s, d: vectors(s, d).select("vec_id", vector.valid(F.col("embedding"), 64).alias("valid"))
)
query("VEC-16", "SELECT vec_id, round(list_aggregate(list_transform(list_transform(embedding, lambda x: (3 * x)::DOUBLE), lambda x: x * x), 'sum') / list_aggregate(list_transform(list_transform(embedding, lambda x: (3 * x)::DOUBLE), lambda x: x * x), 'sum'), 3) AS size FROM embeddings")(
    lambda s, d: vectors(s, d).select("vec_id", F.round(vector.norm(vector.normalized(F.transform("embedding", lambda x: x * 3))), 3).alias("size"))
)
query("VEC-18", "SELECT CASE WHEN label < 3 THEN 'dimension 64 instead of 32' ELSE NULL END AS reason, count(*) AS n FROM embeddings GROUP BY 1")(
    lambda s, d: vectors(s, d).select(F.when(F.col("label") < 3, vector.problem(F.col("embedding"), 32)).otherwise(vector.problem(F.col("embedding"), 64)).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))
)
query("VEC-19", "SELECT len(embedding)::BIGINT AS dimensions, count(*) AS rows FROM embeddings GROUP BY 1")(lambda s, d: store.dimension_report(vectors(s, d)))
query("VEC-20", f"WITH {VECTORS}, {ASKED} SELECT _key, round({COS}, 6) AS score FROM vectors, asked ORDER BY {COS} DESC, _key LIMIT 5")(
    lambda s, d: rounded(search.semantic_search(vectors(s, d), query_vector(s, d), min_score=-2.0, top_n=5).select("_key", "score"), "score")
)
query("VEC-21", "SELECT vec_id, round(list_min(embedding)::DOUBLE, 5) AS min, round(list_max(embedding)::DOUBLE, 5) AS max, round(list_avg(embedding::DOUBLE[]), 5) AS mean, round(list_stddev_pop(embedding::DOUBLE[]), 5) AS std, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 5) AS norm FROM embeddings")(
    lambda s, d: rounded(vectors(s, d).select("vec_id", vector.stats(F.col("embedding")).alias("x")).select("vec_id", *(F.col(f"x.{c}").cast("double").alias(c) for c in ("min", "max", "mean", "std", "norm"))), "min", "max", "mean", "std", "norm", digits=5)
)
query("VEC-22", "SELECT vec_id, '[' || printf('%.2f, %.2f', embedding[1]::DOUBLE, embedding[2]::DOUBLE) || ', ... +' || (len(embedding) - 2) || ' more]' AS shown FROM embeddings")(
    lambda s, d: vectors(s, d).select("vec_id", vector.display(F.col("embedding"), 2, 2).alias("shown"))
)
TOP = f"top AS (SELECT label, {COS} AS score FROM vectors, asked ORDER BY score DESC, _key LIMIT {{k}})"
query("VEC-23", f"WITH {VECTORS}, {ASKED}, {TOP.format(k=25)}, votes AS (SELECT label, sum(score * score) AS v, count(*) AS n FROM top WHERE score > 0 GROUP BY label) SELECT arg_max(label, (v, -label)) AS label, round(max(v) / sum(v), 6) AS confidence, (max(v) / sum(v) >= 0.7 AND sum(n) >= 25) AS auto_accept FROM votes")(
    lambda s, d: rounded(search.knn_vote(vectors(s, d), query_vector(s, d)), "confidence")
)
query("VEC-24", f"WITH {VECTORS}, {ASKED}, {TOP.format(k=3)} SELECT (count(*) FILTER (label = 1) * 2 >= count(*)) AS positive FROM top")(lambda s, d: search.knn_majority(vectors(s, d), query_vector(s, d)))

# ---- hybrid ranking

BM, SEM = "bm AS (SELECT _key, row_number() OVER (ORDER BY score DESC, _key) AS r FROM scored WHERE score >= 0.1 QUALIFY r <= 20)", f"sem AS (SELECT _key, row_number() OVER (ORDER BY {COS} DESC, _key) AS r FROM vectors, asked WHERE _key IN (SELECT _key FROM docs) AND {COS} >= 0.05 QUALIFY r <= 20)"
FUSED = "(w1 / (60 + coalesce(bm.r, (SELECT count(*) FROM bm) + 1)) + w2 / (60 + coalesce(sem.r, (SELECT count(*) FROM sem) + 1)))"


def _hybrid(s, d, weights, top_n=10):
    out = hybrid.hybrid_search(plain_docs(s, d), vectors(s, d), ASK, query_vector(s, d), min_score={"bm25": 0.1, "semantic": 0.05}, weights=weights, top_n=top_n, index=text_index(s, d))
    return rounded(out.select("_key", F.col("bm25_rank").cast("long").alias("bm25_rank"), F.col("semantic_rank").cast("long").alias("semantic_rank"), "hybrid_score"), "hybrid_score", digits=9)


for _name, _weights in (("HYB-01", None), ("HYB-06", {"bm25": 3.0, "semantic": 1.0})):
    _w1 = 0.5 if _weights is None else 0.75
    _f = FUSED.replace("w1", f"{_w1}::DOUBLE").replace("w2", f"{1 - _w1}::DOUBLE")
    query(_name, f"WITH {DOCS}, {bm25_sql(TERMS, FIELDS)}, {VECTORS}, {ASKED}, {BM}, {SEM} SELECT _key, bm.r AS bm25_rank, sem.r AS semantic_rank, round({_f}, 9) AS hybrid_score FROM bm FULL JOIN sem USING (_key) ORDER BY {_f} DESC, bm.r NULLS LAST, sem.r NULLS LAST, _key LIMIT 10")(
        lambda s, d, w=_weights: _hybrid(s, d, w)
    )


def graph_list(s, d):
    """The third list: the five nearest vectors as seeds, with the two that follow each by number."""
    seeds = search.semantic_search(vectors(s, d), query_vector(s, d), min_score=-2, top_n=5).select("_key", "score")
    related = seeds.select(F.col("_key").alias("seed"), F.explode(F.array(F.lit(1), F.lit(2))).alias("position")).select("seed", (F.col("seed").cast("int") + F.col("position")).cast("string").alias("_key"), "position")
    return hybrid.graph_candidates(seeds, related)


GRAPH_LIST = f"""seeds AS (SELECT _key, {COS} AS s FROM vectors, asked ORDER BY s DESC, _key LIMIT 5),
cand AS (SELECT _key, s, 0 AS p FROM seeds UNION ALL SELECT (_key::INT + k)::VARCHAR, 0.8::DOUBLE * s, k FROM seeds, (SELECT unnest([1, 2]) AS k)),
best AS (SELECT _key, max((s, -(p > 0)::INT, -p)) AS x FROM cand GROUP BY _key),
gr AS (SELECT _key, row_number() OVER (ORDER BY x DESC, _key) AS r FROM best)"""


def text_list(s, d, n=20):
    """The first list: documents by BM25 of their content."""
    return hybrid.ranked(textindex.hits(text_index(s, d), ASK, 0.0, n, fields=["content"]))


def vector_list(s, d, n=20):
    """The second list: vectors by cosine."""
    return hybrid.ranked(search.semantic_search(vectors(s, d), query_vector(s, d), min_score=-2.0, top_n=n))


def ranked_lists(n: int) -> str:
    """Both lists in SQL, as ``bm`` and ``sem``."""
    return f"{bm25_sql(TERMS, ['content'])}, bm AS (SELECT _key, row_number() OVER (ORDER BY score DESC, _key) AS r FROM scored QUALIFY r <= {n}), sem AS (SELECT _key, row_number() OVER (ORDER BY {COS} DESC, _key) AS r FROM vectors, asked QUALIFY r <= {n})"


def _three(s, d):
    lists = {"bm25": text_list(s, d), "semantic": vector_list(s, d), "graph": graph_list(s, d)}
    fused = hybrid.fuse(lists, hybrid.scaled(None, hybrid.THREE_WEIGHTS))
    return rounded(fused.orderBy(*hybrid.fused_order(list(lists))).limit(15).select("_key", "hybrid_score"), "hybrid_score", digits=9)


#: The fused score of lists, each with a weight; a key that a list lacks comes after its last.
fused_sql = lambda **weights: "(" + " + ".join(f"{w}::DOUBLE / (60 + coalesce({n}.r, (SELECT count(*) FROM {n}) + 1))" for n, w in weights.items()) + ")"
_rrf = fused_sql(bm=0.4, sem=0.4, gr=0.2)
query("HYB-04", f"WITH {DOCS}, {VECTORS}, {ASKED}, {ranked_lists(20)}, {GRAPH_LIST} SELECT _key, round({_rrf}, 9) AS hybrid_score FROM bm FULL JOIN sem USING (_key) FULL JOIN gr USING (_key) ORDER BY {_rrf} DESC, bm.r NULLS LAST, sem.r NULLS LAST, gr.r NULLS LAST, _key LIMIT 15")(_three)

# ---- joins

query("JON-01", "SELECT d.doc_id, e.label, d.lang FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id WHERE d.n_chars > 300")(
    lambda s, d: table(s, d, "embeddings").join(table(s, d, "documents").filter("n_chars > 300"), F.col("vec_id") == F.col("doc_id")).select("doc_id", "label", "lang")
)
query("JON-02", f"WITH {PLACES} SELECT e._key AS edge, e._to AS _id, c.c_name FROM edges e LEFT JOIN (SELECT 'customer/' || c_custkey AS _id, c_name FROM customer WHERE c_custkey % 2 = 0) c ON e._to = c._id WHERE e._from = 'nation/5'")(
    lambda s, d: graph.documents_for(place_edges(s, d), table(s, d, "customer").filter("c_custkey % 2 = 0").select(F.concat(F.lit("customer/"), "c_custkey").alias("_id"), "c_name"), "nation/5").select("edge", "_id", "c_name")
)
query("JON-03", f"WITH {TURNS} SELECT e._key AS edge, e._from AS _id, m.role FROM edges e LEFT JOIN (SELECT 'messages/' || conv_id || '-' || turn AS _id, role FROM conversations) m ON e._from = m._id WHERE e._to = 'messages/3-1'")(
    lambda s, d: graph.messages_for(turn_edges(s, d), table(s, d, "conversations").select(F.concat(F.lit("messages/"), F.concat_ws("-", "conv_id", "turn")).alias("_id"), "role"), "messages/3-1").select("edge", "_id", "role")
)
JON07 = "pairs AS (SELECT n.vec_id AS a, k.vec_id AS b, list_cosine_similarity(n.embedding::DOUBLE[], k.embedding::DOUBLE[]) AS score FROM embeddings n, embeddings k WHERE n.vec_id % 100 = 0 AND n.vec_id <> k.vec_id)"
query("JON-07", f"WITH {JON07} SELECT 'n' || a AS _from, 'n' || b AS _to, CASE WHEN score > 0.5 THEN 'strong_similar' ELSE 'similar' END AS type, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, 'n' || b) AS r FROM pairs WHERE score > 0.2) WHERE r <= 5")(
    lambda s, d: rounded(
        memory.similarity_edges(*((v := vectors(s, d).select(F.concat(F.lit("n"), "vec_id").alias("_key"), "embedding", "vec_id")).filter("vec_id % 100 = 0"), v), 0.2, 0.5).drop("rationale"), "score"
    )
)

# ---- graph

WALK = """walk AS (
    SELECT '{start}' AS vertex, 0 AS depth, []::VARCHAR[] AS path, NULL::VARCHAR AS edge
    UNION ALL SELECT s.dst, w.depth + 1, list_append(w.path, s.edge), s.edge FROM walk w JOIN steps s ON s.src = w.vertex WHERE w.depth < {depth} AND NOT list_contains(w.path, s.edge))"""
OUT = "steps AS (SELECT _from AS src, _to AS dst, _key AS edge FROM edges)"
ANY = "steps AS (SELECT _from AS src, _to AS dst, _key AS edge FROM edges UNION ALL SELECT _to, _from, _key FROM edges)"
one = lambda s, v: s.createDataFrame([(v,)], "_id string")

query("GRF-01", f"WITH RECURSIVE {PLACES}, {OUT}, {WALK.format(start='region/1', depth=2)} SELECT vertex, edge, depth FROM walk WHERE depth >= 1")(
    lambda s, d: graph.traverse(place_edges(s, d), one(s, "region/1"), 1, 2).select("vertex", "edge", "depth")
)
query("GRF-01-any", f"WITH RECURSIVE {TURNS}, {ANY}, {WALK.format(start='messages/2-1', depth=3)} SELECT vertex, edge, depth FROM walk")(
    lambda s, d: graph.traverse(turn_edges(s, d), one(s, "messages/2-1"), 0, 3, "ANY").select("vertex", "edge", "depth")
)
#: Each kind of vertex stands on one level, so a level is what the one before leads to.
_by = "arg_min(p.path || '>' || e._to, (e._key, e._from)) AS path, min(e._key) AS edge"
_levels = ", ".join(f"l{k} AS (SELECT e._to AS vertex, {_by} FROM l{k - 1} p JOIN trade e ON e._from = p.vertex GROUP BY e._to)" for k in range(1, 6))
query("GRF-01-deep", f"WITH {TRADE}, l0 AS (SELECT 'region/1' AS vertex, 'region/1' AS path), {_levels} " + " UNION ALL ".join(f"SELECT vertex, edge, {k} AS depth, path FROM l{k}" for k in range(1, 6)))(
    lambda s, d: graph.traverse(trade_edges(s, d), one(s, "region/1"), 1, 5, "OUTBOUND", "global").select("vertex", "edge", "depth", F.array_join("vertices", ">").alias("path"))
)
query("GRF-02", f"WITH {PLACES} SELECT _key, _from, _to, type FROM edges WHERE (_from = 'nation/3' OR _to = 'nation/3') AND type = 'HAS_NATION'")(
    lambda s, d: graph.relationships(place_edges(s, d), "nation/3", "HAS_NATION").select("_key", "_from", "_to", "type")
)
query("GRF-03", f"WITH RECURSIVE {PLACES}, {OUT}, {WALK.format(start='region/2', depth=2)} SELECT vertex, depth FROM walk WHERE depth >= 1 AND split_part(vertex, '/', 1) = 'customer'")(
    lambda s, d: graph.related_documents(place_edges(s, d), one(s, "region/2"), "customer", "sideways", 2).select("vertex", "depth")
)
_seeds = lambda s: s.createDataFrame([("messages/0-1",), ("messages/1-0",), ("messages/4-2",)], "_id string")
SEEDED = f"""seeds AS (SELECT unnest(['messages/0-1', 'messages/1-0', 'messages/4-2']) AS seed), {ANY},
walk AS (SELECT seed, seed AS vertex, 0 AS depth FROM seeds UNION ALL SELECT w.seed, s.dst, w.depth + 1 FROM walk w JOIN steps s ON s.src = w.vertex WHERE w.depth < 2),
near AS (SELECT seed, vertex, min(depth) AS depth FROM walk GROUP BY seed, vertex HAVING min(depth) > 0)"""
query("GRF-04", f"WITH RECURSIVE {TURNS}, {SEEDED} SELECT seed, vertex, depth, row_number() OVER (PARTITION BY seed ORDER BY depth, vertex)::INT AS position FROM near")(
    lambda s, d: graph.graph_rag(turn_edges(s, d), _seeds(s), 2).select("seed", "vertex", "depth", F.col("position").cast("int").alias("position"))
)
query("AGG-03", f"WITH RECURSIVE {TURNS}, {SEEDED}, c AS (SELECT seed, count(near.vertex) AS n FROM seeds LEFT JOIN near USING (seed) GROUP BY seed) SELECT count(*) AS seeds, sum(n)::BIGINT AS related, max(n) AS most, round(avg(n), 6) AS mean FROM c")(
    lambda s, d: rounded(graph.related_stats(graph.graph_rag(turn_edges(s, d), _seeds(s), 2), _seeds(s)), "mean")
)
query("GRF-08", f"WITH {PLACES} SELECT _from, _to, type FROM edges UNION ALL SELECT 'customer/' || o_custkey, 'orders/' || o_orderkey, 'PLACED' FROM orders")(
    lambda s, d: store.insert(place_edges(s, d), graph.new_edges(table(s, d, "orders").select(F.concat(F.lit("customer/"), "o_custkey").alias("_from"), F.concat(F.lit("orders/"), "o_orderkey").alias("_to")), "PLACED")).select("_from", "_to", "type")
)
query("GRF-10", f"WITH {PLACES} SELECT _key FROM edges WHERE _key <> 'n4'")(lambda s, d: graph.without_edge(place_edges(s, d), "n4").select("_key"))
query("GRF-11", f"WITH {PLACES} SELECT _key FROM edges WHERE NOT (_from = 'region/1' AND _to = 'nation/1')")(lambda s, d: graph.without_edges_between(place_edges(s, d), "region/1", "nation/1").select("_key"))
query("GRF-12", f"WITH {PLACES} SELECT _key FROM edges WHERE _from <> 'nation/7' AND _to <> 'nation/7'")(lambda s, d: graph.without_vertex(place_edges(s, d), "nation/7").select("_key"))
query("GRF-15", f"WITH {PLACES} SELECT _key, _from, _to FROM edges UNION ALL SELECT 'x' || n_nationkey, 'nation/' || n_nationkey, 'region/' || (n_nationkey % 7) FROM nation WHERE n_nationkey % 7 < 5 AND n_nationkey > 3")(
    lambda s, d: graph.insert_checked(
        place_edges(s, d).select("_key", "_from", "_to"),
        table(s, d, "nation").select(F.when(F.col("n_nationkey") <= 3, F.concat(F.lit("n"), "n_nationkey")).otherwise(F.concat(F.lit("x"), "n_nationkey")).alias("_key"), F.concat(F.lit("nation/"), "n_nationkey").alias("_from"), F.concat(F.lit("region/"), F.col("n_nationkey") % 7).alias("_to")),
        table(s, d, "nation").select(F.concat(F.lit("nation/"), "n_nationkey").alias("_id")).unionByName(table(s, d, "region").select(F.concat(F.lit("region/"), "r_regionkey").alias("_id"))),
    ).select("_key", "_from", "_to")
)

# ---- changes: the collection after them

_nations = lambda s, d: table(s, d, "nation").select(F.col("n_nationkey").cast("string").alias("_key"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))
_changes = lambda s, d: table(s, d, "nation").filter("n_nationkey % 3 = 0").select(F.when(F.col("n_nationkey") > 12, F.concat(F.lit("new"), "n_nationkey")).otherwise(F.col("n_nationkey").cast("string")).alias("_key"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("N-"), "n_name")).alias("name"))
NATIONS = "n AS (SELECT n_nationkey::VARCHAR AS _key, n_name AS name, n_regionkey AS region FROM nation), c AS (SELECT CASE WHEN n_nationkey > 12 THEN 'new' || n_nationkey ELSE n_nationkey::VARCHAR END AS _key, CASE WHEN n_nationkey % 2 = 0 THEN 'N-' || n_name END AS name FROM nation WHERE n_nationkey % 3 = 0)"
query("DML-01", f"WITH {NATIONS} SELECT _key, name, region FROM n UNION ALL SELECT 'z' || _key, name, NULL FROM c")(lambda s, d: store.insert(_nations(s, d), _changes(s, d).withColumn("_key", F.concat(F.lit("z"), "_key"))))
query("DML-03", f"WITH {NATIONS} SELECT _key, coalesce(c.name, n.name) AS name, region FROM n FULL JOIN c USING (_key)")(lambda s, d: store.upsert(_nations(s, d), _changes(s, d)))
query("DML-04", f"WITH {NATIONS} SELECT n._key, coalesce(c.name, n.name) AS name, region FROM n LEFT JOIN c USING (_key)")(lambda s, d: store.update(_nations(s, d), _changes(s, d)))
query("DML-05", f"WITH {NATIONS} SELECT * FROM n WHERE _key NOT IN (SELECT _key FROM c)")(lambda s, d: store.delete(_nations(s, d), _changes(s, d)))
query("DML-06-ignore", f"WITH {NATIONS} SELECT * FROM n UNION ALL SELECT _key, name, NULL FROM c WHERE _key NOT IN (SELECT _key FROM n)")(lambda s, d: store.bulk_import(_nations(s, d), _changes(s, d), "ignore"))
query("DML-06-replace", f"WITH {NATIONS} SELECT * FROM n WHERE _key NOT IN (SELECT _key FROM c) UNION ALL SELECT _key, name, NULL FROM c")(lambda s, d: store.bulk_import(_nations(s, d), _changes(s, d), "replace"))
query("DML-06-update", f"WITH {NATIONS} SELECT _key, coalesce(c.name, n.name) AS name, region FROM n FULL JOIN c USING (_key)")(lambda s, d: store.bulk_import(_nations(s, d), _changes(s, d), "update"))
query("DML-11", "SELECT DISTINCT ON (_key) replace(lang || '_' || source || '_' || (doc_id % 3), ' ', '_') AS _key, max(doc_id) OVER (PARTITION BY lang, source, doc_id % 3) AS latest FROM documents")(
    lambda s, d: table(s, d, "documents").select(text.lesson_key(F.col("lang"), F.col("source"), (F.col("doc_id") % 3).cast("string")).alias("_key"), "doc_id").groupBy("_key").agg(F.max("doc_id").alias("latest"))
)

# ---- messages and memory

MESSAGES = "m AS (SELECT conv_id || '-' || turn AS _key, conv_id::VARCHAR AS conversation_id, turn, role AS message_type, text AS content, lag(conv_id || '-' || turn) OVER (PARTITION BY conv_id ORDER BY turn) AS previous_message_key FROM conversations)"
PAIRS = "p AS (SELECT conv_id, turn, text AS u, lead(role) OVER w AS r2, lead(text) OVER w AS a, lead(turn) OVER w AS t2, role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), x AS (SELECT * FROM p WHERE role = 'user' AND r2 = 'assistant')"
query("MEM-01", f"WITH {MESSAGES} SELECT * FROM m")(lambda s, d: memory.messages(table(s, d, "conversations")))
query("MEM-04", f"WITH {MESSAGES} SELECT _key, turn, message_type FROM m WHERE conversation_id = '5' ORDER BY turn DESC LIMIT 3 OFFSET 1")(
    lambda s, d: memory.conversation_messages(memory.messages(table(s, d, "conversations")), "5", "turn", "DESC", 3, 1).select("_key", "turn", "message_type")
)
query("MEM-03", f"WITH {MESSAGES} SELECT _key FROM m WHERE _key <> '3-1'")(lambda s, d: memory.without_message(memory.messages(table(s, d, "conversations")), turn_edges(s, d), "3-1")[0].select("_key"))
query("MEM-05", f"WITH {TURNS} SELECT _key FROM edges WHERE _from NOT LIKE 'messages/5-%' AND _to NOT LIKE 'messages/5-%'")(lambda s, d: memory.without_conversation(memory.messages(table(s, d, "conversations")), turn_edges(s, d), "5")[1].select("_key"))
query("AGG-02", "SELECT count(*) AS deleted FROM conversations WHERE conv_id = 5")(lambda s, d: memory.without_conversation(memory.messages(table(s, d, "conversations")), turn_edges(s, d), "5")[2])
query("MEM-06", f"WITH {PAIRS} SELECT conv_id || '-' || turn AS _key, conv_id::VARCHAR AS conversation_id, 'User: ' || u || chr(10) || 'Agent: ' || a AS content, CASE WHEN length(u || ' ' || a) > 100 THEN substr(u || ' ' || a, 1, 97) || '...' ELSE u || ' ' || a END AS summary FROM x")(
    lambda s, d: memory.memories(table(s, d, "conversations"))
)
query("MEM-06-edges", f"""WITH {PAIRS} SELECT 'messages/' || conv_id || '-' || t2 AS _from, 'messages/' || conv_id || '-' || turn AS _to, 'RESPONSE_TO' AS type FROM x
UNION ALL SELECT 'messages/' || conv_id || '-' || turn, 'memories/' || conv_id || '-' || turn, 'PART_OF' FROM x UNION ALL SELECT 'messages/' || conv_id || '-' || t2, 'memories/' || conv_id || '-' || turn, 'PART_OF' FROM x""")(
    lambda s, d: memory.memory_edges(table(s, d, "conversations"))
)
query("MEM-07", "SELECT doc_id, CASE WHEN length(text) > 100 THEN substr(text, 1, 97) || '...' ELSE text END AS summary FROM documents")(lambda s, d: table(s, d, "documents").select("doc_id", text.shorten(F.col("text")).alias("summary")))
query("MEM-10", f"WITH {MESSAGES} SELECT _key, content FROM m WHERE conversation_id = '7' ORDER BY turn LIMIT 10")(lambda s, d: memory.conversation_context(memory.messages(table(s, d, "conversations")), "7").select("_key", "content"))


@query("GRF-07", """WITH e AS (SELECT 'm' || a.vec_id || '_' || b.vec_id AS _key, 'memories/' || a.vec_id AS _from, 'memories/' || b.vec_id AS _to, CASE WHEN b.vec_id % 2 = 0 THEN 'even' ELSE 'odd' END AS type, a.vec_id + b.vec_id AS timestamp
    FROM embeddings a JOIN embeddings b ON a.vec_id = (b.vec_id - 1) // 2 WHERE b.vec_id > 0),
s AS (SELECT _from AS src, _to AS dst, _key AS edge FROM e UNION ALL SELECT _to, _from, _key FROM e),
w AS (SELECT s1.dst AS vertex, s1.edge, 1 AS depth FROM s s1 WHERE s1.src = 'memories/5' UNION ALL SELECT s2.dst, s2.edge, 2 FROM s s1 JOIN s s2 ON s1.dst = s2.src AND s1.edge <> s2.edge WHERE s1.src = 'memories/5')
SELECT vertex, w.edge, depth, type, timestamp AS edge_time FROM w JOIN e ON w.edge = e._key WHERE type = 'odd' ORDER BY depth, edge_time DESC, vertex, edge LIMIT 10""")
def _related(s, d):
    v = table(s, d, "embeddings").select("vec_id")
    child = v.select(F.col("vec_id").alias("b")).filter("b > 0").select("b", F.floor((F.col("b") - 1) / 2).alias("a"))
    ident = lambda c: F.concat(F.lit("memories/"), c)
    edges = child.select(F.concat(F.lit("m"), "a", F.lit("_"), "b").alias("_key"), ident("a").alias("_from"), ident("b").alias("_to"), F.when(F.col("b") % 2 == 0, "even").otherwise("odd").alias("type"), (F.col("a") + F.col("b")).alias("timestamp"))
    return memory.related_memories(edges, one(s, "memories/5"), "odd", 2).select("vertex", "edge", "depth", "type", "edge_time")


# ---- aggregations, sorts, sets

query("AGG-04", "SELECT event_type AS status, count(*) AS n FROM events GROUP BY event_type")(lambda s, d: table(s, d, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n")))
query("AGG-08", "SELECT source, count(*) AS files, sum(strlen(text))::BIGINT AS bytes FROM documents GROUP BY source")(
    lambda s, d: table(s, d, "documents").groupBy("source").agg(F.count("*").alias("files"), F.sum(F.octet_length("text")).alias("bytes"))
)
query("SRT-03", "SELECT doc_id, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 100 OFFSET 20")(lambda s, d: table(s, d, "documents").select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").offset(20).limit(100))
query("SRT-05")(lambda s, d: memory.sample(plain_docs(s, d), 20).select("_key"))
query("SET-02", "SELECT lang, source, min(doc_id) AS doc_id FROM documents GROUP BY lang, source")(lambda s, d: table(s, d, "documents").groupBy("lang", "source").agg(F.min("doc_id").alias("doc_id")))
query("SET-03", f"WITH {DOCS} SELECT _key, array_to_string(list_sort(list_intersect(tags, ['en', 'src0', 'q1'])), ',') AS common FROM docs")(
    lambda s, d: docs(s, d).select("_key", F.array_join(F.array_sort(F.array_intersect("tags", F.lit(["en", "src0", "q1"]))), ",").alias("common"))
)
