"""Registered queries of the further extraction, table, chunk, callback, batch and image operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import images, text
from marlstone.operators import batch, chunk, code, declared, extract, memory, store, tables
from marlstone.plans.content_queries import SQL as CONTENT_SQL
from marlstone.plans.content_queries import QUALITY, TABLES, _chain, _docs, _tables, chunks_sql
from marlstone.plans.fixtures import table

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


_nation = lambda s, d, *parts: table(s, d, "nation").select("n_nationkey", F.concat(*(F.col(p[1:]) if p[0] == "$" else F.lit(p) for p in parts)).alias("t"))

# ---- structured texts


def paths_sql() -> str:
    """Common table expressions that end in ``placed`` (id, position, number, path): of each level above a heading the last since a higher one."""
    own, rest = r"regexp_extract(title, '^([0-9]+(?:[.][0-9]+)*)[.]?\s', 1)", r"trim(regexp_replace(regexp_replace(title, '^[0-9]+(?:[.][0-9]+)*[.]?\s*', ''), '[\x00-\x1f\x7f]', '', 'g'), ' ')"
    plain = r"trim(regexp_replace(title, '[\x00-\x1f\x7f]', '', 'g'), ' ')"
    return f"""heads AS ({CONTENT_SQL['EXT-04']}),
named AS (SELECT id, position, level, {own} AS own, CASE WHEN {own} <> '' THEN {rest} ELSE {plain} END AS t FROM heads),
e AS (SELECT id, position, level, own, CASE WHEN t = '' THEN 'Unnamed Section' ELSE t END AS title FROM named),
since AS (SELECT r.id, r.position, k, coalesce(max(p.position) FILTER (p.level < k), -1) AS any_above, coalesce(max(p.position) FILTER (p.level < k AND p.own = ''), -1) AS counted_above
    FROM e r JOIN e p ON p.id = r.id AND p.position <= r.position, range(1, 7) ks(k) WHERE k <= r.level GROUP BY ALL),
parts AS (SELECT s.id, s.position, k, arg_max(p.title, p.position) FILTER (p.level = k AND p.position > any_above) AS title, count(*) FILTER (p.level = k AND p.own = '' AND p.position > counted_above) AS n
    FROM since s JOIN e p ON p.id = s.id AND p.position <= s.position GROUP BY ALL),
placed AS (SELECT id, position, CASE WHEN any_value(own) <> '' THEN any_value(own) ELSE coalesce(string_agg(n::VARCHAR, '.' ORDER BY k) FILTER (n > 0), '') END AS number,
    list(parts.title ORDER BY k) FILTER (parts.title IS NOT NULL) AS path FROM parts JOIN e USING (id, position) GROUP BY id, position)"""


@query("EXT-03", f"WITH {paths_sql()} SELECT id, position::INT AS first_line, number, array_to_string(list_transform(path, lambda p: sha256(p)), '>') AS section_hash_path FROM placed")
def _hierarchy(s, d):
    heads = extract.html_headings(table(s, d, "pages"), "page_id", "html")
    rows = heads.select("id", F.col("position").cast("int").alias("first_line"), F.lit("heading").alias("type"), F.col("title").alias("content"), "level")
    return extract.sections(rows).select("id", "first_line", "number", F.array_join(F.transform("path", lambda p: F.sha2(p, 256)), ">").alias("section_hash_path"))


query("EXT-05", "SELECT n_nationkey AS id, 0::BIGINT AS position, 'x = ' || n_regionkey AS code, 'About ' || n_name || ':' AS description FROM nation")(
    lambda s, d: extract.rst_rows(_nation(s, d, "First words.\n\nAbout ", "$n_name", "::\n\n    x = ", "$n_regionkey", "\n\nEnd\n"), "n_nationkey", "t")
)
query("EXT-06", "SELECT doc_id, '```python' || chr(10) || text || chr(10) || '```' AS fenced FROM documents")(
    lambda s, d: _docs(s, d).select("doc_id", extract.backtick_fences(F.concat(F.lit("~~~ {.python .numberLines}\n"), "text", F.lit("\n~~~~"))).alias("fenced"))
)

CODE = {"javascript": "function f{}(a, b) {{ return a; }}", "java": "public static int f{}(int a, String b) {{ return a; }}", "go": "func (r *R) f{}(a int, b string) int {{}}", "rust": "pub fn f{}<T>(a: T, b: i32) -> T {{ a }}", "c": "static int f{}(int a, char *b) {{ return a; }}"}
SHOWN = {"javascript": "a|b", "java": "int a|String b", "go": "a int|b string", "rust": "a: T|b: i32", "c": "int a|char *b"}


@query("EXT-08", " UNION ALL ".join(f"SELECT '{lang}' AS language, 'f' || n_nationkey AS name, '{shown}' AS parameters FROM nation" for lang, shown in SHOWN.items()))
def _declared(s, d):
    out = None
    for lang, body in CODE.items():
        before, after = body.format("\0").split("\0")
        found = _nation(s, d, before, "$n_nationkey", after).select(F.lit(lang).alias("language"), F.inline(declared.functions_in(F.col("t"), lang))).withColumn("parameters", F.array_join("parameters", "|"))
        out = found if out is None else out.unionByName(found)
    return out


query("EXT-08-comments", """SELECT 'f' || doc_id AS name, 'a|b = "(,)"' AS parameters, doc_id % 7 AS depth FROM documents""")(
    # a text as a comment before a function, in as many blocks
    lambda s, d: table(s, d, "documents")
    .select(declared.declared(F.concat(F.lit("/* "), F.replace("text", F.lit("*/"), F.lit("")), F.lit(" function no() {} */\n"), F.repeat(F.lit("{ "), (F.col("doc_id") % 7).cast("int")), F.lit("function f"), "doc_id", F.lit('(a, // no(\n b = "(,)") {')), "javascript")[0].alias("f"))
    .select("f.name", F.array_join("f.shown", "|").alias("parameters"), F.col("f.depth").cast("long").alias("depth"))
)
query("EXT-47", "SELECT n_nationkey, 'x' || n_nationkey AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'int' END AS type, CASE WHEN n_nationkey % 3 = 0 THEN n_regionkey::VARCHAR END AS default_value FROM nation")(
    lambda s, d: table(s, d, "nation")
    .select("n_nationkey", code.parameter(F.concat(F.lit("x"), "n_nationkey", F.when(F.col("n_nationkey") % 2 == 0, ": int").otherwise(""), F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit(" = "), "n_regionkey")).otherwise(""))).alias("p"))
    .select("n_nationkey", "p.name", "p.type", F.col("p.default").alias("default_value"))
)
query("EXT-13", "SELECT n_nationkey AS id, node, parent, type FROM nation, (VALUES (0, NULL, 'heading'), (1, 0, 'paragraph'), (3, 0, 'heading'), (4, 3, 'code'), (7, NULL, 'heading'), (8, 7, 'paragraph')) v(node, parent, type)")(
    lambda s, d: extract.nodes(extract.blocks(_nation(s, d, "# A ", "$n_name", "\nwords\n\n## B\n```python\nx = 1\n```\n# C\nend ", "$n_nationkey"), "n_nationkey", "t")).select("id", "node", "parent", "type")
)
MIXED = ("# ", "$n_name", "\nwords\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n<!-- page: 2 -->\n```sql\nselect 1\n```\n\n![logo](x.png)\n<!-- page: 5 -->\nmore")
query("EXT-15", "SELECT conv_id AS id, turn AS page FROM conversations WHERE trim(text, ' ' || chr(10)) <> ''")(
    lambda s, d: extract.paged_rows(
        table(s, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda t: F.concat(F.lit("<!-- page: "), t["turn"], F.lit(" -->\n"), t["text"], F.lit("\n"))), "").alias("t")), "conv_id", "t"
    ).select("id", "page").distinct()
)
query("EXT-39", "SELECT n_nationkey AS id, page, position, type, CASE WHEN type = 'heading' THEN n_name ELSE content END AS content FROM nation, (VALUES (1, 1, 'heading', ''), (1, 2, 'text', 'words'), (1, 3, 'table', '| a | b |' || chr(10) || '|---|---|' || chr(10) || '| 1 | 2 |'), (2, 4, 'code', 'select 1'), (2, 5, 'image', '![logo](x.png)'), (5, 6, 'text', 'more')) v(page, position, type, content)")(
    lambda s, d: extract.paged_rows(_nation(s, d, *MIXED), "n_nationkey", "t").select("id", "page", "position", "type", "content")
)
query("EXT-17", "SELECT c_custkey AS id, 'table_' || n AS table_id, n::BIGINT AS page, 'k,v' AS header, CASE n WHEN 1 THEN c_name || ',1' ELSE '' END AS body FROM customer, (VALUES (1), (2)) v(n)")(
    lambda s, d: extract.json_tables(
        table(s, d, "customer").select("c_custkey", F.to_json(F.array(F.struct(F.lit(1).alias("page"), F.array(F.array(F.lit("k"), F.lit("v")), F.array("c_name", F.lit("1"))).alias("rows")), F.struct(F.lit(2).alias("page"), F.array(F.array(F.lit("k"), F.lit("v"))).alias("rows")))).alias("j")), "c_custkey", "j"
    ).select("id", "table_id", "page", F.array_join("header", ",").alias("header"), F.array_join(F.flatten("body"), ",").alias("body"))
)
query("EXT-45", r"SELECT page_id AS id, url AS original_source, 'p' AS html_selector, len(regexp_extract_all(html, '(?i)<p\b[^>]*>'))::BIGINT AS rows FROM pages WHERE regexp_matches(html, '(?i)<p\b[^>]*>')")(
    lambda s, d: extract.html_rows(table(s, d, "pages"), "page_id", "html", "url", "p").groupBy("page", "id", "original_source", "html_selector").agg(F.count("*").alias("rows")).drop("page")
)
query("EXT-46", "SELECT url AS file_path, 'page' AS type, NULL::VARCHAR AS language, length(html)::BIGINT AS characters FROM pages")(lambda s, d: extract.content_map(table(s, d, "pages"), "url", "html", "page").select("file_path", "type", "language", "characters"))


@query("EXT-31")
def _pipeline(s, d):
    files = _docs(s, d).select(F.concat("doc_id", F.lit(".md")).alias("path"), F.col("text").alias("content")).unionByName(table(s, d, "pages").select(F.concat("page_id", F.lit(".html")).alias("path"), F.col("html").alias("content")))
    return extract.pipeline(files, "thinghat eren")[1].select("_key", F.round("score", 6).alias("score"))


# ---- tables

BEFORE = "lag(header) OVER w AS h, lag(n) OVER w AS m, lag(page) OVER w AS p, lag(y1) OVER w AS b FROM t WINDOW w AS (PARTITION BY doc ORDER BY page, number)"
query("EXT-19", f"WITH {TABLES}, f AS (SELECT *, {BEFORE}) SELECT number, coalesce(header = h AND (abs(n - m) / greatest(n, m)::DOUBLE <= 0.5 OR m = 1), false) AS fits FROM f")(
    lambda s, d: tables.mergeable(_tables(s, d).withColumn("header", F.when(F.size("header") == 2, F.array(F.lit("part"), F.lit("qty"))).otherwise(F.col("header")))).select("number", "fits")
)
GEOMETRY = "g AS (SELECT doc, page, min(y0) AS top, max(y1) AS bottom, min(y0) - 10 AS top_margin, 100.0::DOUBLE - max(y1) + 10 AS bottom_margin FROM t GROUP BY doc, page)"
query("EXT-41", f"WITH {TABLES}, {GEOMETRY} SELECT doc, page, top AS content_top, bottom AS content_bottom, top_margin, bottom_margin FROM g")(lambda s, d: tables.page_geometry(_tables(s, d).withColumn("height", F.lit(100.0))))
query(
    "EXT-20",
    f"""WITH {TABLES}, {GEOMETRY}, j AS (SELECT t.*, g.top, g.bottom, g.top_margin, g.bottom_margin FROM t JOIN g USING (doc, page)),
f AS (SELECT *, lag(two) OVER w AS q, lag(page) OVER w AS p, lag(y1) OVER w AS b, lag(bottom) OVER w AS pb, lag(bottom_margin) OVER w AS pm FROM j WINDOW w AS (PARTITION BY doc ORDER BY page, number))
SELECT number, coalesce(CASE WHEN page = p THEN two = q AND abs(y0 - b) < 0.5 * abs(bottom - top) WHEN page = p + 1 THEN abs(y0 - top) < 0.5 OR (pb > pm AND top < top_margin) ELSE false END, false) AS joins FROM f""",
)(lambda s, d: tables.geometric_merges(t := _tables(s, d), tables.page_geometry(t.withColumn("height", F.lit(100.0))), 0.5, 0.5).select("number", "joins"))
query("EXT-34", f"WITH {TABLES} SELECT number, 'over ' || number AS above, 'Table ' || number AS below, 'Table ' || number AS title FROM t")(
    lambda s, d: tables.context(
        t := _tables(s, d).withColumn("page", F.col("number")),
        t.select("doc", "page", F.explode(F.array(*(F.struct((F.get("bbox", F.lit(side)) + off - 1).alias("top"), (F.get("bbox", F.lit(side)) + off).alias("bottom"), F.concat(F.lit(word), "number").alias("content")) for side, off, word in ((1, -250.0, "over "), (1, -150.0, "near "), (3, 250.0, "Table "))))).alias("x")).select("doc", "page", "x.*"),
        5,
        200.0,
    ).select("number", "above", "below", "title")
)
CHAIN = f"WITH {TABLES}, f AS (SELECT *, {BEFORE}), r AS (SELECT *, sum(CASE WHEN header = h AND page <= p + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY page, number) AS run FROM f)"
query("EXT-36", f"{CHAIN} SELECT doc, arg_min(number, (page, number)) AS first, min(page) AS first_page, max(page) AS last_page, string_agg(number::VARCHAR, ',' ORDER BY page, number) AS numbers, sum(n)::BIGINT AS rows FROM r GROUP BY doc, run")(
    lambda s, d: tables.merge_chain(_tables(s, d)).select("doc", "first", "first_page", "last_page", F.array_join(F.transform("numbers", lambda n: n.cast("string")), ",").alias("numbers"), F.size("body").cast("long").alias("rows"))
)
query("EXT-38", f"WITH {TABLES} SELECT doc || '-' || page || '-' || number AS table_id, CASE WHEN number % 5 = 1 THEN 'edited' ELSE 'extracted' END AS status, number % 5 <> 1 AS needs_review FROM t WHERE number % 5 <> 2")(
    lambda s, d: tables.as_rows(
        t := _tables(s, d), t.filter("number % 5 IN (1, 2)").select(F.concat_ws("-", "doc", "page", "number").alias("table_id"), F.when(F.col("number") % 5 == 1, "edited").otherwise("rejected").alias("status"), F.lit("by hand").alias("text"))
    ).select("table_id", "status", "needs_review")
)
query("AGG-07", f"WITH {TABLES} SELECT round(avg(0.4 * {QUALITY} + 0.3 + 0.3 * two::INT), 6) AS quality FROM t")(lambda s, d: tables.quality(_tables(s, d)).agg(F.round(F.avg("quality"), 6).alias("quality")))

# ---- chunks

query("CHK-01", f"WITH {chunks_sql(500)} SELECT id, section, chunk, code FROM chunked")(lambda s, d: chunk.chunk_rows(_docs(s, d), "doc_id", "text").select("id", "section", "chunk", "code"))
query("CHK-06", "SELECT doc_id AS id, length(text) // 4 AS code_token_count, sha256(text) AS section_id FROM documents")(lambda s, d: chunk.whole(_docs(s, d), "doc_id", "text").select("id", "code_token_count", "section_id"))
query("CHK-08", f"WITH {chunks_sql(50)} SELECT id, section, count(*) AS chunks, max(tokens) AS longest, sha256(string_agg(code, chr(10) ORDER BY chunk)) AS joined FROM chunked GROUP BY id, section")(
    lambda s, d: chunk.chunk_rows(_docs(s, d), "doc_id", "text", 50)
    .groupBy("id", "section")
    .agg(F.count("*").alias("chunks"), F.max("code_token_count").alias("longest"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "code"))), lambda c: c["code"]), "\n"), 256).alias("joined"))
)
query("TWN-08", f"""WITH {chunks_sql(500)}, n AS (SELECT id, count(*) AS chunks, count(DISTINCT section) AS sections FROM chunked GROUP BY id)
SELECT source || '/' || doc_id || CASE doc_id % 3 WHEN 0 THEN '.MD' WHEN 1 THEN '.py' ELSE '.txt' END AS path, CASE doc_id % 3 WHEN 0 THEN 'sections' WHEN 1 THEN 'metadata' ELSE 'chunks' END AS kind,
       CASE doc_id % 3 WHEN 0 THEN coalesce(sections, 0) WHEN 1 THEN 1 ELSE coalesce(chunks, 0) END AS parts FROM documents LEFT JOIN n ON id = doc_id""")(
    lambda s, d: chunk.process(_docs(s, d).select(F.concat("source", F.lit("/"), "doc_id", F.when(F.col("doc_id") % 3 == 0, ".MD").when(F.col("doc_id") % 3 == 1, ".py").otherwise(".txt")).alias("path"), F.col("text").alias("content")))
)

# ---- callbacks and batches


def _needs(n: int):
    """A model that gives a good answer after so many rounds of feedback as its question asks for."""

    def call(messages):
        wanted = int(messages[0]["content"])
        return "good" if (len(messages) - 1) // 2 >= wanted else "bad"

    return call


query("UDF-03", "SELECT item_id AS task_id, CASE WHEN item_id % 5 < 3 THEN 'success' ELSE 'error' END AS status, CASE WHEN item_id % 5 < 3 THEN 'good' ELSE 'Max retries (3) exceeded.' END AS result, least(item_id % 5, 3)::INT AS retry_count FROM benchmark")(
    lambda s, d: batch.call_with_retries(table(s, d, "benchmark").select(F.col("item_id").alias("task_id"), (F.col("item_id") % 5).cast("string").alias("question")), _needs(3), [lambda a: True if a == "good" else "it is bad"])
)
query("UDF-04", "SELECT * FROM (VALUES ('not_empty', true), ('json', true), ('other', false)) v(name, known)")(lambda s, d: s.createDataFrame([(n, batch.validator(n) is not None) for n in ("not_empty", "json", "other")], "name string, known boolean"))


@query("UDF-05", "SELECT * FROM (VALUES (0, 1.0::DOUBLE), (1, 2.0::DOUBLE)) v(attempt, waited)")
def _backoff(s, d):
    waited: list[float] = []
    left = [ValueError(), ValueError()]

    def action():
        if left:
            raise left.pop()
        return "done"

    if batch.with_backoff(action, sleep=waited.append) != "done":
        raise AssertionError("the third try gives a result")
    return s.createDataFrame(list(enumerate(waited)), "attempt int, waited double")


def _flaky():
    """A service that never gives an answer to some texts and a late one to others."""

    def service(text, attempt):
        if text == "never":
            raise batch.ServiceError(400)
        if text == "late" and attempt < 2:
            raise batch.ServiceError(503)
        return f"{text} after {attempt}"

    return service


query("UDF-06", "SELECT doc_id, CASE doc_id % 3 WHEN 1 THEN 'late after 2' WHEN 2 THEN 'now after 0' END AS answer, CASE WHEN doc_id % 3 = 0 THEN 'status 400' END AS service_error FROM documents")(
    lambda s, d: batch.call_service(_docs(s, d).select("doc_id", F.when(F.col("doc_id") % 3 == 0, "never").when(F.col("doc_id") % 3 == 1, "late").otherwise("now").alias("t")), "t", _flaky(), sleep=lambda _: None).select("doc_id", "answer", "service_error")
)
FAILS = "conv_id % 5 = 0 AND turn % 20"
query("DAG-03", f"SELECT CASE WHEN {FAILS} = 1 THEN 'error' WHEN {FAILS} = 2 THEN 'dependency_failed' WHEN {FAILS} > 2 THEN 'error' ELSE 'success' END AS status, count(*) AS n FROM conversations GROUP BY 1")(lambda s, d: batch.status_counts(batch.run(_chain(s, d))))
query("DAG-06", "SELECT item_id, 'system: You are a helpful assistant. Answer in well-formed JSON.; user: ' || text AS messages FROM benchmark")(
    lambda s, d: table(s, d, "benchmark").select("item_id", F.array_join(F.transform(batch.messages_for(F.col("text")), lambda m: F.concat_ws(": ", m["role"], m["content"])), "; ").alias("messages"))
)
query("DAG-08", "SELECT count(*) FILTER (item_id % 4 = 0) AS hits, count(*) FILTER (item_id % 4 <> 0) AS misses FROM benchmark")(
    lambda s, d: (lambda found: found[0].agg(F.count("*").alias("hits")).crossJoin(found[1].agg(F.count("*").alias("misses"))))(
        batch.cached(
            tasks := table(s, d, "benchmark").select("item_id", F.concat_ws(" ", "item_id", "text").alias("question")),
            tasks.filter("item_id % 2 = 0").select(F.sha2("question", 256).alias("prompt_hash"), F.lit("known").alias("result"), F.when(F.col("item_id") % 4 == 0, F.current_timestamp()).otherwise(F.current_timestamp() - F.expr("INTERVAL 3 DAYS")).alias("at")),
        )
    )
)
query("TWN-09", "SELECT 'clicks' AS step, count(*) AS rows, 0::BIGINT AS errors, 'done' AS state FROM events WHERE event_type = 'click' UNION ALL SELECT 'all', count(*), count(*) FILTER (event_type = 'error'), 'failed' FROM events")(
    lambda s, d: batch.tracked({"clicks": (e := table(s, d, "events").withColumn("status", F.col("event_type"))).filter("status = 'click'"), "all": e})
)
query("SRT-04", """WITH e AS (SELECT b.vec_id AS n, 'memories/' || ((b.vec_id - 1) // 2) AS _from, 'memories/' || b.vec_id AS _to FROM embeddings b WHERE b.vec_id > 0),
s AS (SELECT _from AS src, _to AS dst, n FROM e UNION ALL SELECT _to, _from, n FROM e)
SELECT dst AS vertex, n AS edge_time FROM s WHERE src = 'memories/7' ORDER BY edge_time DESC, vertex LIMIT 10""")(
    lambda s, d: memory.related_memories(
        table(s, d, "embeddings").filter("vec_id > 0").select(F.concat(F.lit("m"), "vec_id").alias("_key"), F.concat(F.lit("memories/"), F.floor((F.col("vec_id") - 1) / 2)).alias("_from"), F.concat(F.lit("memories/"), "vec_id").alias("_to"), F.lit("x").alias("type"), F.col("vec_id").alias("timestamp")), s.createDataFrame([("memories/7",)], "_id string")
    ).select("vertex", "edge_time")
)

# ---- images

query("IMG-02", "SELECT p_partkey, CASE WHEN p_size * 70 * 200 <= 350000 THEN 70 WHEN p_size * 60 * 200 <= 350000 THEN 60 WHEN p_size * 50 * 200 <= 350000 THEN 50 WHEN p_size * 40 * 200 <= 350000 THEN 40 ELSE 30 END AS quality FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", images.best_quality(F.map_from_arrays(q := F.lit([30, 40, 50, 60, 70]), F.transform(q, lambda x: x * 200 * F.col("p_size")))).alias("quality"))
)
query("IMG-05", """SELECT p_partkey, '{"role":"user","content":[{"type":"text","text":"' || p_name || '"}' || CASE WHEN p_partkey % 2 = 0 THEN ',{"type":"image_url","image_url":"http://x/' || p_partkey || '"}' ELSE '' END || ']}' AS message FROM part""")(
    lambda s, d: table(s, d, "part").select("p_partkey", images.multimodal(F.col("p_name"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("http://x/"), "p_partkey"))).alias("message"))
)
query("TWN-10", "SELECT p_partkey, floor(400 * pow(0.9::DOUBLE, k))::BIGINT AS width, floor(300 * pow(0.9::DOUBLE, k))::BIGINT AS height, k::INT AS attempts FROM (SELECT p_partkey, CASE WHEN p_size * 1000 <= 20000 THEN 0 WHEN p_size * 1000 * 0.81 <= 20000 THEN 1 WHEN p_size * 1000 * 0.6561 <= 20000 THEN 2 WHEN p_size * 1000 * 0.531441 <= 20000 THEN 3 WHEN p_size * 1000 * 0.43046721 <= 20000 THEN 4 ELSE 5 END AS k FROM part)")(
    lambda s, d: table(s, d, "part").select("p_partkey", images.shrunk(F.lit(400), F.lit(300), F.col("p_size") * 1000, 20_000).alias("x")).select("p_partkey", "x.width", "x.height", "x.attempts")
)
