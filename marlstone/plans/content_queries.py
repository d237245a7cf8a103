"""Registered queries of extraction, tables, chunks, glossaries, batches and streams, each with DuckDB's SQL where that can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from marlstone.functions import text
from marlstone.functions.fuzzy import fuzzy_ratio
from marlstone.operators import batch, chunk, extract, glossary, html, memory, tables
from marlstone.plans.fixtures import table
from marlstone.streaming import ingest

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


def _docs(s, d):
    return table(s, d, "documents")


# ---- texts

query("CHK-04", r"SELECT doc_id, len(list_filter(string_split(regexp_replace(trim(text, ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> ''))::BIGINT AS sentences FROM documents")(
    lambda s, d: _docs(s, d).select("doc_id", F.size(text.sentences(F.col("text"))).cast("long").alias("sentences"))
)
query("CHK-05", "SELECT doc_id, (length(text) // 4)::BIGINT AS tokens FROM documents")(lambda s, d: _docs(s, d).select("doc_id", text.count_tokens(F.col("text")).alias("tokens")))
query("CHK-07", "SELECT doc_id, sha256(text) AS hash FROM documents")(lambda s, d: _docs(s, d).select("doc_id", F.sha2("text", 256).alias("hash")))


def chunks_sql(limit: int) -> str:
    """Common table expressions that end in ``chunked`` (id, section, chunk, code, tokens).

    Sections are told by their header lines. A fold has what is joined so far as
    one text, chunks apart by character 1; character 2 is before what stands alone.
    """
    last = "string_split(a, chr(1))[-1]"
    full = f"(length({last}) + 1 + length(x)) // 4 > {limit}"
    words = f"list_reduce(string_split(s, ' '), lambda a, x: a || CASE WHEN {last} = '' THEN '' WHEN {full} THEN chr(1) ELSE ' ' END || x)"
    pack = f"list_reduce(p, lambda a, x: a || CASE WHEN x[1] = chr(2) OR {last}[1] = chr(2) OR {full} THEN chr(1) ELSE ' ' END || x)"
    filled = "list_filter({}, lambda x: {} <> '')".format
    return rf"""cut AS (SELECT doc_id AS id, {filled("string_split(regexp_replace(text, '(?m)(^[*][*][0-9]+([.][0-9]+)*[.]?[ \t\n]+[A-Z0-9][^\n*]+?[ \t\n]*[*][*][ \t]*$)', chr(3) || '\1', 'g'), chr(3))", "trim(x, ' ')")} AS parts FROM documents),
sects AS (SELECT id, unnest(parts) AS content, generate_subscripts(parts, 1) - 1 AS section FROM cut),
sents AS (SELECT id, section, {filled(r"string_split(regexp_replace(trim(content, ' '), '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))", "x")} AS ss FROM sects),
pieces AS (SELECT id, section, flatten(list_transform(ss, lambda s: CASE WHEN length(s) // 4 > {limit} THEN list_transform({filled(f"string_split({words}, chr(1))", "x")}, lambda w: chr(2) || w) ELSE [s] END)) AS p FROM sents),
packs AS (SELECT id, section, string_split({pack}, chr(1)) AS cs FROM pieces WHERE len(p) > 0),
chunked AS (SELECT id, section, chunk, code, length(code) // 4 AS tokens FROM (SELECT id, section, ltrim(unnest(cs), chr(2)) AS code, generate_subscripts(cs, 1) - 1 AS chunk FROM packs))"""


query("CHK-03", f"WITH {chunks_sql(120)} SELECT id, section, chunk, tokens AS code_token_count, sha256(code) AS section_id FROM chunked")(lambda s, d: chunk.chunk_rows(_docs(s, d), "doc_id", "text", 120).select("id", "section", "chunk", "code_token_count", "section_id"))
query("CHK-14", f"WITH {chunks_sql(500)} SELECT id, count(*) AS chunks, sum(tokens)::BIGINT AS tokens FROM chunked GROUP BY id")(lambda s, d: chunk.chunk_rows(_docs(s, d), "doc_id", "text").groupBy("id").agg(F.count("*").alias("chunks"), F.sum("code_token_count").alias("tokens")))
query("CHK-09")(lambda s, d: _docs(s, d).select("doc_id", F.size(chunk.overlapping_chunks(text.sentences(F.col("text")), 100)).alias("chunks")))
query("CHK-10")(lambda s, d: chunk.summarize(_docs(s, d), "doc_id", "text", lambda c: text.shorten(c, 200), 500, 600))
query("CHK-12", "SELECT source, count(*) AS files, sum(strlen(text))::BIGINT AS bytes, sum(length(text) // 4)::BIGINT AS tokens FROM documents GROUP BY source")(
    lambda s, d: chunk.digest(_docs(s, d).select("source", F.concat("lang", F.lit("/"), "doc_id", F.lit(".txt")).alias("path"), F.col("text").alias("content")), "source")
)
query("CHK-13", """WITH p AS (SELECT source, lang, doc_id FROM documents),
l AS (SELECT DISTINCT source AS path, source || '/' AS line FROM p UNION SELECT DISTINCT source || '/' || lang, '    ' || lang || '/' FROM p UNION SELECT source || '/' || lang || '/' || doc_id || '.txt', '        ' || doc_id || '.txt' FROM p) SELECT path, line FROM l ORDER BY path""")(
    lambda s, d: chunk.tree(_docs(s, d).select(F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".txt"))).alias("path")))
)
query("CHK-15", r"SELECT doc_id, CASE WHEN len(w) > 20 THEN array_to_string(w[:10], ' ') || ' ... ' || array_to_string(w[-10:], ' ') ELSE text END AS short FROM (SELECT doc_id, text, string_split_regex(trim(text, ' '), '\s+') AS w FROM documents)")(
    lambda s, d: _docs(s, d).select("doc_id", text.middle_out(F.col("text"), 20).alias("short"))
)
query("EXT-12", r"""WITH p AS (SELECT conv_id, turn, unnest(regexp_extract_all('lang: ' || role || chr(10) || 'Turn No: ' || turn || chr(10) || text, '(?m)^[A-Za-z0-9_\- ]+:\s*.+$', 0)) AS line FROM conversations)
SELECT conv_id, turn, max(CASE WHEN line LIKE 'lang:%' THEN trim(substr(line, 6)) END) AS lang, max(CASE WHEN line LIKE 'Turn No:%' THEN trim(substr(line, 9)) END) AS turn_no FROM p GROUP BY conv_id, turn""")(
    lambda s, d: table(s, d, "conversations").select("conv_id", "turn", extract.metadata(F.concat(F.lit("lang: "), "role", F.lit("\nTurn No: "), "turn", F.lit("\n"), "text")).alias("m")).select("conv_id", "turn", F.col("m")["lang"].alias("lang"), F.col("m")["turn_no"].alias("turn_no"))
)
query("EXT-32", "SELECT doc_id, concat_ws(chr(10), nullif(trim(lang, ' '), ''), nullif(trim(source, ' '), ''), NULL, nullif(trim(text, ' '), '')) AS joined FROM documents")(
    lambda s, d: _docs(s, d).select("doc_id", text.embedding_text(F.col("lang"), F.col("source"), F.lit("  "), F.col("text")).alias("joined"))
)
query("EXT-33", r"""WITH a AS (SELECT page_id, regexp_replace(html, '[\r\n]+', ' ', 'g') AS t FROM pages), b AS (SELECT page_id, regexp_replace(t, '<[^>]+>', '', 'g') AS t FROM a), c AS (SELECT page_id, regexp_replace(t, 'https?://\S+', '', 'g') AS t FROM b),
e AS (SELECT page_id, regexp_replace(t, '\S+@\S+\.\S+', '', 'g') AS t FROM c), f AS (SELECT page_id, trim(regexp_replace(replace(regexp_replace(t, '[•●▪]', '-', 'g'), 'α', 'alpha'), '\s+', ' ', 'g'), ' ') AS t FROM e)
SELECT page_id, CASE WHEN t = '' OR regexp_matches(t, '[.!?]$') THEN t ELSE t || '.' END AS text FROM f""")(lambda s, d: table(s, d, "pages").select("page_id", text.normalize(F.col("html")).alias("text")))
query("EXT-02", "SELECT doc_id, CASE WHEN title = '' THEN 'Unnamed Section' ELSE title END AS title FROM (SELECT doc_id, trim(regexp_replace(split_part(text, chr(10), 1), '[\\x00-\\x1f\\x7f]', '', 'g'), ' ') AS title FROM documents)")(
    lambda s, d: _docs(s, d).select("doc_id", text.section_title(F.substring_index("text", "\n", 1)).alias("title"))
)
query("EXT-10", r"""WITH l AS (SELECT doc_id AS id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents),
f AS (SELECT *, starts_with(line, '```') AS fence, sum(starts_with(line, '```')::INT) OVER (PARTITION BY id ORDER BY n) AS fences FROM l),
k AS (SELECT *, CASE WHEN fences % 2 = 1 OR fence THEN 'code' WHEN regexp_matches(line, '^#{1,6}\s+.+$') THEN 'heading' WHEN trim(line, ' ') = '' THEN 'blank' ELSE 'paragraph' END AS type FROM f),
o AS (SELECT *, lag(type) OVER (PARTITION BY id ORDER BY n) AS before FROM k)
SELECT id, type, count(*) AS blocks FROM o WHERE type <> 'blank' AND (before IS DISTINCT FROM type OR type = 'heading' OR (fence AND fences % 2 = 1)) GROUP BY id, type""")(lambda s, d: extract.blocks(_docs(s, d), "doc_id", "text").groupBy("id", "type").agg(F.count("*").alias("blocks")))
query("EXT-04", r"""WITH h AS (SELECT page_id AS id, unnest(regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>', 0)) AS h, generate_subscripts(regexp_extract_all(html, '(?is)<h[1-6][^>]*>.*?</h[1-6]>', 0), 1) - 1 AS position FROM pages)
SELECT id, position, regexp_extract(h, '(?i)^<h([1-6])', 1)::INT AS level, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(h, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&amp;', '&'), '\s+', ' ', 'g'), ' ') AS title FROM h""")(
    lambda s, d: extract.html_headings(table(s, d, "pages"), "page_id", "html")
)
query("SRC-16")(lambda s, d: html.elements(table(s, d, "pages"), "page_id", "html", ["article p", "nav > ul > li a[href]", "pre, code", "div.ad"]))
query("SRC-19", "SELECT page_id, regexp_matches(lower(html), 'react|vue|angular|next\\.js|nuxt') AS framework FROM pages".replace("\\\\", "\\"))(lambda s, d: table(s, d, "pages").select("page_id", F.lower("html").rlike(r"react|vue|angular|next\.js|nuxt").alias("framework")))
query("EXT-09", "SELECT page_id, CASE regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1) WHEN 'html' THEN 'html' WHEN 'py' THEN 'python' WHEN 'js' THEN 'javascript' WHEN 'php' THEN 'php' END AS language FROM pages WHERE regexp_extract(url, '\\.([A-Za-z0-9]+)$', 1) IN ('', 'html', 'py', 'js', 'php')".replace("\\\\", "\\"))(
    lambda s, d: table(s, d, "pages").withColumn("e", text.extension(F.col("url"))).filter(F.col("e").isin("", "html", "py", "js", "php")).select("page_id", extract.language(F.col("e")).alias("language"))
)
query("EXT-44", "SELECT doc_id, strlen(text)::BIGINT AS bytes FROM documents WHERE strlen(text) <= 2000")(lambda s, d: _docs(s, d).select("doc_id", F.octet_length("text").cast("long").alias("bytes")).filter("bytes <= 2000"))
query("EXT-43", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")(
    lambda s, d: table(s, d, "events").select("event_id", extract.allowed_metadata(F.from_json("props", "map<string,string>"), ["k"])["k"].alias("k"))
)
query("FN-names", r"SELECT page_id, substr(regexp_replace(trim(url, ' '), '[^A-Za-z0-9._-]+', '_', 'g'), 1, 100) AS name, lower(regexp_extract(url, '\.([A-Za-z0-9]+)$', 1)) AS ext, regexp_replace(list_last(string_split(rtrim(url, '/'), '/')), '\.git$', '') AS repo FROM pages")(
    lambda s, d: table(s, d, "pages").select("page_id", text.file_name(F.col("url")).alias("name"), text.extension(F.col("url")).alias("ext"), text.repository_name(F.col("url")).alias("repo"))
)
query("FN-json", "SELECT event_id, json_valid(props) AS good FROM events")(lambda s, d: table(s, d, "events").select("event_id", text.first_json(F.concat(F.lit("text "), "props")).isNotNull().alias("good")))
query("FN-sanitize", "SELECT page_id, regexp_replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '(javascript|vbscript|data):', '', 'gi') AS clean FROM pages")(
    lambda s, d: table(s, d, "pages").select("page_id", text.sanitize(F.col("html"), None).alias("clean"))
)

# ---- glossary

TERMS = ["the", "that", "thation", "eren", "and", "inder"]
query("TXT-09", "SELECT doc_id, array_to_string(list_filter(['and', 'eren', 'inder', 'that', 'thation', 'the'], lambda t: regexp_matches(text, '(?i)(^|[^\\p{L}\\p{N}_])' || t || '($|[^\\p{L}\\p{N}_])')), ',') AS terms FROM documents")(lambda s, d: _docs(s, d).select("doc_id", F.array_join(glossary.unique_terms(glossary.find_terms(_docs(s, d), TERMS)), ",").alias("terms")))
def marked_sql(terms) -> str:
    """A text's runs of letters and of other characters, those that are a term with marks around them."""
    return "list_transform(regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+'), lambda x: CASE WHEN lower(x) IN (" + ", ".join(f"'{t}'" for t in terms) + ") THEN '**' || x || '**' ELSE x END)"


query("TXT-10", f"SELECT doc_id, sha256(array_to_string({marked_sql(TERMS)}, '')) AS marked FROM documents")(lambda s, d: _docs(s, d).select("doc_id", "text", glossary.find_terms(_docs(s, d), TERMS).alias("m")).select("doc_id", F.sha2(glossary.highlight(F.col("text"), F.col("m")), 256).alias("marked")))
query("TXT-12", "SELECT p_type AS term, lower(p_type) AS term_lower, count(*) AS n FROM part GROUP BY p_type ORDER BY term_lower")(
    lambda s, d: glossary.terms_in_order(table(s, d, "part").groupBy(F.col("p_type").alias("term")).agg(F.count("*").alias("n")).select("term", F.lower("term").alias("term_lower"), "n"))
)
query("TXT-13", """WITH k AS (SELECT upper(r_name) AS term, lower(r_name) AS term_lower, 'region' AS definition, length(r_name) AS length FROM region),
n AS (SELECT lower(term) AS term_lower, max(term) AS term, definition FROM (SELECT r_name AS term, 'new' AS definition FROM region WHERE r_regionkey < 2 UNION ALL SELECT n_name, 'new' FROM nation) GROUP BY 1, 3)
SELECT coalesce(k.term, n.term) AS term, term_lower, coalesce(n.definition, k.definition) AS definition FROM k FULL JOIN n USING (term_lower)""")(
    lambda s, d: glossary.add_terms(
        table(s, d, "region").select(F.upper("r_name").alias("term"), F.lower("r_name").alias("term_lower"), F.lit("region").alias("definition"), F.length("r_name").alias("length")),
        table(s, d, "region").filter("r_regionkey < 2").select(F.col("r_name").alias("term"), F.lit("new").alias("definition")).unionByName(table(s, d, "nation").select(F.col("n_name").alias("term"), F.lit("new").alias("definition"))),
    ).select("term", "term_lower", "definition")
)
query("TXT-06")(lambda s, d: table(s, d, "part").select("p_partkey", F.round(fuzzy_ratio("p_name", "p_type"), 6).alias("ratio")))

# ---- tables, made of line items: a document for each customer, a table for each order


def _tables(s, d):
    headers = F.when(F.col("o_orderkey") % 4 == 0, F.array(F.lit("Part"), F.lit("Qty"))).otherwise(F.array(F.lit("part"), F.lit("QTY"), F.lit("price")))
    items = table(s, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity"))).alias("items"))
    body = F.transform("items", lambda i: F.array(i["l_partkey"].cast("string"), i["l_quantity"].cast("int").cast("string")))
    key = F.col("o_orderkey")
    return table(s, d, "orders").join(items, F.col("l_orderkey") == key).select(
        F.col("o_custkey").alias("doc"), F.floor(key / 400).alias("page"), key.alias("number"), headers.alias("header"), body.alias("body"),
        (F.lit(60.0) + key % 40).alias("accuracy"), (key % 30).cast("double").alias("whitespace"), F.array(*(x.cast("double") for x in (key % 5, key % 3, key % 5 + 4, key % 3 + 2))).alias("bbox"),
    )


TABLES = """items AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey),
t AS (SELECT o_custkey AS doc, o_orderkey // 400 AS page, o_orderkey AS number, CASE WHEN o_orderkey % 4 = 0 THEN 'part,qty' ELSE 'part,qty,price' END AS header, n, (60.0 + o_orderkey % 40)::DOUBLE AS accuracy, (o_orderkey % 30)::DOUBLE AS whitespace,
    (o_orderkey % 5)::DOUBLE AS x0, (o_orderkey % 3)::DOUBLE AS y0, (o_orderkey % 5 + 4)::DOUBLE AS x1, (o_orderkey % 3 + 2)::DOUBLE AS y1, o_orderkey % 4 = 0 AS two FROM orders JOIN items ON l_orderkey = o_orderkey)"""
INTER = "(greatest(least(x1, 5.0) - greatest(x0, 1.0), 0) * greatest(least(y1, 3.0) - greatest(y0, 1.0), 0))"
query("EXT-16", f"WITH {TABLES} SELECT number, round({INTER} / (8.0 + 8.0 - {INTER}), 6) AS iou FROM t")(
    lambda s, d: _tables(s, d).select("number", F.round(tables.iou(F.col("bbox"), F.array(F.lit(1.0), F.lit(1.0), F.lit(5.0), F.lit(3.0))), 6).alias("iou"))
)
query("JON-08", f"WITH {TABLES} SELECT number, page % 2 = 0 AND {INTER} / (8.0 + 8.0 - {INTER}) >= 0.3 AS valid FROM t")(
    lambda s, d: tables.overlapping(_tables(s, d), _tables(s, d).filter("page % 2 = 0").select("page").distinct().withColumn("box", F.array(F.lit(1.0), F.lit(1.0), F.lit(5.0), F.lit(3.0))), 0.3).select("number", "valid")
)
query("EXT-21", f"WITH {TABLES}, r AS (SELECT *, sum(CASE WHEN header = prev THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY page, number) AS run FROM (SELECT *, lag(header) OVER (PARTITION BY doc ORDER BY page, number) AS prev FROM t)) SELECT doc, run::BIGINT AS run, min(page) AS first_page, max(page) AS last_page, sum(n)::BIGINT AS rows, count(*) AS parts FROM r GROUP BY doc, run")(
    lambda s, d: tables.merged_runs(_tables(s, d)).select("doc", "run", "first_page", "last_page", F.size("body").cast("long").alias("rows"), F.col("parts").cast("long").alias("parts"))
)
query("EXT-18", f"""WITH {TABLES}, f AS (SELECT *, lag(header) OVER w AS h, lag(n) OVER w AS m FROM t WINDOW w AS (PARTITION BY doc ORDER BY page, number)),
r AS (SELECT *, sum(CASE WHEN header = h AND (abs(n - m) / greatest(n, m)::DOUBLE <= 0.5 OR m = 1) THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY page, number) AS run FROM f),
p AS (SELECT *, (row_number() OVER (PARTITION BY doc, run ORDER BY page, number) - 1) // 2 AS pair FROM r)
SELECT doc, string_agg(number::VARCHAR, ',' ORDER BY page, number) AS numbers, sum(n)::BIGINT AS rows FROM p GROUP BY doc, run, pair""")(
    lambda s, d: tables.merge_pairs(_tables(s, d)).select("doc", F.array_join(F.transform("numbers", lambda n: n.cast("string")), ",").alias("numbers"), F.size("body").cast("long").alias("rows"))
)
QUALITY = "least(greatest(accuracy / 100, 0), 1)"
query("EXT-22", f"WITH {TABLES} SELECT doc, round(avg(0.4 * {QUALITY} + 0.3 + 0.3 * two::INT), 6) AS quality FROM t GROUP BY doc")(
    lambda s, d: tables.quality(_tables(s, d)).groupBy("doc").agg(F.round(F.avg("quality"), 6).alias("quality"))
)
query("EXT-23", f"WITH {TABLES} SELECT number, round(100 * (0.4 * {QUALITY} + 0.3 + 0.1 * two::INT + 0.2 * (100 - whitespace) / 100), 6) AS confidence FROM t")(
    lambda s, d: tables.quality(_tables(s, d)).select("number", F.round("confidence", 6).alias("confidence"))
)
query("EXT-25", f"WITH {TABLES}, q AS (SELECT doc, page, 's' || number % 4 AS settings, accuracy AS quality FROM t) SELECT doc, page, arg_max(settings, (quality, -ascii(substr(settings, 2)))) AS settings, max(quality) AS quality FROM q GROUP BY doc, page")(
    lambda s, d: tables.best_settings(_tables(s, d).select("doc", "page", F.concat(F.lit("s"), F.col("number") % 4).alias("settings"), F.col("accuracy").alias("quality")))
)
query("EXT-42", f"WITH {TABLES} SELECT 's' || number % 4 AS settings, round(avg(accuracy), 6) AS quality, count(*) AS uses FROM t GROUP BY 1")(
    lambda s, d: tables.settings_report(_tables(s, d).select(F.concat(F.lit("s"), F.col("number") % 4).alias("settings"), F.col("accuracy").alias("quality"))).withColumn("quality", F.round("quality", 6))
)
query("EXT-11", f"WITH {TABLES} SELECT number, n - 1 AS rows, (2 * (n - 1))::BIGINT AS cells FROM t WHERE n >= 2")(
    lambda s, d: _tables(s, d).filter(F.size("body") >= 2).select("number", tables.padded(F.col("body")).alias("p")).select("number", F.size("p.rows").cast("long").alias("rows"), F.size(F.flatten("p.rows")).cast("long").alias("cells"))
)
query("EXT-14", "SELECT o_custkey, count(*) AS rows, string_agg(o_orderkey || ';' || o_orderstatus, ';' ORDER BY o_orderkey) AS cells FROM orders GROUP BY o_custkey")(
    # a table for each customer, a row of another width in it
    lambda s, d: table(s, d, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("o"))
    .select("o_custkey", extract.markdown_table(F.concat(F.lit("| Order | Status |\n|---|:-:|\n| odd |\n"), F.array_join(F.transform("o", lambda o: F.concat(F.lit("| "), o["o_orderkey"], F.lit(" | "), o["o_orderstatus"], F.lit(" |"))), "\n"))).alias("t"))
    .select("o_custkey", F.size("t.rows").cast("long").alias("rows"), F.array_join(F.flatten("t.rows"), ";").alias("cells"))
)
query("EXT-28", "SELECT c_custkey, trim(regexp_replace(c_name, '[\\r\\n]+', ' ', 'g'), ' ') AS name, try_cast(regexp_extract(c_name, '[0-9]+') AS DOUBLE) AS number FROM customer".replace("\\\\", "\\"))(
    lambda s, d: table(s, d, "customer").select("c_custkey", tables.cleaned(F.col("c_name")).alias("name"), F.regexp_extract("c_name", "[0-9]+", 0).try_cast("double").alias("number"))
)
query("EXT-37", """WITH c AS (SELECT n_nationkey AS table_id, CASE n_nationkey % 4 WHEN 0 THEN 'approved' WHEN 1 THEN 'edited' ELSE 'rejected' END AS status, CASE WHEN n_nationkey % 4 = 1 THEN 'fixed' END AS text FROM nation WHERE n_nationkey % 2 = 0 OR n_nationkey % 4 = 1)
SELECT n_nationkey AS table_id, coalesce(c.text, n_name) AS text, coalesce(c.status, 'extracted') AS status, c.status IS NULL AS needs_review FROM nation LEFT JOIN c ON table_id = n_nationkey WHERE c.status IS DISTINCT FROM 'rejected'""")(
    lambda s, d: tables.corrected(
        table(s, d, "nation").select(F.col("n_nationkey").alias("table_id"), F.col("n_name").alias("text")),
        table(s, d, "nation").filter("n_nationkey % 2 = 0 OR n_nationkey % 4 = 1").select(F.col("n_nationkey").alias("table_id"), F.when(F.col("n_nationkey") % 4 == 0, "approved").when(F.col("n_nationkey") % 4 == 1, "edited").otherwise("rejected").alias("status"), F.when(F.col("n_nationkey") % 4 == 1, "fixed").alias("text")),
    )
)

# ---- batches: a chain of tasks for every twenty turns of a conversation

_chain = lambda s, d: table(s, d, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("task_id"), F.when(F.col("turn") % 20 > 0, F.array(F.concat_ws("-", "conv_id", F.col("turn") - 1))).otherwise(F.array().cast("array<string>")).alias("dependencies"), F.when((F.col("conv_id") % 5 == 0) & (F.col("turn") % 20 == 1), "fail").otherwise(F.concat(F.lit("q"), "turn")).alias("question"))
query("DAG-02", "SELECT conv_id || '-' || turn AS task_id, (turn % 20)::INT AS depth FROM conversations")(lambda s, d: batch.depths(_chain(s, d)).select("task_id", F.col("depth").cast("int").alias("depth")))
query("DAG-01", """SELECT conv_id || '-' || turn AS task_id, CASE WHEN conv_id % 5 <> 0 OR turn % 20 = 0 THEN 'success' WHEN turn % 20 = 1 THEN 'error' WHEN turn % 20 = 2 THEN 'dependency_failed' ELSE 'error' END AS status,
CASE WHEN conv_id % 5 <> 0 OR turn % 20 = 0 THEN 'answer: q' || turn WHEN turn % 20 = 1 THEN 'the call failed' WHEN turn % 20 = 2 THEN 'Dependency ' || conv_id || '-' || (turn - 1) || ' failed.' ELSE 'Unresolved dependencies or cycle detected.' END AS result FROM conversations""")(
    lambda s, d: batch.run(_chain(s, d))
)
query("DAG-10", "SELECT event_type AS status, count(*) AS n FROM events GROUP BY 1")(lambda s, d: batch.status_counts(table(s, d, "events").select(F.col("event_type").alias("status"))))
query("DAG-04", "SELECT item_id, 'see ' || replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') || ' and {{ b.result }}' AS filled FROM benchmark")(
    lambda s, d: table(s, d, "benchmark").select("item_id", batch.substitute(F.lit("see {{ a.result }} and {{ b.result }}"), F.create_map(F.lit("a"), "text")).alias("filled"))
)

# ---- streams: the batch form of the stream's plan

query("STR-01", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS begin, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2")(
    lambda s, d: ingest.event_counts(table(s, d, "events")).withColumn("value", F.round("value", 4))
)
query("MEM-02", "SELECT conv_id || '-' || turn AS _key, text AS content FROM conversations WHERE conv_id = 3 AND turn = 1")(lambda s, d: memory.messages(table(s, d, "conversations")).filter("_key = '3-1'").select("_key", "content"))
