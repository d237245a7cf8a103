"""The tables as the collections that the operators work on, in Spark and in DuckDB's SQL."""

from __future__ import annotations

import re
import zlib
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.operators import textindex


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with key, title (the first line), content and tags (language, source, labels)."""
    d, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    tags = F.array_compact(F.array("lang", "source", F.concat(F.lit("q"), "quality"), F.concat(F.lit("tox"), "toxic")))
    key = F.col("doc_id").cast("string")
    return d.join(labels, "doc_id", "left").select(
        key.alias("_key"), F.concat(F.lit("documents/"), key).alias("_id"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"), tags.alias("tags"), "doc_id", "lang", "source", "n_chars", "quality", "toxic"
    )


def plain_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as above without labels: no join where tags are not needed."""
    key = F.col("doc_id").cast("string")
    return table(spark, sf_dir, "documents").select(key.alias("_key"), F.substring_index("text", "\n", 1).alias("title"), F.col("text").alias("content"), "doc_id", "lang", "source", "n_chars")


def text_index(spark: SparkSession, sf_dir: str) -> textindex.TextIndex:
    """The stored index of titles and contents, built when it is first asked for."""
    return textindex.stored(plain_docs(spark, sf_dir), f"{sf_dir}/documents.parquet", ["title", "content"])


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("vec_id").cast("string")
    return table(spark, sf_dir, "embeddings").select(key.alias("_key"), F.concat(F.lit("vectors/"), key).alias("_id"), "vec_id", "embedding", "label")


def query_vector(spark: SparkSession, sf_dir: str, vec_id: int = 0) -> list[float]:
    """The stored vector that a query asks with."""
    return [float(x) for x in table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).select("embedding").first()[0]]


def place_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges region to nation to customer."""
    nation, customer = table(spark, sf_dir, "nation"), table(spark, sf_dir, "customer")
    ident = lambda kind, c: F.concat(F.lit(kind + "/"), c)
    one = nation.select(F.concat(F.lit("n"), "n_nationkey").alias("_key"), ident("region", F.col("n_regionkey")).alias("_from"), ident("nation", F.col("n_nationkey")).alias("_to"), F.lit("HAS_NATION").alias("type"))
    two = customer.select(F.concat(F.lit("c"), "c_custkey").alias("_key"), ident("nation", F.col("c_nationkey")).alias("_from"), ident("customer", F.col("c_custkey")).alias("_to"), F.lit("HAS_CUSTOMER").alias("type"))
    return one.unionByName(two)


def trade_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges above, and on from customer to order, part and supplier; parts and suppliers have many edges."""
    orders, items = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    ident = lambda kind, c: F.concat(F.lit(kind + "/"), c)
    line = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    edge = lambda df, key, a, b, kind: df.select(key.alias("_key"), a.alias("_from"), b.alias("_to"), F.lit(kind).alias("type"))
    parts = [
        edge(orders, ident("o", F.col("o_orderkey")), ident("customer", F.col("o_custkey")), ident("order", F.col("o_orderkey")), "PLACED"),
        edge(items, ident("p", line), ident("order", F.col("l_orderkey")), ident("part", F.col("l_partkey")), "HOLDS"),
        edge(items, ident("s", line), ident("part", F.col("l_partkey")), ident("supplier", F.col("l_suppkey")), "FROM_SUPPLIER"),
    ]
    return reduce(DataFrame.unionByName, parts, place_edges(spark, sf_dir))


def turn_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """NEXT edges between the turns of a conversation."""
    from pyspark.sql import Window

    order = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lead("turn").over(order).alias("_next")).filter("_next IS NOT NULL")
    ident = lambda t: F.concat(F.lit("messages/"), F.concat_ws("-", "conv_id", t))
    return c.select(F.concat_ws("-", "conv_id", "turn").alias("_key"), ident(F.col("turn")).alias("_from"), ident(F.col("_next")).alias("_to"), F.lit("NEXT").alias("type"))


def as_pdf(text: Column) -> Column:
    """Texts as PDF files."""
    return F.pandas_udf(lambda batch: pd.Series([simple_pdf(t or "") for t in batch], dtype=object), "binary")(text)


def simple_pdf(text: str, lines: int = 50) -> bytes:
    """A PDF file of a text in Latin letters, ``lines`` to a page."""
    rows = text.rstrip("\n").split("\n")
    parts = [rows[i : i + lines] for i in range(0, len(rows), lines)]
    escaped = lambda row: re.sub(rb"([\\()])", rb"\\\1", row.encode("cp1252", "replace"))
    bodies = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [" + b" ".join(b"%d 0 R" % (4 + 2 * i) for i in range(len(parts))) + b"] /Count %d >>" % len(parts), b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>"]
    for i, part in enumerate(parts):
        shown = zlib.compress(b"BT /F1 10 Tf 12 TL 50 780 Td " + b" ".join(b"(%s) Tj T*" % escaped(row) for row in part) + b" ET")
        bodies.append(b"<< /Type /Page /Parent 2 0 R /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (5 + 2 * i))
        bodies.append(b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(shown), shown))
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, body) for n, body in enumerate(bodies, 1)) + b"trailer << /Root 1 0 R >>\n"


DOCS = """docs AS (
    SELECT cast(d.doc_id AS VARCHAR) AS _key, 'documents/' || d.doc_id AS _id, split_part(d.text, chr(10), 1) AS title, d.text AS content,
           list_filter([d.lang, d.source, 'q' || l.quality, 'tox' || l.toxic], lambda x: x IS NOT NULL) AS tags, d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
    FROM documents d LEFT JOIN labels l USING (doc_id))"""
VECTORS = "vectors AS (SELECT cast(vec_id AS VARCHAR) AS _key, vec_id, embedding, label FROM embeddings)"
ASKED = "asked AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)"
PLACES = """edges AS (
    SELECT 'n' || n_nationkey AS _key, 'region/' || n_regionkey AS _from, 'nation/' || n_nationkey AS _to, 'HAS_NATION' AS type FROM nation
    UNION ALL SELECT 'c' || c_custkey, 'nation/' || c_nationkey, 'customer/' || c_custkey, 'HAS_CUSTOMER' FROM customer)"""
LINE = "l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey"
TRADE = f"""{PLACES}, trade AS (
    SELECT _key, _from, _to FROM edges
    UNION ALL SELECT 'o/' || o_orderkey, 'customer/' || o_custkey, 'order/' || o_orderkey FROM orders
    UNION ALL SELECT 'p/' || {LINE}, 'order/' || l_orderkey, 'part/' || l_partkey FROM lineitem
    UNION ALL SELECT 's/' || {LINE}, 'part/' || l_partkey, 'supplier/' || l_suppkey FROM lineitem)"""
TURNS = """edges AS (
    SELECT conv_id || '-' || turn AS _key, 'messages/' || conv_id || '-' || turn AS _from, 'messages/' || conv_id || '-' || nxt AS _to, 'NEXT' AS type
    FROM (SELECT conv_id, turn, lead(turn) OVER (PARTITION BY conv_id ORDER BY turn) AS nxt FROM conversations) WHERE nxt IS NOT NULL)"""


def words_sql(column: str) -> str:
    return f"regexp_extract_all(lower(coalesce({column}, '')), '[\\p{{L}}\\p{{N}}_]+')"


def bm25_sql(terms: list[str], fields: list[str], name: str = "scored", k1: float = 1.2, b: float = 0.75) -> str:
    """Common table expressions that end in ``name``: all columns of docs and score, for documents with a term."""
    words = ", ".join(f"{words_sql(f)} AS w_{f}" for f in fields)
    holds = [(f, i, t) for f in fields for i, t in enumerate(terms)]
    stats = ", ".join([*(f"avg(len(w_{f})) AS avg_{f}" for f in fields), *(f"count(*) FILTER (list_contains(w_{f}, '{t}')) AS df_{f}_{i}" for f, i, t in holds)])
    tf = lambda f, t: f"len(list_filter(w_{f}, lambda x: x = '{t}'))::DOUBLE"
    parts = " + ".join(f"CASE WHEN df_{f}_{i} = 0 THEN 0.0::DOUBLE ELSE ln(1 + (n - df_{f}_{i} + 0.5::DOUBLE) / (df_{f}_{i} + 0.5::DOUBLE)) * {tf(f, t)} * {k1 + 1}::DOUBLE / ({tf(f, t)} + {k1}::DOUBLE * ({1 - b}::DOUBLE + {b}::DOUBLE * len(w_{f}) / avg_{f})) END" for f, i, t in holds)
    any_term = " OR ".join(f"list_contains(w_{f}, '{t}')" for f, _, t in holds)
    return f"""words AS (SELECT *, {words} FROM docs),
stats AS (SELECT count(*) AS n, {stats} FROM words),
{name} AS (SELECT words.*, {parts} AS score FROM words, stats WHERE {any_term})"""
