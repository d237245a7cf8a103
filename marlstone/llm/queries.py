"""The registered queries of the numbered operators, each over its whole table, and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.llm import bpe, chat_rotation, decontamination, license_scan, pii, quality_classifier, quality_rules, resampling, secret_scan, simhash_dedup, spans, suffix_dedup, top_k, whitening


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of a document and a benchmark item found in it."""
    return decontamination.find_contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate component of every document."""
    return simhash_dedup.near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition coverage of every text and whether it is kept."""
    return quality_rules.judge(documents(spark, sf_dir), ["doc_id"])


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE round trip of every text."""
    return bpe.round_trip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_chat_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from the perspective of each of its speakers."""
    return chat_rotation.rotate(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP5_SQL = r"""
WITH turns AS (
    SELECT row_number() OVER () AS row_id, conv_id, turn, role,
           CASE WHEN role IS NULL THEN 'user' WHEN role = 'system' THEN role ELSE 'user name=' || array_to_string(list_transform(
               string_split(role, ''), lambda c: CASE WHEN regexp_matches(c, '[\p{L}\p{M}\p{N}_-]') THEN c ELSE printf('%%%X;', unicode(c)) END), '') END AS tag,
           replace(replace(coalesce(text, ''), '<|im_start|>', '<| im_start|>'), '<|im_end|>', '<| im_end|>') AS text
    FROM conversations),
speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM turns WHERE role <> 'system'),
said AS (
    SELECT turns.conv_id, perspective, row_id, turn, role, text, coalesce(role = perspective, false) AS mine,
           '<|im_start|>' || CASE WHEN mine THEN 'assistant' ELSE tag END || chr(10) AS head,
           text || '<|im_end|>' AS body
    FROM turns JOIN speakers ON turns.conv_id IS NOT DISTINCT FROM speakers.conv_id),
placed AS (
    SELECT *, sum(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, role NULLS FIRST, text, row_id) AS stop FROM said)
SELECT conv_id, perspective, 0::BIGINT AS part, count(*) AS n_turns,
       string_agg(head || body || chr(10), '' ORDER BY turn NULLS FIRST, role NULLS FIRST, text, row_id) AS rendered,
       coalesce(string_agg((stop - 1 - length(body))::BIGINT || ':' || (stop - 1)::BIGINT, ',' ORDER BY turn NULLS FIRST, role NULLS FIRST, text, row_id) FILTER (mine), '') AS mask
FROM placed GROUP BY conv_id, perspective
"""


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, each document being the one version of its path; the ledger starts empty."""
    docs = documents(spark, sf_dir)
    found = secret_scan.findings_by_path(docs, secret_scan.update_ledger(docs), ["doc_id"])
    base = F.filter("findings", lambda s: s["rank"] <= 2)
    return found.select(
        "doc_id",
        *(spans.count_of(base, kind).alias(f"n_{kind}") for kind in ("assign", "access", "hex")),
        F.sha2(spans.joined(base), 256).alias("base_sha256"),
        spans.joined(F.col("findings")).alias("spans"),
    )


#: Ends of the matches of a plain pattern by the gaps between them; kinds as in RULES.
OP6_SQL = r"""
WITH rules(rank, kind, pattern, least) AS (VALUES
    (0, 'assign', '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 12),
    (1, 'access', 'AKIA[A-Z0-9]+', 18),
    (2, 'hex', '[0-9a-f]{16,}', 16),
    (3, 'pem', '-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----', 1),
    (4, 'jwt', 'eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}', 1)),
texts AS (SELECT row_number() OVER () AS row_id, doc_id, coalesce(text, '') AS text FROM documents),
pairs AS (
    SELECT row_id, rank, kind, least, unnest(regexp_extract_all(text, pattern, 0)) AS m, unnest(regexp_extract_all(text, pattern, 2 * (rank = 0)::INT)) AS part,
           unnest(string_split_regex(text, pattern)[:len(regexp_extract_all(text, pattern, 0))]) AS gap, generate_subscripts(regexp_extract_all(text, pattern, 0), 1) AS i
    FROM texts, rules WHERE regexp_matches(text, pattern)),
placed AS (
    SELECT row_id, rank, kind, least, part, sum(length(gap) + length(m)) OVER (PARTITION BY row_id, rank ORDER BY i) AS stop, length(m) AS size FROM pairs),
found AS (SELECT row_id, rank, kind, (stop - size)::BIGINT AS start, stop::BIGINT AS stop FROM placed WHERE length(part) >= least),
per_row AS (
    SELECT row_id, count(*) FILTER (rank = 0) AS n_assign, count(*) FILTER (rank = 1) AS n_access, count(*) FILTER (rank = 2) AS n_hex,
           coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) FILTER (rank <= 2), '') AS base,
           string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, rank) AS spans
    FROM found GROUP BY row_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM texts LEFT JOIN per_row USING (row_id)
"""


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels outside the held-out fold."""
    return quality_classifier.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: the spans of the fixed rules, and those that learned patterns add."""
    found = pii.find_pii(documents(spark, sf_dir), ["doc_id"])
    return found.select(
        "doc_id",
        *(spans.count_of(F.col("seeds"), kind).alias(f"n_{kind}") for kind in ("email", "ip", "card", "phone")),
        F.sha2(spans.joined(F.col("seeds")), 256).alias("base_sha256"),
        spans.joined(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
        spans.count_of(F.col("spans"), "learned").alias("n_learned"),
    )


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses declared in every document."""
    return license_scan.find_licenses(documents(spark, sf_dir))


#: Every window of every template over every document that has a shingle of it, without bands.
OP9_SQL = (
    "WITH templates(license_id, body) AS (VALUES "
    + ", ".join(f"('{name}', '{text}')" for name, text in license_scan.TEMPLATES.items())
    + r"""),
tw AS (SELECT license_id, list_filter(string_split_regex(lower(body), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM templates),
ts AS (SELECT license_id, list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s FROM tw),
t AS (SELECT license_id, s, len(s) AS n, greatest(1, ceil(0.8 * len(s) - 1e-9))::BIGINT AS need, greatest(1, len(s) // 4) AS stride FROM ts),
dw AS (SELECT row_number() OVER () AS row_id, doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda w: w <> '') AS w FROM documents),
d AS (SELECT row_id, doc_id, list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) AS s FROM dw WHERE len(w) >= 5),
starts AS (
    SELECT row_id, doc_id, license_id, n, need, d.s AS ds, t.s AS ts, n + stride - 1 AS width, unnest(range(0, len(d.s), stride)) AS a
    FROM d JOIN t ON list_has_any(d.s, t.s)),
held AS (SELECT row_id, doc_id, license_id, n, need, a, len(list_intersect(list_distinct(ds[a + 1:a + width]), ts))::BIGINT AS held FROM starts)
SELECT doc_id, license_id, max(held) AS held, max(held)::DOUBLE / n AS containment, arg_max(a, held * 1000000000 - a)::BIGINT AS first_word
FROM held WHERE held >= need GROUP BY row_id, doc_id, license_id, n
"""
)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the passages of 400 bytes that occur again."""
    return suffix_dedup.summarize(documents(spark, sf_dir))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weight, score and rank of every document when a tenth is drawn towards the benchmark's texts."""
    return resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: CRC-32 by its table, a byte at a time, of each different word.
OP11_SQL = r"""
WITH RECURSIVE crc(i, bit, c) AS (
    SELECT range, 0, range::BIGINT FROM range(256)
    UNION ALL
    SELECT i, bit + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM crc WHERE bit < 8),
steps AS MATERIALIZED (SELECT list(c ORDER BY i) AS step FROM crc WHERE bit = 8),
doc_words AS MATERIALIZED (
    SELECT row_id, unnest(words) AS word FROM (
        SELECT row_number() OVER () AS row_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents)),
target_words AS (
    SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark),
hashed AS MATERIALIZED (
    SELECT word, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(hex(word)) // 2), lambda i: ('0x' || substr(hex(word), (2 * i + 1)::BIGINT, 2))::BIGINT)),
                                 lambda c, b: xor(c >> 8, step[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
    FROM (SELECT word FROM doc_words UNION SELECT word FROM target_words), steps),
s AS (SELECT bucket, count(*) AS s FROM doc_words JOIN hashed USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM target_words JOIN hashed USING (word) GROUP BY bucket),
totals AS (SELECT (SELECT count(*) FROM doc_words) AS s_all, (SELECT count(*) FROM target_words) AS t_all),
gains AS (
    SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (s_all + 10000) / ((s + 1)::DOUBLE * (t_all + 10000))))::BIGINT AS gain
    FROM s LEFT JOIN t USING (bucket), totals),
weights AS (SELECT row_id, count(*) AS n_features, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM doc_words JOIN hashed USING (word) JOIN gains USING (bucket) GROUP BY row_id),
scored AS (
    SELECT row_id, doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT + 0.5)::DOUBLE / 4294967296)))::BIGINT AS score
    FROM (SELECT row_number() OVER () AS row_id, doc_id FROM documents) LEFT JOIN weights USING (row_id)),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, row_id) AS place, count(*) OVER (PARTITION BY n_features >= 20) AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM placed
"""


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four leading whitened components of every embedding."""
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest of every twentieth embedding, by exact inner product."""
    return top_k.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


OP13_SQL = """
WITH whole AS (
    SELECT row_number() OVER () AS row_id, vec_id, list_transform(embedding, lambda c: floor(64 * c::DOUBLE)) AS x FROM embeddings
    WHERE vec_id IS NOT NULL AND len(list_filter(embedding, lambda c: isfinite(c))) = 64),
scores AS (SELECT q.row_id, q.vec_id AS query_id, c.vec_id, c.row_id AS other, list_inner_product(q.x, c.x)::BIGINT AS score FROM whole q, whole c WHERE q.vec_id % 20 = 0 AND q.row_id <> c.row_id)
SELECT query_id, row_number() OVER (PARTITION BY row_id ORDER BY score DESC, vec_id, other)::INTEGER AS rank, vec_id, score FROM scores
QUALIFY rank <= 20
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op1_decontamination": op1_decontamination, "op2_simhash_dedup": op2_simhash_dedup, "op3_quality_rules": op3_quality_rules, "op4_bpe": op4_bpe, "op5_chat_rotation": op5_chat_rotation, "op6_secret_scan": op6_secret_scan, "op7_quality_classifier": op7_quality_classifier, "op8_pii": op8_pii, "op9_license_scan": op9_license_scan, "op10_suffix_dedup": op10_suffix_dedup, "op11_resampling": op11_resampling, "op12_whitening": op12_whitening, "op13_top_k": op13_top_k, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    return {"op5_chat_rotation": OP5_SQL, "op6_secret_scan": OP6_SQL, "op9_license_scan": OP9_SQL, "op11_resampling": OP11_SQL, "op13_top_k": OP13_SQL}
