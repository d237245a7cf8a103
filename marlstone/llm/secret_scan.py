"""Secret scans over the history of files by an incremental ledger of blobs.

Every version of every path is content-addressed. The ledger is only appended
to: a row for a blob and the (rule, version) pairs under which it was scanned,
with what these found. A scan looks only for pairs of a blob and a rule's version
that no row has, so a changed rule is sought alone. Findings are joined back to
all paths that ever held the blob. Rows that were appended twice, by a job that
ran again, count once.

Edge cases: a null or empty text is the empty blob, which has no findings.
Copies are one blob and are scanned once. Repeated rows of a path give repeated
rows. An empty table gives an empty ledger and no rows. Columns of the input
beside those named are not read, and path columns may have any name. Texts are
scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.llm import spans
from marlstone.llm.common import materialize

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: kind, version, pattern, condition on a match; order is the order of kinds at equal starts. A new version rescans all blobs for that rule.
RULES = (
    ("assign", "1", ASSIGN, lambda m: F.length(F.regexp_extract(m, ASSIGN, 2)) >= 12),
    ("access", "1", r"AKIA[A-Z0-9]+", lambda m: F.length(m) >= 18),
    ("hex", "1", r"[0-9a-f]{16,}", None),
    ("pem", "1", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----", None),
    ("jwt", "1", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", None),
)


def blob_id(text: Column) -> Column:
    """The address of a content: its SHA-256."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def current_rules() -> list[str]:
    """The (rule, version) pairs of now, as texts."""
    return [f"{kind}@{version}" for kind, version, _, _ in RULES]


def findings_of(text: Column, wanted: Column | None = None) -> Column:
    """The findings of all rules, or of the ``wanted`` ones, in a text by start, then rule."""
    each = []
    for rank, (kind, version, pattern, valid) in enumerate(RULES):
        found = spans.find(text, kind, rank, pattern, valid)
        each.append(found if wanted is None else F.when(F.array_contains(wanted, f"{kind}@{version}"), found).otherwise(spans.no_spans()))
    return spans.by_start(F.concat(*each))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """The ledger's new rows (blob, rules, findings): one for each blob of ``versions`` that was not scanned under all rules of now, with what was lacking."""
    text, now = F.coalesce(F.col(text_col), F.lit("")), F.lit(current_rules())
    blobs = versions.select(blob_id(text).alias("blob"), text.alias("content"))
    if ledger is None:
        return blobs.dropDuplicates(["blob"]).select("blob", now.alias("rules"), findings_of(F.col("content")).alias("findings"))
    seen = ledger.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list(F.array_intersect("rules", now)))).alias("seen"))
    # what has been seen whole goes before texts are dealt out
    blobs = blobs.join(seen.filter(F.size(F.array_except(now, F.col("seen"))) == 0), "blob", "left_anti").dropDuplicates(["blob"]).join(seen, "blob", "left")
    lacking = blobs.withColumn("rules", F.array_except(now, F.coalesce("seen", F.array().cast("array<string>"))))
    return lacking.select("blob", "rules", findings_of(F.col("content"), F.col("rules")).alias("findings"))


def update_ledger(versions: DataFrame, ledger: DataFrame | None = None, text_col: str = "text") -> DataFrame:
    """The ledger after the new rows were appended to its table, which is made in the shared folder where there is none."""
    new = scan_unseen(versions, ledger, text_col)
    if ledger is None:
        return materialize(new, "secret-ledger")
    path = getattr(ledger, "shared_path", None) or materialize(ledger, "secret-ledger").shared_path
    new.write.mode("append").parquet(path)
    grown = versions.sparkSession.read.schema(new.schema).parquet(path)
    grown.shared_path = path
    return grown


def findings_by_path(versions: DataFrame, ledger: DataFrame, path_cols: list[str], text_col: str = "text") -> DataFrame:
    """The paths of all versions with their blob and its findings under the rules of now."""
    inside = [f"_path{i}" for i in range(len(path_cols))]
    paths = versions.select(*(F.col(c).alias(i) for c, i in zip(path_cols, inside, strict=True)), blob_id(F.col(text_col)).alias("blob"))
    kinds = F.transform(F.array_intersect("rules", F.lit(current_rules())), lambda r: F.split_part(r, F.lit("@"), F.lit(1)))
    valid = ledger.select("blob", kinds.alias("kinds"), "findings").select("blob", F.filter("findings", lambda s: F.array_contains("kinds", s["kind"])).alias("findings"))
    of_blob = valid.groupBy("blob").agg(spans.by_start(F.array_distinct(F.flatten(F.collect_list("findings")))).alias("findings"))
    # as a new value it is dealt out for the join, so that the paths of a blob that very many share can be split
    found = paths.join(of_blob.select(F.substring("blob", 1, 32).alias("blob"), "findings"), "blob", "left")
    return found.select(*(F.col(i).alias(c) for c, i in zip(path_cols, inside, strict=True)), "blob", "findings")
