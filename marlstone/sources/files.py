"""Files as DataFrames and back: discovery, reading and the sinks."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions.text import extension

SMALL_FILE = 50 * 1024
#: What is passed over when a tree is searched.
EXCLUDED = ("*.png", "*.jpg", "*.gif", "*.svg", "*.zip", "*.min.js", "*/node_modules/*", "*/__pycache__/*", "*/.venv/*")


def _listed(spark: SparkSession, path: str) -> DataFrame:
    """Path (relative), length and content of all files below a folder, without version control's own."""
    root = path.rstrip("/")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    own = F.regexp_replace("path", ".*" + re.escape(re.sub(r"^\w+:/*", "/", root)) + "/", "")
    return files.select(own.alias("path"), "length", "content").filter(~F.concat(F.lit("/"), "path").contains("/.git/"))


def find_files(spark: SparkSession, path: str, extensions: Sequence[str] = (), files: Sequence[str] = (), dirs: Sequence[str] = ()) -> DataFrame:
    """(path, length) of files by name, folder or extension (case aside), sorted; the content is not read."""
    listed = _listed(spark, path).select("path", "length")
    hit = F.lit(False)
    if files or dirs:
        hit = F.col("path").isin(list(files))
        for d in dirs:
            hit = hit | F.startswith("path", F.lit(d.rstrip("/") + "/"))
    elif extensions:
        hit = extension(F.col("path")).isin([e.lower().lstrip(".") for e in extensions])
    return listed.filter(hit).orderBy("path")


def glob_pattern(pattern: str) -> str:
    """A shell pattern as a regular expression."""
    return "^" + "".join({"*": ".*", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"


def relevant_files(spark: SparkSession, path: str, exclude: Sequence[str] = EXCLUDED) -> DataFrame:
    """(path, length) of all files that meet no excluding pattern."""
    listed = _listed(spark, path).select("path", "length")
    for pattern in exclude:
        listed = listed.filter(~F.col("path").rlike(glob_pattern(pattern)))
    return listed.orderBy("path")


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of files as text."""
    return _listed(spark, path).select("path", F.decode("content", "UTF-8").alias("content"))


def total_bytes(spark: SparkSession, path: str, most_gb: float = 1.0) -> DataFrame:
    """One row: the bytes of a tree and whether they are within the limit."""
    return _listed(spark, path).agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")).withColumn("within", F.col("bytes") <= int(most_gb * 1024**3))


def small(files: DataFrame, most: int = SMALL_FILE) -> DataFrame:
    return files.filter(F.col("length") <= most)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """JSON lines; what is not JSON gives null rather than an error."""
    reader = spark.read.option("mode", "PERMISSIVE")
    return (reader.schema(schema) if schema else reader).json(path)


def save_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def save_csv(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """CSV with a header; what is there stays unless it is to be overwritten."""
    df.write.mode("overwrite" if overwrite else "ignore").option("header", "true").csv(path)


def save_layout(df: DataFrame, path: str, kind: str = "kind") -> None:
    """Rows in a folder for each kind (chunks, parsed, metadata, output)."""
    df.write.mode("overwrite").partitionBy(kind).parquet(path)


def markdown(title: Column, level: Column, body: Column) -> Column:
    """A heading and what stands below it."""
    return F.concat(F.repeat(F.lit("#"), F.least(level, F.lit(6))), F.lit(" "), F.initcap(F.replace(title, F.lit("_"), F.lit(" "))), F.lit("\n\n"), body)


def fetched(urls: DataFrame, url_col: str, fetcher: Callable[[Column], Column]) -> DataFrame:
    """``urls`` with ``content``, what an injected fetcher makes of each address; null for what it can't get."""
    return urls.withColumn("content", fetcher(F.col(url_col)))


def _rendered(data: object, level: int, title_case: bool) -> str:
    if isinstance(data, Mapping):
        parts = []
        for key, value in data.items():
            name = key.replace("_", " ").title() if title_case else key
            parts.append(f"{'#' * level} {name}\n\n{_rendered(value, level + 1, title_case)}")
        return "".join(parts)
    if isinstance(data, list):
        return "".join("- " + _rendered(item, level + 1, title_case).lstrip() for item in data)
    return f"{data}\n\n"


def json_markdown(value: Column, level: int = 1, title_case: bool = True) -> Column:
    """JSON texts as headings with what stands below them; null for what is no JSON."""

    def render(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            out: list[str | None] = []
            for text in batch:
                try:
                    out.append(_rendered(json.loads(text), level, title_case))
                except (TypeError, ValueError):
                    out.append(None)
            yield pd.Series(out, dtype=object)

    return F.pandas_udf(render, "string")(value)
