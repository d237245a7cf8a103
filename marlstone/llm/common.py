"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir; where that is unset, a local one in local mode (tests), else an error."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    if spark.sparkContext.master.startswith("local"):
        return os.path.join(tempfile.gettempdir(), "marlstone-shared")
    raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


def application_dir(spark: SparkSession) -> str:
    """Where this application's tables stand in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/marlstone-{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Cut lineage: write ``df`` as Parquet to the shared folder and read it back.

    The written table is compressed, survives the loss of any executor and is
    read again instead of being computed twice. ``release`` deletes it; all
    tables of an application are deleted by ``clear``.
    """
    path = f"{application_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.shared_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more."""
    for table in tables:
        _delete(table.sparkSession, table.shared_path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application has written to the shared folder; results that were not read yet can't be read after it."""
    _delete(spark, application_dir(spark))


#: Rows of an Arrow batch of texts, at most; Spark's default of 10,000 rows is held by the JVM, by Arrow and as strings at once.
BATCH_ROWS = 500


def small_batches(spark: SparkSession) -> None:
    """From now on the session sends BATCH_ROWS rows to Python at once, or fewer if it is set so; the JVM and the workers share an executor's memory."""
    rows = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if not 0 < rows <= BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def give_back() -> None:
    """Return to the system what a worker has freed: it waits for further tasks beside the JVM, and would keep its largest size."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` is called so, in either case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def slices(texts: Iterable[str | None], limit: int = 2_000_000) -> Iterator[tuple[int, list[str]]]:
    """Cut a batch of texts to slices of about ``limit`` characters, at least one text each.

    Yields the position of the first text and the texts; a null becomes "".
    Keeps a task's memory bounded whatever the lengths of the texts are.
    """
    start, size, part = 0, 0, []
    for i, text in enumerate(texts):
        text = text or ""
        if part and size + len(text) > limit:
            yield start, part
            start, size, part = i, 0, []
        part.append(text)
        size += len(text)
    if part:
        yield start, part
