"""Tables in the folder that all executors share, to cut the lineage of what is computed in rounds."""

from __future__ import annotations

import hashlib
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where that is unset, a local folder in local mode (tests), else an error."""
    if path := spark.conf.get("spark.checkpoint.dir", None):
        return path
    if spark.sparkContext.master.startswith("local"):
        return os.path.join(tempfile.gettempdir(), "marlstone-shared")
    raise ValueError("spark.checkpoint.dir must name a folder that all executors share")


def application_dir(spark: SparkSession) -> str:
    """Where this application's tables stand in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/marlstone-{spark.sparkContext.applicationId}/library"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, below the application's."""
    return f"{application_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back; it outlives any executor."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """As ``written``, as a table with a bucket for each shuffle partition: joins by all of ``keys`` do not shuffle it again."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"marlstone_{path.rsplit('/', 1)[-1].replace('-', '_')}"
    df.repartition(n, *keys).write.format("parquet").bucketBy(n, *keys).option("path", path).saveAsTable(table)
    return spark.table(table)


def delete(spark: SparkSession, path: str) -> None:
    """Delete a folder of any store."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a folder of any store is there."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def clear(spark: SparkSession) -> None:
    """Delete all that the library has written to the shared folder for this application; what was not read yet can't be read after it."""
    delete(spark, application_dir(spark))


def source_version(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of the files of a table; it changes when they do."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length", F.unix_micros("modificationTime").alias("at")).collect()
    return hashlib.sha256(repr(sorted(map(tuple, files))).encode()).hexdigest()
