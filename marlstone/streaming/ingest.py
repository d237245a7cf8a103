"""Streams: messages into a store, and counts of events by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of the Parquet files that come into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def event_counts(events: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Events by window and type, late ones up to the watermark: (begin, event_type, n, value). Works on streams and tables."""
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    counted = events.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return counted.select(F.col("w.start").alias("begin"), "event_type", "n", "value")


def once(messages: DataFrame, late: str = "1 day") -> DataFrame:
    """Messages of a stream (_key, timestamp), each key once within the watermark."""
    return messages.withWatermark("timestamp", late).dropDuplicatesWithinWatermark(["_key"])


def store(messages: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append the stream to a Parquet table, all that is there now, exactly once."""
    return messages.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
