"""Windowed counts over the stream of events, with a watermark for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 8).parquet(path)


def windowed(events: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total) a window; an event seen twice within the watermark counts once."""
    once = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
    counted = once.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return counted.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """(user_id, start, stop, n): stretches of a user's events without a longer gap."""
    source = events.withWatermark("ts", "1 hour") if events.isStreaming else events
    counted = source.groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return counted.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("stop"), "n")


def write_available(df: DataFrame, path: str, checkpoint: str):
    """Process what is there now and stop; the checkpoint makes a rerun take up where this ended."""
    return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
