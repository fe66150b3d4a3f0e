"""Structured Streaming over event tables (an extension: there is no event time in the data model itself)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def event_stream(spark: SparkSession, folder: str, schema) -> DataFrame:
    """Events read as files arrive."""
    return spark.readStream.schema(schema).parquet(folder)


def windowed(events: DataFrame, *, size: str = "1 day", late: str = "1 day", time: str = "ts") -> DataFrame:
    """Counts and sums by tumbling window and type; runs as a batch and, with a watermark, as a stream."""
    e = events.withColumn(time, F.col(time).cast("timestamp"))
    e = e.withWatermark(time, late) if e.isStreaming else e
    w = F.window(time, size)
    return e.groupBy(w.alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "events", "total")


def sessions(events: DataFrame, *, gap: str = "1 hour", late: str = "1 day", time: str = "ts") -> DataFrame:
    """Sessions a user: runs of events less than ``gap`` apart."""
    e = events.withColumn(time, F.col(time).cast("timestamp"))
    e = e.withWatermark(time, late) if e.isStreaming else e
    w = F.session_window(time, gap)
    return e.groupBy(w.alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events")).select("user_id", F.col("w.start").alias("session_start"), "events")
