"""Event-time windows and sessions over the events table; plain Spark, for batches and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def timed(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Events with a watermark (on streams only; batches ignore it)."""
    df = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return df.withWatermark("ts", delay) if df.isStreaming else df


def windows(events: DataFrame, size: str = "1 hour", slide: str | None = None) -> DataFrame:
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    g = timed(events).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    g = timed(events).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
