"""Windowed counts and running profiles over event streams, with late events bounded by a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, time: str = "ts", key: str = "event_type", value: str = "value", window: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """window_start, key, n, total: works alike on a stream and on a table."""
    at = F.col(time).cast("timestamp")
    marked = events.withColumn(time, at)
    if events.isStreaming:
        marked = marked.withWatermark(time, late)
    w = F.window(time, window, slide) if slide else F.window(time, window)
    out = marked.groupBy(w.alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), "key", "n", "total")


def sessions(events: DataFrame, time: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """key, session_start, session_end, n: bursts of events with no longer gap inside."""
    marked = events.withColumn(time, F.col(time).cast("timestamp"))
    if events.isStreaming:
        marked = marked.withWatermark(time, late)
    out = marked.groupBy(F.session_window(time, gap).alias("w"), F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return out.select("key", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
