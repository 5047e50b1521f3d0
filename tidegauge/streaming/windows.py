"""Windowed sums for batch tables and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, width: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Count and sum per window and event type; on a stream, events up to ``late`` behind the newest still count."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    return rows.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")
