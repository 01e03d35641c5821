"""Windowed event counts, over a table and over a stream by the same expression."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling(events: DataFrame, width: str = "1 hour") -> DataFrame:
    """(window_start, event_type, n, total) by windows of ``ts``."""
    by = events.groupBy(F.window("ts", width).alias("w"), "event_type")
    return by.agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def stream(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``tumbling`` over a stream whose ``ts`` is a timestamp; rows later than ``late`` are left out."""
    return tumbling(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late), width)
