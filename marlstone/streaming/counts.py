"""Counts over event time, for batches and streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, time: str, key: str, width: str, lateness: str | None = "1 hour") -> DataFrame:
    """start, key, n for each window of event time. On a stream, rows later than `lateness` are dropped and state is
    bounded by it; None keeps all windows."""
    rows = events.select(F.col(time).cast("timestamp").alias("_at"), key)
    if lateness:
        rows = rows.withWatermark("_at", lateness)
    return rows.groupBy(F.window("_at", width).alias("_w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("_w.start").alias("start"), key, "n")
