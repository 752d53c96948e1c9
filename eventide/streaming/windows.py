"""Event-time windows over a stream of journal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(
    events: DataFrame, size: str = "1 hour", delay: str = "10 minutes", ts: str = "created_utc", by: tuple[str, ...] = ("kind",)
) -> DataFrame:
    """Events per window and key, emitted once the watermark has passed the window."""
    w = F.window(ts, size).alias("w")
    counts = events.withWatermark(ts, delay).groupBy(w, *by).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("w.start").alias("window_start"), *by, "n")


def session_counts(
    events: DataFrame, gap: str, delay: str = "10 minutes", ts: str = "ts", by: tuple[str, ...] = ("camera",)
) -> DataFrame:
    """Session windows: bursts approximately; see stateful.burst_stream for the exact rule."""
    w = F.session_window(ts, gap).alias("w")
    counts = events.withWatermark(ts, delay).groupBy(*by, w).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(*by, F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")
