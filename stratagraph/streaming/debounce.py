"""Trailing-edge debounce as session windows, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, gap: str = "2 seconds", ts: str = "ts", watermark: str | None = None) -> DataFrame:
    """key, started, fires, n: events of a key less than gap apart are one burst, which fires gap after its last event. On a
    stream a watermark lets finished bursts go out."""
    if watermark:
        events = events.withWatermark(ts, watermark)
    g = events.groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return g.select(key, F.col("w.start").alias("started"), F.col("w.end").alias("fires"), "n")
