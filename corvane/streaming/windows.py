"""Event-time windows, for batches and for streams alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed(events: DataFrame, ts: str, window: str, keys: list[str], aggregates: list[Column], slide: str | None = None, late: str | None = None) -> DataFrame:
    """(start, end, keys, aggregates) in tumbling or sliding windows; ``late``: how long a stream waits."""
    if late:
        events = events.withWatermark(ts, late)
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    rows = events.groupBy(w.alias("w"), *keys).agg(*aggregates)
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(c for c in rows.columns if c != "w"))


def sessions(events: DataFrame, ts: str, gap: str, keys: list[str], aggregates: list[Column], late: str | None = None) -> DataFrame:
    """(start, end, keys, aggregates) of sessions that end after a gap."""
    if late:
        events = events.withWatermark(ts, late)
    rows = events.groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(*aggregates)
    return rows.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *(c for c in rows.columns if c != "w"))
