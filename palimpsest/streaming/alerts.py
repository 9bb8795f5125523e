"""Alerts on streams of events: two stateful steps in append mode.

The first step counts in short windows, in parallel; the second joins windows that lie close
together to sessions. Both leave their state as the watermark passes, and each alert is given once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def bursts(events: DataFrame, more_than: int, width: str = "1 minute", gap: str = "90 seconds", windows: int = 2, late: str = "10 minutes", operation: str = "DELETE") -> DataFrame:
    """Runs of at least ``windows`` windows in a row that have more than so many events of an
    operation in one table. ``gap`` must lie between one and two widths."""
    counts = events.where(F.col("operation") == operation).withWatermark("changed_at", late).groupBy("table_name", F.window("changed_at", width)).agg(F.count("*").alias("n"))
    high = counts.where(F.col("n") > more_than)
    runs = high.groupBy("table_name", F.session_window(F.window_time("window"), gap)).agg(F.min("window.start").alias("first"), F.max("window.end").alias("last"), F.count("*").alias("windows"), F.sum("n").alias("events"))
    return runs.where(F.col("windows") >= windows).select("table_name", "first", "last", "windows", "events")


def stalls(events: DataFrame, silence: str = "5 minutes", width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Ends of stretches of events after which none came for at least ``silence``; ``silent_from``
    is the end of the last window with events, ``events`` how many the stretch had."""
    counts = events.withWatermark("changed_at", late).groupBy(F.window("changed_at", width)).agg(F.count("*").alias("n"))
    # One key for all, which Spark does not see to be one: sessions need a key.
    stretches = counts.groupBy((F.col("n") < 0).alias("none"), F.session_window(F.window_time("window"), silence)).agg(F.max("window.end").alias("silent_from"), F.sum("n").alias("events"))
    return stretches.select("silent_from", "events")
