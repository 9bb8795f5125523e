"""Contexts as append-only versions, resolved when they are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F


def resolve(versions: DataFrame) -> DataFrame:
    """One row an id: first written, last metadata, and when that value was first set. Writing the
    same metadata again changes nothing."""
    order = Window.partitionBy("id").orderBy("written_at", "seq")
    changed = ~F.lag("metadata").over(order).eqNullSafe(F.col("metadata"))
    runs = versions.withColumn("_changed", changed)
    key = F.struct("written_at", "seq")
    return runs.groupBy("id").agg(
        F.max_by("metadata", key).alias("metadata"),
        F.min("written_at").alias("created_at"),
        F.max(F.when(F.col("_changed"), F.col("written_at"))).alias("updated_at"),
    )


def used_only(versions: DataFrame, events: DataFrame) -> DataFrame:
    """Versions of contexts that some event has: a context without events is not written."""
    ids = events.where(F.col("context_id").isNotNull()).select(F.col("context_id").alias("id"))
    return versions.join(ids, "id", "left_semi")
