"""Putting an old image back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, functions as F


def revert_columns(event: dict) -> list[str]:
    """Columns that an event can give back: those of its old image but the key."""
    if not event.get("old_data"):
        raise ValueError("an INSERT has no old image to go back to")
    return [c for c in json.loads(event["old_data"]) if c != "id"]


def reverted(target: DataFrame, log: DataFrame, record_id: object, log_id: int, columns: list[str] | None = None, key: str = "id") -> DataFrame:
    """The table with one record's columns as they were before an event. Nulls are put back too;
    a record that is not there is not made again."""
    found = log.where(F.col("id") == log_id).select("old_data").limit(1)
    columns = columns if columns is not None else revert_columns((found.collect() or [{"old_data": None}])[0].asDict())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in target.schema if f.name in columns)
    entry = found.select(F.lit(str(record_id)).alias("_record"), F.from_json("old_data", schema).alias("_old"))
    joined = target.join(entry, target[key].cast("string") == F.col("_record"), "left")
    return joined.select(*[F.when(F.col("_record").isNotNull(), F.col(f"_old.{c}")).otherwise(target[c]).alias(c) if c in columns else target[c] for c in target.columns])
