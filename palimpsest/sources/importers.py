"""Histories of other tools as audit events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.payload import row_json
from ..schema import AUDIT_LOG

REQUIRED = ("operation", "changed_at", "table_name")


def _rest(df: DataFrame, skip: set[str]) -> Column:
    return row_json(F.struct(*[c for c in df.columns if c not in skip]))


def from_event_table(events: DataFrame, table: str, label: str = "pgh_label", moment: str = "pgh_created_at", key: str = "pgh_obj_id", prefix: str = "pgh_") -> DataFrame:
    """Labelled snapshots: the label's beginning names the operation, columns with the prefix are
    bookkeeping and only kept as provenance."""
    name = F.lower(F.col(label))
    operation = F.when(name.startswith("insert") | name.startswith("create"), "INSERT").when(name.startswith("delete") | name.startswith("remove"), "DELETE").otherwise("UPDATE")
    image = _rest(events, {c for c in events.columns if c.startswith(prefix)})
    return events.select(
        operation.alias("operation"),
        F.col(moment).alias("changed_at"),
        F.col(key).cast("string").alias("object_id"),
        F.lit(table).alias("table_name"),
        F.when(operation == "DELETE", image).alias("old_data"),
        F.when(operation != "DELETE", image).alias("new_data"),
        F.create_map(F.lit("imported_from"), F.lit("event_table"), F.lit("label"), F.col(label)).alias("meta"),
    )


def from_history_table(history: DataFrame, table: str, key: str = "id", prefix: str = "history_") -> DataFrame:
    """Rows marked ``+``, ``~`` and ``-``."""
    kind = F.col(f"{prefix}type")
    operation = F.when(kind == "+", "INSERT").when(kind == "-", "DELETE").otherwise("UPDATE")
    image = _rest(history, {c for c in history.columns if c.startswith(prefix)})
    return history.select(
        operation.alias("operation"),
        F.col(f"{prefix}date").alias("changed_at"),
        F.col(key).cast("string").alias("object_id"),
        F.lit(table).alias("table_name"),
        F.when(operation == "DELETE", image).alias("old_data"),
        F.when(operation != "DELETE", image).alias("new_data"),
        F.create_map(F.lit("imported_from"), F.lit("history_table")).alias("meta"),
    )


def conform(events: DataFrame) -> DataFrame:
    """Any rows in the log's schema: required columns must be there, others are null."""
    missing = [c for c in REQUIRED if c not in events.columns]
    if missing:
        raise ValueError(f"events lack {', '.join(missing)}")
    unknown = [c for c in events.columns if c not in AUDIT_LOG.fieldNames()]
    if unknown:
        raise ValueError(f"the log has no {', '.join(unknown)}")
    column = lambda f: F.col(f.name).cast(f.dataType) if f.name in events.columns else F.lit(None).cast(f.dataType)
    return events.select(*[column(f).alias(f.name) for f in AUDIT_LOG])
