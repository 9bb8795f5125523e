"""Rows, tables and fields as they were."""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime
from typing import Any

from pyspark.sql import DataFrame, Row, Window, functions as F

from ..functions.payload import has_key
from ..identifiers import validate_identifier
from ..plans.months import until


def row_as_of(log: DataFrame, table: str, object_id: str, at: datetime | str) -> DataFrame:
    """At most one row: the image at a moment. Top one by time, then nothing if it is a DELETE."""
    validate_identifier(table, "table")
    last = log.where((F.col("table_name") == table) & (F.col("object_id") == str(object_id)) & until(log, at)).orderBy(F.desc("changed_at"), F.desc("id")).limit(1)
    return last.where(F.col("operation") != "DELETE").select("object_id", "id", "changed_at", F.col("new_data").alias("data"))


def table_as_of(log: DataFrame, table: str, at: datetime | str) -> DataFrame:
    """Images of all rows that exist at a moment: one shuffle, with the latest event of each row
    picked on either side of it. Deleted rows go after picking."""
    validate_identifier(table, "table")
    latest = Window.partitionBy("object_id").orderBy(F.desc("changed_at"), F.desc("id"))
    seen = log.where((F.col("table_name") == table) & until(log, at))
    last = seen.withColumn("_n", F.row_number().over(latest)).where("_n = 1")
    return last.where(F.col("operation") != "DELETE").select("object_id", "id", "changed_at", F.col("new_data").alias("data"))


def as_of_join(points: DataFrame, log: DataFrame, table: str, latest: datetime | str | None = None) -> DataFrame:
    """The image at its own moment for every (object_id, at): events and points are merged in
    order of time within each object and the last event is carried to the point. Events after
    ``latest``, the last moment asked for, are not read if it is given. An object's events
    lie in one task; ``scan.as_of_join`` splits them."""
    if latest is not None:
        log = log.where(until(log, latest))
    event = F.struct("id", "operation", F.col("new_data").alias("data"), "changed_at")
    events = log.where(F.col("table_name") == table).select("object_id", F.col("changed_at").alias("at"), F.lit(0).alias("is_point"), F.col("id").alias("tie"), event.alias("event"))
    asked = points.select("object_id", F.col("at").cast(log.schema["changed_at"].dataType).alias("at"), F.lit(1).alias("is_point"), F.lit(None).cast("bigint").alias("tie"), F.lit(None).cast(events.schema["event"].dataType).alias("event"))
    order = Window.partitionBy("object_id").orderBy("at", "is_point", "tie").rowsBetween(Window.unboundedPreceding, 0)
    found = events.union(asked).withColumn("event", F.last("event", ignorenulls=True).over(order)).where("is_point = 1")
    return found.where(F.col("event").isNotNull() & (F.col("event.operation") != "DELETE")).select("object_id", "at", "event.id", "event.changed_at", "event.data")


def field_history(log: DataFrame, table: str, object_id: str, field: str) -> DataFrame:
    """Moments and values of one field; a DELETE always closes the line with null."""
    own = log.where((F.col("table_name") == table) & (F.col("object_id") == str(object_id)))
    changed = F.coalesce(F.map_contains_key("diff", field), F.lit(False))
    keep = F.when(F.col("operation") == "INSERT", has_key(F.col("new_data"), field)).when(F.col("operation") == "UPDATE", changed).otherwise(F.col("operation") == "DELETE")
    value = F.when(F.col("operation") != "DELETE", F.get_json_object("new_data", f"$.{field}"))
    return own.where(keep).select("id", "changed_at", value.alias("value")).orderBy("changed_at", "id")


def sql_table_function(view: str, name: str) -> str:
    """SQL that installs ``name(table, at)`` over a view of the log."""
    validate_identifier(view, "view"), validate_identifier(name, "function")
    return (
        f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(asked STRING, moment TIMESTAMP) RETURNS TABLE(object_id STRING, data STRING) "
        f"RETURN SELECT object_id, last.data FROM (SELECT object_id, max_by(struct(operation, new_data AS data), struct(changed_at, id)) AS last "
        f"FROM {view} WHERE table_name = {name}.asked AND changed_at <= {name}.moment GROUP BY object_id) WHERE last.operation <> 'DELETE'"
    )


def typed_rows(rows: DataFrame, schema: str) -> DataFrame:
    """Images in a current schema: fields that it lacks are dropped, new ones are null."""
    return rows.select("object_id", F.from_json("data", schema).alias("row")).select("object_id", "row.*")


def _own_schema(rows: DataFrame) -> str:
    """The schema of all images together, from their own JSON."""
    found = rows.agg(F.expr("schema_of_variant_agg(try_parse_json(data))")).first()[0] or ""
    return found.replace("OBJECT<", "STRUCT<").replace(": VOID", ": STRING") if found.startswith("OBJECT<") else "id string"


class Tracked:
    """History of one table."""

    def __init__(self, log: DataFrame, table: str):
        self.log, self.table = log, validate_identifier(table, "table")

    def history(self) -> DataFrame:
        return self.log.where(F.col("table_name") == self.table)

    def events(self, pk: Any) -> DataFrame:
        return self.history().where(F.col("object_id") == str(pk))

    def at(self, pk: Any, at: datetime | str, schema: str | None = None) -> Row | None:
        """The row as it was, in a schema of today or in that of its own image."""
        found = row_as_of(self.log, self.table, str(pk), at).collect()
        if not found:
            return None
        rows = self.log.sparkSession.createDataFrame([(found[0]["object_id"], found[0]["data"])], "object_id string, data string")
        return typed_rows(rows, schema or _own_schema(rows)).first()

    def field_history(self, pk: Any, field: str) -> DataFrame:
        return field_history(self.log, self.table, str(pk), field)

    def state(self, at: datetime | str) -> DataFrame:
        return table_as_of(self.log, self.table, at)

    def state_as_of(self, at: datetime | str, schema: str | None = None) -> Iterator[Row]:
        """All rows as they were, a partition at a time on the driver."""
        found = self.state(at)
        return typed_rows(found, schema or _own_schema(found)).toLocalIterator(prefetchPartitions=True)
