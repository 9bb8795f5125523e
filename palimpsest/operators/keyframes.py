"""States at the turn of a month, kept so that later states need not read what lies before.

A keyframe has the last event of every object before its moment, also of objects that are gone: an
event that comes late may be older than the deletion, and must not bring the object back. A later
state is the latest event of each object among the keyframe, the months since, and what has come
late for earlier ones.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window, functions as F

from ..identifiers import validate_identifier
from ..plans.months import before, until

KEYFRAME = "object_id string, operation string, id bigint, changed_at timestamp, new_data string"
COLUMNS = ("object_id", "operation", "id", "changed_at", "new_data")


def last_events(events: DataFrame) -> DataFrame:
    """The last event of each object."""
    latest = Window.partitionBy("object_id").orderBy(F.desc("changed_at"), F.desc("id"))
    return events.select(*COLUMNS).withColumn("_n", F.row_number().over(latest)).where("_n = 1").drop("_n")


def keyframe(log: DataFrame, table: str, at: datetime | str, earlier: DataFrame | None = None) -> DataFrame:
    """The last event of each object of a table before a moment; ``earlier`` is a keyframe from
    which ``log`` goes on."""
    validate_identifier(table, "table")
    events = log.where((F.col("table_name") == table) & before(log, at)).select(*COLUMNS)
    return last_events(events if earlier is None else events.unionByName(earlier.select(*COLUMNS)))


def table_as_of(frame: DataFrame, since: DataFrame, table: str, at: datetime | str) -> DataFrame:
    """Images at a moment from a keyframe before it and events that the keyframe does not know."""
    events = since.where((F.col("table_name") == validate_identifier(table, "table")) & until(since, at))
    last = last_events(frame.select(*COLUMNS).unionByName(events.select(*COLUMNS)))
    return last.where(F.col("operation") != "DELETE").select("object_id", "id", "changed_at", F.col("new_data").alias("data"))
