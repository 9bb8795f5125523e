"""A running last value over any number of rows of one key, in parallel.

A window over a key puts all its rows into one task. Here rows are dealt by ranges of key and order,
which cut a large key wherever they like; each range is scanned by itself, and what a range leaves
to the next is one row a range, over which a short scan runs. So the longest task has a range, not
a key.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.months import until


def last_before(rows: DataFrame, key: str, order: list[str], value: str, stage: Callable[[DataFrame], DataFrame], ranges: int | None = None) -> DataFrame:
    """``rows`` with the last ``value`` that is not null among the rows of the same ``key`` up to
    each, in ``order``. ``stage`` writes rows and reads them back: a range's number is data from
    then on, so that no new run of a task can deal a row elsewhere."""
    by = [F.col(key), *[F.col(c) for c in order]]
    spread = rows.repartitionByRange(ranges, *by) if ranges else rows.repartitionByRange(*by)
    placed = stage(spread.sortWithinPartitions(*by).withColumn("_range", F.spark_partition_id()))
    within = Window.partitionBy("_range", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    found = placed.withColumn("_found", F.last(value, ignorenulls=True).over(within))
    # Of each range, the last key that has a value, and that value.
    last = F.max_by(F.struct(F.col(key).alias("key"), F.col(value).alias("value")), F.struct(key, *order))
    ends = placed.where(F.col(value).isNotNull()).groupBy("_range").agg(last.alias("end"))
    numbers = placed.select("_range").distinct().join(ends, "_range", "left")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = numbers.select("_range", F.last("end", ignorenulls=True).over(earlier).alias("_carried"))
    # As many rows as there are ranges.
    joined = found.join(F.broadcast(carried), "_range")
    fits = F.col("_carried.key").eqNullSafe(F.col(key))
    return joined.withColumn(value, F.coalesce("_found", F.when(fits, F.col("_carried.value")))).drop("_range", "_found", "_carried")


def as_of_join(points: DataFrame, log: DataFrame, table: str, stage: Callable[[DataFrame], DataFrame], latest: datetime | None = None, ranges: int | None = None) -> DataFrame:
    """The image at its own moment for every (object_id, at), as ``timetravel.as_of_join`` gives it,
    for objects of any number of events. Nothing after the latest moment asked for is read;
    it is looked up if it isn't given."""
    kind = log.schema["changed_at"].dataType
    if latest is None:
        moment = F.col("at").cast(kind).cast("timestamp")
        found = points.agg(F.date_format(F.max(moment), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at")).first()["at"]
        latest = found or "1970-01-01 00:00:00"
    event = F.struct("id", "operation", F.col("new_data").alias("data"), "changed_at")
    events = log.where((F.col("table_name") == table) & until(log, latest)).select("object_id", F.col("changed_at").alias("at"), F.lit(0).alias("is_point"), F.col("id").alias("tie"), event.alias("event"))
    none: Column = F.lit(None)
    asked = points.select("object_id", F.col("at").cast(kind).alias("at"), F.lit(1).alias("is_point"), F.monotonically_increasing_id().alias("tie"), none.cast(events.schema["event"].dataType).alias("event"))
    found = last_before(events.unionByName(asked), "object_id", ["at", "is_point", "tie"], "event", stage, ranges).where("is_point = 1")
    return found.where(F.col("event").isNotNull() & (F.col("event.operation") != "DELETE")).select("object_id", "at", "event.id", "event.changed_at", "event.data")
