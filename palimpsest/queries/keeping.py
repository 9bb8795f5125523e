"""Integrity and lifecycle."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.intervals import month_bounds
from ..functions.payload import has_key
from ..operators import contexts as context_ops, retention, revert, upgrade
from ..operators.timetravel import table_as_of, typed_rows
from ..plans.months import with_month
from ..sources import importers, testlog
from .base import NOW, OBJECT, Registered, micros

register = Registered()


@register(f"SELECT id, changed_us FROM audit WHERE changed_at >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY")
def purge_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = with_month(testlog.log(spark, sf_dir))
    return retention.survivors(log, datetime.fromisoformat(NOW), "2 weeks").select("id", micros().alias("changed_us"))


SHIFTED = "SELECT *, changed_at - to_months(CAST(id % 9 AS INTEGER)) AS moved FROM audit"


def shifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log over nine months: its moments moved back by a number of months that the id gives."""
    log = testlog.log(spark, sf_dir)
    return log.withColumn("changed_at", (F.col("changed_at") - F.make_interval(months=(F.col("id") % 9).cast("int"))).cast("timestamp"))


@register(f"SELECT DISTINCT strftime(moved, '%Y-%m') AS month FROM ({SHIFTED}) WHERE date_trunc('month', moved) + INTERVAL 1 MONTH <= TIMESTAMP '2024-01-31' - INTERVAL 4 MONTH")
def dropped_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = [r[0] for r in with_month(shifted(spark, sf_dir)).select("changed_month").distinct().collect()]
    names = retention.droppable_months([*months, "__DEFAULT__"], datetime.fromisoformat(NOW), "4 months")
    return spark.createDataFrame([(n,) for n in names], "month string")


@register(f"SELECT strftime(m, '%Y-%m') AS month, epoch_us(m) AS start_us, epoch_us(m + INTERVAL 1 MONTH) AS end_us, n AS events FROM (SELECT date_trunc('month', moved) AS m, count(*) AS n FROM ({SHIFTED}) GROUP BY 1)")
def partition_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of the months from the oldest event on, and the events that lie in them."""
    log = shifted(spark, sf_dir)
    first, last = log.agg(F.min("changed_at"), F.max("changed_at")).first()
    rows = month_bounds(first, (last.year - first.year) * 12 + last.month - first.month + 1)
    bounds = spark.createDataFrame([(n, a, b) for n, a, b in rows], "month string, a timestamp, b timestamp")
    inside = F.broadcast(bounds).join(log, (F.col("changed_at") >= F.col("a")) & (F.col("changed_at") < F.col("b")))
    return inside.groupBy("month", micros("a").alias("start_us"), micros("b").alias("end_us")).agg(F.count("*").alias("events"))


@register("""WITH v AS (SELECT user_id, event_type, ts, event_id, LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS was FROM events)
SELECT CAST(user_id AS VARCHAR) AS id, arg_max(event_type, (ts, event_id)) AS metadata, epoch_us(min(ts)) AS created_us, epoch_us(max(ts) FILTER (was IS NULL OR was <> event_type)) AS updated_us FROM v GROUP BY user_id""", log=False)
def context_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types as versions of a context: the last one counts, from when it was first set."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    versions = e.select(F.col("user_id").cast("string").alias("id"), F.col("event_type").alias("metadata"), F.col("ts").alias("written_at"), F.col("event_id").alias("seq"))
    return context_ops.resolve(versions).select("id", "metadata", micros("created_at").alias("created_us"), micros("updated_at").alias("updated_us"))


FIRST_UPDATE = "(SELECT old_{0} FROM audit WHERE object_id = '7' AND operation = 'UPDATE' ORDER BY id LIMIT 1)"
REVERTED = ", ".join(f"CASE WHEN object_id = '7' THEN {FIRST_UPDATE.format(old)} ELSE {c} END AS {c}" for c, old in (("event_type", "type"), ("value", "value"), ("k", "k")))


@register(f"SELECT CAST(owner AS BIGINT) AS id, {REVERTED} FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY changed_at DESC, id DESC) AS n FROM audit) WHERE n = 1 AND operation <> 'DELETE'")
def revert_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surviving table with one row as it was before its first update."""
    log = testlog.log(spark, sf_dir)
    current = typed_rows(table_as_of(log, "events", "2030-01-01 00:00:00"), "id bigint, event_type string, value double, k bigint").drop("object_id")
    first = log.where((F.col("object_id") == OBJECT) & (F.col("operation") == "UPDATE")).agg(F.min("id")).first()[0]
    return revert.reverted(current, log, OBJECT, first).select("id", "event_type", "value", "k")


UPGRADED = " UNION ALL ".join(
    f"SELECT id, operation, '{c}' AS field, CASE WHEN operation <> 'INSERT' THEN CAST(old_{old} AS VARCHAR) END AS old, CASE WHEN operation <> 'DELETE' THEN CAST({c} AS VARCHAR) END AS new FROM audit WHERE operation <> 'UPDATE' OR {c} IS DISTINCT FROM old_{old}"
    for c, old in (("event_type", "type"), ("value", "value"), ("k", "k"))
)


@register(UPGRADED)
def diff_upgrade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Diffs of new values only, brought to pairs twice over; the second time changes nothing."""
    log = testlog.log(spark, sf_dir)
    values = F.to_json(F.transform_values("diff", lambda _, v: v["new"]), {"ignoreNullFields": "false"})
    once = upgrade.paired(log.withColumn("diff", values))
    twice = upgrade.paired(once.withColumn("diff", F.to_json("diff", {"ignoreNullFields": "false"})))
    return twice.select("id", "operation", F.explode("diff").alias("field", "change")).where("field <> 'id'").select("id", "operation", "field", "change.old", "change.new")


@register(" UNION ALL ".join(f"SELECT '{c}' AS field, count(*) FILTER (operation <> 'DELETE') AS images, {n} AS with_key FROM audit" for c, n in (("event_type", "count(*) FILTER (operation <> 'DELETE')"), ("value", "count(*) FILTER (operation <> 'DELETE')"), ("gone", "CAST(0 AS BIGINT)"))))
def missing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null is not the same as missing: images have all keys of their row, whatever their values."""
    images = testlog.log(spark, sf_dir).where(F.col("new_data").isNotNull()).withColumn("new_data", F.regexp_replace("new_data", '"value":[^,]*', '"value":null'))
    counted = images.agg(F.count("*").alias("images"), *[F.count_if(has_key(F.col("new_data"), c)).alias(c) for c in ("event_type", "value", "gone")])
    return counted.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col("images").alias("images"), F.col(c).alias("with_key")) for c in ("event_type", "value", "gone")])).alias("x")).select("x.*")


@register("SELECT conv_id AS object_key, CASE WHEN turn = mn THEN 'INSERT' WHEN turn = mx THEN 'DELETE' ELSE 'UPDATE' END AS operation, role, text FROM (SELECT *, min(turn) OVER (PARTITION BY conv_id) AS mn, max(turn) OVER (PARTITION BY conv_id) AS mx FROM conversations)", log=False)
def import_history_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as versions marked +, ~ and -."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    ends = c.groupBy("conv_id").agg(F.min("turn").alias("first"), F.max("turn").alias("last"))
    marked = c.join(ends, "conv_id").select(F.col("conv_id").alias("id"), "role", "text", F.when(F.col("turn") == F.col("first"), "+").when(F.col("turn") == F.col("last"), "-").otherwise("~").alias("history_type"), F.timestamp_seconds("turn").alias("history_date"))
    events = importers.from_history_table(marked, "conversations")
    data = F.coalesce("new_data", "old_data")
    return events.select(F.col("object_id").cast("bigint").alias("object_key"), "operation", F.get_json_object(data, "$.role").alias("role"), F.get_json_object(data, "$.text").alias("text"))


@register("SELECT event_id, CASE WHEN event_type = 'error' THEN 'DELETE' WHEN event_type = 'signup' THEN 'INSERT' ELSE 'UPDATE' END AS operation, CAST(user_id AS VARCHAR) AS object_id, value FROM events", log=False)
def import_event_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled snapshots of another tool."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    label = F.when(F.col("event_type") == "error", "delete_row").when(F.col("event_type") == "signup", "insert_row").otherwise("update_row")
    rows = e.select(label.alias("pgh_label"), F.col("ts").alias("pgh_created_at"), F.col("user_id").alias("pgh_obj_id"), "event_id", "value")
    events = importers.from_event_table(rows, "events")
    data = F.coalesce("new_data", "old_data")
    return events.select(F.get_json_object(data, "$.event_id").cast("bigint").alias("event_id"), "operation", "object_id", F.get_json_object(data, "$.value").cast("double").alias("value"))
