"""Reports for people: blame lines, histories, statistics and health."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import render
from ..operators import blame as blame_ops, metrics
from ..operators.history import History
from ..operators.retention import lag_behind
from ..sources import testlog
from .asking import ACTOR, _blame, _history, _now
from .base import NOW, OBJECT, Registered, micros
from .logs import made_once

register = Registered()

SUMMARY = """CASE operation WHEN 'INSERT' THEN 'inserted (4 fields)' WHEN 'DELETE' THEN 'deleted (4 fields)' ELSE concat('changed: ', concat_ws(', ', CASE WHEN event_type IS DISTINCT FROM old_type THEN 'event_type' END, CASE WHEN k IS DISTINCT FROM old_k THEN 'k' END, CASE WHEN value IS DISTINCT FROM old_value THEN 'value' END)) END"""


@register(f"""SELECT id, rtrim(concat(strftime(changed_at, '%Y-%m-%d %H:%M'), '  ', operation, '  ', actor, repeat(' ', max(length(actor)) OVER () - length(actor)), '  ', change, CASE WHEN reason IS NOT NULL THEN concat('  (', reason, ')') ELSE '' END, CASE WHEN context_id IS NOT NULL THEN concat('  ctx=', substr(context_id, 1, 8)) ELSE '' END)) AS line
FROM (SELECT a.*, {ACTOR} AS actor, ctx.reason, {SUMMARY} AS change FROM audit a LEFT JOIN ctx ON ctx.id = a.context_id WHERE object_id = '{OBJECT}' ORDER BY a.changed_at, a.id LIMIT 200)""")
def blame_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blame_ops.text_lines(_blame(spark, sf_dir)).select("id", "line")


@register(f"SELECT a.id, a.operation, strftime(a.changed_at, '%Y-%m-%dT%H:%M:%S.%f') AS changed_at, {ACTOR} AS actor, ctx.reason AS change_reason, CASE WHEN operation <> 'INSERT' THEN old_type END AS old_type, CASE WHEN operation <> 'DELETE' THEN event_type END AS new_type FROM audit a LEFT JOIN ctx ON ctx.id = a.context_id WHERE object_id = '{OBJECT}' AND (operation <> 'UPDATE' OR event_type IS DISTINCT FROM old_type)")
def blame_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries as JSON objects with ISO moments, read back."""
    text = blame_ops.json_rows(_blame(spark, sf_dir, field="event_type"))
    shape = "id bigint, operation string, changed_at string, actor string, change_reason string, diff map<string,struct<old:string,new:string>>"
    side = F.col("x.diff")["event_type"]
    return text.select(F.from_json("entry", shape).alias("x")).select("x.id", "x.operation", "x.changed_at", "x.actor", "x.change_reason", side["old"].alias("old_type"), side["new"].alias("new_type"))


@register("""SELECT id, source, reason, list_aggregate(list_filter([CASE WHEN operation <> 'UPDATE' OR event_type IS DISTINCT FROM old_type THEN concat('event_type: ', coalesce('"' || old_type || '"', '∅'), ' → ', coalesce('"' || event_type || '"', '∅')) END,
CASE WHEN operation <> 'UPDATE' THEN concat('id: ', CASE WHEN operation = 'INSERT' THEN '∅' ELSE '"' || object_id || '"' END, ' → ', CASE WHEN operation = 'DELETE' THEN '∅' ELSE '"' || object_id || '"' END) END,
CASE WHEN operation <> 'UPDATE' OR k IS DISTINCT FROM old_k THEN concat('k: ', coalesce('"' || old_k || '"', '∅'), ' → ', coalesce('"' || k || '"', '∅')) END,
CASE WHEN operation <> 'UPDATE' OR value IS DISTINCT FROM old_value THEN concat('value: ', coalesce('"' || old_value || '"', '∅'), ' → ', coalesce('"' || value || '"', '∅')) END], lambda x: x IS NOT NULL), 'string_agg', '; ') AS changes
FROM (SELECT a.*, ctx.source, ctx.reason FROM audit a LEFT JOIN ctx ON ctx.id = a.context_id) WHERE operation <> 'UPDATE' OR event_type IS DISTINCT FROM old_type OR k IS DISTINCT FROM old_k OR value IS DISTINCT FROM old_value""")
def history_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = blame_ops.history_report(testlog.changed(testlog.log(spark, sf_dir)), testlog.contexts(spark, sf_dir))
    return found.select("id", "source", "reason", F.array_join("changes", "; ").alias("changes"))


@register("SELECT conv_id, turn, replace(concat('[', role, '] ', text), '[', '\\[') AS escaped FROM conversations", log=False)
def markup_escaped(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return c.select("conv_id", "turn", render.escape_markup(F.concat(F.lit("["), "role", F.lit("] "), "text")).alias("escaped"))


@register("SELECT a.id, coalesce(c.c_name, a.object_id) AS value FROM audit a LEFT JOIN customer c ON CAST(c.c_custkey AS VARCHAR) = a.object_id")
def labelled_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys replaced by the names of what they point at."""
    found = testlog.log(spark, sf_dir).select("id", F.col("object_id").alias("value"))
    return blame_ops.labelled(found, spark.read.parquet(f"{sf_dir}/customer.parquet"), "c_custkey", "c_name").select("id", "value")


@register("SELECT id, CASE k % 3 WHEN 0 THEN 'audit_x_trigger' WHEN 1 THEN 'auditXxXtrigger' ELSE 'audit_other' END AS table_name FROM (SELECT id, coalesce(k, old_k) AS k FROM audit) WHERE k % 3 = 0")
def table_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    """LIKE with an escape: underscores that mean themselves."""
    k = F.coalesce(F.get_json_object("new_data", "$.k"), F.get_json_object("old_data", "$.k")).cast("bigint")
    log = testlog.log(spark, sf_dir).withColumn("table_name", F.when(k % 3 == 0, "audit_x_trigger").when(k % 3 == 1, "auditXxXtrigger").otherwise("audit_other"))
    return History(log).table_like("audit#_%#_trigger").df.select("id", "table_name")


@register(f"SELECT id FROM audit WHERE changed_at > TIMESTAMP '{NOW}' - INTERVAL 3 DAY")
def within_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).within(3 * 86_400, _now()).df.select("id")


@register("SELECT id, changed_us FROM audit ORDER BY changed_at DESC, id DESC LIMIT 20 OFFSET (SELECT (greatest(1, CAST(ceil(count(*) / 20.0) AS BIGINT)) - 1) * 20 FROM audit)")
def history_last_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page beyond the last is the last."""
    return _history(spark, sf_dir).page(10**6).select("id", micros().alias("changed_us"))


@register("SELECT count(*) AS \"rows\", coalesce(max(id), 0) AS last_id FROM audit")
def log_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.log_counts(testlog.log(spark, sf_dir))


@register("SELECT event_type AS name, count(*) AS calls, round(sum(value), 4) AS total_ms, round(avg(value), 6) AS mean_ms, round(stddev_pop(value) / avg(value), 6) AS spread, round(100 * sum(value) / sum(sum(value)) OVER (), 4) AS percent FROM events GROUP BY event_type", log=False)
def statement_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of events as if they were times of statements, with each one's share of all time."""
    found = metrics.statement_statistics(spark.read.parquet(f"{sf_dir}/events.parquet").withColumnRenamed("event_type", "name"), "name", "value")
    return found.select("name", "calls", F.round("total_ms", 4).alias("total_ms"), F.round("mean_ms", 6).alias("mean_ms"), F.round("spread", 6).alias("spread"), F.round("percent", 4).alias("percent"))


@register("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY event_type", log=False)
def value_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.latency_quantiles(spark.read.parquet(f"{sf_dir}/events.parquet"), "value", "event_type", made_once)


@register(f"SELECT count(*) AS events, (epoch_us(TIMESTAMP '{NOW}' - INTERVAL 10 DAY) - min(changed_us)) / 1000000 AS seconds_behind, count(DISTINCT strftime(changed_at, '%Y-%m')) AS months, count(DISTINCT object_id) AS objects FROM audit")
def log_health(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for a dashboard: events, retention lag, months and objects."""
    log = testlog.log(spark, sf_dir)
    behind = lag_behind(log, datetime.fromisoformat(NOW), "10 days").scalar()
    return log.agg(F.count("*").alias("events"), F.count_distinct(F.date_format("changed_at", "yyyy-MM")).alias("months"), F.count_distinct("object_id").alias("objects")).select("events", behind.alias("seconds_behind"), "months", "objects")
