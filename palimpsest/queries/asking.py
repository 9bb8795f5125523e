"""History, blame and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import render
from ..operators import blame as blame_ops, metrics
from ..operators.history import History
from ..sources import testlog
from .base import AT, EVENT_SQL, NOW, OBJECT, Registered, event_columns, micros, sql_field  # noqa: F401

register = Registered()


def _history(spark: SparkSession, sf_dir: str) -> History:
    return History(testlog.log(spark, sf_dir))


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


@register(f"SELECT {EVENT_SQL} FROM audit WHERE object_id = '{OBJECT}'")
def for_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).for_object("events", OBJECT).df.select(*event_columns())


@register("SELECT id, operation FROM audit WHERE user_id = 12")
def for_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).for_user(12).df.select("id", "operation")


@register("SELECT id, operation FROM audit WHERE user_id IS NULL")
def for_user_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).for_user(None).df.select("id", "operation")


@register("SELECT id, changed_us FROM audit WHERE context_id = md5('7|2024-01-03')")
def for_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib

    return _history(spark, sf_dir).trail(hashlib.md5(b"7|2024-01-03").hexdigest()).select("id", micros().alias("changed_us"))


@register("SELECT id, changed_us FROM audit ORDER BY changed_at DESC, id DESC LIMIT 100")
def recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).recent(100).select("id", micros().alias("changed_us"))


@register(f"SELECT id, operation, object_id FROM audit WHERE user_id = 30 AND changed_at >= TIMESTAMP '{AT}' AND operation IN ('UPDATE', 'DELETE')")
def chained_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).for_user(30).by_table("events").since(AT).operation("UPDATE", "DELETE").df.select("id", "operation", "object_id")


@register("SELECT id FROM audit WHERE event_type = 'purchase' AND (operation = 'INSERT' OR (operation = 'UPDATE' AND old_type IS DISTINCT FROM event_type))")
def diff_contains_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).changed("event_type", "new", "purchase").df.select("id")


@register("SELECT id FROM audit WHERE old_type = 'click' AND (operation = 'DELETE' OR (operation = 'UPDATE' AND old_type IS DISTINCT FROM event_type))")
def diff_contains_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).changed("event_type", "old", "click").df.select("id")


@register("SELECT id, operation FROM audit WHERE operation <> 'UPDATE' OR k IS DISTINCT FROM old_k")
def touching_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).touching("k").df.select("id", "operation")


@register("SELECT a.id, a.context_id FROM audit a JOIN ctx ON ctx.id = a.context_id WHERE ctx.source = 'http'")
def trace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).linked_to(testlog.contexts(spark, sf_dir), "source", "http").select("id", "context_id")


@register("SELECT id, object_id FROM audit WHERE object_id LIKE '%12%'")
def object_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).object_contains("12").df.select("id", "object_id")


@register("SELECT 'events' AS table_name, operation, count(*) AS n FROM audit GROUP BY operation")
def facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).facets().withColumnRenamed("count", "n")


@register("SELECT id, object_id FROM audit WHERE object_id IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_nationkey = 3)")
def subject_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = spark.read.parquet(f"{sf_dir}/customer.parquet").where("c_nationkey = 3").select(F.col("c_custkey").cast("string").alias("object_id"))
    return _history(spark, sf_dir).of_subjects(ids).select("id", "object_id")


@register("SELECT id, changed_us FROM audit ORDER BY changed_at DESC, id DESC LIMIT 20 OFFSET 40")
def history_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _history(spark, sf_dir).page(3).select("id", micros().alias("changed_us"))


def _blame(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return blame_ops.blame(testlog.log(spark, sf_dir), testlog.contexts(spark, sf_dir), "events", OBJECT, **options)


ACTOR = "CASE WHEN a.user_id IS NOT NULL AND ctx.username IS NOT NULL THEN concat('user=', CAST(a.user_id AS VARCHAR), ' (', ctx.username, ')') WHEN a.user_id IS NOT NULL THEN concat('user=', CAST(a.user_id AS VARCHAR)) WHEN ctx.username IS NOT NULL THEN concat('user=', ctx.username) WHEN ctx.source IS NOT NULL THEN concat('source=', ctx.source) ELSE 'system' END"


@register(f"SELECT a.id, a.operation, a.changed_us, {ACTOR} AS actor, ctx.reason AS change_reason FROM audit a LEFT JOIN ctx ON ctx.id = a.context_id WHERE object_id = '{OBJECT}' ORDER BY a.changed_at, a.id LIMIT 200")
def blame_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blame(spark, sf_dir).select("id", "operation", micros().alias("changed_us"), "actor", "change_reason")


QUOTED = """concat('"', {}, '"')"""


@register(f"""SELECT id, CASE operation WHEN 'INSERT' THEN concat('→ ', {QUOTED.format('event_type')}) WHEN 'DELETE' THEN concat({QUOTED.format('old_type')}, ' → ∅') ELSE concat({QUOTED.format('old_type')}, ' → ', {QUOTED.format('event_type')}) END AS change
FROM (SELECT * FROM audit WHERE object_id = '{OBJECT}' ORDER BY changed_at, id LIMIT 200) WHERE operation <> 'UPDATE' OR event_type IS DISTINCT FROM old_type""")
def blame_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blame(spark, sf_dir, field="event_type").select("id", "change")


@register(f"""SELECT id FROM (SELECT * FROM audit WHERE object_id = '{OBJECT}' ORDER BY changed_at, id LIMIT 10) WHERE operation <> 'UPDATE' OR event_type IS DISTINCT FROM old_type""")
def blame_limit_before_narrow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blame(spark, sf_dir, field="event_type", limit=10).select("id")


@register(f"SELECT a.id, {ACTOR} AS actor FROM audit a LEFT JOIN ctx ON ctx.id = a.context_id")
def actor_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = _history(spark, sf_dir).with_context(testlog.contexts(spark, sf_dir))
    return joined.select("id", render.actor(F.col("user_id"), F.col("metadata")).alias("actor"))


@register("""SELECT id, CASE operation WHEN 'INSERT' THEN 'inserted (4 fields)' WHEN 'DELETE' THEN 'deleted (4 fields)' ELSE concat('changed: ', concat_ws(', ', CASE WHEN event_type IS DISTINCT FROM old_type THEN 'event_type' END, CASE WHEN k IS DISTINCT FROM old_k THEN 'k' END, CASE WHEN value IS DISTINCT FROM old_value THEN 'value' END)) END AS change FROM audit
WHERE operation <> 'UPDATE' OR event_type IS DISTINCT FROM old_type OR k IS DISTINCT FROM old_k OR value IS DISTINCT FROM old_value""")
def change_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testlog.changed(testlog.log(spark, sf_dir)).select("id", render.row_change(F.col("operation"), F.col("diff")).alias("change"))


@register("SELECT conv_id, turn, CASE WHEN text IS NULL THEN '∅' ELSE concat('\"', replace(replace(CASE WHEN length(text) > 40 THEN concat(substr(text, 1, 37), '...') ELSE text END, '\\', '\\\\'), '\"', '\\\"'), '\"') END AS shown FROM conversations", log=False)
def value_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", render.value(F.col("text")).alias("shown"))


@register(" UNION ALL ".join(f"SELECT id, '{c}' AS field, CAST(old_{o} AS VARCHAR) AS old, CAST({c} AS VARCHAR) AS new FROM audit WHERE {c} IS DISTINCT FROM old_{o}" for c, o in (("event_type", "type"), ("k", "k"), ("value", "value"))))
def image_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blame_ops.image_changes(testlog.log(spark, sf_dir)).where("field <> 'id'").select("id", "field", "old", "new")


@register("SELECT ctx.id, ctx.source, ctx.username AS \"user\", ctx.reason, coalesce(n, 0) AS events FROM ctx LEFT JOIN (SELECT context_id, count(*) AS n FROM audit GROUP BY context_id) c ON c.context_id = ctx.id")
def context_event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blame_ops.context_report(testlog.contexts(spark, sf_dir), testlog.log(spark, sf_dir))


@register(f"SELECT 'events' AS table_name, operation, count(*) AS events FROM audit WHERE changed_at > TIMESTAMP '{NOW}' - INTERVAL 7 DAY GROUP BY operation")
def event_counts_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.event_counts(testlog.log(spark, sf_dir), _now(), 7 * 86_400)


@register("SELECT operation, count(*) AS events, round(count(*) / greatest((max(changed_us) - min(changed_us)) / 1000000.0, 1.0), 2) AS per_second, min(changed_us) AS oldest_us, max(changed_us) AS newest_us FROM audit GROUP BY operation")
def event_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.event_rates(testlog.log(spark, sf_dir), ("operation",)).select("operation", "events", "per_second", micros("oldest").alias("oldest_us"), micros("newest").alias("newest_us"))


@register("SELECT 'events' AS table_name, count(*) AS events, count(*) FILTER (operation = 'INSERT') AS inserts, count(*) FILTER (operation = 'UPDATE') AS updates, count(*) FILTER (operation = 'DELETE') AS deletes FROM audit")
def op_counts_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.operation_counts(testlog.log(spark, sf_dir))


@register("SELECT 'events' AS table_name, (SELECT count(*) FROM audit WHERE operation = 'INSERT') AS inserts, (SELECT count(DISTINCT user_id) FROM events) AS live_rows, CASE WHEN (SELECT count(*) FROM audit WHERE operation = 'INSERT') < 0.9 * (SELECT count(DISTINCT user_id) FROM events) THEN 'MISSING EVENTS' ELSE 'ok' END AS status")
def integrity_cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    live = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.count_distinct("user_id").alias("live_rows")).withColumn("table_name", F.lit("events"))
    return metrics.integrity_check(testlog.log(spark, sf_dir), live).select("table_name", "inserts", "live_rows", "status")


@register("SELECT source, count(*) AS contexts, CAST(sum(coalesce(n, 0)) AS BIGINT) AS events, round(sum(coalesce(n, 0)) / count(*), 2) AS events_each FROM ctx LEFT JOIN (SELECT context_id, count(*) AS n FROM audit GROUP BY context_id) c ON c.context_id = ctx.id GROUP BY source")
def source_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.source_distribution(testlog.log(spark, sf_dir), testlog.contexts(spark, sf_dir))


@register("SELECT epoch_us(time_bucket(INTERVAL 5 MINUTE, changed_at)) AS window_us, operation, count(*) AS events, round(count(*) / 300.0, 4) AS per_second FROM audit GROUP BY ALL ORDER BY events DESC, window_us, operation LIMIT 10")
def rate_5m_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rates = metrics.windowed_rates(testlog.log(spark, sf_dir))
    return rates.select(micros("window_start").alias("window_us"), "operation", "events", "per_second").orderBy(F.desc("events"), "window_us", "operation").limit(10)


@register("SELECT operation, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 2) AS percent FROM audit GROUP BY operation")
def ratio_to_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = testlog.log(spark, sf_dir).groupBy("operation").agg(F.count("*").alias("n"))
    return metrics.ratio_to_total(counts, "n")


@register("SELECT context_id, epoch_us(date_trunc('day', changed_at)) AS day_us, count(*) AS events FROM audit WHERE context_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def bulk_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = testlog.log(spark, sf_dir).withColumn("changed_at", F.date_trunc("day", "changed_at"))
    return metrics.bulk_operations(log, 1).select("context_id", micros().alias("day_us"), "events")


@register("""SELECT epoch_us(minute) AS minute_us, deletes FROM (SELECT minute, deletes, LAG(minute) OVER (ORDER BY minute) AS was FROM (SELECT date_trunc('minute', changed_at) AS minute, count(*) AS deletes FROM audit WHERE operation = 'DELETE' GROUP BY 1) WHERE deletes / 60.0 > 0.01) WHERE was = minute - INTERVAL 1 MINUTE""")
def delete_burst(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.delete_bursts(testlog.log(spark, sf_dir), 0.01).select(micros("minute").alias("minute_us"), "deletes")


@register("""SELECT epoch_us(m) AS minute_us FROM (SELECT m, max(s) OVER (ORDER BY m) AS seen FROM (SELECT m, CASE WHEN a.minute IS NOT NULL THEN m END AS s FROM generate_series(TIMESTAMP '2024-01-10', TIMESTAMP '2024-01-11 23:59:00', INTERVAL 1 MINUTE) g(m)
LEFT JOIN (SELECT DISTINCT date_trunc('minute', changed_at) AS minute FROM audit) a ON a.minute = m)) WHERE date_diff('minute', coalesce(seen, TIMESTAMP '2024-01-09 23:59:00'), m) >= 5""")
def stalled_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    start, end = (F.lit(f"2024-01-1{d} 00:00:00").cast("timestamp_ntz") for d in (0, 2))
    return metrics.stalled_minutes(testlog.log(spark, sf_dir), start, end).select(micros("minute").alias("minute_us"))


@register(f"SELECT (epoch_us(TIMESTAMP '{NOW}' - INTERVAL 30 DAY) - min(changed_us)) / 1000000 AS seconds_behind FROM audit")
def retention_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    from datetime import datetime

    from ..operators.retention import lag_behind

    return lag_behind(testlog.log(spark, sf_dir), datetime.fromisoformat(NOW), "30 days")
