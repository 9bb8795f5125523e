"""Event volumes, rates and health of a log."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

def event_counts(log: DataFrame, now: Column, seconds: int) -> DataFrame:
    """Events of the last seconds by table and operation."""
    recent = log.where(F.col("changed_at") > now - F.make_dt_interval(secs=F.lit(seconds)))
    return recent.groupBy("table_name", "operation").agg(F.count("*").alias("events"))


def event_rates(log: DataFrame, by: tuple[str, ...] = ("table_name", "operation")) -> DataFrame:
    """Count, events a second over the span (a second at least), oldest and newest."""
    micros = F.unix_micros(F.col("changed_at").cast("timestamp"))
    span = F.greatest((F.max(micros) - F.min(micros)) / 1_000_000, F.lit(1.0))
    return log.groupBy(*by).agg(F.count("*").alias("events"), F.round(F.count("*") / span, 2).alias("per_second"), F.min("changed_at").alias("oldest"), F.max("changed_at").alias("newest"))


def operation_counts(log: DataFrame) -> DataFrame:
    one = lambda op: F.count_if(F.col("operation") == op).alias(f"{op.lower()}s")
    return log.groupBy("table_name").agg(F.count("*").alias("events"), one("INSERT"), one("UPDATE"), one("DELETE"))


def integrity_check(log: DataFrame, live: DataFrame) -> DataFrame:
    """Tables whose inserts fall short of nine tenths of their live rows (table_name, live_rows)."""
    joined = operation_counts(log).join(live, "table_name", "left")
    status = F.when(F.col("live_rows").isNull(), "unknown").when(F.col("inserts") < 0.9 * F.col("live_rows"), "MISSING EVENTS").otherwise("ok")
    return joined.withColumn("status", status)


def log_counts(log: DataFrame) -> DataFrame:
    """Rows and the last id, 0 in an empty log."""
    return log.agg(F.count("*").alias("rows"), F.coalesce(F.max("id"), F.lit(0)).alias("last_id"))


def chain_status(log: DataFrame) -> DataFrame:
    return log.agg(
        F.count("*").alias("total"),
        F.count("chain_seq").alias("chained"),
        F.count("row_hash").alias("hashed"),
        F.max("chain_seq").alias("tip_seq"),
        F.max_by("changed_at", "chain_seq").alias("tip_at"),
    )


def source_distribution(log: DataFrame, contexts: DataFrame) -> DataFrame:
    """Contexts and their events by source; contexts without events count too."""
    counts = log.where(F.col("context_id").isNotNull()).groupBy(F.col("context_id").alias("id")).agg(F.count("*").alias("n"))
    source = F.coalesce(F.get_json_object("metadata", "$.source"), F.lit("unknown"))
    joined = contexts.join(counts, "id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return joined.groupBy(source.alias("source")).agg(F.count("*").alias("contexts"), F.sum("n").alias("events"), F.round(F.sum("n") / F.count("*"), 2).alias("events_each"))


def ratio_to_total(counts: DataFrame, value: str) -> DataFrame:
    """Adds each row's percentage of the total, a scalar subquery."""
    total = counts.agg(F.sum(value)).scalar()
    return counts.withColumn("percent", F.round(100 * F.col(value) / total, 2))


def windowed_rates(log: DataFrame, by: str = "operation", width: str = "5 minutes") -> DataFrame:
    """Events a second in windows."""
    seconds = F.lit(1.0) * (F.unix_micros(F.col("window.end").cast("timestamp")) - F.unix_micros(F.col("window.start").cast("timestamp"))) / 1_000_000
    return log.groupBy(F.window("changed_at", width), by).agg(F.count("*").alias("events")).select(F.col("window.start").alias("window_start"), by, "events", F.round(F.col("events") / seconds, 4).alias("per_second"))


def bulk_operations(log: DataFrame, more_than: int) -> DataFrame:
    """Contexts with many events at one moment."""
    return log.where(F.col("context_id").isNotNull()).groupBy("context_id", "changed_at").agg(F.count("*").alias("events")).where(F.col("events") > more_than)


def delete_bursts(log: DataFrame, per_second: float, windows: int = 2) -> DataFrame:
    """Minutes in which deletes of a table pass a rate for so many minutes in a row."""
    minute = F.date_trunc("minute", "changed_at")
    counts = log.where(F.col("operation") == "DELETE").groupBy("table_name", minute.alias("minute")).agg(F.count("*").alias("deletes"))
    high = counts.where(F.col("deletes") / 60 > per_second)
    order = Window.partitionBy("table_name").orderBy("minute")
    before = F.lag("minute", windows - 1).over(order)
    return high.withColumn("_from", before).where(F.col("_from") == F.col("minute") - F.make_dt_interval(mins=F.lit(windows - 1))).drop("_from")


def stalled_minutes(log: DataFrame, start: Column, end: Column, run: int = 5) -> DataFrame:
    """Minutes at which no event has come for so many minutes. Only minutes with events meet."""
    minutes = log.where((F.col("changed_at") >= start) & (F.col("changed_at") < end)).select(F.date_trunc("minute", "changed_at").alias("minute")).distinct()
    line = log.sparkSession.range(1).select(F.explode(F.sequence(start, end - F.make_dt_interval(mins=F.lit(1)), F.make_dt_interval(mins=F.lit(1)))).alias("minute"))
    day = F.date_trunc("hour", "minute")
    counted = line.join(minutes.withColumn("_seen", F.lit(1)), "minute", "left").withColumn("_hour", day)
    last_in = counted.groupBy("_hour").agg(F.max(F.when(F.col("_seen") == 1, F.col("minute"))).alias("_last"))
    carried = last_in.withColumn("_before", F.max("_last").over(Window.orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1))).select("_hour", "_before")
    within = F.max(F.when(F.col("_seen") == 1, F.col("minute"))).over(Window.partitionBy("_hour").orderBy("minute").rowsBetween(Window.unboundedPreceding, 0))
    placed = counted.join(carried, "_hour").withColumn("_event", F.coalesce(within, "_before", start - F.make_dt_interval(mins=F.lit(1))))
    gap = (F.unix_micros(F.col("minute").cast("timestamp")) - F.unix_micros(F.col("_event").cast("timestamp"))) / 60_000_000
    return placed.where(gap >= run).select("minute")


def latency_quantiles(df: DataFrame, value: str, by: str, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The least value of each group that 50, 95 and 99 percent of its values do not exceed, null if
    it has none. Different values are counted and ordered over a range partitioning of all groups,
    written once (by ``stage``), so no task needs the whole of a group."""
    counts = df.groupBy(F.col(by).alias("_by"), F.col(value).alias("_value")).agg(F.count(value).alias("_n"))
    placed = stage(counts.repartitionByRange("_by", "_value").withColumn("_part", F.spark_partition_id()))
    group = Window.partitionBy("_group")
    parts = placed.groupBy(F.col("_by").alias("_group"), F.col("_part").alias("_at")).agg(F.sum("_n").alias("_here"))
    sums = parts.select("_group", "_at", (F.sum("_here").over(group.orderBy("_at")) - F.col("_here")).alias("_before"), F.sum("_here").over(group).alias("_all"))
    within = Window.partitionBy("_by", "_part").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(sums, F.col("_by").eqNullSafe(F.col("_group")) & (F.col("_part") == F.col("_at")))
    ranked = joined.withColumn("_up_to", F.col("_before") + F.sum("_n").over(within))
    # In whole numbers: a product with 0.95 may lie just beyond the place that it means.
    least = lambda percent: F.min(F.when(100 * F.col("_up_to") >= percent * F.col("_all"), F.col("_value"))).alias(f"p{percent}")
    return ranked.groupBy(F.col("_by").alias(by)).agg(least(50), least(95), least(99))


def statement_statistics(df: DataFrame, name: str, millis: str, top: int = 25) -> DataFrame:
    """Calls, total, mean, relative spread and share of all time of timed statements, slowest first."""
    mean = F.avg(millis)
    rows = df.groupBy(name).agg(F.count("*").alias("calls"), F.sum(millis).alias("total_ms"), mean.alias("mean_ms"), F.try_divide(F.stddev_pop(millis), mean).alias("spread"))
    total = rows.agg(F.sum("total_ms")).scalar()
    return rows.withColumn("percent", 100 * F.col("total_ms") / total).orderBy(F.desc("total_ms"), name).limit(top)


def partition_sizes(log: DataFrame) -> DataFrame:
    """Rows and bytes of files by month, largest first, from file metadata."""
    files = log.select("changed_month", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
    each = files.groupBy("changed_month", "path").agg(F.count("*").alias("rows"), F.max("size").alias("size"))
    return each.groupBy("changed_month").agg(F.sum("rows").alias("rows"), F.sum("size").alias("bytes")).withColumn("bytes_a_row", F.col("bytes") / F.col("rows")).orderBy(F.desc("bytes"))
