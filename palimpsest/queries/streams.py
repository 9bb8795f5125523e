"""Streams, run to their end over a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.months import MONTH
from ..sources import feed, testlog
from ..sources.folders import fresh_folder
from ..sources.store import Engine
from ..streaming.alerts import bursts, stalls
from ..streaming.ordered import ordered_changes, state_with_timers
from ..streaming.stream import images_to_changes, stream_capture, stream_rates
from .base import Registered, micros

register = Registered()


def _folder(spark: SparkSession) -> str:
    return fresh_folder(spark, "stream")


def _run(stream: DataFrame, folder: str, mode: str) -> DataFrame:
    """The stream's output as a table, after all there is has gone through it."""
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")


def _changes(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    rows = testlog.changes(spark, sf_dir).withColumn("changed_at", F.col("changed_at").cast("timestamp"))
    rows.write.parquet(f"{folder}/in")
    return spark.readStream.schema(rows.schema).parquet(f"{folder}/in")


@register("SELECT id, operation, changed_us, object_id, event_type FROM audit")
def stream_capture_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    out = _run(stream_capture(_changes(spark, sf_dir, folder), testlog.SPEC), folder, "append")
    return out.select("id", "operation", micros().alias("changed_us"), "object_id", F.get_json_object("new_data", "$.event_type").alias("event_type"))


@register("SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, changed_at)) AS window_us, operation, count(*) AS events FROM audit GROUP BY ALL")
def stream_rates_by_hour(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _folder(spark)
    events = stream_capture(_changes(spark, sf_dir, folder), testlog.SPEC)
    out = _run(stream_rates(events, "1 hour", "1 hour"), folder, "complete")
    return out.select(micros("window.start").alias("window_us"), "operation", "events")


@register("SELECT operation, changed_us, object_id, event_type, value, old_type, old_value FROM audit WHERE operation <> 'UPDATE' OR event_type IS DISTINCT FROM old_type OR value IS DISTINCT FROM old_value")
def stream_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only new images arrive; the state of each object gives the old ones."""
    folder = _folder(spark)
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    images = e.select(F.col("user_id").alias("id"), "event_type", "value", F.col("ts").cast("timestamp").alias("changed_at"), (F.col("event_type") == "error").alias("deleted"), F.col("event_id").alias("tie"))
    images.write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(images.schema).parquet(f"{folder}/in")
    get = lambda side, n, k, name: F.get_json_object(side, f"$.{n}").cast(k).alias(name)
    return _run(images_to_changes(stream, tie="tie"), folder, "append").select(
        "operation", micros().alias("changed_us"), "object_id", get("new_data", "event_type", "string", "event_type"), get("new_data", "value", "double", "value"), get("old_data", "event_type", "string", "old_type"), get("old_data", "value", "double", "old_value")
    )


#: Micro-batches of a stream that comes out of order, how far it may, and a moment that ends it.
BATCHES, JITTER_HOURS, LATE, END = 6, 48, "3 days", "2030-01-01 00:00:00"
#: Rows of a file, of which a micro-batch has one at least.
FILE_ROWS = 250_000


def _out_of_order(rows: DataFrame, moment: str, number: str, last: DataFrame, folder: str) -> DataFrame:
    """A stream of files, equally many a micro-batch, in which rows stand up to ``JITTER_HOURS`` from
    their place; a last row of a later time lets the watermark pass all of them."""
    spark = rows.sparkSession
    shifted = F.unix_micros(moment) + F.pmod(F.xxhash64(number), F.lit(JITTER_HOURS * 3600)) * 1_000_000
    placed = rows.withColumn("_at", shifted)
    placed.write.parquet(f"{folder}/rows")
    rows = spark.read.schema(placed.schema).parquet(f"{folder}/rows")
    low, high = rows.agg(F.min("_at"), F.max("_at")).first()
    turn = F.floor((F.col("_at") - F.lit(low or 0)) * BATCHES / F.lit((high or 0) - (low or 0) + 1))
    # As the source counts files, no micro-batch may have fewer than another: the smallest one says how many.
    files = max(1, min((r["count"] for r in rows.groupBy(turn).count().collect()), default=0) // FILE_ROWS)
    for k in range(BATCHES):
        rows.where(turn == k).drop("_at").repartition(files).write.parquet(f"{folder}/in/batch={k}")
    last.write.parquet(f"{folder}/in/batch={BATCHES}")
    return spark.readStream.schema(rows.drop("_at").schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true").parquet(f"{folder}/in")


@register("SELECT operation, changed_us, object_id, event_type, value, old_type, old_value FROM audit WHERE operation <> 'UPDATE' OR event_type IS DISTINCT FROM old_type OR value IS DISTINCT FROM old_value")
def stream_images_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images over several micro-batches and out of order, with state and timers."""
    folder = _folder(spark)
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    images = e.select(F.col("user_id").alias("id"), "event_type", "value", F.col("ts").cast("timestamp").alias("changed_at"), (F.col("event_type") == "error").alias("deleted"), F.col("event_id").alias("tie"))
    end = images.limit(1).select(F.lit(-1).cast("bigint").alias("id"), "event_type", "value", F.lit(END).cast("timestamp").alias("changed_at"), F.lit(True).alias("deleted"), "tie")
    stream = _out_of_order(images, "changed_at", "tie", end, folder)
    get = lambda side, n, k, name: F.get_json_object(side, f"$.{n}").cast(k).alias(name)
    with state_with_timers(spark):
        out = _run(ordered_changes(stream, LATE, tie="tie"), folder, "append")
    return out.select(
        "operation", micros().alias("changed_us"), "object_id", get("new_data", "event_type", "string", "event_type"), get("new_data", "value", "double", "value"), get("old_data", "event_type", "string", "old_type"), get("old_data", "value", "double", "old_value")
    )


def _late_events(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    log = testlog.log(spark, sf_dir).select("id", "operation", F.col("changed_at").cast("timestamp").alias("changed_at"), "table_name")
    end = log.limit(1).select(F.lit(-1).cast("bigint").alias("id"), F.lit("DELETE").alias("operation"), F.lit(END).cast("timestamp").alias("changed_at"), F.lit("none").alias("table_name"))
    return _out_of_order(log, "changed_at", "id", end, folder)


@register("""SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, changed_at)) AS window_us, operation, count(*) AS events FROM audit GROUP BY ALL""")
def stream_rates_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates in append mode: each window is given once, when the watermark has passed it."""
    folder = _folder(spark)
    out = _run(stream_rates(_late_events(spark, sf_dir, folder), "1 hour", LATE), folder, "append")
    return out.select(micros("window.start").alias("window_us"), "operation", "events")


@register("""SELECT 'events' AS table_name, epoch_us(min(w)) AS first_us, epoch_us(max(w) + INTERVAL 12 HOUR) AS last_us, count(*) AS windows, CAST(sum(n) AS BIGINT) AS events
FROM (SELECT *, w - row_number() OVER (ORDER BY w) * INTERVAL 12 HOUR AS run FROM (SELECT time_bucket(INTERVAL 12 HOUR, changed_at, TIMESTAMP '2000-01-01') AS w, count(*) AS n FROM audit WHERE operation = 'DELETE' GROUP BY 1 HAVING count(*) > 1)) GROUP BY run HAVING count(*) >= 2""")
def stream_bursts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half days with several deletions, two or more in a row."""
    folder = _folder(spark)
    out = _run(bursts(_late_events(spark, sf_dir, folder), 1, width="12 hours", gap="18 hours", late=LATE), folder, "append")
    return out.select("table_name", micros("first").alias("first_us"), micros("last").alias("last_us"), "windows", "events")


@register("""SELECT epoch_us(max(w) + INTERVAL 1 MINUTE) AS silent_us, CAST(sum(n) AS BIGINT) AS events FROM (SELECT *, sum(fresh) OVER (ORDER BY w) AS stretch FROM
(SELECT *, CASE WHEN w - lag(w) OVER (ORDER BY w) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM (SELECT date_trunc('minute', changed_at) AS w, count(*) AS n FROM audit GROUP BY 1))) GROUP BY stretch""")
def stream_stalls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches of events that are followed by half an hour without any."""
    folder = _folder(spark)
    out = _run(stalls(_late_events(spark, sf_dir, folder), "30 minutes", late=LATE), folder, "append")
    return out.select(micros("silent_from").alias("silent_us"), "events")


def _three_commits(spark: SparkSession, sf_dir: str, turns: range = range(3), path: str | None = None) -> Engine:
    engine = Engine(spark, path or fresh_folder(spark, "log"))
    engine.bootstrap()
    rows = testlog.log(spark, sf_dir).withColumn("changed_at", F.col("changed_at").cast("timestamp")).withColumn("meta", F.create_map(F.lit("event"), F.col("id").cast("string")))
    for turn in turns:
        engine.append_events(rows.where(F.col("id") % 3 == turn).drop("id"))
    return engine


@register("SELECT id AS event_id, id % 3 + 1 AS commit, object_id, strftime(changed_at, '%Y-%m') AS month FROM audit WHERE id % 3 >= 1 AND CAST(object_id AS BIGINT) % 2 = 1 AND strftime(changed_at, '%Y-%m') >= '2024-01' AND operation = 'UPDATE'")
def feed_since_commit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was committed after the first of three commits, with filters on month and operation."""
    engine = _three_commits(spark, sf_dir)
    feed.register(spark)
    rows = spark.read.format(feed.NAME).option("path", engine.path).option("since", 1).load()
    rows = rows.where((F.col(MONTH) >= "2024-01") & (F.col("operation") == "UPDATE")).where("cast(object_id as bigint) % 2 = 1")
    return rows.select(F.col("meta")["event"].cast("bigint").alias("event_id"), "commit", "object_id", F.col(MONTH).alias("month"))


@register("SELECT id AS event_id, id % 3 + 1 AS commit FROM audit")
def feed_stream_restarted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream that stops after two commits and is started again after the third."""
    folder = _folder(spark)
    engine = _three_commits(spark, sf_dir, range(2))
    feed.register(spark)
    stream = spark.readStream.format(feed.NAME).option("path", engine.path).load().select(F.col("meta")["event"].cast("bigint").alias("event_id"), "commit")
    _run(stream, folder, "append")
    _three_commits(spark, sf_dir, range(2, 3), engine.path)
    return _run(stream, folder, "append").select("event_id", "commit")
