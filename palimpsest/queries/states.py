"""States from keyframes, lookups by an index of files, and as-of joins of large objects."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import scan
from .base import AT, OBJECT, Registered, image, micros
from .keeping import SHIFTED, shifted
from .logs import _engine, _event_id, _events, _halves, made_once

register = Registered()
#: A moment within the nine months of the shifted log, and a keyframe's month before it.
LATE_AT, MONTH_BEFORE, MONTH_EARLIER = "2023-11-20 00:00:00", "2023-11", "2023-09"


def _kept_states(spark: SparkSession, sf_dir: str, late: bool):
    """A log over nine months with two keyframes, the second made from the first; with ``late``, a
    third of the events of all months comes after both."""
    rows = made_once(shifted(spark, sf_dir).withColumn("meta", F.create_map(F.lit("event"), F.col("id").cast("string"))))
    engine = _engine(spark)
    first = F.col("id") % 3 != 2 if late else F.lit(True)
    engine.append_events(rows.where(first).drop("id"))
    for month in (MONTH_EARLIER, MONTH_BEFORE):
        engine.write_keyframe("events", month)
    if late:
        engine.append_events(rows.where(~first).drop("id"))
    return engine


STATE = f"""SELECT object_id, event_type, value, k FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY moved DESC, {{tie}} DESC) AS n FROM ({SHIFTED}) WHERE moved <= TIMESTAMP '{LATE_AT}') WHERE n = 1 AND operation <> 'DELETE'"""


@register(STATE.format(tie="operation"))
def asof_keyframe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state from the last keyframe and one month."""
    return image(_kept_states(spark, sf_dir, late=False).as_of("events", datetime.fromisoformat(LATE_AT)))


@register(STATE.format(tie="id % 3 = 2, operation"))
def asof_keyframe_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same where events of the months before came after the keyframe, deletions among them."""
    return image(_kept_states(spark, sf_dir, late=True).as_of("events", datetime.fromisoformat(LATE_AT)))


@register(f"SELECT 'object' AS kind, id AS event_id, changed_us FROM audit WHERE object_id = '{OBJECT}' UNION ALL SELECT 'user', id, changed_us FROM audit WHERE user_id = 8 UNION ALL SELECT 'context', id, changed_us FROM audit WHERE context_id = (SELECT min(context_id) FROM audit)")
def indexed_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An object's, a user's and a context's events from the files that the index names."""
    engine = _engine(spark, indexed=True)
    for half in _halves(_events(spark, sf_dir)):
        engine.append_events(half)
    least = engine.log.agg(F.min("context_id")).first()[0]
    found = {"object": engine.for_object("events", OBJECT), "user": engine.for_user(8), "context": engine.for_context(least)}
    parts = [h.df.select(F.lit(kind).alias("kind"), _event_id(), micros().alias("changed_us")) for kind, h in found.items()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


#: Seven of ten events are of one object.
HOT = "CASE WHEN event_id % 10 < 7 THEN 'hot' ELSE CAST(user_id AS VARCHAR) END"


def hot_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    object_id = F.when(F.col("event_id") % 10 < 7, "hot").otherwise(F.col("user_id").cast("string"))
    operation = F.when(F.col("event_type") == "error", "DELETE").otherwise("UPDATE")
    image = F.when(F.col("event_type") != "error", F.to_json(F.struct("event_type", "value")))
    return e.select(F.col("event_id").alias("id"), operation.alias("operation"), F.col("ts").alias("changed_at"), object_id.alias("object_id"), F.lit("events").alias("table_name"), image.alias("new_data"))


@register(f"""WITH l AS (SELECT event_id AS id, {HOT} AS object_id, ts, event_type FROM events),
p AS (SELECT row_number() OVER () AS n, {HOT} AS object_id, ts + INTERVAL 1 HOUR AS at FROM events UNION ALL SELECT -row_number() OVER (), CAST(o_custkey AS VARCHAR), TIMESTAMP '{AT}' FROM orders),
f AS (SELECT p.n, p.object_id, p.at, l.ts, max(l.id) AS id FROM p ASOF JOIN (SELECT DISTINCT object_id, ts FROM l) s ON p.object_id = s.object_id AND p.at >= s.ts JOIN l ON l.object_id = s.object_id AND l.ts = s.ts GROUP BY ALL)
SELECT f.object_id, epoch_us(f.at) AS at_us, f.id, l.event_type FROM f JOIN l USING (id) WHERE l.event_type <> 'error'""", log=False)
def asof_join_hot_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of one object with most of the events, and of others, at as many moments."""
    log = hot_log(spark, sf_dir)
    asked = log.select("object_id", (F.col("changed_at") + F.make_dt_interval(hours=F.lit(1))).alias("at"))
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").cast("string").alias("object_id"), F.lit(AT).cast("timestamp_ntz").alias("at"))
    found = scan.as_of_join(asked.unionByName(orders), log, "events", made_once, ranges=32)
    return found.select("object_id", micros("at").alias("at_us"), "id", F.get_json_object("data", "$.event_type").alias("event_type"))
