"""Logs that are written, read, purged, upgraded and declared through the engine.

Each query makes a log in a folder of its own and returns what it then holds.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .. import context
from ..functions.payload import hmac_hex, json_diff
from ..identifiers import validate_identifier
from ..operators import metrics
from ..operators.timetravel import Tracked, sql_table_function, typed_rows
from ..plans.months import MONTH, with_month
from ..plans.registry import Registry, reconciled
from ..schema import AUDIT_LOG
from ..sources import importers, testlog
from ..sources.folders import fresh_folder
from ..sources.store import Engine, parameterised, write_json_lines
from ..spec import Capture
from ..streaming.stream import append_stream
from .base import AT, NOW, OBJECT, Registered, event_columns, image, micros
from .keeping import SHIFTED, shifted

register = Registered()
#: The middle of the log, between two batches.
MIDDLE = datetime.fromisoformat(AT).replace(tzinfo=timezone.utc)


def made_once(df: DataFrame) -> DataFrame:
    """A table of rows that several appends take their parts from, each of them reading it twice."""
    path = fresh_folder(df.sparkSession, "rows")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's events with moments of the log's own type; their ids come along as ``meta``."""
    log = testlog.log(spark, sf_dir)
    return made_once(log.withColumn("changed_at", F.col("changed_at").cast("timestamp")).withColumn("meta", F.create_map(F.lit("event"), F.col("id").cast("string"))).drop("id"))


def _engine(spark: SparkSession, **options: bool) -> Engine:
    engine = Engine(spark, fresh_folder(spark, "log"), **options)
    engine.bootstrap()
    return engine


def _halves(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    early = F.col("changed_at") < F.lit(MIDDLE.isoformat()).cast("timestamp")
    return events.where(early), events.where(~early)


def _event_id() -> F.Column:
    return F.col("meta")["event"].cast("bigint").alias("event_id")


@register("SELECT row_number() OVER (ORDER BY changed_at, object_id, operation) AS id, id AS event_id, operation, changed_us, object_id FROM audit")
def append_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole log in two batches: ids are consecutive, in order of time, across batches."""
    engine = _engine(spark)
    for half in _halves(_events(spark, sf_dir)):
        engine.append_events(half)
    return engine.log.select("id", _event_id(), "operation", micros().alias("changed_us"), "object_id")


@register("SELECT id AS event_id, row_number() OVER (ORDER BY CASE WHEN changed_at < TIMESTAMP '2024-01-15' THEN 1 ELSE 0 END, changed_at, object_id, operation) AS id FROM audit")
def append_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The later half comes first: late events keep their own moments and get later ids."""
    engine = _engine(spark)
    for half in reversed(_halves(_events(spark, sf_dir))):
        engine.append_events(half)
    return engine.log.select(_event_id(), "id")


@register("SELECT id AS event_id, row_number() OVER (ORDER BY id % 4, changed_at, object_id, operation) AS id, CAST(1 AS BIGINT) AS parts FROM audit")
def append_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four commits whose batches are made one a month: ids stay."""
    engine = _engine(spark)
    rows = _events(spark, sf_dir)
    for turn in range(4):
        engine.append_events(rows.where(F.col("meta")["event"].cast("bigint") % 4 == turn))
    engine.merge_batches(at_least=2)
    parts = len(engine.manifest()["parts"]) // max(1, len(engine.months()))
    return engine.log.select(_event_id(), "id", F.lit(parts).cast("bigint").alias("parts"))


@register(f"SELECT object_id, event_type, value, k FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY changed_at DESC, id DESC) AS n FROM audit WHERE changed_at <= TIMESTAMP '{NOW}') WHERE n = 1 AND operation <> 'DELETE'")
def asof_after_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States stay right when events come late, as they go by time."""
    engine = _engine(spark)
    for half in reversed(_halves(_events(spark, sf_dir))):
        engine.append_events(half)
    return image(engine.as_of("events", NOW))


@register("SELECT row_number() OVER (ORDER BY changed_at, object_id, operation) AS id, id AS event_id FROM audit")
def append_stream_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two streams into one log, the first of them started again and its batch sent once more."""
    engine, folder = _engine(spark), fresh_folder(spark, "streams")
    for name, half in zip(("first", "second"), _halves(_events(spark, sf_dir))):
        half.write.parquet(f"{folder}/{name}")
        stream = spark.readStream.schema(half.schema).parquet(f"{folder}/{name}")
        before = set(engine.manifest()["streams"])
        for _ in range(2):
            append_stream(stream, engine, f"{folder}/checkpoint-{name}", availableNow=True).awaitTermination()
        (own,) = set(engine.manifest()["streams"]) - before
        engine.append_events(half, own, 0)
    return engine.log.select("id", _event_id())


@register(f"SELECT object_id, event_type, value, k FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY changed_at DESC, id DESC) AS n FROM audit WHERE changed_at <= TIMESTAMP '{AT}') WHERE n = 1 AND operation <> 'DELETE'")
def asof_other_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that is read in another session zone than it was written in, at a month's edge too."""
    engine = _engine(spark)
    engine.append_events(_events(spark, sf_dir))
    abroad = spark.newSession()
    abroad.conf.set("spark.sql.session.timeZone", "Pacific/Auckland")
    return image(Engine(abroad, engine.path).as_of("events", MIDDLE.astimezone(timezone.utc)))


@register("SELECT strftime(CASE WHEN id % 2 = 0 THEN TIMESTAMP '2024-01-31 23:30:00' ELSE TIMESTAMP '2024-02-01 00:30:00' END, '%Y-%m') AS month, count(*) AS events FROM audit GROUP BY ALL")
def months_other_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months are those of UTC: moments on both sides of a month's end, in a session far from UTC."""
    ids = testlog.log(spark, sf_dir).select("id")
    fresh = fresh_folder(spark, "ids")
    ids.write.parquet(fresh)
    abroad = spark.newSession()
    abroad.conf.set("spark.sql.session.timeZone", "Pacific/Auckland")
    moment = F.when(F.col("id") % 2 == 0, F.lit("2024-01-31T23:30:00Z")).otherwise(F.lit("2024-02-01T00:30:00Z")).cast("timestamp")
    return with_month(abroad.read.parquet(fresh).select(moment.alias("changed_at"))).groupBy(F.col(MONTH).alias("month")).agg(F.count("*").alias("events"))


@register(f"SELECT id AS event_id, epoch_us(moved) AS moved_us FROM ({SHIFTED}) WHERE moved >= TIMESTAMP '{NOW}' - INTERVAL 4 MONTH")
def purge_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months before the cutoff go, its own month is rewritten, and the chain holds from the anchor."""
    engine = _engine(spark, admin=True, hash_chain=True)
    engine.append_events(shifted(spark, sf_dir).withColumn("meta", F.create_map(F.lit("event"), F.col("id").cast("string"))).drop("id"))
    engine.purge(datetime.fromisoformat(NOW), "4 months", keep_anchor=True)
    if not engine.verify()["ok"]:
        raise ValueError("the rest of the chain does not hold")
    return engine.log.select(_event_id(), micros().alias("moved_us"))


@register(f"SELECT strftime(moved, '%Y-%m') AS month, count(*) AS events FROM ({SHIFTED}) WHERE date_trunc('month', moved) + INTERVAL 1 MONTH > TIMESTAMP '{NOW}' - INTERVAL 4 MONTH GROUP BY 1")
def drop_old_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = _engine(spark, admin=True)
    engine.append_events(shifted(spark, sf_dir).drop("id"))
    engine.drop_old_months(datetime.fromisoformat(NOW), "4 months")
    return engine.log.groupBy(F.col(MONTH).alias("month")).agg(F.count("*").alias("events"))


@register(f"SELECT strftime(moved, '%Y-%m') AS month, count(*) AS \"rows\", TRUE AS has_bytes, row_number() OVER (ORDER BY count(*) DESC, strftime(moved, '%Y-%m')) AS place FROM ({SHIFTED}) GROUP BY 1")
def partition_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and bytes of each month's files, from file metadata."""
    engine = _engine(spark)
    engine.append_events(shifted(spark, sf_dir).drop("id"))
    found = metrics.partition_sizes(engine.log)
    place = F.row_number().over(Window.orderBy(F.desc("rows"), "changed_month")).cast("bigint")
    return found.select(F.col("changed_month").alias("month"), "rows", (F.col("bytes") > 0).alias("has_bytes"), place.alias("place"))


@register(f"SELECT strftime(moved, '%Y-%m') AS month, TRUE AS same_bytes, TRUE AS same_files FROM ({SHIFTED}) GROUP BY 1")
def partition_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each month by file metadata against those that the file system lists."""
    engine = _engine(spark)
    for half in _halves(shifted(spark, sf_dir).drop("id")):
        engine.append_events(half)
    found = metrics.partition_sizes(engine.log)
    listed = []
    for month, batch in engine.manifest()["parts"]:
        files = [f for f in engine._fs.listStatus(engine._at("log", f"{MONTH}={month}", f"batch={batch}")) if f.getPath().getName().endswith(".parquet")]
        listed.append((month, sum(f.getLen() for f in files), len(files)))
    sizes = spark.createDataFrame(listed, "changed_month string, n bigint, files bigint").groupBy("changed_month").agg(F.sum("n").alias("n"), F.sum("files").alias("files"))
    read = engine.log.select("changed_month", F.col("_metadata.file_path").alias("path")).distinct().groupBy("changed_month").agg(F.count("*").alias("read"))
    both = found.join(sizes, "changed_month").join(read, "changed_month")
    return both.select(F.col("changed_month").alias("month"), (F.col("bytes") == F.col("n")).alias("same_bytes"), (F.col("files") == F.col("read")).alias("same_files"))


@register("SELECT count(*) AS total, count(*) FILTER (changed_at >= TIMESTAMP '2024-01-15') AS checked, TRUE AS ok, count(*) FILTER (changed_at < TIMESTAMP '2024-01-15') + 1 AS chain_from, count(*) AS last_id FROM audit")
def chain_switch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chain is switched on between two batches; a writer that does not ask for it chains too."""
    engine = _engine(spark)
    early, later = _halves(_events(spark, sf_dir))
    engine.append_events(early)
    engine.enable_chain()
    Engine(spark, engine.path).append_events(later)
    found, status = engine.verify(), engine.status()
    return engine.log.agg(F.count("*").alias("total"), F.lit(found["checked"]).cast("bigint").alias("checked"), F.lit(found["ok"]).alias("ok"), F.lit(status["chain_from"]).cast("bigint").alias("chain_from"), F.coalesce(F.max("id"), F.lit(0)).alias("last_id"))


@register("SELECT strftime(changed_at, '%Y-%m') AS month, count(*) AS events, min(id) AS first_id, max(id) AS last_id FROM audit GROUP BY 1")
def upgrade_format1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of the first format, with months but no batches, brought to today's."""
    path = fresh_folder(spark, "old")
    rows = testlog.log(spark, sf_dir).withColumn("changed_at", F.col("changed_at").cast("timestamp"))
    with_month(importers.conform(rows)).write.partitionBy(MONTH).parquet(f"{path}/log")
    engine = Engine(spark, path)
    engine._put("_version.json", '{"format": 1}')
    if engine.upgrade() != ["batches and manifests", "tables"] or engine.upgrade():
        raise ValueError("the upgrade took other steps")
    return engine.log.groupBy(F.col(MONTH).alias("month")).agg(F.count("*").alias("events"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@register("SELECT id, number AS user_text, source, username, reason FROM ctx")
def engine_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts written twice, first without their reasons: the last version counts."""
    engine = _engine(spark)
    rows = testlog.contexts(spark, sf_dir)
    engine.write_contexts(rows.withColumn("metadata", F.regexp_replace("metadata", ',"change_reason":"[^"]*"', "")))
    engine.write_contexts(rows)
    get = lambda n: F.get_json_object("metadata", f"$.{n}")
    return engine.contexts.select("id", get("user_id").alias("user_text"), get("source").alias("source"), get("username").alias("username"), get("change_reason").alias("reason"))


@register("SELECT operation, count(*) AS events, 5 AS user_id, TRUE AS one_context, 'nightly -> repair' AS reason FROM audit GROUP BY operation")
def capture_in_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes without a context of their own take the driver's: nested blocks are one context."""
    engine = _engine(spark)
    rows = testlog.changes(spark, sf_dir).drop("context_id", "metadata", "id").withColumn("changed_at", F.col("changed_at").cast("timestamp"))
    with context.audit_context(source="job", user_id="5"), context.change_reason("nightly"), context.change_reason("repair"):
        engine.capture(rows, testlog.SPEC)
    named = engine.history().with_context(engine.contexts)
    return named.groupBy("operation", "user_id").agg(F.count("*").alias("events"), (F.count_distinct("context_id") == 1).alias("one_context"), F.max(F.get_json_object("metadata", "$.change_reason")).alias("reason"))


@register("SELECT event_id AS id, CASE event_type WHEN 'signup' THEN 'INSERT' ELSE 'UPDATE' END AS operation, epoch_us(ts) AS changed_us, CAST(user_id AS VARCHAR) AS object_id FROM events", log=False)
def import_custom(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hand-made log in the log's schema: what it lacks is null."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = e.select(F.col("event_id").alias("id"), F.when(F.col("event_type") == "signup", "INSERT").otherwise("UPDATE").alias("operation"), F.col("ts").alias("changed_at"), F.col("user_id").alias("object_id"), F.lit("events").alias("table_name"))
    found = importers.conform(rows)
    if [f.name for f in found.schema] != AUDIT_LOG.fieldNames():
        raise ValueError("not the log's schema")
    return found.select("id", "operation", micros().alias("changed_us"), "object_id")


@register("""SELECT n_name AS table_name, CASE WHEN NOT regexp_full_match(n_name, '[A-Za-z_][A-Za-z0-9_]*') THEN 'refused' WHEN n_regionkey >= 3 THEN 'install' WHEN n_nationkey % 2 = 1 THEN 'update' ELSE 'keep' END AS action FROM nation
UNION ALL SELECT 'OLD_' || n_name, 'remove' FROM nation WHERE n_regionkey = 0 AND regexp_full_match(n_name, '[A-Za-z_][A-Za-z0-9_]*')""", log=False)
def registry_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as tables: some are tracked already, some with other columns, some no more wanted;
    names that are no identifiers are refused."""
    rows = [(r["n_nationkey"], r["n_name"], r["n_regionkey"]) for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name", "n_regionkey").collect()]
    good, refused = [], []
    for key, name, region in rows:
        try:
            good.append((key, validate_identifier(name, "table"), region))
        except ValueError:
            refused.append((name, "refused"))
    registry = Registry(_engine(spark))
    registry.apply([Capture(n, without=("p",) if k % 2 else ()) for k, n, r in good if r < 3] + [Capture(f"OLD_{n}") for _, n, r in good if r == 0])
    pending = registry.pending([Capture(n) for _, n, _ in good], prune=True).select("table_name", "action")
    return pending.unionByName(spark.createDataFrame(refused, "table_name string, action string"))


@register("""WITH g AS (SELECT *, row_number() OVER (ORDER BY n_nationkey) AS turn FROM nation WHERE regexp_full_match(n_name, '[A-Za-z_][A-Za-z0-9_]*'))
SELECT n_name || '_to_auditlog' AS name, n_name AS table_name, n_nationkey % 2 = 0 AS all_columns, TRUE AS again_unchanged FROM g WHERE n_nationkey % 3 <> 0""", log=False)
def registry_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Installed captures after they were applied, applied again without effect, and some removed."""
    rows = [(r[0], r[1]) for r in spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_name").collect() if " " not in r[1]]
    captures = {k: Capture(n, without=("p",) if k % 2 else ()) for k, n in rows}
    registry = Registry(_engine(spark))
    registry.apply([Capture(n, keep=("old",)) for _, n in rows])
    registry.apply(captures.values())
    again = registry.apply(captures.values())
    for k, c in captures.items():
        if k % 3 == 0:
            registry.remove(c.name)
    return registry.installed.select("name", "table_name", F.col("plan").contains("insert compares *\n").alias("all_columns"), F.lit(not (again["install"] or again["update"])).alias("again_unchanged"))


@register("SELECT user_id AS name, 'remove' AS action FROM (SELECT DISTINCT 'u' || user_id AS user_id FROM events WHERE event_type = 'error') WHERE user_id NOT IN (SELECT 'u' || user_id FROM events WHERE event_type = 'purchase') UNION ALL SELECT DISTINCT 'u' || user_id, CASE WHEN user_id IN (SELECT user_id FROM events WHERE event_type = 'error') THEN 'keep' ELSE 'install' END FROM events WHERE event_type = 'purchase'", log=False)
def reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reconciliation itself, over as many names as there are."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    side = lambda kind: e.where(F.col("event_type") == kind).select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("name"), F.lit("t").alias("table_name"), F.lit("x").alias("checksum")).distinct()
    return reconciled(side("purchase"), side("error"), prune=True).select("name", "action")


@register(f"SELECT object_id, event_type, value, k FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY changed_at DESC, id DESC) AS n FROM audit WHERE changed_at <= TIMESTAMP '{AT}') WHERE n = 1 AND operation <> 'DELETE'")
def sql_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of a table through an installed SQL table function."""
    tag = fresh_folder(spark, "f").rsplit("-", 1)[1][:8]
    log = testlog.log(spark, sf_dir).withColumn("changed_at", F.col("changed_at").cast("timestamp"))
    log.createOrReplaceTempView(f"log_{tag}")
    spark.sql(sql_table_function(f"log_{tag}", f"as_of_{tag}"))
    return image(spark.sql(f"SELECT * FROM as_of_{tag}('events', TIMESTAMP '{AT}')"))


@register("SELECT operation, count(*) AS n FROM audit WHERE changed_at >= TIMESTAMP '2024-01-15' AND user_id > 3 GROUP BY operation")
def parameterised_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parameterised(spark, "SELECT operation, count(*) AS n FROM {log} WHERE changed_at >= CAST(? AS TIMESTAMP_NTZ) AND user_id > ? GROUP BY operation", AT, 3, log=testlog.log(spark, sf_dir))


@register(f"SELECT object_id, event_type, value, k FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY changed_at DESC, id DESC) AS n FROM audit WHERE changed_at <= TIMESTAMP '{AT}') WHERE n = 1 AND operation <> 'DELETE' ORDER BY object_id LIMIT 10")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state as JSON lines, with a limit, written and read again."""
    path = fresh_folder(spark, "lines")
    write_json_lines(Tracked(testlog.log(spark, sf_dir), "events").state(AT), path, limit=10)
    return image(spark.read.text(path).select(F.from_json("value", "object_id string, data string").alias("x")).select("x.*"))


EVENTS_OF = f"FROM audit WHERE object_id = '{OBJECT}'"


@register(f"SELECT id, operation, changed_us {EVENTS_OF}")
def tracked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tracked(testlog.log(spark, sf_dir), "events").events(OBJECT).select("id", "operation", micros().alias("changed_us"))


@register("SELECT id, operation, changed_us, object_id, user_id, context_id, event_type, value, k, old_type, old_value, old_k FROM audit")
def tracked_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tracked(testlog.log(spark, sf_dir), "events").history().select(*event_columns())


@register(f"SELECT id, CASE WHEN operation <> 'DELETE' THEN k END AS value {EVENTS_OF} AND (operation <> 'UPDATE' OR k IS DISTINCT FROM old_k)")
def tracked_field_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Tracked(testlog.log(spark, sf_dir), "events").field_history(OBJECT, "k").select("id", F.col("value").cast("bigint").alias("value"))


@register(f"SELECT object_id, event_type, CAST(NULL AS VARCHAR) AS added FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY changed_at DESC, id DESC) AS n FROM audit WHERE changed_at <= TIMESTAMP '{AT}') WHERE n = 1 AND operation <> 'DELETE'")
def tracked_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A state in today's schema: columns it lacks are dropped, new ones are null."""
    return typed_rows(Tracked(testlog.log(spark, sf_dir), "events").state(AT), "event_type string, added string")


@register(f"SELECT object_id, event_type, value, k FROM (SELECT * {EVENTS_OF} AND changed_at <= TIMESTAMP '{AT}' ORDER BY changed_at DESC, id DESC LIMIT 1) WHERE operation <> 'DELETE'")
def tracked_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = Tracked(testlog.log(spark, sf_dir), "events").at(OBJECT, AT, "event_type string, value double, k bigint")
    found = [(row.object_id, row.event_type, row["value"], row.k)] if row else []
    return spark.createDataFrame(found, "object_id string, event_type string, value double, k bigint")


@register("SELECT id, 'event_type' AS field, old_type AS old, event_type AS new FROM audit WHERE operation = 'UPDATE' AND old_type IS DISTINCT FROM event_type UNION ALL SELECT id, 'k', CAST(old_k AS VARCHAR), CAST(k AS VARCHAR) FROM audit WHERE operation = 'UPDATE' AND old_k IS DISTINCT FROM k UNION ALL SELECT id, 'value', CAST(old_value AS VARCHAR), CAST(value AS VARCHAR) FROM audit WHERE operation = 'UPDATE' AND old_value IS DISTINCT FROM value")
def json_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of images that are only there as JSON."""
    updates = testlog.log(spark, sf_dir).where("operation = 'UPDATE'")
    return updates.select("id", F.explode(json_diff(F.col("old_data"), F.col("new_data"))).alias("field", "change")).select("id", "field", "change.old", "change.new")


@register(f"SELECT object_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY object_id ORDER BY changed_at DESC, id DESC) AS n FROM audit WHERE changed_at <= TIMESTAMP '{AT}') WHERE n = 1 AND operation <> 'DELETE'")
def tracked_state_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same state by the iterator over its rows."""
    rows = Tracked(testlog.log(spark, sf_dir), "events").state_as_of(AT)
    return spark.createDataFrame([(r.object_id, r.event_type, float(r["value"])) for r in rows], "object_id string, event_type string, value double")


KEY = "session secret"
_IPAD, _OPAD = (bytes(b ^ p for b in KEY.encode().ljust(64, b"\0")).hex() for p in (0x36, 0x5C))


@register(f"SELECT c_custkey, substr(sha256(from_hex('{_OPAD}') || from_hex(sha256(from_hex('{_IPAD}') || encode(c_name)))), 1, 16) AS session FROM customer", log=False)
def session_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keyed pseudonyms as a column, the same as those of single requests."""
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", F.substring(hmac_hex(KEY, F.col("c_name")), 1, 16).alias("session"))
