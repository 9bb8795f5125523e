"""The hash chain over the whole log, with its full images.

The chain is built once and written, as a log keeps it; checks read what was written. The SQL of
building it and of its tip is a recursion over all events with their whole images.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import chain, metrics
from ..sources import testlog
from ..sources.folders import fresh_folder
from .base import AT, LOG, Registered, sql_field

register = Registered()


def _kept(df: DataFrame, spark: SparkSession) -> DataFrame:
    path = fresh_folder(spark, "chain")
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return testlog.log(spark, sf_dir).select(*chain.HASHED)


def _chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _kept(chain.chained(_rows(spark, sf_dir)), spark)


def tampered(log: DataFrame) -> DataFrame:
    """Every tenth id with one of its hashed fields changed, each field in turn."""
    edits = {
        "new_data": F.concat(F.coalesce("new_data", F.lit("")), F.lit(" ")),
        "old_data": F.concat(F.coalesce("old_data", F.lit("")), F.lit(" ")),
        "operation": F.lower("operation"),
        "changed_at": F.col("changed_at") + F.make_dt_interval(secs=F.lit(1)),
        "table_name": F.upper("table_name"),
    }
    turn = F.col("id") / 10 % len(edits)
    changed = {c: F.when((F.col("id") % 10 == 0) & (turn == k), new).otherwise(F.col(c)) for k, (c, new) in enumerate(edits.items())}
    return log.withColumns(changed)


def _sql_image(kind: str, value: str, k: str, absent: str) -> str:
    text = f"""concat('{{"id":', object_id, ',"event_type":"', {kind}, '","value":', CAST({value} AS VARCHAR), ',"k":', CAST({k} AS VARCHAR), '}}')"""
    return f"CASE WHEN operation <> '{absent}' THEN {text} END"


FIELDS = ("CAST(id AS VARCHAR)", "CAST(changed_us AS VARCHAR)", "operation", "'events'", _sql_image("old_type", "old_value", "old_k", "INSERT"), _sql_image("event_type", "value", "k", "DELETE"))
CHAIN = f""", p AS MATERIALIZED (SELECT id, sha256(concat({", ".join(sql_field(v) for v in FIELDS)})) AS digest, row_number() OVER (ORDER BY id) AS seq FROM audit),
h AS (SELECT id, seq, CAST(NULL AS VARCHAR) AS prev_hash, sha256(concat('v1|', digest, '|')) AS row_hash FROM p WHERE seq = 1
UNION ALL SELECT p.id, p.seq, h.row_hash, sha256(concat('v1|', p.digest, '|', h.row_hash)) FROM h JOIN p ON p.seq = h.seq + 1) """


def _recursive(sql: str) -> str:
    return (LOG + CHAIN).replace("WITH e AS", "WITH RECURSIVE e AS", 1) + sql


@register(_recursive("SELECT id, seq AS chain_seq, prev_hash, row_hash FROM h"), log=False)
def chain_log_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.chained(_rows(spark, sf_dir)).select("id", "chain_seq", "prev_hash", "row_hash")


@register(_recursive("SELECT id, seq AS chain_seq, row_hash FROM h ORDER BY seq DESC LIMIT 1"), log=False)
def chain_log_tip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.chain_tip(chain.chained(_rows(spark, sf_dir))).select("id", "chain_seq", "row_hash")


@register("SELECT count(*) AS checked, TRUE AS ok, CAST(0 AS BIGINT) AS n_broken FROM audit")
def chain_log_verify_ok(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _chained(spark, sf_dir)
    return chain.summary(log, chain.verify(log))


@register("SELECT id, 'row_hash mismatch' AS reason FROM audit WHERE id % 10 = 0")
def chain_log_verify_tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chain.verify(tampered(_chained(spark, sf_dir)))


@register("SELECT m AS id, unnest(['expected tip row is missing', 'tail of the log is missing']) AS reason FROM (SELECT max(id) AS m FROM audit)")
def chain_log_tail_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _chained(spark, sf_dir)
    tip = chain.chain_tip(log).first().asDict()
    return chain.verify(log.where(F.col("id") < tip["id"]), tip)


@register("SELECT max(id) AS id, 'expected tip hash changed' AS reason FROM audit")
def chain_log_anchor_rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _chained(spark, sf_dir)
    return chain.verify(log, chain.chain_tip(log).first().asDict() | {"row_hash": "0" * 64})


@register(f"SELECT count(*) AS total, CAST(0 AS BIGINT) AS broken, count(*) FILTER (changed_at >= TIMESTAMP '{AT}') AS hashed FROM audit")
def chain_log_legacy_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows from before a moment have no hash and are not part of the chain."""
    rows = _rows(spark, sf_dir)
    legacy = F.col("changed_at") < F.lit(AT).cast("timestamp_ntz")
    none = [F.lit(None).cast(k).alias(c) for c, k in (("row_hash", "string"), ("prev_hash", "string"), ("chain_seq", "bigint"))]
    log = _kept(chain.chained(rows.where(~legacy)).unionByName(rows.where(legacy).select("*", *none)), spark)
    broken = chain.verify(log).agg(F.count("*")).scalar()
    return log.agg(F.count("*").alias("total"), F.count("row_hash").alias("hashed")).select("total", broken.alias("broken"), "hashed")


@register("SELECT count(*) AS total, count(*) AS chained, count(*) AS hashed, count(*) AS tip_seq FROM audit")
def chain_log_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.chain_status(_chained(spark, sf_dir)).select("total", "chained", "hashed", "tip_seq")


@register("SELECT id, 'row without a hash' AS reason FROM audit WHERE id % 50 = 7")
def chain_log_bare_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that somebody has put in beside the chain after it was switched on."""
    rows = _rows(spark, sf_dir)
    own = F.col("id") % 50 == 7
    none = [F.lit(None).cast(k).alias(c) for c, k in (("row_hash", "string"), ("prev_hash", "string"), ("chain_seq", "bigint"))]
    log = _kept(chain.chained(rows.where(~own)).unionByName(rows.where(own).select("*", *none)), spark)
    return chain.verify(log, chain_from=0)


#: Names of the first round; they read the whole log now, as their namesakes do.
for _old, _new in {"chain_build": "build", "chain_tip": "tip", "chain_verify_ok": "verify_ok", "chain_verify_tampered": "verify_tampered", "chain_tail_truncated": "tail_truncated", "chain_anchor_rewritten": "anchor_rewritten", "chain_legacy_rows": "legacy_rows", "chain_status": "status"}.items():
    register.queries[_old] = register.queries[f"chain_log_{_new}"]
    register.sql[_old] = register.sql[f"chain_log_{_new}"]
