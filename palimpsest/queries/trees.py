"""The history tree over the whole log, and what a purge leaves of chain and tree.

Logs are written through the engine, in several batches where events come late.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import tree
from ..plans.months import MONTH
from ..sources.folders import fresh_folder
from ..sources.store import Engine
from ..streaming.stream import append_stream
from .base import LOG, NOW, Registered, micros, sql_field
from .chains import FIELDS, tampered
from .keeping import SHIFTED, shifted
from .logs import _engine, _event_id, _events, _halves, made_once

register = Registered()

DIGESTS = f", n AS MATERIALIZED (SELECT * EXCLUDE (id), row_number() OVER (ORDER BY changed_at, object_id, operation) AS id FROM audit), d AS MATERIALIZED (SELECT id, sha256(concat({', '.join(sql_field(v) for v in FIELDS)})) AS digest FROM n)"
TREE = DIGESTS + """, t AS (SELECT 0 AS level, id - 1 AS place, sha256(from_hex('00' || digest)) AS hash FROM d
UNION ALL SELECT level + 1, place // 2, sha256(from_hex('01' || string_agg(hash, '' ORDER BY place))) FROM t GROUP BY level, place // 2 HAVING count(*) = 2) """


def _recursive(sql: str) -> str:
    return (LOG + TREE).replace("WITH e AS", "WITH RECURSIVE e AS", 1) + sql


def _thirds(spark: SparkSession, sf_dir: str, engine: Engine) -> list[dict]:
    """Three batches whose moments all reach over the same nine months, so that events of the
    second and third come late; the roots after each."""
    rows = made_once(shifted(spark, sf_dir).withColumn("meta", F.create_map(F.lit("event"), F.col("id").cast("string"))))
    roots = []
    for turn in range(3):
        engine.append_events(rows.where(F.col("id") % 3 == turn).drop("id"))
        roots.append(engine.tree_root())
    return roots


def _whole(spark: SparkSession, sf_dir: str) -> Engine:
    engine = _engine(spark, history_tree=True)
    for half in _halves(_events(spark, sf_dir)):
        engine.append_events(half)
    return engine


@register(_recursive("SELECT level, place, hash FROM t"), log=False)
def chain_tree_build(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of a log of two commits: the second goes on from the peaks of the first."""
    return _whole(spark, sf_dir).tree_nodes.select("level", "place", F.lower(F.hex("hash")).alias("hash"))


@register(f"SELECT id AS event_id, epoch_us(moved) AS moved_us, TRUE AS chain_ok, TRUE AS tree_ok FROM ({SHIFTED}) WHERE moved >= TIMESTAMP '{NOW}' - INTERVAL 4 MONTH")
def chain_tree_purge_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A purge of events that stand between others in the order of commits, in three steps: what is
    left is held against chain and tree, and against the root of the first commit."""
    engine = _engine(spark, admin=True, hash_chain=True, history_tree=True)
    roots = _thirds(spark, sf_dir, engine)
    for age in ("7 months", "5 months", "4 months"):
        engine.purge(datetime.fromisoformat(NOW), age, keep_anchor=True)
    chain_ok = engine.verify()["ok"]
    tree_ok = not engine.verify_tree(roots[0]).limit(1).count()
    return engine.log.select(_event_id(), micros().alias("moved_us"), F.lit(chain_ok).alias("chain_ok"), F.lit(tree_ok).alias("tree_ok"))


@register(f"SELECT strftime(moved, '%Y-%m') AS month, count(*) AS events, TRUE AS chain_ok, TRUE AS tree_ok FROM ({SHIFTED}) WHERE date_trunc('month', moved) + INTERVAL 1 MONTH > TIMESTAMP '{NOW}' - INTERVAL 4 MONTH GROUP BY 1")
def chain_tree_drop_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with whole months that are dropped."""
    engine = _engine(spark, admin=True, hash_chain=True, history_tree=True)
    _thirds(spark, sf_dir, engine)
    engine.drop_old_months(datetime.fromisoformat(NOW), "4 months")
    chain_ok, tree_ok = engine.verify()["ok"], not engine.verify_tree().limit(1).count()
    return engine.log.groupBy(F.col(MONTH).alias("month")).agg(F.count("*").alias("events")).withColumns({"chain_ok": F.lit(chain_ok), "tree_ok": F.lit(tree_ok)})


@register("""WITH n AS (SELECT row_number() OVER () AS id FROM audit)
SELECT id, CASE id % 10 WHEN 0 THEN 'row differs from its leaf' WHEN 3 THEN 'row is missing' ELSE 'row stands twice' END AS reason FROM n WHERE id % 10 IN (0, 3, 7)""".replace("WITH n AS", ", n AS", 1))
def chain_tree_tampered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with any hashed field changed, rows taken out and rows put in twice."""
    engine = _whole(spark, sf_dir)
    log, state = engine.log, engine.manifest()["tree"]
    edited = tampered(log).where("id % 10 <> 3")
    edited = edited.unionByName(edited.where("id % 10 = 7"))
    return tree.verify(edited, engine.tree_nodes, state["first"], state["size"], engine.tree_root()["root"], keep=engine._kept)


@register(", n AS (SELECT row_number() OVER () AS id, count(*) OVER () AS size FROM audit) SELECT id, CAST(floor(log2(xor(id - 1, size))) AS INTEGER) AS steps, TRUE AS proven FROM n")
def chain_tree_inclusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A proof for every row that it is in the root."""
    engine = _whole(spark, sf_dir)
    state = engine.manifest()["tree"]
    proofs = tree.inclusion(engine.tree_nodes, state["size"], engine.log.select((F.col("id") - state["first"]).alias("place")))
    return proofs.select((F.col("place") + state["first"]).alias("id"), F.size("path").alias("steps"), tree.proven(state["peaks"]).alias("proven"))


@register("SELECT CAST(sum(count(*)) OVER (ORDER BY id % 3) AS BIGINT) AS size, TRUE AS same FROM audit GROUP BY id % 3")
def chain_tree_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roots after each of three commits, from the nodes that are there after the last."""
    engine = _engine(spark, history_tree=True)
    roots = _thirds(spark, sf_dir, engine)
    nodes = engine.tree_nodes
    return spark.createDataFrame([(r["size"], tree.root_at(nodes, r["size"]) == r["root"]) for r in roots], "size bigint, same boolean")


@register("SELECT row_number() OVER (ORDER BY id % 3, changed_at, object_id, operation) AS id, id AS event_id, TRUE AS chain_ok, TRUE AS tree_ok FROM audit")
def append_stream_chained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stream of three micro-batches into a log with chain and tree."""
    engine, folder = _engine(spark, hash_chain=True, history_tree=True), fresh_folder(spark, "streams")
    rows = _events(spark, sf_dir)
    for turn in range(3):
        rows.where(F.col("meta")["event"].cast("bigint") % 3 == turn).coalesce(1).write.parquet(f"{folder}/in/turn={turn}")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
    append_stream(stream, engine, f"{folder}/checkpoint", availableNow=True).awaitTermination()
    chain_ok, tree_ok = engine.verify()["ok"], not engine.verify_tree().limit(1).count()
    return engine.log.select("id", _event_id(), F.lit(chain_ok).alias("chain_ok"), F.lit(tree_ok).alias("tree_ok"))
