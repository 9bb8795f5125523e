"""Variants, sketches, indexed search and linked export."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import linked, search, sketches, variants
from ..plans.months import with_month
from ..sources import testlog
from .base import Registered
from .keeping import SHIFTED, shifted
from .logs import made_once

register = Registered()

DIFFS = " UNION ALL ".join(f"SELECT id, '{c}' AS field, CAST(old_{o} AS VARCHAR) AS old, CAST({c} AS VARCHAR) AS new FROM audit WHERE operation = 'UPDATE' AND old_{o} IS DISTINCT FROM {c}" for c, o in (("event_type", "type"), ("k", "k"), ("value", "value")))


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates with both images as variants, made from typed rows."""
    return variants.captured(testlog.changes(spark, sf_dir).where("operation = 'UPDATE'"))


@register(DIFFS)
def variant_diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of images that are variants."""
    found = _updates(spark, sf_dir).select("id", F.explode(variants.diff(F.col("old_image"), F.col("new_image"))).alias("field", "change"))
    kind = {"event_type": "string", "k": "bigint", "value": "double"}
    text = lambda side: F.coalesce(*[F.when(F.col("field") == f, F.variant_get(F.col("change")[side], "$", k).cast("string")) for f, k in kind.items()])
    return found.select("id", "field", text("old").alias("old"), text("new").alias("new"))


@register("SELECT id, old_type, value FROM audit WHERE operation = 'UPDATE' AND event_type = 'purchase' AND old_type IS DISTINCT FROM 'purchase'")
def variant_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates to one value, with the one before and a path of the image."""
    rows = _updates(spark, sf_dir).withColumn("diff", variants.diff(F.col("old_image"), F.col("new_image")))
    return rows.where(variants.contains("event_type", "new", "purchase")).select("id", variants.value("event_type", "old").alias("old_type"), variants.path("new_image", "$.value", "double").alias("value"))


@register("SELECT id, event_type, k FROM audit WHERE k > 50 AND operation <> 'DELETE'")
def variant_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths of images whose texts are parsed once."""
    rows = variants.parsed(testlog.log(spark, sf_dir))
    return rows.select("id", variants.path("new_image", "$.event_type").alias("event_type"), variants.path("new_image", "$.k", "bigint").alias("k")).where("k > 50")


def _nine_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.get_json_object("new_data", "$.value").cast("double")
    rows = shifted(spark, sf_dir).where("operation <> 'DELETE'").select("id", "changed_at", "object_id", F.get_json_object("new_data", "$.event_type").alias("event_type"), value.alias("value"))
    return made_once(with_month(rows))


@register(f"SELECT event_type, CAST(r AS DOUBLE) AS rank, count(value) AS n, TRUE AS within FROM ({SHIFTED}), unnest([0.5, 0.95, 0.99]) AS u(r) WHERE operation <> 'DELETE' AND strftime(moved, '%Y-%m') BETWEEN '2023-07' AND '2023-12' GROUP BY ALL")
def quantiles_by_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantiles of six months from monthly sketches; their exact ranks are off by no more than the
    sketch allows."""
    log = _nine_months(spark, sf_dir)
    kept = made_once(sketches.by_month(log, "value", "event_type"))
    found = sketches.quantiles(sketches.merged(kept, "event_type", "2023-07", "2023-12"), "event_type")
    own = log.where(F.col("changed_month").between("2023-07", "2023-12"))
    errors = sketches.rank_errors(found, own, "value", "event_type")
    return errors.select("event_type", F.col("rank").cast("decimal(3,2)").cast("double").alias("rank"), "n", (F.col("rank_error") <= 2 * sketches.RANK_ERROR).alias("within"))


@register(f"SELECT event_type AS item, count(*) AS n FROM ({SHIFTED}) WHERE operation <> 'DELETE' AND strftime(moved, '%Y-%m') >= '2023-10' GROUP BY 1 ORDER BY n DESC LIMIT 10")
def hitters_by_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most frequent event types of the last months, from monthly sketches."""
    kept = made_once(sketches.hitters_by_month(_nine_months(spark, sf_dir), "event_type"))
    return sketches.top_items(kept.where("changed_month >= '2023-10'"), 10).select("item", F.col("count").alias("n"))


@register("""SELECT 'urchas' AS text, id FROM audit WHERE (CASE WHEN operation <> 'UPDATE' OR event_type IS DISTINCT FROM old_type THEN concat(coalesce(event_type, ''), '|', coalesce(old_type, '')) ELSE '' END) LIKE '%urchas%'
UNION ALL SELECT '1', id FROM audit WHERE object_id LIKE '%1%' OR (CASE WHEN operation <> 'UPDATE' OR value IS DISTINCT FROM old_value THEN concat(coalesce(CAST(value AS VARCHAR), ''), '|', coalesce(CAST(old_value AS VARCHAR), '')) ELSE '' END) LIKE '%1%' OR (CASE WHEN operation <> 'UPDATE' OR k IS DISTINCT FROM old_k THEN concat(coalesce(CAST(k AS VARCHAR), ''), '|', coalesce(CAST(old_k AS VARCHAR), '')) ELSE '' END) LIKE '%1%'""")
def search_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in objects and diffs: one by its trigrams, one that is too short for them."""
    log = testlog.log(spark, sf_dir)
    postings = made_once(search.index(log))
    counts = made_once(search.frequencies(postings))
    found = [search.search(log, postings, counts, t).select(F.lit(t).alias("text"), "id") for t in ("urchas", "1", "no such text")]
    return found[0].unionByName(found[1]).unionByName(found[2])


def _shop_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers, orders and their lines as a log; every fifth order once was another customer's."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    row = lambda df, table, key, image, old=None: df.select(F.lit(table).alias("table_name"), key.cast("string").alias("object_id"), (F.to_json(old) if old is not None else F.lit(None).cast("string")).alias("old_data"), F.to_json(image).alias("new_data"))
    customers, orders, lines = read("customer"), read("orders"), read("lineitem")
    moved = orders.where("o_orderkey % 5 = 0")
    line_key = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    parts = [
        row(customers, "customer", F.col("c_custkey"), F.struct(F.col("c_custkey").alias("id"), "c_name")),
        row(orders, "orders", F.col("o_orderkey"), F.struct(F.col("o_orderkey").alias("id"), "o_custkey")),
        row(moved, "orders", F.col("o_orderkey"), F.struct(F.col("o_orderkey").alias("id"), "o_custkey"), F.struct(F.col("o_orderkey").alias("id"), (F.col("o_custkey") + 1).alias("o_custkey"))),
        row(lines, "lineitem", line_key, F.struct(line_key.alias("id"), "l_orderkey", "l_partkey")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


SUBJECT = "c_custkey % 50 = 3"


@register(f"""WITH c AS (SELECT c_custkey FROM customer WHERE {SUBJECT}), o AS (SELECT DISTINCT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c) OR (o_orderkey % 5 = 0 AND o_custkey + 1 IN (SELECT c_custkey FROM c)))
SELECT 'customer' AS table_name, CAST(c_custkey AS VARCHAR) AS object_id, 0 AS step, 1 AS events FROM c UNION ALL
SELECT 'orders', CAST(o_orderkey AS VARCHAR), 1, CASE WHEN o_orderkey % 5 = 0 THEN 2 ELSE 1 END FROM o UNION ALL
SELECT 'lineitem', concat(l_orderkey, '-', l_linenumber), 2, count(*) FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM o) GROUP BY ALL""", log=False)
def subject_export_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some customers' rows, their orders, also those that were theirs, and the lines of these."""
    log = _shop_log(spark, sf_dir)
    start = spark.read.parquet(f"{sf_dir}/customer.parquet").where(SUBJECT).select(F.lit("customer").alias("table_name"), F.col("c_custkey").alias("object_id"))
    references = (linked.Reference("orders", "o_custkey", "customer"), linked.Reference("lineitem", "l_orderkey", "orders"))
    return linked.subject_export(log, start, references, made_once).groupBy("table_name", "object_id", "step").agg(F.count("*").alias("events"))
