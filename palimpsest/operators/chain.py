"""Tamper evidence: a hash chain over the log.

A row's digest covers id, time, operation, table and both images; its hash covers the digest and
the hash of the row before. Digests are computed in parallel, ranged by id and written; only (id,
digest) goes through the running hash, which is sequential by nature: one stretch of ranges after
another, each a task of its own that goes on from the last hash of the one before. Checking
is parallel throughout: hashes of the rows before are found by a lag within buckets of the chain's
order and a second lag over one row a bucket.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..sources.folders import fresh_folder

VERSION = "v1"
BUCKET_ROWS = 65_536
#: Rows of a stretch; one range of ids at least.
STRETCH_ROWS = 1 << 20
HASHED = ("id", "changed_at", "operation", "table_name", "old_data", "new_data")


def _field(value: Column) -> Column:
    """Length and text, so that no text can imitate two fields."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-;")).otherwise(F.concat(F.length(text).cast("string"), F.lit(":"), text, F.lit(";")))


def digest() -> Column:
    moment = F.unix_micros(F.col("changed_at").cast("timestamp"))
    return F.sha2(F.concat(*[_field(moment if c == "changed_at" else F.col(c)) for c in HASHED]), 256)


def row_hash(row_digest: Column, before: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(VERSION), row_digest, F.coalesce(before, F.lit(""))), 256)


LINK_COLUMNS = ("row_hash", "prev_hash", "chain_seq")
LINKS = "id bigint, row_hash string, prev_hash string, chain_seq bigint"


def chained(batch: DataFrame, tip: dict[str, Any] | None = None) -> DataFrame:
    """The batch with ``row_hash``, ``prev_hash`` and ``chain_seq``, continuing from a tip; rows meet
    their hashes in a join on the id."""
    return batch.drop(*LINK_COLUMNS).join(links(batch, tip), "id")


def _folded(digests: DataFrame, last: str, seq: int) -> DataFrame:
    """The running hash over one stretch, in order in one task."""

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number = last, seq
        for part in batches:
            hashes, before = [], []
            for one in part.column("digest").to_pylist():
                before.append(own or None)
                own = hashlib.sha256(f"{VERSION}|{one.hex()}|{own}".encode()).hexdigest()
                hashes.append(own)
            numbers = pa.array(range(number + 1, number + 1 + len(hashes)), pa.int64())
            number += len(hashes)
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(hashes, pa.string()), pa.array(before, pa.string()), numbers], names=["id", "row_hash", "prev_hash", "chain_seq"])

    return digests.select("id", "digest").coalesce(1).sortWithinPartitions("id").mapInArrow(fold, LINKS)


def links(batch: DataFrame, tip: dict[str, Any] | None = None, folder: str | None = None) -> DataFrame:
    """``id`` and the hashes of a batch, continuing from a tip, written to ``folder``, which all
    executors share. The running hash reads ids and digests, and nothing else; only its last value
    passes through the driver from one stretch to the next."""
    spark, folder = batch.sparkSession, folder or fresh_folder(batch.sparkSession, "links")
    digests = batch.select(F.col("id").cast("bigint").alias("id"), F.unhex(digest()).alias("digest"))
    digests.repartitionByRange("id").sortWithinPartitions("id").withColumn("part", F.spark_partition_id()).write.parquet(f"{folder}/digests")
    ranged = spark.read.schema("id bigint, digest binary, part int").parquet(f"{folder}/digests")
    stretches: list[list[int]] = []
    for part, n in sorted(tuple(r) for r in ranged.groupBy("part").agg(F.count("*").alias("n")).collect()):
        if not stretches or stretches[-1][2] + n > STRETCH_ROWS:
            stretches.append([part, part, 0])
        stretches[-1][1], stretches[-1][2] = part, stretches[-1][2] + n
    last, seq = (tip or {}).get("row_hash") or "", int((tip or {}).get("chain_seq") or 0)
    for number, (low, high, n) in enumerate(stretches):
        path = f"{folder}/links/stretch={number}"
        _folded(ranged.where(F.col("part").between(low, high)), last, seq).write.parquet(path)
        seq += n
        if number + 1 < len(stretches):
            last = spark.read.schema(LINKS).parquet(path).where(F.col("chain_seq") == seq).first()["row_hash"]
    if not stretches:
        return spark.createDataFrame([], LINKS)
    return spark.read.schema(LINKS + ", stretch int").parquet(f"{folder}/links").drop("stretch")


def chain_tip(log: DataFrame) -> DataFrame:
    """The last chained row, or none."""
    return log.where(F.col("row_hash").isNotNull()).orderBy(F.desc_nulls_last("chain_seq"), F.desc("id")).limit(1).select("id", "chain_seq", "row_hash", "changed_at")


#: What stands for rows that a purge has taken: a stretch of the chain without a row left in it.
GAP = "first_seq bigint, last_seq bigint, first_prev string, last_hash string, last_id bigint"


def gaps(gone: DataFrame, before: DataFrame | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Gaps that chained rows leave which go, whatever their place in the chain; ``before`` are gaps
    of earlier purges. Neighbours of one bucket are one gap."""
    rows = gone.where(F.col("row_hash").isNotNull() & F.col("chain_seq").isNotNull()).select(F.col("chain_seq").alias("first_seq"), F.col("chain_seq").alias("last_seq"), F.col("prev_hash").alias("first_prev"), F.col("row_hash").alias("last_hash"), F.col("id").alias("last_id"))
    rows = (rows if before is None else rows.unionByName(before)).withColumn("_bucket", F.floor(F.col("first_seq") / bucket_rows))
    order = Window.partitionBy("_bucket").orderBy("first_seq")
    fresh = ~F.coalesce(F.lag("last_seq").over(order) + 1 == F.col("first_seq"), F.lit(False))
    runs = rows.withColumn("_fresh", fresh.cast("int")).withColumn("_run", F.sum("_fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = lambda c: F.max_by(c, "last_seq").alias(c)
    return runs.groupBy("_bucket", "_run").agg(F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"), F.min_by("first_prev", "first_seq").alias("first_prev"), last("last_hash"), last("last_id")).drop("_bucket", "_run")


def _with_gaps(log: DataFrame, left: DataFrame | None) -> DataFrame:
    """Gaps among the rows of a log, as rows of their own with the mark ``is_gap``."""
    log = log.withColumn("is_gap", F.lit(False))
    if left is None:
        return log
    return log.unionByName(left.select(F.col("last_id").alias("id"), F.col("first_seq").alias("chain_seq"), F.col("first_prev").alias("prev_hash"), F.col("last_hash").alias("row_hash"), F.lit(True).alias("is_gap")), allowMissingColumns=True)


def with_expected(log: DataFrame, bucket_rows: int = BUCKET_ROWS, start: str | None = None) -> DataFrame:
    """Chained rows with ``expected_prev``, the hash before them in order of ``chain_seq``, rows
    without one first, then id. ``start`` is the hash before the first one."""
    rows = log.where(F.col("row_hash").isNotNull()).withColumn("_bucket", F.coalesce(F.floor(F.col("chain_seq") / bucket_rows), F.lit(-1)))
    order = [F.asc_nulls_first("chain_seq"), F.asc("id")]
    rows = rows.withColumn("_lag", F.lag("row_hash").over(Window.partitionBy("_bucket").orderBy(*order)))
    first = F.row_number().over(Window.partitionBy("_bucket").orderBy(*order))
    rows = rows.withColumn("_first", first == 1)
    last = F.max(F.struct(F.coalesce("chain_seq", F.lit(-(1 << 62))).alias("s"), "id", "row_hash"))
    ends = rows.groupBy("_bucket").agg(last.alias("end")).select("_bucket", F.lag("end.row_hash", 1, start).over(Window.orderBy("_bucket")).alias("_before"))
    joined = rows.join(ends, "_bucket", "left")
    return joined.withColumn("expected_prev", F.when(F.col("_first"), F.col("_before")).otherwise(F.col("_lag"))).drop("_bucket", "_lag", "_first", "_before")


def verify(log: DataFrame, expected_tip: dict[str, Any] | None = None, bucket_rows: int = BUCKET_ROWS, chain_from: int | None = None, anchor: dict[str, Any] | None = None, left: DataFrame | None = None) -> DataFrame:
    """Broken rows: ``id`` and one ``reason`` each. A wrong link hides a wrong hash; empty and
    null hashes are equal. A tip that was noted before must still be there as it was. From the id
    ``chain_from`` on every row must have a hash; ``anchor`` is a row before the first one, which
    that must follow, and ``left`` are the gaps of purges, which the rows beside them must fit."""
    log = _with_gaps(log, left)
    rows = with_expected(log, bucket_rows, (anchor or {}).get("row_hash"))
    blank = lambda c: F.when(F.col(c) != "", F.col(c))
    reason = F.when(~blank("prev_hash").eqNullSafe(blank("expected_prev")), "prev_hash mismatch").when(~F.col("is_gap") & (row_hash(digest(), F.col("expected_prev")) != F.col("row_hash")), "row_hash mismatch")
    broken = rows.select("id", reason.alias("reason")).where("reason is not null")
    if chain_from is not None:
        bare = log.where((F.col("id") >= chain_from) & F.col("row_hash").isNull())
        broken = broken.unionByName(bare.select("id", F.lit("row without a hash").alias("reason")))
    if not expected_tip or expected_tip.get("id") is None:
        return broken
    tip_id, tip_hash = int(expected_tip["id"]), expected_tip.get("row_hash")
    there = log.agg(F.max(F.when(F.col("id") == tip_id, F.struct(F.coalesce("row_hash", F.lit("")).alias("h")))).alias("own"), F.coalesce(F.max("id"), F.lit(0)).alias("most"))
    checks = F.array(
        F.when(F.col("own").isNull(), F.lit("expected tip row is missing")).when(F.col("own.h") != F.lit(tip_hash or ""), F.lit("expected tip hash changed")),
        F.when(F.col("most") < tip_id, F.lit("tail of the log is missing")),
    )
    noted = there.select(F.lit(tip_id).cast("bigint").alias("id"), F.explode(checks).alias("reason")).where("reason is not null")
    return broken.unionByName(noted)


def summary(log: DataFrame, broken: DataFrame) -> DataFrame:
    """One row: chained rows that were checked, whether all is well, and how many are broken."""
    count = broken.agg(F.count("*")).scalar()
    return log.agg(F.count("row_hash").alias("checked")).select("checked", (count == 0).alias("ok"), count.alias("n_broken"))


def verify_summary(log: DataFrame, expected_tip: dict[str, Any] | None = None, chain_from: int | None = None, anchor: dict[str, Any] | None = None, first: int = 1000, left: DataFrame | None = None) -> dict[str, Any]:
    """Counts, and the first broken rows; ``verify`` gives the table of all of them."""
    if expected_tip and anchor and expected_tip.get("id") is not None and expected_tip["id"] <= anchor["id"]:
        expected_tip = None  # a purge has taken the whole chain
    broken = verify(log, expected_tip, chain_from=chain_from, anchor=anchor, left=left)
    found = summary(log, broken).first()
    rows = [(r["id"], r["reason"]) for r in broken.orderBy("id", "reason").limit(first).collect()] if found["n_broken"] else []
    return {"checked": found["checked"], "ok": found["ok"], "n_broken": found["n_broken"], "broken": rows}
