"""The hash chain over the whole log: a plain fold, SQL, and edits of any field at any place."""

import calendar
import hashlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from palimpsest.operators import chain
from palimpsest.queries import chains
from palimpsest.sources import testlog
from palimpsest.sources.folders import fresh_folder


def field(value):
    return "-;" if value is None else f"{len(str(value))}:{value};"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def fold(spark, data):
    """(id, chain_seq, prev_hash, row_hash) of every event."""
    last, out = None, []
    for n, r in enumerate(testlog.log(spark, data).orderBy("id").collect(), 1):
        moment = calendar.timegm(r["changed_at"].timetuple()) * 1_000_000 + r["changed_at"].microsecond
        digest = sha("".join(field(v) for v in (r["id"], moment, r["operation"], r["table_name"], r["old_data"], r["new_data"])))
        before, last = last, sha(f"v1|{digest}|{last or ''}")
        out.append((r["id"], n, before, last))
    return out


def test_whole_log_is_chained(spark, data, fold):
    known = __spark_entry__.queries()
    assert len(fold) > 300
    assert sorted(tuple(r) for r in known["chain_log_build"](spark, data).collect()) == fold
    assert [tuple(r) for r in known["chain_log_tip"](spark, data).collect()] == [(fold[-1][0], fold[-1][1], fold[-1][3])]


def test_edits_are_found_anywhere(spark, data, fold):
    log = chains._chained(spark, data)
    for column in ("operation", "table_name", "old_data", "new_data"):
        edited = log.withColumn(column, F.when(F.col("id") == fold[-1][0], F.lit("edited")).otherwise(F.col(column)))
        assert [tuple(r) for r in chain.verify(edited, bucket_rows=64).collect()] == [(fold[-1][0], "row_hash mismatch")]


@pytest.mark.parametrize("rows", [1, 100, 1 << 20])
def test_stretches_go_on_from_each_other(spark, data, fold, rows, monkeypatch):
    """The chain by several tasks of bounded stretches is the one of a plain fold."""
    monkeypatch.setattr(chain, "STRETCH_ROWS", rows)
    monkeypatch.setattr(chain, "fresh_folder", lambda spark, tag: folders.append(folder := fresh_folder(spark, tag)) or folder)
    folders = []
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    log = testlog.log(spark, data)
    cut = fold[len(fold) // 2]
    first = sorted(tuple(r[c] for c in ("id", "chain_seq", "prev_hash", "row_hash")) for r in chain.links(log.where(F.col("id") <= cut[0])).collect())
    tip = {"row_hash": cut[3], "chain_seq": cut[1]}
    second = sorted(tuple(r[c] for c in ("id", "chain_seq", "prev_hash", "row_hash")) for r in chain.links(log.where(F.col("id") > cut[0]), tip).collect())
    assert first + second == fold
    found = spark.read.parquet(f"{folders[0]}/links").groupBy("stretch").count().collect()
    assert len(found) == (1 if rows == 1 << 20 else 4)
    assert chain.links(log.limit(0)).count() == 0
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("name", ["chain_log_anchor_rewritten", "chain_log_tail_truncated", "chain_log_verify_tampered", "chain_tail_truncated", "chain_tip"])
def test_checks_over_several_stretches(name, spark, data, fold, monkeypatch):
    """Checks of a chain that several tasks have made, none of which read all rows."""
    folders = []
    monkeypatch.setattr(chain, "STRETCH_ROWS", 100)
    monkeypatch.setattr(chain, "fresh_folder", lambda spark, tag: folders.append(folder := fresh_folder(spark, tag)) or folder)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    found = sorted(tuple(r) for r in __spark_entry__.queries()[name](spark, data).collect())
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    last, n, _, tip = fold[-1]
    want = {
        "chain_log_anchor_rewritten": [(last, "expected tip hash changed")],
        "chain_log_tail_truncated": [(last, "expected tip row is missing"), (last, "tail of the log is missing")],
        "chain_log_verify_tampered": [(r[0], "row_hash mismatch") for r in fold if r[0] % 10 == 0],
        "chain_tip": [(last, n, tip)],
    }
    assert found == want.get(name, want["chain_log_tail_truncated"])
    stretches = [r["count"] for r in spark.read.parquet(f"{folders[0]}/links").groupBy("stretch").count().collect()]
    assert sum(stretches) == n and max(stretches) < n / 2
