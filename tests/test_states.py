"""Keyframes, the index of files and the segmented scan."""

import random
from datetime import datetime, timedelta

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from palimpsest.operators import scan, timetravel
from palimpsest.sources import fileindex
from palimpsest.sources.store import Engine

EVENT = "operation string, changed_at timestamp, object_id string, table_name string, user_id int, context_id string, new_data string"
START = datetime(2024, 1, 1)


def events(spark, rows):
    return spark.createDataFrame([(op, START + timedelta(days=d), o, "t", int(o), f"c{int(o) % 7}", None if op == "DELETE" else f'{{"v":{d}}}') for op, d, o in rows], EVENT)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def states(df):
    return sorted((r["object_id"], r["data"]) for r in df.collect())


def test_keyframes_with_late_events_and_purges(spark, tmp_path):
    rng = random.Random(7)
    engine = Engine(spark, str(tmp_path / "log"), admin=True)
    engine.bootstrap()
    some = lambda n: events(spark, [(rng.choice(["INSERT", "UPDATE", "UPDATE", "DELETE"]), rng.randrange(180), str(rng.randrange(12))) for _ in range(n)])
    engine.append_events(some(60))
    engine.write_keyframe("t", "2024-03")
    engine.append_events(some(40))
    engine.write_keyframe("t", "2024-05")
    engine.append_events(some(40))
    for at in ("2024-02-10 00:00:00", "2024-03-01 00:00:00", "2024-04-15 00:00:00", "2024-05-20 12:00:00", datetime(2024, 8, 1)):
        assert states(engine.as_of("t", at)) == states(timetravel.table_as_of(engine.log, "t", at)), at
    engine.purge(datetime(2024, 4, 30), "30 days")
    assert engine.manifest()["keyframes"] == []
    assert states(engine.as_of("t", "2024-06-01")) == states(timetravel.table_as_of(engine.log, "t", "2024-06-01"))


def test_a_late_event_does_not_bring_an_object_back(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "log"))
    engine.bootstrap()
    engine.append_events(events(spark, [("INSERT", 0, "1"), ("DELETE", 20, "1"), ("INSERT", 3, "2")]))
    engine.write_keyframe("t", "2024-02")
    engine.append_events(events(spark, [("UPDATE", 10, "1"), ("UPDATE", 40, "2")]))
    assert states(engine.as_of("t", "2024-06-01")) == [("2", '{"v":40}')]


def test_earlier_months_are_not_read(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "log"))
    engine.bootstrap()
    engine.append_events(events(spark, [("UPDATE", d, str(d % 5)) for d in range(180)]))
    engine.write_keyframe("t", "2024-05")
    files = engine.as_of("t", "2024-05-20").inputFiles()
    assert files and not [f for f in files if "changed_month=2024-0" in f and f.split("changed_month=")[1][:7] < "2024-05"]
    # One late event of January: its batch is read beside the keyframe, the others of January are not.
    engine.append_events(events(spark, [("UPDATE", 2, "4")]))
    early = [f for f in engine.as_of("t", "2024-05-20").inputFiles() if "changed_month=2024-01" in f]
    assert len(early) == 1


def test_lookups_read_a_tenth_of_200_files(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "log"), indexed=True)
    engine.bootstrap()
    kept = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "200")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        rows = spark.range(20_000).select(
            F.lit("UPDATE").alias("operation"), F.expr("timestamp'2024-01-01' + make_dt_interval(0, 0, 0, id % 1000)").alias("changed_at"), F.format_string("o%04d", F.col("id") % 4000).alias("object_id"),
            F.lit("t").alias("table_name"), (F.col("id") % 2000).cast("int").alias("user_id"), F.md5((F.col("id") % 5000).cast("string")).alias("context_id"), F.lit("{}").alias("new_data"),
        )
        engine.append_events(rows)
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    groups = lambda df: sum(pq.ParquetFile(f.removeprefix("file://")).num_row_groups for f in df.inputFiles())
    whole = groups(engine.log)
    assert len(engine.log.inputFiles()) >= 150
    context = engine.log.agg(F.min("context_id")).first()[0]
    for found, all_rows in ((engine.for_object("t", "o0007"), engine.history().for_object("t", "o0007")), (engine.for_user(17), engine.history().for_user(17)), (engine.for_context(context), engine.history().for_context(context))):
        assert groups(found.df) < whole / 10
        assert sorted(r["id"] for r in found.df.collect()) == sorted(r["id"] for r in all_rows.df.collect())
    one = pq.ParquetFile(engine.log.inputFiles()[0].removeprefix("file://"))
    assert one.metadata.num_row_groups == 1
    assert engine.for_object("t", "none").df.count() == 0 and engine.for_user(None).df.count() == 0


def test_index_after_purges_and_later_switch(spark, tmp_path, monkeypatch):
    engine = Engine(spark, str(tmp_path / "log"), admin=True)
    engine.bootstrap()
    engine.append_events(events(spark, [("UPDATE", d, str(d % 5)) for d in range(100)]))
    engine.enable_index()
    Engine(spark, engine.path).append_events(events(spark, [("UPDATE", d, "3") for d in range(0, 100, 9)]))
    engine.purge(datetime(2024, 3, 20), "30 days")
    want = sorted(r["id"] for r in engine.log.where("object_id = '3'").collect())
    assert sorted(r["id"] for r in engine.for_object("t", 3).df.collect()) == want == sorted(r["id"] for r in engine.for_user(3).df.collect())
    monkeypatch.setattr(fileindex, "MOST_FILES", 0)
    assert sorted(r["id"] for r in engine.for_object("t", 3).df.collect()) == want
    engine.vacuum()
    assert engine.for_object("t", 3).df.count() == len(want)


@pytest.mark.parametrize("ranges", [1, 3, 40])
def test_scan_over_ranges(spark, tmp_path, ranges):
    rng = random.Random(ranges)
    rows = [(rng.choice(["a", "a", "a", "b", "c", None]), rng.randrange(50), i, rng.choice([None, None, i])) for i in range(300)]
    df = spark.createDataFrame(rows, "k string, at int, tie int, v int")
    number = iter(range(100))

    def stage(x):
        path = str(tmp_path / f"s{next(number)}")
        x.write.parquet(path)
        return spark.read.schema(x.schema).parquet(path)

    got = {(r["k"], r["tie"]): r["v"] for r in scan.last_before(df, "k", ["at", "tie"], "v", stage, ranges).collect()}
    last, want = {}, {}
    for k, at, tie, v in sorted(rows, key=lambda r: (r[1], r[2])):
        last[k] = v if v is not None else last.get(k)
        want[k, tie] = last[k]
    assert got == want


def test_scan_join_equals_window_join_and_prunes(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "log"))
    engine.bootstrap()
    engine.append_events(events(spark, [("DELETE" if d % 11 == 3 else "UPDATE", d, "1" if d % 3 else str(d % 5)) for d in range(180)]))
    points = spark.createDataFrame([(str(o), START + timedelta(days=d, hours=1)) for o in range(5) for d in range(0, 90, 7)], "object_id string, at timestamp")
    got = scan.as_of_join(points, engine.log, "t", engine._kept, ranges=16)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, timetravel.as_of_join(points, engine.log, "t").collect()))
    # No window has the object alone for its key.
    assert "windowspecdefinition(object_id" not in plan(got)
    nothing = scan.as_of_join(points.limit(0), engine.log, "t", engine._kept)
    assert nothing.count() == 0
