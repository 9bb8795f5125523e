"""Merged batches, the feed of commits, older formats, and the command line of all that."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palimpsest.cli import main
from palimpsest.schema import CONTEXT
from palimpsest.sources import feed
from palimpsest.sources.folders import drop_folders, fresh_folder
from palimpsest.sources.store import Engine, commit_of

EVENT = "operation string, changed_at timestamp, object_id string, table_name string, new_data string, meta map<string, string>"
START = datetime(2024, 1, 1)


def events(spark, *days):
    return spark.createDataFrame([("UPDATE", START + timedelta(days=d), str(d % 3), "t", f'{{"d": {d}}}', {"day": str(d)}) for d in days], EVENT)


def rows(df):
    return sorted((r["id"], r["meta"]["day"]) for r in df.collect())


def test_merge_keeps_everything(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "log"), admin=True, hash_chain=True, history_tree=True, indexed=True)
    engine.bootstrap()
    for k in range(4):
        engine.append_events(events(spark, k, 40 - k, 33))
    before, noted = rows(engine.log), engine.tree_root()
    assert engine.merge_batches(at_least=9) == [] and engine.merge_batches(at_least=2) == ["2024-01", "2024-02"]
    assert rows(engine.log) == before and len(engine.manifest()["parts"]) == 2
    assert engine.verify()["ok"] and engine.verify_tree(noted).count() == 0
    assert rows(engine.for_object("t", "1").df) == [x for x in before if int(x[1]) % 3 == 1]
    with engine.lock():
        pass
    assert engine.purge(datetime(2024, 2, 10), "5 days", keep_anchor=True) == 8 and engine.verify()["ok"] and engine.verify_tree(noted).count() == 0


def test_side_tables_are_merged(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "log"), admin=True, history_tree=True, indexed=True)
    engine.bootstrap()
    for k in range(3):
        engine.append_events(events(spark, k, 40 + k), contexts=spark.createDataFrame([("c", f'{{"k": {k}}}')], "id string, metadata string"))
    noted, found, contexts = engine.tree_root(2), rows(engine.for_object("t", 1).df), engine.contexts.collect()
    assert engine.merge_side_tables(at_least=4) == [] and engine.merge_side_tables(at_least=3) == ["contexts", "index", "tree_nodes"]
    now = engine.manifest()
    assert len(now["contexts"]) == len(now["tree_nodes"]) == len(now["index"]) == 1 and len(engine._names("tree")) == 1
    engine.append_events(events(spark, 5))
    assert engine.verify_tree(noted).count() == 0 and engine.contexts.collect() == contexts
    assert rows(engine.for_object("t", 1).df) == found and rows(engine.for_object("t", 2).df)[-1][1] == "5"
    assert engine.vacuum() == 0


def test_feed_gives_each_commit_once(spark, tmp_path):
    """Also after a purge has written a month anew, and after older batches were merged."""
    engine = Engine(spark, str(tmp_path / "log"), admin=True)
    engine.bootstrap()
    feed.register(spark)
    read = lambda since, **more: spark.read.format(feed.NAME).options(path=engine.path, since=since, **more).load()
    assert read(0).count() == 0
    for k in range(3):
        engine.append_events(events(spark, k, 40 + k))
    found = {(r["commit"], r["meta"]["day"]) for r in read(0).collect()}
    assert found == {(k + 1, str(d)) for k in range(3) for d in (k, 40 + k)}
    assert {r["commit"] for r in read(1, until=2).collect()} == {2}
    engine.purge(datetime(2024, 1, 12), "10 days")
    assert {(r["commit"], r["meta"]["day"]) for r in read(0).collect()} == {x for x in found if int(x[1]) >= 1}
    assert read(2).select("id").count() == 2
    engine.merge_batches(until_commit=2, at_least=2)
    assert {r["commit"] for r in read(2).where("commit = 3").collect()} == {3} and read(2).count() == 2
    filtered = read(0).where((F.col("changed_month") == "2024-02") & (F.col("object_id") == "1"))
    assert sorted(r["meta"]["day"] for r in filtered.collect()) == [str(d) for d in (40, 41, 42) if d % 3 == 1]
    one = read(0).orderBy("changed_at").first()
    assert one["changed_at"] == START + timedelta(days=1) and json.loads(one["new_data"]) == {"d": 1} and one["old_data"] is None


def test_filters_choose_files(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "log"))
    engine.bootstrap()
    engine.append_events(events(spark, 1, 40, 70))
    wanted = feed.Wanted()
    assert not wanted.take(feed.EqualTo(("new_data",), "x")) and wanted.take(feed.GreaterThanOrEqual(("changed_month",), "2024-02")) and wanted.take(feed.EqualTo(("object_id",), "1"))
    files = feed._Commits(engine.path).files(0, 9, wanted)
    assert {f.month for f in files} == {"2024-02", "2024-03"} and {f.commit for f in files} == {1}
    assert sum(b.num_rows for f in files for b in feed._Commits(engine.path).rows(f, wanted)) == 2


def test_contexts_of_format_2(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "log"))
    engine.bootstrap()
    engine.append_events(events(spark, 1))
    old = spark.createDataFrame([("c", '{"a":1}', START, 4)], CONTEXT)
    old.write.mode("append").parquet(f"{engine.path}/contexts")
    engine._put("_version.json", '{"format": 2}')
    assert engine.contexts.count() == 0
    assert engine.upgrade() == ["contexts", "tables"] and engine.version() == 3
    engine.write_contexts(spark.createDataFrame([("c", '{"a":2}')], "id string, metadata string"))
    found = engine.contexts.collect()
    assert [(r["id"], r["metadata"], r["created_at"]) for r in found] == [("c", '{"a":2}', START)] and engine.context_versions.agg(F.max("seq")).first()[0] == 5
    assert commit_of("format1") == 0 and commit_of("000000000012-ab") == 12 and commit_of("ab-cd") == 0


def test_command_line(spark, tmp_path, capsys):
    path = str(tmp_path / "log")
    run = lambda *args: main(["--log", path, *args], spark)
    assert run("tree-enable") == 0 and run("index-enable") == 0
    engine = Engine(spark, path)
    for k in range(2):
        engine.append_events(events(spark, k, 40))
    capsys.readouterr()
    assert run("tree-root") == 0
    noted = capsys.readouterr().out.strip()
    assert json.loads(noted)["size"] == 4
    assert run("keyframe", "t", "2024-02") == 0 and run("merge", "--at-least", "2") == 0 and run("tree-verify", "--root", noted) == 0
    assert run("tree-verify", "--root", json.dumps({"size": 3, "root": "0"})) == 1
    assert "root differs" in capsys.readouterr().out
    assert len(engine.manifest()["keyframes"]) == 1 and run("as-of", "t", "2024-03-01") == 0


def test_folders_can_be_dropped(spark):
    drop_folders(spark)
    paths = [fresh_folder(spark, "x") for _ in range(3)]
    for p in paths:
        spark.range(2).write.parquet(p)
    assert drop_folders(spark, keep=1) == 2 and spark.read.parquet(paths[2]).count() == 2
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        spark.read.parquet(paths[0])
