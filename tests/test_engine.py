"""Specs, contexts, intervals, the store, the registry, the command line and random histories."""

import asyncio
import json
from datetime import datetime

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import Window, functions as F

from palimpsest import context
from palimpsest.cli import main
from palimpsest.functions.intervals import cutoff, parse_interval
from palimpsest.functions.payload import hmac_hex, json_diff
from palimpsest.identifiers import validate_identifier
from palimpsest.operators import chain
from palimpsest.operators.blame import format_blame
from palimpsest.operators.capture import capture_cdc
from palimpsest.operators.retention import droppable_months
from palimpsest.operators.revert import reverted
from palimpsest.operators.timetravel import Tracked, field_history, sql_table_function, table_as_of
from palimpsest.plans.policy import grant_admin, revoke_writes
from palimpsest.plans.registry import Registry, declared, forget_declared, tracked
from palimpsest.sources.importers import conform
from palimpsest.sources.store import Engine, Locked, discard, read_jdbc, write_jdbc, write_json_lines
from palimpsest.spec import Capture

ROW = "struct<id: bigint, name: string, email: string>"
CHANGES = f"operation string, changed_at timestamp, OLD {ROW}, NEW {ROW}"


def changes(spark, *rows):
    return spark.createDataFrame([(op, datetime.fromisoformat(at), old, new) for op, at, old, new in rows], CHANGES)


def history(spark):
    a, b, c = (1, "a", "e1"), (1, "a", None), (1, "b", "e2")
    return changes(
        spark,
        ("INSERT", "2024-01-01 10:00:00", None, a),
        ("UPDATE", "2024-01-02 10:00:00", a, b),
        ("UPDATE", "2024-02-03 10:00:00", b, b),
        ("UPDATE", "2024-02-04 10:00:00", b, c),
        ("DELETE", "2024-03-05 10:00:00", c, None),
        ("INSERT", "2024-03-06 10:00:00", None, a),
    )


@pytest.mark.parametrize("name", ["", "a b", "1a", "a;", "a\n", "é", None])
def test_bad_identifiers(name):
    with pytest.raises(ValueError):
        validate_identifier(name)


def test_captures():
    one, two = Capture("t", columns=("a", "b")), Capture("t", columns=("a",))
    assert one.plan().checksum == Capture("t", columns=("b", "a")).plan().checksum != two.plan().checksum
    assert two.compared(["a", "b"], "UPDATE") == ["a"] and two.compared(["a", "b"], "DELETE") == ["a", "b"]
    assert Capture("t", without=("a",)).compared(["a", "b"], "DELETE") == ["b"]
    assert "update compares ['a']" in two.plan(["a", "b"]).text and two.plan(["a", "b"]).checksum != two.plan(["a"]).checksum
    for wrong in ({"columns": ()}, {"columns": ("a",), "without": ("b",)}, {"keep": ("a b",)}, {"label": ""}):
        with pytest.raises(ValueError):
            Capture("t", **wrong)


def test_contexts():
    with context.audit_context(source="http", a=1) as outer:
        with context.audit_context(a=2) as inner:
            assert inner.id == outer.id and inner.metadata["a"] == 2
        assert context.current_context().metadata["a"] == 1
        with context.change_reason("x"), context.change_reason("y") as both:
            assert both.metadata["change_reason"] == "x -> y"
    assert context.current_context() is None

    @context.with_context(source="task")
    async def work():
        return context.current_context().metadata["source"]

    assert asyncio.run(work()) == "task"
    with context.request_context({"method": "GET"}) as none:
        assert none is None
    with context.request_context({"method": "POST", "user_id": 3, "session_key": "s"}, secret="k") as c:
        assert c.metadata["user_id"] == 3 and len(c.metadata["session"]) == 16


@pytest.mark.parametrize("text", ["", "forever", "30", "30 fortnights", "days"])
def test_bad_intervals(text):
    with pytest.raises(ValueError):
        parse_interval(text)


def test_intervals():
    assert cutoff(datetime(2025, 4, 14), "6 months") == datetime(2024, 10, 14)
    assert cutoff(datetime(2025, 3, 1), "1 Year") == datetime(2024, 3, 1)
    assert cutoff(datetime(2024, 3, 31), "1 month") == datetime(2024, 2, 29)
    assert droppable_months(["2020-01", "__DEFAULT__", "2024-03"], datetime(2024, 3, 5), "365 days") == ["2020-01"]


def test_capture_and_time_travel(spark):
    log = capture_cdc(history(spark).withColumn("id", F.monotonically_increasing_id()), Capture("users"))
    rows = {r["changed_at"].isoformat()[:10]: r for r in log.collect()}
    assert "2024-02-03" not in rows  # nothing changed, no event
    assert rows["2024-01-02"]["diff"]["email"].asDict() == {"old": "e1", "new": None}
    assert rows["2024-03-05"]["new_data"] is None and json.loads(rows["2024-03-05"]["old_data"])["name"] == "b"
    states = {at: [json.loads(r["data"])["name"] for r in table_as_of(log, "users", at).collect()] for at in ("2023-01-01", "2024-01-01 10:00:00", "2024-02-10", "2024-03-05 12:00:00", "2024-03-07")}
    assert list(states.values()) == [[], ["a"], ["b"], [], ["a"]]
    values = [r["value"] for r in field_history(log, "users", "1", "email").collect()]
    assert values == ["e1", None, "e2", None, "e1"]
    row = Tracked(log, "users").at(1, "2024-02-10")
    assert row.name == row["name"] == "b" and "missing" not in row and Tracked(log, "users").at(9, "2024-02-10") is None
    log.createOrReplaceTempView("audit_view")
    spark.sql(sql_table_function("audit_view", "as_of"))
    assert spark.sql("SELECT * FROM as_of('users', TIMESTAMP '2024-02-10')").count() == 1


def test_json_diff(spark):
    df = spark.createDataFrame([('{"a": 1, "b": null, "x": 1}', '{"a": 1, "b": 2, "c": null}'), ('{"a": 1}', '{"a": 1}')], "o string, n string")
    one, two = df.select(json_diff(F.col("o"), F.col("n")).alias("d")).collect()
    assert {k: v.asDict() for k, v in one["d"].items()} == {"b": {"old": None, "new": "2"}, "c": {"old": None, "new": None}}
    assert two["d"] is None


@settings(max_examples=4, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 3), st.sampled_from(["set", "gone"]), st.sampled_from(["x", "y", None])), min_size=1, max_size=20))
def test_random_histories(spark, steps):
    state, rows, states = {}, [], []
    for k, (key, what, value) in enumerate(steps):
        at = f"2024-01-01 00:00:{k:02d}"
        old = state.get(key)
        new = (key, "n", value) if what == "set" else None
        if old is not None or new is not None:
            rows.append(("INSERT" if old is None else "DELETE" if new is None else "UPDATE", at, old, new))
        state.pop(key, None) if new is None else state.__setitem__(key, new)
        states.append((at, {str(i): v[2] for i, v in state.items()}))
    if not rows:
        return
    log = capture_cdc(changes(spark, *rows).withColumn("id", F.monotonically_increasing_id()), Capture("t")).cache()
    for at, want in states[-1:] + states[len(states) // 2 : len(states) // 2 + 1]:
        assert {r["object_id"]: json.loads(r["data"])["email"] for r in table_as_of(log, "t", at).collect()} == want


def test_store(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "log"), hash_chain=True)
    engine.bootstrap(), engine.bootstrap()
    assert engine.log.count() == 0 and engine.verify()["ok"]
    with context.audit_context(username="alice", user_id=7, change_reason="fix"):
        assert engine.capture(history(spark), Capture("users")) == 5
    assert engine.capture(history(spark).limit(0), Capture("users")) == 0
    assert engine.append_events(spark.createDataFrame([("UPDATE", datetime(2024, 3, 7), "users", "1")], "operation string, changed_at timestamp, table_name string, object_id string")) == 1
    assert [r["id"] for r in engine.log.orderBy("id").collect()] == [1, 2, 3, 4, 5, 6]
    assert engine.months() == ["2024-01", "2024-02", "2024-03"]
    tip = engine.chain_tip()
    assert tip["chain_seq"] == 6 and engine.verify(tip) == {"checked": 6, "ok": True, "n_broken": 0, "broken": []}
    assert chain.verify_summary(engine.log.withColumn("new_data", F.when(F.col("id") == 2, "{}").otherwise(F.col("new_data"))))["broken"] == [(2, "row_hash mismatch")]
    found = engine.blame("users", "1", field="email")
    assert [e["operation"] for e in found.collect()] == ["INSERT", "UPDATE", "UPDATE", "DELETE", "INSERT"]
    assert found.first()["actor"] == "user=7 (alice)" and "fix" in format_blame(found, "users", "1")
    assert "(no events found)" in format_blame(engine.blame("users", "9"), "users", "9")
    lines = list(write_json_lines(engine.as_of("users", "2024-02-10")))
    assert json.loads(json.loads(lines[0])["data"])["name"] == "b"
    assert "PartitionFilters: [isnotnull(changed_month" in engine.as_of("users", "2024-02-10")._jdf.queryExecution().toString()
    assert main(["--log", engine.path, "chain-verify"], spark) == 0 and main(["--log", engine.path, "status"], spark) == 0
    with pytest.raises(PermissionError):
        engine.purge(datetime(2024, 3, 4), "1 month")
    with engine.lock(), pytest.raises(Locked):
        engine.append_events(engine.log.drop("changed_month"))
    admin = Engine(spark, engine.path, admin=True)
    assert admin.purge(datetime(2024, 3, 4), "1 month", dry_run=True) == 2
    assert admin.purge(datetime(2024, 3, 4, 10), "1 month", keep_anchor=True) == 2 and admin.log.count() == 4
    assert admin.verify()["ok"] and admin.manifest()["anchor"]["id"] == 2  # the head is gone, as the anchor says
    assert chain.verify_summary(admin.log)["broken"] == [(3, "prev_hash mismatch")]
    assert admin.drop_old_months(datetime(2024, 3, 6), "5 days") == ["2024-02"] and admin.verify()["ok"]


def test_revert(spark):
    log = capture_cdc(history(spark).withColumn("id", F.lit(1)), Capture("users")).withColumn("id", F.row_number().over(__import__("pyspark").sql.Window.orderBy("changed_at")))
    target = spark.createDataFrame([(1, "z", "z"), (2, "k", "k")], "id bigint, name string, email string")
    assert [tuple(r) for r in reverted(target, log, 1, 3).orderBy("id").collect()] == [(1, "a", None), (2, "k", "k")]
    with pytest.raises(ValueError):
        reverted(target, log, 1, 1)


def test_registry(spark, tmp_path):
    registry = Registry(Engine(spark, str(tmp_path / "log")))
    one, two = Capture("a"), Capture("b")
    assert registry.state(one) == "missing" and registry.apply([one, two])["install"] == [one.name, two.name]
    assert registry.apply([one, two])["keep"] == [one.name, two.name] and not registry.install(one) and registry.install(one, force=True)
    changed = Capture("a", without=("p",))
    assert registry.state(changed) == "stale"
    assert [(r["name"], r["action"]) for r in registry.pending([changed], prune=True).orderBy("name").collect()] == [(one.name, "update"), (two.name, "remove")]
    done = registry.apply([changed], prune=True)
    assert done["update"] == [one.name] and done["remove"] == [two.name] and registry.installed.count() == 1
    assert registry.remove(one.name) and not registry.remove(one.name) and registry.installed.count() == 0
    forget_declared()

    @tracked("things", without=("secret",))
    class Things:
        pass

    assert declared()[0].table == "things" and Things.__capture__ in declared("th") and not declared("x")
    assert revoke_writes("log", "app")[0].startswith("REVOKE INSERT") and grant_admin("log", "dba")[0].startswith("GRANT SELECT")


def numbered(spark, n):
    """Many events, a third of them at one moment and of one object."""
    hot = F.col("id") % 3 == 0
    moment = F.when(hot, F.lit("2024-01-05 00:00:00").cast("timestamp")).otherwise(F.timestamp_seconds(F.col("id") % 5000 + 1_704_067_200))
    return spark.range(n).select(F.lit("UPDATE").alias("operation"), moment.alias("changed_at"), F.lit("t").alias("table_name"), F.when(hot, "0").otherwise(F.col("id").cast("string")).alias("object_id"), F.col("id").cast("string").alias("new_data"))


def test_ids_of_a_large_batch(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "log"))
    engine.bootstrap()
    assert engine.append_events(numbered(spark, 600_000)) == 600_000 and engine.append_events(numbered(spark, 10)) == 10
    assert tuple(engine.log.agg(F.count("*"), F.count_distinct("id"), F.min("id"), F.max("id"), F.count_distinct("new_data")).first()) == (600_010, 600_010, 1, 600_010, 600_000)
    order = Window.partitionBy(F.floor(F.col("id") / 1_000_000)).orderBy("id")
    assert engine.log.where("id <= 600000").withColumn("was", F.lag("changed_at").over(order)).where("was > changed_at").count() == 0


def test_crash_leaves_the_log_as_it_was(spark, tmp_path, monkeypatch):
    engine = Engine(spark, str(tmp_path / "log"), admin=True, hash_chain=True)
    engine.bootstrap()
    engine.append_events(numbered(spark, 20))

    def crash(*_, **__):
        raise RuntimeError("power")

    monkeypatch.setattr(Engine, "_commit", crash)
    for act in (lambda: engine.append_events(numbered(spark, 5)), lambda: engine.purge(datetime(2024, 1, 6), "1 day")):
        with pytest.raises(RuntimeError):
            act()
        assert engine.log.count() == 20 and engine.verify()["ok"]
    monkeypatch.undo()
    assert engine.vacuum() > 0 and engine.append_events(numbered(spark, 5)) == 5
    assert engine.log.agg(F.max("id")).first()[0] == 25 and engine.verify()["ok"]


def test_old_lock_is_taken_over(spark, tmp_path, monkeypatch):
    engine = Engine(spark, str(tmp_path / "log"))
    engine.bootstrap()
    engine._put("_writer.lock", json.dumps({"owner": "gone", "until": 1.0}))
    assert engine.append_events(numbered(spark, 3)) == 3
    engine._put("_writer.lock", json.dumps({"owner": "here", "until": 1e12}))
    with pytest.raises(Locked):
        engine.append_events(numbered(spark, 3))


def test_moments_with_an_offset(spark):
    from datetime import timedelta, timezone

    from palimpsest.plans.months import since, until, with_month

    log = with_month(spark.createDataFrame([("2024-01-31T23:30:00Z",), ("2024-02-01T00:30:00Z",)], "t string").select(F.col("t").cast("timestamp").alias("changed_at")))
    at = datetime(2024, 2, 1, 1, 0, tzinfo=timezone(timedelta(hours=1)))  # midnight in UTC
    assert [r["changed_month"] for r in log.where(until(log, at)).collect()] == ["2024-01"]
    assert [r["changed_month"] for r in log.where(since(log, at)).collect()] == ["2024-02"]
    assert log.where(until(log, "2024-02-01T01:31:00+01:00")).count() == 2


def test_jdbc_round_trip(spark, tmp_path):
    """An embedded database, where Spark brings one."""
    url = f"jdbc:derby:{tmp_path / 'db'};create=true"
    rows = spark.range(10).select("id", F.create_map(F.lit("a"), F.col("id")).alias("m"))
    try:
        write_jdbc(rows, url, "t", driver="org.apache.derby.jdbc.EmbeddedDriver", createTableColumnTypes="m VARCHAR(100)")
    except Exception as why:
        if "ClassNotFound" in str(why):
            pytest.skip("no embedded database")
        raise
    back = read_jdbc(spark, url, "t", "id", (0, 10), 2, driver="org.apache.derby.jdbc.EmbeddedDriver")
    assert sorted((r["id"], json.loads(r["m"])["a"]) for r in back.collect()) == [(k, k) for k in range(10)] and back.rdd.getNumPartitions() == 2


def test_command_line(spark, tmp_path, capsys):
    log, out = str(tmp_path / "log"), str(tmp_path / "plan.txt")
    run = lambda *a: main(["--log", log, *a], spark)
    assert run("init") == 0 and run("plan", "users", "--exclude", "password", "--output", out) == 0
    assert "except ['password']" in open(out).read()
    assert run("chain-enable") == 0
    engine = Engine(spark, log)
    with context.audit_context(username="bob"):
        engine.capture(history(spark), Capture("users"))
    assert run("chain-verify") == 0 and run("blame", "users", "1", "--format", "json") == 0
    entries_ = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    assert [e["operation"] for e in entries_] == ["INSERT", "UPDATE", "UPDATE", "DELETE", "INSERT"] and entries_[0]["metadata"]["username"] == "bob"
    assert run("as-of", "users", "2024-02-10", "--limit", "1") == 0 and '"name' in capsys.readouterr().out
    assert run("purge", "1 month", "--dry-run") == 0
    with pytest.raises(PermissionError):
        run("purge", "1 month")
    assert run("purge", "1 month", "--admin") == 0 and engine.log.count() == 0 and engine.verify()["ok"]
    assert run("partitions", "--months", "1") == 0 and run("policy", "app") == 0 and run("status") == 0


def test_rest_of_the_store(spark, tmp_path):
    discard(spark.range(3))
    log = capture_cdc(history(spark).withColumn("id", F.monotonically_increasing_id()), Capture("users"))
    rows = list(Tracked(log, "users").state_as_of("2024-02-10"))

    now = list(Tracked(log, "users").state_as_of("2024-02-10", "name string, added string"))
    assert [r.name for r in rows] == ["b"] == [r.name for r in now] and rows[0].object_id == "1" and now[0].added is None
    assert context.open_trace() == {}
    with context.job_context("nightly") as c:
        assert c.metadata == {"source": "job", "job": "nightly"}
    key = spark.createDataFrame([("s",)], "s string").select(F.substring(hmac_hex("k", F.col("s")), 1, 16)).first()[0]
    assert key == context.pseudonymous_session("s", "k")


def test_conform_rejects(spark):
    with pytest.raises(ValueError):
        conform(spark.createDataFrame([(1,)], "operation int"))


def test_core_stands_alone():
    import ast
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent / "palimpsest"
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            names = [n.module or "" for n in ast.walk(ast.parse(p.read_text())) if isinstance(n, ast.ImportFrom)]
            assert not any("llm" in n for n in names), p
