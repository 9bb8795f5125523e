"""The history tree and the gaps of a chain: a plain tree, random purges, edits that must be found."""

import hashlib
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import chain, tree
from palimpsest.sources.store import Engine

EVENT = "operation string, changed_at timestamp, object_id string, table_name string, new_data string"


def events(spark, moments):
    return spark.createDataFrame([("INSERT", m, str(i), "t", f'{{"id":{i}}}') for i, m in enumerate(moments)], EVENT)


def plain(hashes):
    """All whole nodes above some leaves, one by one."""
    found, level, row = {}, 0, list(hashes)
    while row:
        found |= {(level, i): h for i, h in enumerate(row)}
        row = [hashlib.sha256(tree.NODE + a + b).digest() for a, b in zip(row[::2], row[1::2])]
        level += 1
    return found


@pytest.mark.parametrize("cuts", [[0], [1], [5, 3, 9], [16, 1, 1, 30], [8, 8], [1] * 6])
def test_nodes_in_several_commits(spark, cuts, monkeypatch):
    monkeypatch.setattr(tree, "BLOCK_LEVELS", 16)
    hashes = [hashlib.sha256(str(i).encode()).digest() for i in range(sum(cuts))]
    nodes, peaks, size = {}, [], 0
    for n in cuts:
        new = spark.createDataFrame([(0, size + i, hashes[size + i]) for i in range(n)], tree.NODES)
        size += n
        added = tree.grown(new, size, peaks).cache()
        nodes |= {(r["level"], r["place"]): bytes(r["hash"]) for r in added.collect()}
        peaks = tree.peaks_at(added, size, peaks)
    assert nodes == plain(hashes)
    assert [(a, b) for a, b, _ in peaks] == tree.peaks_of(size) and all(bytes.fromhex(h) == nodes[a, b] for a, b, h in peaks)


def test_levels_beyond_one_block(spark):
    """Two rounds: nodes above level 16, whose leaves come in two commits."""
    n = (1 << 17) + 3
    rows = spark.range(n).select(F.lit(0).alias("level"), F.col("id").alias("place"), F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("hash"))
    first = tree.grown(rows.where("place < 70001"), 70_001).cache()
    peaks = tree.peaks_at(first, 70_001)
    second = tree.grown(rows.where("place >= 70001"), n, peaks).cache()
    want = plain([hashlib.sha256(str(i).encode()).digest() for i in range(n)])
    assert first.count() + second.count() == len(want)
    for level, place, h in tree.peaks_at(first.unionByName(second), n):
        assert bytes.fromhex(h) == want[level, place]


def reasons(df):
    return sorted((r["id"], r["reason"]) for r in df.collect())


def test_random_purges_of_interleaved_batches(spark, tmp_path):
    rng = random.Random(3)
    engine = Engine(spark, str(tmp_path / "log"), admin=True, hash_chain=True, history_tree=True)
    engine.bootstrap()
    start = datetime(2024, 1, 1)
    for _ in range(3):
        engine.append_events(events(spark, [start + timedelta(days=rng.randrange(200)) for _ in range(rng.randrange(1, 25))]))
    noted = engine.tree_root()
    for day in (60, 61, 130):
        engine.purge(start + timedelta(days=day + 30), "30 days", keep_anchor=True)
        assert engine.verify()["ok"], engine.verify()
        assert reasons(engine.verify_tree(noted)) == []
    left = {r["id"] for r in engine.log.select("id").collect()}
    assert left and len(left) < noted["size"]
    engine.append_events(events(spark, [start, start + timedelta(days=190)]))
    assert engine.verify()["ok"] and reasons(engine.verify_tree(noted)) == []
    # What is left is still guarded, beside the gaps as elsewhere.
    now = engine.manifest()
    one = min(left)
    state, gaps = now["tree"], engine._parts("gaps", now["gaps"], chain.GAP)
    edited = engine.log.withColumn("new_data", F.when(F.col("id") == one, "{}").otherwise(F.col("new_data")))
    gone = engine._parts("tree_gone", now["tree_gone"], "id bigint")
    check = lambda log: reasons(tree.verify(log, engine.tree_nodes, state["first"], state["size"], engine.tree_root()["root"], gone))
    assert check(edited) == [(one, "row differs from its leaf")]
    assert check(engine.log.where(F.col("id") != one)) == [(one, "row is missing")]
    assert (one, "row_hash mismatch") in reasons(chain.verify(edited, left=gaps))
    assert reasons(chain.verify(engine.log.where(F.col("id") != one), left=gaps))


def test_edited_nodes_and_roots_are_found(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "log"), history_tree=True)
    engine.bootstrap()
    assert engine.tree_root()["size"] == 0 and reasons(engine.verify_tree()) == []
    engine.append_events(events(spark, [datetime(2024, 1, 1)] * 11))
    state = engine.manifest()["tree"]
    other = engine.tree_nodes.withColumn("hash", F.when(F.expr("level = 1 and place = 2"), F.unhex(F.lit("00" * 32))).otherwise(F.col("hash")))
    found = reasons(tree.verify(engine.log, other, state["first"], state["size"], engine.tree_root()["root"]))
    assert found == [(5, "node differs from those below")]
    assert reasons(engine.verify_tree({"size": 4, "root": "0" * 64})) == [(4, "root differs from the noted one")]
    assert reasons(engine.verify_tree({"size": 40, "root": "0" * 64})) == [(40, "root differs from the noted one")]
    proofs = tree.inclusion(engine.tree_nodes, 11, spark.range(-1, 12).select(F.col("id").alias("place")))
    got = {r["place"]: r["ok"] for r in proofs.select("place", tree.proven(state["peaks"]).alias("ok")).collect()}
    assert got == dict.fromkeys(range(11), True)
    wrong = proofs.withColumn("hash", F.unhex(F.lit("11" * 32))).select(tree.proven(state["peaks"]).alias("ok"))
    assert not any(r["ok"] for r in wrong.collect())


@pytest.mark.parametrize("levels", [16, 2])
def test_proofs_meet_their_nodes_by_block(spark, levels, monkeypatch):
    """All paths of a log, those above a block too, from a plan that sends no table to the driver."""
    monkeypatch.setattr(tree, "BLOCK_LEVELS", levels)
    monkeypatch.setattr(tree, "PROOF_ROWS", 3)
    n = 45
    want = plain([hashlib.sha256(str(i).encode()).digest() for i in range(n)])
    gone = (1, 3)
    nodes = spark.createDataFrame([(level, place, h) for (level, place), h in want.items() if (level, place) != gone], tree.NODES)
    proofs = tree.inclusion(nodes, n, spark.range(n).select(F.col("id").alias("place")))
    assert "Broadcast" not in proofs._jdf.queryExecution().executedPlan().toString()
    got = {r["place"]: r for r in proofs.collect()}
    assert set(got) == set(range(n))
    for place, r in got.items():
        assert (r["peak"], r["place"] >> r["peak"]) in tree.peaks_of(n) and bytes(r["hash"]) == want[0, place]
        path = [(level, (place >> level) ^ 1) for level in range(r["peak"])]
        assert [(s["level"], bytes(s["hash"]), s["is_left"]) for s in r["path"]] == [(level, want[level, p], p % 2 == 0) for level, p in path if (level, p) != gone]


def test_purge_reads_no_later_month(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "log"), admin=True)
    engine.bootstrap()
    engine.append_events(events(spark, [datetime(2024, m, 5) for m in range(1, 10)]))
    plan = engine._before(engine.manifest(), datetime(2024, 3, 1))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(changed_month" in plan and "2024-09" not in plan
    assert engine.purge(datetime(2024, 3, 1), "1 day", dry_run=True) == 2


def test_context_is_committed_with_its_events(spark, tmp_path):
    """A crash before the commit leaves neither; after it both are there."""
    from palimpsest import context
    from palimpsest.spec import Capture

    row = "struct<id: bigint, name: string>"
    changes = spark.createDataFrame([("INSERT", datetime(2024, 1, 1), None, (1, "a"))], f"operation string, changed_at timestamp, OLD {row}, NEW {row}")
    engine = Engine(spark, str(tmp_path / "log"))
    engine.bootstrap()
    with context.audit_context(source="job") as own:
        commit, engine._commit = engine._commit, None
        with pytest.raises(TypeError):
            engine.capture(changes, Capture("users"))
        assert engine.log.count() == 0 and engine.contexts.count() == 0
        engine._commit = commit
        assert engine.capture(changes, Capture("users")) == 1
    assert [r["id"] for r in engine.contexts.collect()] == [own.id]
    assert engine.manifest()["number"] == 1
