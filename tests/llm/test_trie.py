"""The trie of conversations against a plain one."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from palimpsest.llm import trie

SCHEMA = "conv_id bigint, turn bigint, role string, text string, digest string, depth int"


def plain(rows):
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            own[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(r, x) for *_, r, x in sorted(turns)] for c, turns in own.items()}
    whole = {}
    for c, turns in own.items():
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(turns) if base == c else tuple(own.get(base, [])[:h] + turns[h:])
    members = defaultdict(set)
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].add(c)
    out = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = sum(len(n) == len(node) + 1 for n in below)
        leaves = sum(not any(len(m) > len(n) and m[: len(n)] == n for m in below) for n in below)
        saved = sum((len(members[n]) - 1) * (len(n[-1][1].encode()) if n else 0) for n in below)
        ends = ",".join(str(c) for c in sorted(c for c in convs if len(whole[c]) == len(node)))
        out.append((min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), children, leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(spark, tmp_path, rows, parts=4):
    spark.createDataFrame([(*r, "d", 0) for r in rows], SCHEMA).repartition(parts).write.parquet(str(tmp_path / "c"))
    nodes = trie.prefix_trie(spark.read.schema(SCHEMA).parquet(str(tmp_path / "c")))
    names = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    return sorted((tuple(r[n] for n in names) for r in nodes.collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_random_conversations(spark, tmp_path, monkeypatch, seed):
    monkeypatch.setattr(trie, "PIECE", 3)
    rng = random.Random(seed)
    rows = []
    for c in {rng.randrange(-20, 80) for _ in range(70)}:
        for t in rng.sample([None, *range(14)], rng.randrange(1, 14)):
            rows.append((c, t, rng.choice(["user", "bot", None]), rng.choice(["a", "bé", "", None])))
    assert found(spark, tmp_path, rows) == plain(rows)


def test_defined_cases(spark, tmp_path):
    rows = [
        (None, 1, "u", "lost"), (5, None, None, None), (5, None, None, None), (5, 3, "u", "x"), (5, 3, "a", "x"), (5, 3, "u", "w"),
        (1, 0, "u", "no first of the five"), (7, 0, "u", "x"), (7, 0, "u", "x"), (10, 1, "u", "long" * 100_000), (11, 1, "u", "long" * 100_000), (12, 1, "ulon", "g"),
    ]
    assert found(spark, tmp_path, rows) == plain(rows)


def test_one_long_conversation_and_many_copies(spark, tmp_path):
    rows = [(0, t, "u", f"turn {t % 7}") for t in range(600)] + [(k * 5, 0, "u", "same") for k in range(1, 300)]
    got = found(spark, tmp_path, rows)
    assert len(got) == 602
    root, same = (next(r for r in got if r[1] == d and r[3] == n) for d, n in ((0, 300), (1, 299)))
    assert root[4:7] == (2, 2, 298 * 4) and same[4:7] == (0, 1, 298 * 4)
    assert same[7] == hashlib.sha256(",".join(str(k * 5) for k in range(1, 300)).encode()).hexdigest()


def test_empty_table(spark, tmp_path):
    assert found(spark, tmp_path, [], 1) == [] == found(spark, tmp_path / "n", [(None, 1, "u", "x")], 1)
