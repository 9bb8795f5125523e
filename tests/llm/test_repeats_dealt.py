"""Contexts of many steps are dealt together, and a shard is indexed in parts."""

import numpy as np
import pyarrow as pa
import pytest

from palimpsest.llm import repeats


@pytest.fixture(scope="module")
def texts():
    """Passages of 80 bytes that several texts have, whole or in part, and many variants of each."""
    rng = np.random.default_rng(11)
    word = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    shared = [word(80) for _ in range(40)]
    cut = lambda: (p := shared[rng.integers(40)])[rng.integers(20) : 80 - rng.integers(20)]
    return [f"{word(rng.integers(30))}{cut()}{word(rng.integers(30))}{cut()}" for _ in range(240)]


def dealt(texts, step, shards, apart=False):
    """Rows for shards, of steps of so many texts."""
    waiting, out = [], []
    for a in range(0, len(texts), step):
        raw = [t.encode() for t in texts[a : a + step]]
        data, at = np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(t) for t in raw]))
        places, hashes = repeats.anchors(data, at)
        spread, bounds = repeats.mixed(hashes + repeats.MIX).astype("<u4"), np.searchsorted(places, at)
        wanted = [[spread[x:y].tobytes()] for x, y in zip(bounds, bounds[1:])]
        keys = np.arange(a, a + len(raw))
        more = () if apart else (waiting, repeats.GATHERED)
        out += repeats._contexts(data, at, keys, keys, wanted, shards, np.zeros(0, np.uint64), *more)
    if not apart:
        out += repeats._by_shard(waiting, shards)
    return pa.Table.from_batches(out)


def removed(table):
    gone = set()
    for shard in sorted(set(table.column("shard").to_pylist())):
        found = repeats._index_shard(table.filter(pa.compute.equal(table.column("shard"), shard)))
        for key, marks in zip(found.column("key").to_pylist(), found.column("marks").to_pylist()):
            gone |= {(key, i) for a, b in np.frombuffer(marks, "<i8").reshape(-1, 2).tolist() for i in range(a, b)}
    return gone


def wanted(texts):
    seen, gone = set(), set()
    for k, t in enumerate(texts):
        windows = [t[i : i + 50] for i in range(len(t) - 49)]
        gone |= {(k, i + j) for i, w in enumerate(windows) if w in seen for j in range(50)}
        seen |= set(windows)
    return gone


def test_rows_do_not_grow_with_steps_times_shards(texts):
    """Before, each of 60 steps made a row for nearly each of 16 shards."""
    rows = dealt(texts, 4, 16).column("shard").to_pylist()
    assert sum(s >= 0 for s in rows) <= 16
    assert sum(s >= 0 for s in dealt(texts, 4, 16, apart=True).column("shard").to_pylist()) > 300


@pytest.mark.parametrize("part", [200, 3000, 1 << 20])
def test_parts_of_a_shard_find_the_same(texts, part, monkeypatch):
    monkeypatch.setattr(repeats, "INDEX_BYTES", part)
    got = removed(dealt(texts, 7, 3))
    assert got == wanted(texts) and got


@pytest.mark.parametrize("enough", [0, 100])
def test_contexts_that_are_dealt_in_between(texts, enough, monkeypatch):
    monkeypatch.setattr(repeats, "GATHERED", enough)
    assert removed(dealt(texts, 7, 3)) == wanted(texts)


@pytest.mark.parametrize("block", [64, 97, 1 << 20])
def test_anchors_over_blocks(texts, block, monkeypatch):
    data, at = np.frombuffer("".join(texts).encode(), np.uint8), np.append(0, np.cumsum([len(t) for t in texts]))
    want = [x.tolist() for x in repeats.anchors(data, at)]
    monkeypatch.setattr(repeats, "BLOCK", block)
    assert [x.tolist() for x in repeats.anchors(data, at)] == want and want[0]
