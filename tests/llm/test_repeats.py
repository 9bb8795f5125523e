"""Anchors with more contexts than a shard should hold."""

from collections import Counter

import numpy as np
import pytest

from palimpsest.llm import repeats

SCHEMA = "doc_id bigint, text string"
PHRASE = "terms of service apply to every visitor of it"


@pytest.fixture(scope="module")
def texts():
    """A phrase of 45 bytes between words of which some repeat, so that some passages do too."""
    rng = np.random.default_rng(5)
    word = lambda n: "".join(chr(97 + c) for c in rng.integers(0, 26, n))
    ends = [word(9) for _ in range(12)]
    return [f"{word(40)}{ends[rng.integers(12)]} {PHRASE} {ends[rng.integers(12)]}{word(40)}" for _ in range(300)]


def kept(texts):
    seen, out = set(), []
    for t in texts:
        raw = t.encode()
        windows = [raw[i : i + 50] for i in range(len(raw) - 49)]
        gone = {i + j for i, w in enumerate(windows) if w in seen for j in range(50)}
        seen |= set(windows)
        out.append(bytes(b for i, b in enumerate(raw) if i not in gone))
    return out


def test_common_phrase_is_split(spark, tmp_path, texts, monkeypatch):
    monkeypatch.setattr(repeats, "SHARD_BYTES", 68 * 100)
    out = str(tmp_path / "d")
    spark.createDataFrame(list(enumerate(texts)), SCHEMA).write.parquet(out)
    docs = spark.read.schema(SCHEMA).parquet(out)
    assert len(repeats.split_anchors(repeats._rows(docs, "text", "doc_id"), 100))
    got = [bytes(r["kept"]) for r in repeats.remove_repeats(docs).orderBy("doc_id").collect()]
    assert got == kept(texts) and sum(map(len, got)) < sum(map(len, texts))


def test_no_shard_has_all_contexts_of_an_anchor(texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    at = np.append(0, np.cumsum([len(t) for t in texts]))
    places, hashes = repeats.anchors(data, at)
    spread = repeats.mixed(hashes + repeats.MIX)
    common = np.array([k for k, n in Counter(spread.tolist()).items() if n > 100], np.uint64)
    wanted = [[common.astype("<u4").tobytes()]] * len(texts)

    def largest(split):
        parts = [b for b in repeats._contexts(data, at, np.arange(len(texts)), np.arange(len(texts)), wanted, 64, split)]
        return max(len(r["keys"]) // 8 for b in parts for r in b.to_pylist() if r["shard"] >= 0)

    assert largest(np.zeros(0, np.uint64)) >= 200
    assert largest(common) <= 2 * 19 * len(common) * len(texts) / 64


def test_repeated_and_null_keys(spark, tmp_path):
    """Rows of a key don't cut each other, and each is cut by its own text."""
    one, two = "a passage of well over fifty bytes that stands in several rows", "another passage of well over fifty bytes, in some other rows"
    rows = [(1, one), (1, "x " + one), (2, two), (2, "short"), (2, f"{two} and {one}"), (2, f"{two} and {one}"), (3, one + two), (3, two), (None, one), (None, None), (0, "y " + two)]
    out = str(tmp_path / "d")
    spark.createDataFrame(rows, SCHEMA).repartition(4).write.parquet(out)
    got = sorted(((r["doc_id"], r["n_bytes"], r["n_removed"], bytes(r["kept"])) for r in repeats.remove_repeats(spark.read.schema(SCHEMA).parquet(out)).collect()), key=repr)
    want = []
    for k, t in rows:
        raw = (t or "").encode()
        seen = {u.encode()[i : i + 50] for j, u in rows if u and j is not None and k is not None and j < k for i in range(len(u.encode()) - 49)}
        gone = {i + j for i in range(len(raw) - 49) if raw[i : i + 50] in seen for j in range(50)}
        want.append((k, len(raw), len(gone), bytes(b for i, b in enumerate(raw) if i not in gone)))
    assert got == sorted(want, key=repr)
