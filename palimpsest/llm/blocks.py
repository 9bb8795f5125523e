"""Dedup of word passages by fixed-block anchors.

Every document is a reference for those of larger keys. Its text is cut into blocks of
``block_words`` words that don't overlap, so short that every window of ``window`` words holds one
whole block of its own document, wherever the window starts. These blocks are the index. All
documents probe it with each of their rolling blocks, in fragments of the blocks' hash order: a
block of the index that another document has too, at any place, is a hit for both.

A hit is extended to either side by the words that a window still lacks, in all divisions of them
over the two sides. Extensions meet by 96 bits of hash, and the smallest key that has one is its
source; words under an extension with a smaller source are repeated. Extensions that overlap or
touch join to maximal repeats, which is what is removed. Text without a hit is never extended.

Equal extensions of one map step count once, by their first document: the others are known to be
repeated. Equal texts are recognised first and all but the first go as a whole. So what a hot
passage sends on is one entry for each step of 2 MB, not one for each document.

Defined results: a null text has no words; texts of fewer words than a window keep all; longer
ones of any size are judged whole; rows of an equal key don't remove from each other, and each is
judged by itself against rows of smaller keys; rows with a null key take no part and keep all;
extra columns are ignored; an empty table gives an empty table. The input must be a scan that
repeats.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import MIX, NOT_SPACE, byte_slices, join_counted, map_arrow, mixed, span_hashes, string_buffers, token_spans, written
from .fragments import DEALT, STEP_BYTES, deal, fragments_for, shared_values, text_bytes

WINDOW_WORDS = 13
#: About so many bytes of text make a word; bytes of text for a shard of extensions.
BYTES_PER_WORD, SHARD_BYTES = 6, 4 << 20
#: One odd factor for each word of a block or window, from two streams.
_FACTORS = mixed(np.arange(1, 1 << 11, dtype=np.uint64) * MIX) | np.uint64(1)
_OTHERS = mixed(_FACTORS) | np.uint64(1)


def block_words(window: int) -> int:
    """The longest block of which every window holds a whole one."""
    return (window + 1) // 2


def _rolling(hashes: np.ndarray, width: int, factors: np.ndarray) -> np.ndarray:
    """A hash of every ``width`` words in turn, across documents as well."""
    n = max(0, len(hashes) - width + 1)
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total += hashes[j : j + n] * factors[j]
    return mixed(total)


def _words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words, the first word of each text, and each word's text."""
    data, at = string_buffers(column)
    starts, ends, first = token_spans(data, at, NOT_SPACE)
    return span_hashes(data, starts, ends), first, np.repeat(np.arange(len(at) - 1), np.diff(first))


def _block_values(hashes: np.ndarray, first: np.ndarray, doc: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of rolling blocks in texts of at least a window, and their values; the lowest bit
    says whether the block is one of the index."""
    width = block_words(window)
    place = np.arange(len(hashes))
    whole = (place + width <= first[1:][doc]) & (np.diff(first)[doc] >= window)
    place = place[whole]
    values = _rolling(hashes, width, _FACTORS)[place] & ~np.uint64(1)
    return place, values | ((place - first[doc[place]]) % width == 0).astype(np.uint64)


def _distinct(values: np.ndarray, doc: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of each text, marked if any of them is, and their bounds."""
    order = np.lexsort((values, doc))
    values, doc = values[order], doc[order]
    last = np.ones(len(values), bool)
    last[:-1] = (values[1:] >> np.uint64(1) != values[:-1] >> np.uint64(1)) | (doc[1:] != doc[:-1])
    return values[last], np.searchsorted(doc[last], np.arange(texts + 1))


def merged_ranges(key: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Table:
    """Ranges of each row, joined where they overlap or touch, as packed 64-bit numbers."""
    kinds = pa.schema([("key", pa.int64()), ("row", pa.int64()), ("marks", pa.binary())])
    if not len(key):
        return kinds.empty_table()
    order = np.lexsort((start, row, key))
    key, row, start, end = key[order], row[order], start[order].astype(np.int64), end[order].astype(np.int64)
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    base = (np.cumsum(fresh) - 1) << 40
    reach = np.maximum.accumulate(base + end)
    opens = np.append(True, (base + start)[1:] > reach[:-1])
    at = np.flatnonzero(opens)
    pair = np.column_stack([start[at], (reach - base)[np.append(at[1:], len(key)) - 1]]).astype("<i8")
    heads = np.flatnonzero(fresh[at])
    packed = [pair[a:b].tobytes() for a, b in zip(heads.tolist(), [*heads[1:].tolist(), len(pair)])]
    return pa.table([pa.array(key[at[heads]]), pa.array(row[at[heads]]), pa.array(packed, pa.binary())], schema=kinds)


MARKS = "bucket bigint, keys binary, rows binary, many binary, marks binary"


def _by_bucket(found: pa.Table, buckets: int) -> pa.Table:
    """Rows of ``merged_ranges`` together by a hash of their row."""
    keys, rows = found.column("key").to_numpy(), found.column("row").to_numpy()
    bucket = ((mixed(rows.view(np.uint64)) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    marks = found.column("marks").to_pylist()
    cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1))
    packed = {c: [] for c in ("keys", "rows", "many", "marks")}
    for own in np.split(order, cuts[1:]) if len(cuts) else ():
        packed["keys"].append(keys[own].astype("<i8").tobytes())
        packed["rows"].append(rows[own].astype("<i8").tobytes())
        packed["many"].append(np.array([len(marks[k]) // 16 for k in own.tolist()], "<u4").tobytes())
        packed["marks"].append(b"".join([marks[k] for k in own.tolist()]))
    return pa.table([pa.array(bucket[order][cuts]), *(pa.array(v, pa.binary()) for v in packed.values())], names=["bucket", *packed])


def _together(table: pa.Table) -> pa.Table:
    """For ``applyInArrow`` by bucket: the ranges of each row, from all shards."""
    whole = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
    many = whole("many", "<u4")
    ranges = whole("marks", "<i8").reshape(-1, 2)
    return merged_ranges(np.repeat(whole("keys", "<i8"), many), np.repeat(whole("rows", "<i8"), many), ranges[:, 0], ranges[:, 1])


EXTENSIONS = "shard bigint, keys binary, rows binary, owner binary, starts binary, high binary, low binary"


def _extensions(part: pa.RecordBatch, window: int, shards: int) -> Iterator[pa.RecordBatch]:
    """Extensions of a step's hits by shard; negative shards have what the step knows itself."""
    wanted = part.column("wanted").to_pylist()
    if not any(wanted):
        return
    hashes, first, doc = _words(part.column("_text"))
    place, values = _block_values(hashes, first, doc, window)
    low = values.astype(np.uint32) & ~np.uint32(1)
    bounds = np.searchsorted(place, first)
    hit = np.zeros(len(place), bool)
    for d, own in enumerate(wanted):
        if own:
            rows = slice(bounds[d], bounds[d + 1])
            hit[rows] = np.isin(low[rows], np.frombuffer(b"".join(own), "<u4") & ~np.uint32(1))
    place = place[hit]
    if not len(place):
        return
    reach = window - block_words(window)
    turn = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(turn, np.maximum(place - reach, first[doc[place]]), 1)
    np.add.at(turn, place + 1, -1)
    start = np.flatnonzero((np.cumsum(turn[:-1]) > 0) & (np.arange(len(hashes)) + window <= first[1:][doc]))
    high = _rolling(hashes, window, _FACTORS)[start]
    other = (_rolling(hashes, window, _OTHERS)[start] >> np.uint64(32)).astype(np.uint32)
    doc, start = doc[start], start - first[doc[start]]
    key, row = pc.fill_null(part.column("id"), 0).to_numpy(), part.column("row").to_numpy()
    order = np.lexsort((start, row[doc], key[doc], other, high))
    high, other, doc, start = high[order], other[order], doc[order], start[order]
    fresh = np.ones(len(order), bool)
    fresh[1:] = (high[1:] != high[:-1]) | (other[1:] != other[:-1])
    later = key[doc] > key[doc][fresh][np.cumsum(fresh) - 1]
    known = merged_ranges(key[doc[later]], row[doc[later]], start[later], start[later] + window)
    if known.num_rows:
        own = _by_bucket(known, 1)
        none = pa.array([b""], pa.binary())
        shard = -1 - int(known.column("row")[0].as_py()) % 65_536
        yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), *(own.column(c).combine_chunks() for c in ("keys", "rows", "many", "marks")), none, none], names=["shard", "keys", "rows", "owner", "starts", "high", "low"])
    high, other, doc, start = high[~later], other[~later], doc[~later], start[~later]
    # Sorted by hash, so a shard is a stretch.
    shard = ((high >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    cuts = np.flatnonzero(np.diff(shard, prepend=-1))
    packed = {c: [] for c in ("keys", "rows", "owner", "starts", "high", "low")}
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(shard)]):
        used, owner = np.unique(doc[a:b], return_inverse=True)
        packed["keys"].append(key[used].astype("<i8").tobytes())
        packed["rows"].append(row[used].astype("<i8").tobytes())
        packed["owner"].append(owner.astype("<u4").tobytes())
        packed["starts"].append(start[a:b].astype("<u4").tobytes())
        packed["high"].append(high[a:b].astype("<u8").tobytes())
        packed["low"].append(other[a:b].astype("<u4").tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(shard[cuts]), *(pa.array(v, pa.binary()) for v in packed.values())], names=["shard", *packed])


def _sources(window: int, buckets: int):
    """For ``applyInArrow`` by shard: ranges whose extension has a smaller source, by bucket, so that
    a document does not make a row for each shard."""

    def run(table: pa.Table) -> pa.Table:
        column = lambda c: table.column(c).to_pylist()
        if table.column("shard")[0].as_py() < 0:
            known = table.rename_columns(["shard", "keys", "rows", "many", "marks", "high", "low"])
            return _by_bucket(_together(known), buckets)
        owner, base = [], 0
        for own, docs in zip(column("owner"), column("keys")):
            owner.append(np.frombuffer(own, "<u4").astype(np.int64) + base)
            base += len(docs) // 8
        owner = np.concatenate(owner)
        keys, rows = (np.frombuffer(b"".join(column(c)), "<i8")[owner] for c in ("keys", "rows"))
        start, high, low = (np.frombuffer(b"".join(column(c)), k) for c, k in (("starts", "<u4"), ("high", "<u8"), ("low", "<u4")))
        order = np.lexsort((keys, low, high))
        high, low, keys = high[order], low[order], keys[order]
        fresh = np.ones(len(order), bool)
        fresh[1:] = (high[1:] != high[:-1]) | (low[1:] != low[:-1])
        later = keys > keys[fresh][np.cumsum(fresh) - 1]
        begin = start[order][later].astype(np.int64)
        return _by_bucket(merged_ranges(keys[later], rows[order][later], begin, begin + window), buckets)

    return run


def repeated_words(rows: DataFrame, window: int = WINDOW_WORDS) -> DataFrame:
    """``row`` and ``marks`` of rows (id, row, _text): keys and packed word ranges that are
    repeated, null for all words of the text."""
    docs = rows.where(F.col("id").isNotNull() & (F.octet_length("_text") >= 2 * window - 1))
    total = text_bytes(docs, "_text")
    fragments, shards = fragments_for(total / BYTES_PER_WORD), max(32, total // SHARD_BYTES)
    buckets = 64 + isqrt(total >> 20)
    digests = written(docs.select("id", "row", F.md5(F.col("_text").cast("binary")).alias("digest")), "digests")
    first = written(digests.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("members")).where("members > 1"), "first")
    copies = written(join_counted(digests, first, ["digest"]).where("id <> first").select("id", "row").distinct(), "copies")

    def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "_text", STEP_BYTES):
            hashes, first_word, doc = _words(part.column("_text"))
            place, values = _block_values(hashes, first_word, doc, window)
            values, bounds = _distinct(values, doc[place], part.num_rows)
            yield from deal(part.column("row").to_numpy(), bounds, values, fragments, True, marked=True)

    def extend(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "_text", STEP_BYTES):
            yield from _extensions(part, window, shards)

    hits = shared_values(map_arrow(docs, probe, DEALT), fragments, True, marked=True)
    hits = hits.groupBy(F.col("key").alias("row")).agg(F.collect_list("shared").alias("wanted"))
    # From the left and without a filter, as at the end: the texts are shuffled once for both.
    wanted = rows.join(written(hits, "hits").join(copies, "row", "left_anti"), "row", "left").select("id", "row", "_text", "wanted")
    found = map_arrow(wanted, extend, EXTENSIONS).groupBy("shard").applyInArrow(_sources(window, buckets), MARKS)
    marks = found.groupBy("bucket").applyInArrow(_together, "key bigint, row bigint, marks binary")
    whole = copies.select(F.col("id").alias("key"), "row", F.lit(None).cast("binary").alias("marks"))
    return marks.union(whole).groupBy("row").agg(F.collect_list(F.struct("key", "marks")).alias("marks"))


def _joined_spans(found: list[bytes]) -> np.ndarray:
    ranges = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
    if not len(ranges):
        return ranges
    table = merged_ranges(np.zeros(len(ranges), np.int64), np.zeros(len(ranges), np.int64), ranges[:, 0], ranges[:, 1])
    return np.frombuffer(table.column("marks")[0].as_py(), "<i8").reshape(-1, 2)


def _without(part: pa.RecordBatch, window: int) -> pa.RecordBatch:
    data, at = string_buffers(part.column("_text"))
    starts, ends, first = token_spans(data, at, NOT_SPACE)
    many, bounds = np.diff(first), first.tolist()
    kept = np.ones(len(starts), bool)
    spans = []
    for a, b, key, found in zip(bounds, bounds[1:], part.column("id").to_pylist(), part.column("marks").to_pylist()):
        own = [m["marks"] for m in found or () if m["key"] == key]
        if None in own:
            own_spans = np.array([[0, b - a]] if b - a >= window else np.zeros((0, 2)), np.int64)
        else:
            own_spans = _joined_spans(own)
        for x, y in own_spans.tolist():
            kept[a + x : a + y] = False
        spans.append(own_spans.astype("<i8").tobytes())
    # One space after each kept word but a text's last one: the byte behind it is white space.
    places = np.flatnonzero(kept)
    doc = np.searchsorted(first, places, side="right") - 1
    followed = places[:-1][doc[1:] == doc[:-1]]
    out, edge = data.copy(), np.zeros(len(data) + 1, np.int64)
    out[ends[followed]] = 0x20
    np.add.at(edge, starts[places], 1)
    np.add.at(edge, ends[places], -1)
    inside = np.cumsum(edge[:-1]) > 0
    inside[ends[followed]] = True
    length = np.append(0, np.cumsum(inside))[at].tolist()
    raw = out[inside].tobytes()
    left = np.bincount(doc, minlength=len(many)).astype(np.int64)
    columns = [pa.array(many, pa.int64()), pa.array(many - left, pa.int64()), pa.array([len(s) // 16 for s in spans], pa.int64()), pa.array(spans, pa.binary()), pa.array([raw[a:b] for a, b in zip(length, length[1:])], pa.binary())]
    return pa.RecordBatch.from_arrays([part.column("id"), *columns], names=["id", "n_words", "n_removed", "n_spans", "spans", "kept"])


def remove_repeated_words(df: DataFrame, text: str = "text", key: str = "doc_id", window: int = WINDOW_WORDS) -> DataFrame:
    """``key``, ``n_words``, ``n_removed``, ``n_spans``, ``spans`` (packed word ranges of the maximal
    repeats) and the remaining words, joined by spaces, in ``kept``, for every row."""
    if not 2 <= window < len(_FACTORS):
        raise ValueError("a window has at least two words, and fewer than there are factors")
    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{text}`").cast("string").alias("_text"))
    rows = rows.select("id", F.xxhash64("id", "_text").alias("row"), "_text")
    joined = rows.join(repeated_words(rows, window), "row", "left").select("id", "marks", "_text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "_text"):
            yield _without(part, window)

    return map_arrow(joined, run, "id bigint, n_words bigint, n_removed bigint, n_spans bigint, spans binary, kept binary").withColumnRenamed("id", key)
