"""Dedup of long byte passages with a run-length compressed Burrows-Wheeler index.

A passage of at least ``LENGTH`` bytes that also stands in an earlier document (smaller key) is
removed. Two occurrences of it lie in documents that share an anchor: in every stretch of
``LENGTH`` bytes the least hash of its short strings is an anchor, wherever the stretch stands.
Anchors that several documents have are found by fragments of their hash order; the contexts
around them, long enough for every passage with that anchor, meet by anchor in shards. A task
gathers the contexts of many steps before it deals them to the shards, and a shard is large and
cuts its anchors into parts when it has them: a row for each step and each index would make rows
with the square of the input. In a part of a shard the distinct contexts, in document order, are
indexed by the Burrows-Wheeler transform of their text, kept as runs, with the document sampled at
the top of each different passage. Every context is then streamed against it from right to left: a
step extends the match by one byte, and a match of ``LENGTH`` bytes names the earliest document
that has it. The transform sorts by the first ``LENGTH`` bytes, which is all that such matches ask
for.

An anchor with more contexts than an index should hold, as a common phrase in differing
surroundings has, is split: each of its passages of ``LENGTH`` bytes is a context of its own, with
its own hash for an anchor, so that its passages spread over all shards and only equal ones meet.

Equal texts are recognised first: all but the first of them go as a whole. Equal contexts of one
map step or shard count once, the others are marked by the first; an anchor with only one context
left in its shard has nothing to be held against and needs no place in the index.

Defined results: a null text counts as empty; texts shorter than ``LENGTH`` bytes keep all; longer
ones of any size are judged whole; rows of an equal key don't remove from each other, and each is
judged by itself against rows of smaller keys; rows with a null key take no part and keep all;
extra columns are ignored; an empty table gives an empty table. The input must be a scan that
repeats.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import BATCH_BYTES, LOW_BYTES, MIX, byte_slices, distinct_in_rows, join_counted, map_arrow, mixed, string_buffers, written
from .fragments import DEALT, deal, fragments_for, shared_values, text_bytes

LENGTH, GRAM = 50, 32
#: Bytes on either side of an anchor's start that a passage with it can reach.
REACH = LENGTH - GRAM
#: Bytes of text for an anchor, of contexts for one anchor, of contexts for an index, and of text for a shard and for a step.
BYTES_PER_ANCHOR, SHARD_BYTES, INDEX_BYTES, DEALT_BYTES, STEP = 10, 1 << 20, 1 << 17, 4 << 20, 2 << 20
#: Shards that inputs of so many ``SHARD_BYTES`` at most have; contexts that a task gathers.
LEAST_SHARDS, GATHERED = 48, 1 << 19
#: Places that anchors are looked for at once, few enough for a processor's cache.
BLOCK = 1 << 15
SEPARATOR = 0xFF
COLUMNS = ("keys", "rows", "starts", "sizes", "anchor", "bytes")
_STEP = np.uint64(0xD6E8FEB86659FD93)


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """best of values[i : i + width] for each i where that many follow, by doubling."""
    have = 1
    while have * 2 <= width:
        values = best(values[:-have], values[have:])
        have *= 2
    return best(values[: len(values) - (width - have)], values[width - have :]) if width > have else values


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Places of all anchors and their hashes."""
    n, width = len(data), length - gram + 1
    valid = np.zeros(n, bool)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= length:
            valid[a : b - length + 1] = True
    places, found = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for start in range(0, n - gram + 1, BLOCK):
        low = max(0, start - width + 1)
        part = data[low : start + BLOCK + length - 1]
        if len(part) < length:
            break
        h, power, have = part.astype(np.uint64) + np.uint64(1), np.array([_STEP]), 1
        while have < gram:  # gram is a power of two
            h = h[:-have] + power * h[have:]
            power, have = power * power, have * 2
        h = mixed(h)
        least = _sliding(h, width, np.minimum)
        least *= valid[low : low + len(least)]
        padded = np.concatenate([np.zeros(width - 1, np.uint64), least, np.zeros(width - 1, np.uint64)])
        h = h[start - low : start - low + BLOCK]
        most = _sliding(padded, width, np.maximum)[start - low : start - low + len(h)]
        here = np.flatnonzero((most == h) & (h > 0))
        places.append(here + start)
        found.append(h[here])
    return np.concatenate(places), np.concatenate(found)


class RunIndex:
    """Run-length Burrows-Wheeler index of distinct contexts; answers the first document of each
    passage of ``length`` bytes (9 or more)."""

    def __init__(self, text: np.ndarray, document_at: np.ndarray, length: int):
        n = len(text)
        padded = np.concatenate([text, np.zeros(length + 64, np.uint8)])
        key = np.zeros(n + length + 8, np.uint64)
        for j in range(8):
            key = (key << np.uint64(8)) | padded[j : j + len(key)]
        rank = self._dense(key)
        have = 8
        while have * 2 < length:
            rank = self._dense(rank[: len(rank) - have] << 32 | rank[have:])
            have *= 2
        head, tail, near = rank[:n], rank[length - have : length - have + n], rank[length - 1 - have : length - 1 - have + n]
        bits = int(rank.max()).bit_length()
        if 2 * bits + n.bit_length() < 64:
            order = np.argsort((head << bits | tail) << n.bit_length() | np.arange(n))
        else:
            order = np.lexsort((tail, head))
        same = np.zeros(n, bool)
        same[1:] = head[order][1:] == head[order][:-1]
        differs = lambda part: ~(same & np.append(False, part[order][1:] == part[order][:-1]))
        top, wider = differs(tail), differs(near)
        # One entry for each different passage, not for each place: repeats make no entries.
        self.tops, self.wider_tops = np.flatnonzero(top), np.flatnonzero(wider)
        self.first_document = document_at[order[self.tops]]
        last = text[order - 1]
        new = np.ones(n, bool)
        new[1:] = last[1:] != last[:-1]
        starts = np.flatnonzero(new)
        sizes = np.diff(np.append(starts, n))
        chars = last[starts].astype(np.int64)
        by = np.argsort(chars << 40 | starts)
        self.runs = (chars << 40 | starts)[by]
        self.sizes = sizes[by]
        self.before = np.cumsum(self.sizes) - self.sizes  # also counts the smaller bytes before
        self.first_run = np.searchsorted(chars[by], np.arange(257))
        self.n_runs, self.n = len(starts), n

    @staticmethod
    def _dense(key: np.ndarray) -> np.ndarray:
        order = np.argsort(key)
        step = np.zeros(len(key), np.int64)
        sorted_key = key[order]
        step[1:] = sorted_key[1:] != sorted_key[:-1]
        out = np.empty(len(key), np.int64)
        out[order] = np.cumsum(step)
        return out

    def extend(self, rows: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """Top of the rows whose text begins with ``chars`` and then what ``rows`` begin with."""
        run = np.searchsorted(self.runs, chars << 40 | rows) - 1
        low = self.first_run[chars]
        inside = run >= low
        run = np.maximum(run, low)
        return self.before[run] + np.where(inside, np.minimum(rows - (self.runs[run] & ((1 << 40) - 1)), self.sizes[run]), 0)

    def first_documents(self, text: np.ndarray, begin: np.ndarray, end: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For contexts of this index: pattern, offset of a passage in it, first document."""
        size = end - begin
        rows = np.zeros(len(begin), np.int64)
        alive = np.arange(len(begin))
        for t in range(int(size.max(initial=0))):
            alive = alive[size[alive] > t]
            at = rows[alive]
            if t >= length:  # a match has its full length: forget its last byte
                at = self.wider_tops[np.searchsorted(self.wider_tops, at, side="right") - 1]
            place = end[alive] - 1 - t
            rows[alive] = at = self.extend(at, text[place].astype(np.int64))
            if t >= length - 1:
                yield alive, place - begin[alive], self.first_document[np.searchsorted(self.tops, at, side="right") - 1]


def _merged(key: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Marked ranges, in order and merged within each row."""
    if not len(key):
        return key, row, start, end
    order = np.lexsort((start, row, key))
    key, row, start, end = key[order], row[order], start[order], end[order]
    other = np.ones(len(key), bool)
    other[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    number = np.cumsum(other) - 1
    reach = np.maximum.accumulate(number * (1 << 40) + end)  # of the same row: later ones begin higher
    new = np.ones(len(key), bool)
    new[1:] = (number * (1 << 40) + start)[1:] > reach[:-1]
    at = np.flatnonzero(new)
    return key[at], row[at], start[at], reach[np.append(at[1:], len(key)) - 1] & ((1 << 40) - 1)


def _packed_marks(key: np.ndarray, row: np.ndarray, start: np.ndarray, end: np.ndarray) -> pa.Table:
    """Marked ranges of each row, merged."""
    key, row, start, end = _merged(key, row, start, end)
    if not len(key):
        return pa.table({"key": pa.array([], pa.int64()), "row": pa.array([], pa.int64()), "marks": pa.array([], pa.binary())})
    other = np.ones(len(key), bool)
    other[1:] = (key[1:] != key[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(other)
    pair = np.column_stack([start, end])
    return pa.table({"key": pa.array(key[first]), "row": pa.array(row[first]), "marks": pa.array([pair[a:b].astype("<i8").tobytes() for a, b in zip(first.tolist(), [*first[1:].tolist(), len(pair)])], pa.binary())})


def _settle(hashes: np.ndarray, key: np.ndarray, row: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of equal contexts: the first by key, row and place, those of larger keys, and further ones
    of the first's key with the number of the first."""
    order = np.lexsort((place, row, key, hashes))
    new = np.ones(len(order), bool)
    new[1:] = hashes[order][1:] != hashes[order][:-1]
    first, number = order[new], np.cumsum(new) - 1
    owner = key[first][number]
    own = ~new & (key[order] == owner)
    return first, order[key[order] > owner], order[own], number[own]


def _around(places: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.maximum(places - REACH, at[doc]), np.minimum(places + LENGTH, at[doc + 1])


def _passages(data: np.ndarray, begin: np.ndarray, end: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, ...]:
    """All passages of contexts, each place once: begins, ends, documents and hashes."""
    many = end - begin - LENGTH + 1
    within = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
    begin, one = np.unique(np.repeat(begin, many) + within, return_index=True)
    return begin, begin + LENGTH, np.repeat(doc, many)[one], mixed(context_hashes(data, begin, begin + LENGTH) + MIX)


def split_anchors(docs: DataFrame, least: int) -> np.ndarray:
    """Anchors with over ``least`` contexts. A step's only context of an anchor doesn't count, so
    one a step may be missed."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "_text", STEP):
            data, at = string_buffers(part.column("_text"))
            places, hashes = anchors(data, at)
            spread = mixed(hashes + MIX)
            _, which, many = np.unique(spread, return_inverse=True, return_counts=True)
            rows = np.flatnonzero(many[which] > 1)
            if not len(rows):
                continue
            context = context_hashes(data, *_around(places[rows], np.searchsorted(at, places[rows], side="right") - 1, at))
            order = np.lexsort((context, spread[rows]))
            spread, context = spread[rows][order], context[order]
            new = np.ones(len(order), bool)
            new[1:] = (spread[1:] != spread[:-1]) | (context[1:] != context[:-1])
            own, n = np.unique(spread[new], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own[n > 1].view(np.int64)), pa.array(n[n > 1].astype(np.int64))], names=["anchor", "n"])

    found = map_arrow(docs, count, "anchor bigint, n bigint").groupBy("anchor").agg(F.sum("n").alias("n")).where(F.col("n") > least)
    return np.sort(np.array([r["anchor"] for r in found.collect()], np.int64).view(np.uint64))


def _contexts(data: np.ndarray, at: np.ndarray, keys: np.ndarray, row: np.ndarray, wanted: list, shards: int, split: np.ndarray, waiting: list | None = None, enough: int = 0) -> Iterator[pa.RecordBatch]:
    """Contexts of shared anchors of a step, by shard; shard -1 has what the step knows itself.
    Contexts stay in ``waiting`` until it has more than ``enough`` of them."""
    if not any(wanted):
        return
    places, hashes = anchors(data, at)
    doc = np.searchsorted(at, places, side="right") - 1
    spread = mixed(hashes + MIX)
    lists = [np.frombuffer(b"".join(own or ()), "<u4") for own in wanted]
    of_doc = lambda number, low: number.astype(np.uint64) << np.uint64(32) | low
    known = np.sort(of_doc(np.repeat(np.arange(len(lists)), [len(x) for x in lists]), np.concatenate(lists)))
    own = of_doc(doc, spread.astype(np.uint32))
    keep = known[np.minimum(np.searchsorted(known, own), len(known) - 1)] == own
    places, doc, spread = places[keep], doc[keep], spread[keep]
    if not len(places):
        return
    begin, end = _around(places, doc, at)
    cut = np.isin(spread, split)
    if cut.any():
        more = _passages(data, begin[cut], end[cut], doc[cut])
        begin, end, doc, spread = (np.append(x[~cut], y) for x, y in zip((begin, end, doc, spread), more))
        places = np.append(places[~cut], more[0])
    context = context_hashes(data, begin, end)
    first, later, again, _ = _settle(context, keys[doc], row[doc], places - at[doc])
    first = np.append(first, again)
    known = _packed_marks(keys[doc[later]], row[doc[later]], (begin - at[doc])[later], (end - at[doc])[later])
    if known.num_rows:
        parts = [-1 - int(known.column("key")[0].as_py()) % 65_536] * known.num_rows
        one = lambda c: pa.array([np.int64(k).tobytes() for k in known.column(c).to_pylist()], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), one("key"), one("row"), known.column("marks").combine_chunks(), *(pa.array([b""] * known.num_rows, pa.binary()) for _ in range(3))], names=["shard", *COLUMNS])
    raw = data.tobytes()
    own = doc[first]
    text = [raw[x:y] for x, y in zip(begin[first].tolist(), end[first].tolist())]
    waiting = [] if waiting is None else waiting
    waiting.append((keys[own], row[own], begin[first] - at[own], end[first] - begin[first], spread[first], text))
    if sum(len(x[-1]) for x in waiting) > enough:
        yield from _by_shard(waiting, shards)


def _by_shard(waiting: list, shards: int) -> Iterator[pa.RecordBatch]:
    """A row for each shard of the contexts in ``waiting``, which is emptied."""
    if not waiting:
        return
    *columns, text = zip(*waiting)
    keys, row, start, size, spread = map(np.concatenate, columns)
    text = [x for own in text for x in own]
    waiting.clear()
    shard = ((spread >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    cuts = np.flatnonzero(np.diff(shard[order], prepend=-1))
    rows, held = {c: [] for c in ("shard", *COLUMNS)}, 0
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(order)]):
        own = order[a:b]
        rows["shard"].append(int(shard[own[0]]))
        rows["keys"].append(keys[own].astype("<i8").tobytes())
        rows["rows"].append(row[own].astype("<i8").tobytes())
        rows["starts"].append(start[own].astype("<u4").tobytes())
        rows["sizes"].append(size[own].astype("<u1").tobytes())
        rows["anchor"].append(spread[own].astype("<u4").tobytes())
        rows["bytes"].append(zlib.compress(b"".join([text[x] for x in own.tolist()]), 1))
        held += sum(len(x[-1]) for c, x in rows.items() if c != "shard")
        if held > BATCH_BYTES or b == len(order):
            yield pa.RecordBatch.from_arrays([pa.array(rows["shard"], pa.int64()), *(pa.array(rows[c], pa.binary()) for c in COLUMNS)], names=["shard", *COLUMNS])
            rows, held = {c: [] for c in rows}, 0


def context_hashes(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of spans of at most LENGTH + REACH bytes, which may overlap."""
    eight = np.ndarray(len(data) + 1, "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    out = (end - begin).astype(np.uint64) * MIX
    for j in range(0, LENGTH + REACH, 8):
        out = (out ^ (eight[np.minimum(begin + j, len(data))] & LOW_BYTES[np.clip(end - begin - j, 0, 8)])) * _STEP
        out ^= out >> np.uint64(32)
    return mixed(out)


def _index_shard(table: pa.Table) -> pa.Table:
    keys, row = (np.concatenate([np.frombuffer(x.as_py(), "<i8") for x in table.column(c)]) for c in ("keys", "rows"))
    if table.column("shard")[0].as_py() < 0:
        return pa.table({"key": pa.array(keys), "row": pa.array(row), "marks": table.column("starts").combine_chunks()})
    starts = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table.column("starts")]).astype(np.int64)
    sizes = np.concatenate([np.frombuffer(x.as_py(), "<u1") for x in table.column("sizes")]).astype(np.int64)
    data = np.frombuffer(b"".join([zlib.decompress(x) for x in table.column("bytes").to_pylist()]), np.uint8)
    end = np.cumsum(sizes)
    first, later, again, number = _settle(context_hashes(data, end - sizes, end), keys, row, starts)
    marked = [(keys[later], row[later], starts[later], (starts + sizes)[later])]
    anchor = np.concatenate([np.frombuffer(x.as_py(), "<u4") for x in table.column("anchor")])[first]
    _, same, variants = np.unique(anchor, return_inverse=True, return_counts=True)
    used = np.flatnonzero(variants[same] > 1)  # an anchor with one context has nothing to be held against
    if not len(used):
        return _packed_marks(*marked[0])
    parts = np.uint64(int(sizes[first[used]].sum()) // INDEX_BYTES + 1)
    part = anchor[used].astype(np.uint64) * parts >> np.uint64(32)
    order = np.lexsort((starts[first[used]], row[first[used]], keys[first[used]], part))
    used, cuts = used[order], np.flatnonzero(np.diff(part[order].astype(np.int64), prepend=-1)).tolist()
    # Further occurrences in the same document have the same passages.
    place = np.full(len(first), -1)
    place[used] = np.arange(len(used))
    number = place[number]
    again, number = again[number >= 0], number[number >= 0]
    for a, b in zip(cuts, [*cuts[1:], len(used)]):
        own = first[used[a:b]]
        pattern, offset = _repeated(data, (end - sizes)[own], sizes[own], keys[own])
        marked.append(_merged(keys[own[pattern]], row[own[pattern]], starts[own[pattern]] + offset, starts[own[pattern]] + offset + LENGTH))
        here = (number >= a) & (number < b)
        others, which = again[here], number[here] - a
        by = np.argsort(pattern, kind="stable")
        low, high = np.searchsorted(pattern[by], which), np.searchsorted(pattern[by], which, side="right")
        which = np.repeat(low, high - low) + np.arange(int((high - low).sum())) - np.repeat(np.cumsum(high - low) - (high - low), high - low)
        others, offset = np.repeat(others, high - low), offset[by][which]
        marked.append(_merged(keys[others], row[others], starts[others] + offset, starts[others] + offset + LENGTH))
    return _packed_marks(*(np.concatenate(x) for x in zip(*marked)))


def _repeated(data: np.ndarray, at: np.ndarray, size: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Contexts, in document order, and offsets of their passages that an earlier document has."""
    text = np.full(int(size.sum()) + len(size), SEPARATOR, np.uint8)
    begin = np.cumsum(size + 1) - size - 1
    within = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    text[np.repeat(begin, size) + within] = data[np.repeat(at, size) + within]
    index = RunIndex(text, np.repeat(keys, size + 1), LENGTH)
    patterns, offsets = [], []
    for pattern, offset, document in index.first_documents(text, begin, begin + size, LENGTH):
        hit = document < keys[pattern]
        patterns.append(pattern[hit])
        offsets.append(offset[hit])
    return np.concatenate(patterns), np.concatenate(offsets)


def _rows(df: DataFrame, text: str, key: str) -> DataFrame:
    """Key, a number that tells rows of one key apart by their text, and the text."""
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("_text"))
    return rows.select("id", F.xxhash64("id", "_text").alias("row"), "_text")


def repeated_passages(rows: DataFrame) -> DataFrame:
    """``row`` and ``marks`` to remove, of rows (id, row, _text): key and packed ranges (64-bit start
    and end bytes), null for a whole text."""
    docs = rows.where(F.col("id").isNotNull() & (F.octet_length("_text") >= LENGTH))
    total = text_bytes(docs, "_text")
    fragments, shards = fragments_for(total / BYTES_PER_ANCHOR), max(8, min(LEAST_SHARDS, total // SHARD_BYTES), total // DEALT_BYTES)
    split = rows.sparkSession.sparkContext.broadcast(split_anchors(docs, SHARD_BYTES // (LENGTH + REACH)))
    digests = written(docs.select("id", "row", F.md5(F.col("_text").cast("binary")).alias("digest")), "digests")
    first = written(digests.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("members")).where("members > 1"), "first")
    copies = written(join_counted(digests, first, ["digest"]).where("id <> first").select("id", "row").distinct(), "copies")

    def deal_anchors(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "_text", STEP):
            data, at = string_buffers(part.column("_text"))
            places, hashes = anchors(data, at)
            values, bounds = distinct_in_rows(mixed(hashes + MIX), np.searchsorted(places, at))
            yield from deal(part.column("row").to_numpy(), bounds, values, fragments, True)

    def deal_contexts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list = []
        for part in byte_slices(batches, "_text", STEP):
            yield from _contexts(*string_buffers(part.column("_text")), pc.fill_null(part.column("id"), 0).to_numpy(), part.column("row").to_numpy(), part.column("wanted").to_pylist(), shards, split.value, waiting, GATHERED)
        yield from _by_shard(waiting, shards)

    shared = shared_values(map_arrow(docs, deal_anchors, DEALT), fragments, True)
    shared = shared.groupBy(F.col("key").alias("row")).agg(F.collect_list("shared").alias("wanted"))
    # Joined from the left and without a filter, as at the end: the texts are shuffled once for both.
    wanted = rows.join(written(shared, "shared").join(copies, "row", "left_anti"), "row", "left").select("id", "row", "_text", "wanted")
    dealt = map_arrow(wanted, deal_contexts, "shard bigint, keys binary, rows binary, starts binary, sizes binary, anchor binary, bytes binary")
    marks = dealt.groupBy("shard").applyInArrow(_index_shard, "key bigint, row bigint, marks binary")
    whole = copies.select(F.col("id").alias("key"), "row", F.lit(None).cast("binary").alias("marks"))
    return marks.union(whole).groupBy("row").agg(F.collect_list(F.struct("key", "marks")).alias("marks"))


def remove_repeats(df: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key``, ``n_bytes``, ``n_removed``, ``n_spans``, ``spans`` (packed ranges) and the
    remaining bytes in ``kept``, for every row."""
    rows = _rows(df, text, key)
    keep = ("id",)
    joined = rows.join(repeated_passages(rows), "row", "left").select("id", "marks", "_text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "_text"):
            data, at = string_buffers(part.column("_text"))
            raw, at = data.tobytes(), at.tolist()
            out = {c: [] for c in ("n_bytes", "n_removed", "n_spans", "spans", "kept")}
            for a, b, key, found in zip(at, at[1:], part.column("id").to_pylist(), part.column("marks").to_pylist()):
                own = [m["marks"] for m in found or () if m["key"] == key]
                if None in own:
                    spans = np.array([[0, b - a]])
                else:
                    ranges = np.frombuffer(b"".join(own), "<i8").reshape(-1, 2)
                    ranges = ranges[np.argsort(ranges[:, 0], kind="stable")]
                    reach = np.maximum.accumulate(ranges[:, 1])
                    new = np.ones(len(ranges), bool)
                    new[1:] = ranges[1:, 0] > reach[:-1]
                    cut = np.flatnonzero(new)
                    spans = np.column_stack([ranges[cut, 0], reach[np.append(cut[1:], len(ranges)) - 1]]) if len(cut) else ranges
                edge = [0, *spans.ravel().tolist(), b - a]
                out["n_bytes"].append(b - a)
                out["n_removed"].append(int((spans[:, 1] - spans[:, 0]).sum()))
                out["n_spans"].append(len(spans))
                out["spans"].append(spans.astype("<i8").tobytes())
                out["kept"].append(b"".join([raw[a + x : a + y] for x, y in zip(edge[::2], edge[1::2])]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([*part.columns[: len(keep)], *(pa.array(v, k) for v, k in zip(out.values(), kinds))], names=[*keep, *out])

    found = map_arrow(joined, run, "id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, spans binary, kept binary")
    return found.withColumnRenamed("id", key)
