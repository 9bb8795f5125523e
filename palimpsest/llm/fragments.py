"""Counting over a hash order that is cut into fragments.

Values of all documents are dealt to fragments of one global hash order. Each map step first
meets what lies together: a value that two of its documents have is known to be shared there, and
only one entry of it goes on, so a value that a third of all documents have makes one entry for
each step, not for each document. Entries keep 32 bits beyond the fragment's number; a chance
meeting of two of them can only report too much, which the exact steps that follow put right.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Entries that a fragment should hold, fragments of small inputs, and text bytes that a step looks at together.
FRAGMENT_ENTRIES, LEAST_FRAGMENTS, STEP_BYTES = 2_000_000, 48, 2 << 20

DEALT = "part bigint, keys binary, owner binary, entries binary"
SHARED = "key bigint, n bigint, shared binary"


def text_bytes(df: DataFrame, text: str) -> int:
    """Bytes of a text column; a full scan, but of one aggregate."""
    return int(df.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0)


def fragments_for(entries: float) -> int:
    return max(LEAST_FRAGMENTS, int(entries // FRAGMENT_ENTRIES) + 1)


def fragment_of(values: np.ndarray, fragments: int) -> np.ndarray:
    """Rising with the value, so that a fragment is a stretch of the order."""
    return (((values >> np.uint64(32)) * np.uint64(fragments)) >> np.uint64(32)).astype(np.int64)


def _lists(keys: np.ndarray, owner: np.ndarray, values: np.ndarray, lists: bool) -> tuple[list, list, list]:
    """Key, count and, if asked for, packed low bits of the values of each owner."""
    order = np.argsort(owner, kind="stable")
    owner, values = owner[order], values[order]
    at = np.flatnonzero(np.diff(owner, prepend=-1))
    ends = np.append(at[1:], len(owner))
    packed = [values[a:b].tobytes() for a, b in zip(at.tolist(), ends.tolist())] if lists else [None] * len(at)
    return keys[owner[at]].tolist(), (ends - at).tolist(), packed


def deal(keys: np.ndarray, bounds: np.ndarray, values: np.ndarray, fragments: int, lists: bool, marked: bool = False) -> Iterator[pa.RecordBatch]:
    """Entries of one step for each fragment, and what the step knows by itself. ``values`` are
    distinct within each key. With ``marked`` their lowest bit is a mark and no part of the value."""
    if not len(values):
        return
    owner = np.repeat(np.arange(len(keys)), np.diff(bounds))
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    own_value = values >> np.uint64(marked)
    first = np.ones(len(values), bool)
    first[1:] = own_value[1:] != own_value[:-1]
    run = np.cumsum(first) - 1
    if marked:  # the entry that goes on has the mark if any has it
        first = np.append(first[1:], True)
    again = np.bincount(run)[run] > 1
    parts, key_rows, owner_rows, entry_rows = [], [], [], []
    if again.any():
        own, n, packed = _lists(keys, owner[again], values[again].astype(np.uint32), lists)
        parts.append(fragments + int(keys[0]) % 65_536)
        key_rows.append(np.array(own, "<i8").tobytes())
        owner_rows.append(np.array(n, "<i4").tobytes())
        entry_rows.append(b"".join(packed) if lists else b"")
    values, owner = values[first], np.where(again, -1, owner)[first]
    where = fragment_of(values, fragments)
    cuts = np.flatnonzero(np.diff(where, prepend=-1))
    for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(values)).tolist()):
        used, place = np.unique(owner[a:b], return_inverse=True)
        has_none = len(used) and used[0] < 0
        parts.append(int(where[a]))
        key_rows.append((keys[used[1:]] if has_none else keys[used]).astype("<i8").tobytes())
        owner_rows.append((place - int(has_none)).astype("<i2" if len(used) < 32_000 else "<i4").tobytes())
        entry_rows.append(values[a:b].astype("<u4").tobytes())
    yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int64()), *(pa.array(x, pa.binary()) for x in (key_rows, owner_rows, entry_rows))], names=["part", "keys", "owner", "entries"])


def meet(fragments: int, lists: bool, marked: bool = False):
    """For ``applyInArrow`` by ``part``: which entries at least two keys have, and with ``marked``
    at least one of them with the mark."""

    def run(table: pa.Table) -> pa.Table:
        rows = [(np.frombuffer(k, "<i8"), o, e) for k, o, e in zip(*(table.column(c).to_pylist() for c in ("keys", "owner", "entries")))]
        if table.column("part")[0].as_py() >= fragments:
            keys, n, packed = [], [], []
            for own, counts, entries in rows:
                counts = np.frombuffer(counts, "<i4")
                at = np.append(0, np.cumsum(counts)) * 4
                keys += own.tolist()
                n += counts.tolist()
                packed += [entries[a:b] for a, b in zip(at, at[1:])] if lists else [None] * len(own)
            return pa.table({"key": pa.array(keys, pa.int64()), "n": pa.array(n, pa.int64()), "shared": pa.array(packed, pa.binary())})
        entries = np.concatenate([np.frombuffer(e, "<u4") for _, _, e in rows])
        owner, base = [], 0
        for own, o, e in rows:
            place = np.frombuffer(o, "<i2" if len(o) * 2 == len(e) else "<i4").astype(np.int64)
            owner.append(np.where(place < 0, -1, place + base))
            base += len(own)
        owner = np.concatenate(owner)
        keys = np.concatenate([own for own, _, _ in rows])
        order = np.argsort(entries, kind="stable")
        entries, owner = entries[order], owner[order]
        own_value = entries >> np.uint32(marked)
        new = np.ones(len(entries), bool)
        new[1:] = own_value[1:] != own_value[:-1]
        run_of = np.cumsum(new) - 1
        shared = (np.bincount(run_of)[run_of] > 1) & (owner >= 0)
        if marked:
            shared &= np.maximum.reduceat(entries & np.uint32(1), np.flatnonzero(new))[run_of] > 0
        own, n, packed = _lists(keys, owner[shared], entries[shared], lists)
        return pa.table({"key": pa.array(own, pa.int64()), "n": pa.array(n, pa.int64()), "shared": pa.array(packed, pa.binary())})

    return run


def shared_values(dealt: DataFrame, fragments: int, lists: bool, marked: bool = False) -> DataFrame:
    """``key``, the number of its values in one fragment that other keys have too, and if asked
    for their low 32 bits; several rows a key."""
    return dealt.groupBy("part").applyInArrow(meet(fragments, lists, marked), SHARED)
