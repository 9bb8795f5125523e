"""Tamper evidence that survives retention: a history tree over the log.

A leaf is the digest of one row; its place is the row's id, counted from the first row of the
tree. Two neighbouring nodes of one level make a node of the next, so a node covers a stretch of
2^level places, and once it is whole it never changes. A log of n rows is summed up by the nodes
of the binary digits of n, its peaks, at most one a level; the root is the digest of n and the
peaks. So a commit adds the nodes that it completes and notes a few hashes, whatever the log's
size, and the root of any earlier size can be had from the nodes that are there.

Leaves are digested in parallel. Nodes are made in blocks of 2^16 neighbours, 16 levels at a time,
so a log of a billion rows takes two rounds and no task has more than a block. Rows that a purge
takes leave their nodes behind, at whatever place in the order they stood: what is left is checked
against its leaves, and the leaves against the root, as before.
"""

from __future__ import annotations

import hashlib
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from . import chain

#: Levels of a block.
BLOCK_LEVELS = 16
NODES = "level int, place bigint, hash binary"
#: What stands before the bytes of a leaf and of a node, so that neither can pass for the other.
LEAF, NODE = b"\x00", b"\x01"


def leaf() -> Column:
    return F.unhex(F.sha2(F.concat(F.lit(LEAF), F.unhex(chain.digest())), 256))


def leaves(log: DataFrame, first: int) -> DataFrame:
    """Leaves of rows from the id ``first`` on."""
    return log.where(F.col("id") >= first).select(F.lit(0).alias("level"), (F.col("id") - first).cast("bigint").alias("place"), leaf().alias("hash"))


def peaks_of(size: int) -> list[tuple[int, int]]:
    """Level and place of the peaks of a log of ``size`` rows, from the left."""
    return [(level, (size >> level) - 1) for level in range(size.bit_length() - 1, -1, -1) if size >> level & 1]


def root(size: int, peaks: list[bytes]) -> str:
    return hashlib.sha256(str(size).encode() + b"".join(peaks)).hexdigest()


def _block(table: pa.Table) -> pa.Table:
    """Nodes above those of a block, which may come in at any of its levels."""
    levels: dict[int, dict[int, bytes]] = {}
    for level, place, own in zip(*(table.column(c).to_pylist() for c in ("level", "place", "hash"))):
        levels.setdefault(level, {})[place] = own
    low = min(levels) // BLOCK_LEVELS * BLOCK_LEVELS
    out: tuple[list, list, list] = ([], [], [])
    for level in range(low, low + BLOCK_LEVELS):
        own, above = levels.get(level, {}), levels.setdefault(level + 1, {})
        for place, right in own.items():
            left = own.get(place - 1) if place % 2 else None
            if left is not None:
                made = hashlib.sha256(NODE + left + right).digest()
                above[place >> 1] = made
                for column, value in zip(out, (level + 1, place >> 1, made)):
                    column.append(value)
    return pa.table([pa.array(c, k) for c, k in zip(out, (pa.int32(), pa.int64(), pa.binary()))], names=["level", "place", "hash"])


def grown(new: DataFrame, size: int, peaks: list[list[Any]] = [], keep=lambda df: df) -> DataFrame:  # noqa: B006
    """``new`` leaves and all nodes that they complete in a log of ``size`` rows; ``peaks`` are those
    of the log before, as (level, place, hash in hex). ``keep`` writes what is read again."""
    spark = new.sparkSession
    old = spark.createDataFrame([(level, place, bytes.fromhex(h)) for level, place, h in peaks], NODES)
    parts = [keep(new.select("level", "place", "hash"))]
    for low in range(0, max(1, size.bit_length()), BLOCK_LEVELS):
        fresh = parts[-1].where(F.col("level") == low)
        before = old.where(F.col("level").between(low, low + BLOCK_LEVELS - 1))
        block = F.expr(f"place >> ({low + BLOCK_LEVELS} - level)")
        parts.append(keep(fresh.unionByName(before).groupBy(block.alias("block")).applyInArrow(_block, NODES)))
    return reduce(DataFrame.unionByName, parts)


def peaks_at(nodes: DataFrame, size: int, known: list[list[Any]] = []) -> list[list[Any]]:  # noqa: B006
    """The peaks of an earlier or the present size, from stored nodes; as many as digits at most.
    ``known`` ones are not looked for."""
    wanted = peaks_of(size)
    found = {(level, place): h for level, place, h in known}
    missing = [(level, place) for level, place in wanted if (level, place) not in found]
    if missing:
        asked = reduce(lambda a, b: a | b, [(F.col("level") == level) & (F.col("place") == place) for level, place in missing])
        found |= {(r["level"], r["place"]): r["hash"].hex() for r in nodes.where(asked).collect()}
    return [[level, place, found.get((level, place), "")] for level, place in wanted]


def root_at(nodes: DataFrame, size: int) -> str:
    return root(size, [bytes.fromhex(h) for _, _, h in peaks_at(nodes, size)])


def verify(log: DataFrame, nodes: DataFrame, first: int, size: int, expected_root: str, purged: DataFrame | None = None, keep=lambda df: df) -> DataFrame:
    """Broken rows: ``id`` and ``reason``. Rows are held against their leaves, leaves against the
    stored nodes above them, and the peaks against a root that was noted. ``purged`` has the ids
    that a purge has taken; any other row must be there."""
    stored = nodes.where("level = 0").select("place", F.col("hash").alias("stored"))
    own = leaves(log, first).groupBy("place").agg(F.count("*").alias("rows"), F.min("hash").alias("least"), F.max("hash").alias("most"))
    both = own.join(stored, "place", "full_outer")
    if purged is not None:
        gone = purged.select((F.col("id") - first).alias("place")).distinct().withColumn("gone", F.lit(True))
        both = both.join(gone, "place", "left")
    else:
        both = both.withColumn("gone", F.lit(None).cast("boolean"))
    reason = (
        F.when(F.col("rows").isNull() & F.col("gone").isNull(), "row is missing")
        .when(F.col("rows").isNotNull() & F.col("stored").isNull(), "row is not in the tree")
        .when(F.col("rows").isNotNull() & F.col("gone").isNotNull(), "row was purged and is back")
        .when((F.col("least") != F.col("stored")) | (F.col("most") != F.col("stored")), "row differs from its leaf")
        .when(F.col("rows") > 1, "row stands twice")
    )
    broken = both.select((F.col("place") + first).alias("id"), reason.alias("reason"))
    again = grown(nodes.where("level = 0"), size, keep=keep)
    other = again.where("level > 0").withColumnRenamed("hash", "made").join(nodes.where("level > 0"), ["level", "place"], "full_outer")
    inner = other.where(~F.col("made").eqNullSafe(F.col("hash")))
    broken = broken.unionByName(inner.select((F.expr("place << level") + first).alias("id"), F.lit("node differs from those below").alias("reason")))
    # One row from a scalar: the peaks are few, and their hashes make the root.
    own_root = root_at(again, size)
    noted = log.sparkSession.range(1).select(F.lit(first + size - 1).cast("bigint").alias("id"), F.when(F.lit(own_root != expected_root), "root differs from the noted one").alias("reason"))
    return broken.unionByName(noted).where(F.col("reason").isNotNull())


PROOFS = "place bigint, peak int, hash binary, path array<struct<level: int, hash: binary, is_left: boolean>>"
#: Proofs that one batch of a block holds.
PROOF_ROWS = 8192


def _paths(asked: pa.Table, nodes: pa.Table) -> pa.Table:
    """Proofs of a block's places, from its nodes and those that its way to the peak needs."""
    levels, places = (nodes.column(c).to_numpy() for c in ("level", "place"))
    hashes, ordered = nodes.column("hash").combine_chunks(), {}
    for level in np.unique(levels):
        rows = np.flatnonzero(levels == level)
        ordered[int(level)] = rows[np.argsort(places[rows], kind="stable")]

    def at(level: int, wanted: np.ndarray) -> np.ndarray:
        """Rows of nodes, -1 where there is none."""
        rows = ordered.get(level)
        if rows is None:
            return np.full(len(wanted), -1)
        found = np.minimum(np.searchsorted(places[rows], wanted), len(rows) - 1)
        return np.where(places[rows[found]] == wanted, rows[found], -1)

    shape = pa.struct([("level", pa.int32()), ("hash", pa.binary()), ("is_left", pa.bool_())])
    names, out = ["place", "peak", "hash", "path"], []
    for start in range(0, max(1, asked.num_rows), PROOF_ROWS):
        own, peak = (asked.column(c).to_numpy()[start : start + PROOF_ROWS] for c in ("place", "peak"))
        leaf_at = at(0, own)
        own, peak, leaf_at = (x[leaf_at >= 0] for x in (own, peak, leaf_at))
        climb = np.arange(peak.max() if len(peak) else 0)
        beside = (own[:, None] >> climb) ^ 1
        rows = np.stack([at(int(n), beside[:, n]) for n in climb], 1) if len(climb) else np.empty((len(own), 0), np.int64)
        rows = np.where(climb < peak[:, None], rows, -1)
        there = rows >= 0
        steps = pa.StructArray.from_arrays([pa.array(np.broadcast_to(climb, rows.shape)[there].astype(np.int32)), hashes.take(pa.array(rows[there])), pa.array(beside[there] % 2 == 0)], fields=list(shape))
        path = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], there.sum(1).cumsum()]).astype(np.int32)), steps)
        out.append(pa.table([pa.array(own, pa.int64()), pa.array(peak, pa.int32()), hashes.take(pa.array(leaf_at)), path], names=names))
    return pa.concat_tables(out)


def inclusion(nodes: DataFrame, size: int, places: DataFrame) -> DataFrame:
    """For each ``place``: its leaf's ``hash``, the ``path`` of neighbours up to its peak, from below,
    and ``peak``, the level of that. Path and peaks show that the leaf is in the root. Places meet
    the nodes of their block; above it all of them go the same way, which is looked up once."""
    top = F.expr(f"cast(length(bin(place ^ {int(size)}L)) - 1 as int)")
    asked = places.select("place").distinct().where(f"place >= 0 and place < {int(size)}L").withColumn("peak", top)
    inside = nodes.where(F.col("level") < BLOCK_LEVELS).select(F.expr(f"place >> ({BLOCK_LEVELS} - level)").alias("block"), "level", "place", "hash")
    blocks = nodes.sparkSession.range((size >> BLOCK_LEVELS) + 1).select(F.col("id").alias("block"), F.expr(f"id << {BLOCK_LEVELS}").alias("place")).withColumn("peak", top)
    way = blocks.where(F.col("peak") > BLOCK_LEVELS).select("block", "place", F.explode(F.sequence(F.lit(BLOCK_LEVELS), F.col("peak") - 1)).alias("level"))
    above = way.select("block", "level", F.expr("(place >> level) ^ 1L").alias("place")).hint("merge").join(nodes.where(F.col("level") >= BLOCK_LEVELS), ["level", "place"])
    known = inside.unionByName(above.select("block", "level", "place", "hash"))
    return asked.withColumn("block", F.expr(f"place >> {BLOCK_LEVELS}")).groupBy("block").cogroup(known.groupBy("block")).applyInArrow(_paths, PROOFS)


def proven(peaks: list[list[Any]]) -> Column:
    """Whether a row of ``inclusion`` leads from its leaf to its peak."""
    both = lambda a, b: F.unhex(F.sha2(F.concat(F.lit(NODE), a, b), 256))
    climbed = F.aggregate("path", F.col("hash"), lambda own, step: F.when(step["is_left"], both(step["hash"], own)).otherwise(both(own, step["hash"])))
    known = F.create_map(*[x for level, _, h in peaks for x in (F.lit(level), F.unhex(F.lit(h)))])
    return F.coalesce((climbed == known[F.col("peak")]) & (F.size("path") == F.col("peak")), F.lit(False))
