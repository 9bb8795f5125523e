"""Trie of conversation prefixes.

Every turn has a digest of its role and text. Within a conversation digests are chained: a prefix's
digest is the SHA-256 of the one before and the turn's. So equal prefixes have equal digests, and
a node of the trie is a group of prefixes by depth and digest.

Conversations are first rebuilt from the opening turns of the first of their five and their own
later turns. Turns of such a family lie together, in order, and are streamed: only the opening
turns, the chain's last digest and one row are held, however long a conversation is.

Each node belongs to its smallest member. The nodes of a member are the lower end of its path, and
a running sum up the path adds up what they give to each of their ancestors; these sums, one for
each prefix of the member, meet by node. So every node is exploded to all its ancestors, but
summed up along a path before anything is shuffled, and a long conversation makes as many rows as
it has turns.

The list of the conversations that end at a node, whose digest takes it as a whole, is never held:
ranges of it are sorted and packed in parallel, and only the digest runs over the packed pieces.

Defined results: turns in the order of ``turn``, null first; turns of one number by role, then by
text; a null role or text counts as empty; repeated rows are turns of their own; rows without
conv_id are left out; a conversation without any turn left is a member of the root only; extra
columns are ignored; an empty table gives no node, not even a root.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import map_arrow, written

#: Conversations of a family, and the modulus of the number of opening turns that they share.
FAMILY, OPENING = 5, 9
#: Rows of an output batch, and conversations of a packed piece.
ROWS, PIECE = 8192, 8192
#: Leading characters by which turns of one number and role are ordered before their digests.
HEAD = 32

PREFIXES = "conv_id bigint, depth bigint, digest binary, parent binary, n_bytes bigint, ends boolean"
_KINDS = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_())


def opening_turns(conv_id: int) -> int:
    return zlib.crc32(str(conv_id).encode()) % OPENING


def _turns(df: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """Turns by family, in order. Texts are digested where they are read."""
    rows = df.where(F.col(f"`{conv}`").isNotNull()).select(
        F.col(f"`{conv}`").cast("bigint").alias("conv"), F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")
    )
    own = F.unhex(F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256))
    rows = rows.select((F.col("conv") - F.col("conv") % FAMILY).alias("family"), "conv", "turn", "role", F.substring("text", 1, HEAD).alias("head"), own.alias("own"), F.octet_length("text").cast("bigint").alias("n_bytes"))
    # The family's first conversation comes first, also among negative numbers.
    order = ["family", F.abs(F.col("conv") % FAMILY), "conv", F.asc_nulls_first("turn"), "role", "head", "own"]
    return rows.repartition("family").sortWithinPartitions(*order).select("family", "conv", "own", "n_bytes")


class _Path:
    """The prefixes of one conversation as they come; the last one waits to be told that it ends."""

    def __init__(self, conv: int, rows: list[tuple]):
        self.conv, self.rows, self.seen, self.skip = conv, rows, 0, 0
        self.last = (conv, 0, b"", None, 0)

    def add(self, own: bytes, n_bytes: int) -> None:
        self.rows.append((*self.last, False))
        before = self.last[2]
        self.last = (self.conv, self.last[1] + 1, hashlib.sha256(before + own).digest(), before, n_bytes)

    def close(self) -> None:
        self.rows.append((*self.last, True))


def _prefixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    family, opening, path = None, [], None

    def given() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _KINDS)], names=["conv_id", "depth", "digest", "parent", "n_bytes", "ends"])
        rows.clear()
        return out

    for batch in batches:
        for base, conv, own, n_bytes in zip(*(batch.column(c).to_pylist() for c in ("family", "conv", "own", "n_bytes"))):
            if path is None or conv != path.conv:
                if path is not None:
                    path.close()
                if base != family:
                    family, opening = base, []
                path = _Path(conv, rows)
                if conv != base:
                    path.skip = opening_turns(conv)
                    for turn in opening[: path.skip]:
                        path.add(*turn)
            if conv == base and len(opening) < OPENING - 1:
                opening.append((own, n_bytes))
            path.seen += 1
            if path.seen > path.skip:
                path.add(own, n_bytes)
            if len(rows) >= ROWS:
                yield given()
    if path is not None:
        path.close()
    if rows:
        yield given()


def _ends(prefixes: DataFrame) -> DataFrame:
    """``digest`` and ``ends_sha256`` of the nodes at which conversations end."""
    order = ["digest", "conv_id"]
    sorted_ends = prefixes.where("ends").select(*order).repartitionByRange(*order).sortWithinPartitions(*order)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, ids = batch.column("digest").to_pylist(), batch.column("conv_id").to_pylist()
            at, out = 0, []
            for k in range(1, len(ids) + 1):
                if k == len(ids) or digests[k] != digests[at] or k - at == PIECE:
                    out.append((digests[at], ids[at], ",".join(map(str, ids[at:k])).encode()))
                    at = k
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.binary(), pa.int64(), pa.binary()))], names=["digest", "least", "ids"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, sha, out = None, None, []
        for batch in batches:
            for own, ids in zip(batch.column("digest").to_pylist(), batch.column("ids").to_pylist()):
                if sha is not None and own == digest:
                    sha.update(b"," + ids)
                    continue
                if sha is not None:
                    out.append((digest, sha.hexdigest()))
                digest, sha = own, hashlib.sha256(ids)
            if len(out) >= ROWS:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.binary(), pa.string()))], names=["digest", "ends_sha256"])
                out = []
        if sha is not None:
            out.append((digest, sha.hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.binary(), pa.string()))], names=["digest", "ends_sha256"])

    pieces = map_arrow(sorted_ends, pack, "digest binary, least bigint, ids binary")
    return map_arrow(pieces.repartition("digest").sortWithinPartitions("digest", "least").select("digest", "ids"), run, "digest binary, ends_sha256 string")


def _up_the_paths(prefixes: DataFrame, nodes: DataFrame) -> DataFrame:
    """For each node: children, leaves and saved tokens of its subtree."""
    paths = prefixes.select("conv_id", "depth", "digest", F.lit(1).alias("step"), F.lit(0).cast("bigint").alias("saved"), F.lit(0).cast("bigint").alias("leaf"))
    own = nodes.select("conv_id", "depth", F.lit(None).cast("binary").alias("digest"), F.lit(0).alias("step"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"), (F.col("n_ends") == F.col("n_convs")).cast("bigint").alias("leaf"))
    up = Window.partitionBy("conv_id").orderBy(F.desc("depth"), "step").rowsBetween(Window.unboundedPreceding, 0)
    owned = F.count(F.when(F.col("step") == 0, 1)).over(up)
    top = F.min(F.when(F.col("step") == 0, F.col("depth"))).over(up)
    summed = paths.unionByName(own).select(
        "depth", "digest", "step", F.sum("saved").over(up).alias("saved"), F.sum("leaf").over(up).alias("leaves"), (owned - (top == F.col("depth")).cast("bigint")).alias("below"), (F.max("depth").over(up) - F.col("depth")).alias("deeper")
    )
    # The next prefix is the member's own if all deeper ones are.
    child = ((F.col("deeper") > 0) & (F.coalesce("below", F.lit(0)) == F.col("deeper"))).cast("bigint")
    return summed.where("step = 1").groupBy("depth", "digest").agg(F.sum(child).alias("n_children"), F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def prefix_trie(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each node: ``digest`` and ``parent`` (digests), ``conv_id`` (smallest member),
    ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and
    ``ends_sha256``."""
    prefixes = written(map_arrow(_turns(df, conv, turn, role, text), _prefixes, PREFIXES), "prefixes")
    # What a digest settles stands among the keys, so that all else is summed before the shuffle.
    nodes = prefixes.groupBy("depth", "digest", "parent", "n_bytes").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.count(F.when(F.col("ends"), 1)).alias("n_ends"))
    nodes = written(nodes, "nodes")
    above = nodes.select((F.col("depth") + 1).alias("depth"), F.col("digest").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(above, ["depth", "parent"], "left").join(_up_the_paths(prefixes, nodes), ["depth", "digest"]).join(_ends(prefixes), "digest", "left")
    none = hashlib.sha256(b"").hexdigest()
    return found.select("digest", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
