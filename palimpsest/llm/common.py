"""Shared helpers: table access, shared-folder checkpoints and Arrow text buffers."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..sources.folders import fresh_folder

#: Text bytes that one vectorised step works on; a longer single text is a step of its own.
CHUNK_BYTES = 1 << 19

#: Remainder of crc32(doc_id) modulo 4 that is held out from learning.
HELD_OUT_MOD, HELD_OUT_REMAINDER = 4, 2


#: Rows and bytes of a batch between Spark and Python: texts may be long, so batches are short.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: A key is hot if it has more than one in so many rows; there cannot be more hot keys than this.
HOT_SHARE = 1000


def bounded_batches(spark: SparkSession) -> SparkSession:
    """Keeps batches of whole texts small in the JVM and in Python: two settings of the session."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return bounded_batches(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lineage is cut, and no
    lost executor can take the rows with it. The folder belongs to the cluster, which clears it."""
    spark = df.sparkSession
    path = fresh_folder(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def name_beside(names: Iterable[str], wanted: str) -> str:
    """A column name that none of ``names`` has."""
    names = set(names)
    while wanted in names:
        wanted += "_"
    return wanted


def text_rows(df: DataFrame, keep: Iterable[str], text: str, own: str) -> tuple[tuple[str, ...], str, DataFrame]:
    """Kept columns, the name of the text beside them, and both as rows. A kept column with the
    name of one that the operator gives (``own``, a schema) is replaced by the operator's."""
    given = set(StructType.fromDDL(own).fieldNames())
    keep = tuple(c for c in keep if c not in given)
    name = name_beside(keep, "_text")
    return keep, name, df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").cast("string").alias(name))


def _give_back() -> None:
    """Returns freed memory to the system, as Python workers live on after their task."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def map_arrow(df: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` whose workers keep no more memory than they need after a task."""

    def tidy(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        _give_back()

    return df.mapInArrow(tidy, schema)


def join_counted(left: DataFrame, right: DataFrame, on: list[str], members: str = "members") -> DataFrame:
    """Inner join with a table of unique keys that says how many rows of ``left`` each key has.

    Keys with more than one in ``HOT_SHARE`` of all rows are broadcast, at most ``HOT_SHARE`` of
    them by their definition; the others are shuffled, and no task gets much of the rows. Both
    sides are read twice and should be written tables. ``members`` is not in the result.
    """
    total = right.agg(F.sum(members)).first()[0] or 0
    hot = F.col(members) > total // HOT_SHARE
    often = F.broadcast(right.where(hot).drop(members))
    seldom = left.join(F.broadcast(right.where(hot).select(*on)), on, "left_anti").join(right.where(~hot).drop(members), on)
    return left.join(often, on).unionByName(seldom)


def join_salted(left: DataFrame, right: DataFrame, on: str, spread: str, members: str = "members") -> DataFrame:
    """``join_counted`` for a ``left`` that is dear to compute, read once: rows of hot keys are dealt
    by ``spread`` to as many copies of the key's row as there are shuffle partitions. ``right`` is
    read twice."""
    total = right.agg(F.sum(members)).first()[0] or 0
    salts = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = F.col(members) > total // HOT_SHARE
    often = F.broadcast(right.where(hot).select(on, F.lit(salts).alias("_salts")))
    left = left.join(often, on, "left").withColumn("_salt", F.when(F.col("_salts").isNull(), 0).otherwise(F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))).drop("_salts")
    right = right.withColumn("_salt", F.explode(F.when(hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0))))).drop(members)
    return left.join(right, [on, "_salt"]).drop("_salt")


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the n + 1 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    at = np.frombuffer(offsets, kind, count=column.offset + len(column) + 1)[column.offset :].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def byte_slices(batches: Iterable[pa.RecordBatch], column: str | int = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that no piece of several rows holds more than ``limit`` text bytes."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, at = string_buffers(batch.column(column))
        start = 0
        while start < batch.num_rows:
            end = int(np.searchsorted(at, at[start] + limit, side="right")) - 1
            end = min(max(end, start + 1), batch.num_rows)
            yield batch.slice(start, end - start)
            start = end


#: Bytes of white-space-separated words, and bytes of words of ASCII letters, digits and non-ASCII.
NOT_SPACE = np.ones(256, bool)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
MIX = np.uint64(0x9E3779B97F4A7C15)
#: The low n bytes of a 64-bit number.
LOW_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def mixed(value: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    value = (value ^ (value >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    value = (value ^ (value >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return value ^ (value >> np.uint64(31))


def token_spans(data: np.ndarray, offsets: np.ndarray, inside_table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes in the table, and the index of each document's first
    run; no run crosses a document's end."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = inside_table[data]
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    finish = inside[:-1] & ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    begins[cut] |= inside[cut]
    finish[cut - 1] |= inside[cut - 1]
    starts = np.flatnonzero(begins)
    return starts, np.flatnonzero(finish) + 1, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span. Every eight bytes are mixed together with their place before
    they are summed, so no arrangement of equal parts can cancel out, however long the span is."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = ends - starts
    parts = np.maximum(1, (size + 7) >> 3)
    before = np.cumsum(parts) - parts
    number = np.arange(int(parts.sum())) - np.repeat(before, parts)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))
    value = eight[np.repeat(starts, parts) + 8 * number] & LOW_BYTES[np.minimum(np.repeat(size, parts) - 8 * number, 8)]
    value = mixed(value ^ mixed((number.astype(np.uint64) + np.uint64(1)) * MIX))
    return mixed(np.add.reduceat(value, before) + size.astype(np.uint64) * MIX)


def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between bounds; empty stretches give 0."""
    total = np.append(np.zeros(1, np.int64 if values.dtype.kind in "biu" else np.float64), np.cumsum(values, dtype=np.int64 if values.dtype.kind in "biu" else np.float64))
    return total[bounds[1:]] - total[bounds[:-1]]


def distinct_in_rows(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each row and the rows' new bounds."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, row))
    values, row = values[order], row[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    values, row = values[new], row[new]
    return values, np.searchsorted(row, np.arange(len(bounds)))


def schema_of(df: DataFrame, keep: Iterable[str], more: str) -> str:
    return ", ".join([f"`{c}` {df.schema[c].dataType.simpleString()}" for c in keep] + [more])


def held_out(key: str = "doc_id"):
    """Whether a row is held out from learning."""
    return F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(HELD_OUT_MOD)) == HELD_OUT_REMAINDER


def learnable(key: str = "doc_id"):
    """Whether a row may be learned from."""
    return ~held_out(key)
