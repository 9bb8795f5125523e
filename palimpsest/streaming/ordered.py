"""Changes from a stream of images that come out of order.

The state of an object is its last image and those that still wait. An image waits until the
watermark has passed its moment, when nothing older can come any more; then all that waited up to
there are put in order and compared one by one. What comes behind the watermark is left out, by
Spark. An object that is gone and has nothing waiting keeps no state.

Objects share their state by bucket: it is read and written in chunks of many rows, so that what a
micro-batch asks of the state store goes by buckets and not by rows or objects. A stream must keep
the number of buckets that it was started with.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ListState
from pyspark.sql.types import BinaryType, StructField, StructType

CHANGES = "operation string, changed_at timestamp, object_id string, old_data string, new_data string"
BUCKETS = 512
#: Rows of a chunk of state, and of one table that a worker gives back.
CHUNK_ROWS = 10_000
# Written out, as workers have no session that could read a schema's text.
_CHUNK = StructType([StructField("rows", BinaryType())])
_WAITING = pa.schema([("object_id", pa.string()), ("at", pa.int64()), ("tie", pa.int64()), ("deleted", pa.bool_()), ("image", pa.string())])
_LAST = pa.schema([("object_id", pa.string()), ("image", pa.string())])
_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def state_with_timers(spark: SparkSession) -> Iterator[None]:
    """Queries that are started inside keep their state where timers can be kept."""
    before = spark.conf.get(_PROVIDER[0], None)
    spark.conf.set(*_PROVIDER)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER[0]) if before is None else spark.conf.set(_PROVIDER[0], before)


def _packed(rows: pa.Table) -> tuple[bytes]:
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema) as writer:
        writer.write_table(rows)
    return (out.getvalue().to_pybytes(),)


def _read(state: ListState, schema: pa.Schema) -> pa.Table:
    chunks = [pa.ipc.open_stream(bytes(c[0])).read_all() for c in state.get()] if state.exists() else []
    return pa.concat_tables(chunks) if chunks else schema.empty_table()


def _write(state: ListState, rows: pa.Table) -> None:
    if rows.num_rows:
        state.put([_packed(rows.slice(n, CHUNK_ROWS)) for n in range(0, rows.num_rows, CHUNK_ROWS)])
    elif state.exists():
        state.clear()


class _Ordered(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _CHUNK)
        self.last = handle.getListState("last", _CHUNK)

    def _timers(self) -> list[int]:
        return [t[0] if isinstance(t, tuple) else t for t in self.handle.listTimers()]

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [pa.Table.from_pandas(part[_WAITING.names], _WAITING, preserve_index=False) for part in rows if len(part)]
        if new:
            self.waiting.appendList([_packed(t) for t in new])
            # One timer, for the first moment at which a waiting image is due; none fires too early.
            due, timers = min(pc.min(t["at"]).as_py() for t in new) // 1000 + 1, self._timers()
            if not timers or min(timers) > due:
                for later in timers:
                    self.handle.deleteTimer(later)
                self.handle.registerTimer(due)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        waiting, passed = _read(self.waiting, _WAITING), timerValues.getCurrentWatermarkInMs() * 1000
        early = pc.less(waiting["at"], passed)
        due, later = waiting.filter(early), waiting.filter(pc.invert(early))
        if later.num_rows:
            # The timer that fires goes when this is done.
            following = pc.min(later["at"]).as_py() // 1000 + 1
            if following not in self._timers():
                self.handle.registerTimer(following)
        if not due.num_rows:
            return
        _write(self.waiting, later)
        last = dict(zip(*(c.to_pylist() for c in _read(self.last, _LAST).columns)))
        found = []
        due = due.sort_by([(c, "ascending") for c in ("at", "tie", "deleted", "image")])
        for own, at, deleted, image in zip(*(due[c].to_pylist() for c in ("object_id", "at", "deleted", "image"))):
            before = last.get(own)
            if deleted:
                if before is not None:
                    found.append(("DELETE", at, own, before, None))
                    del last[own]
            elif before is None or (before != image and json.loads(before) != json.loads(image)):
                found.append(("INSERT" if before is None else "UPDATE", at, own, before, image))
                last[own] = image
        _write(self.last, pa.table([pa.array(last.keys(), pa.string()), pa.array(last.values(), pa.string())], schema=_LAST))
        for n in range(0, len(found), CHUNK_ROWS):
            out = pd.DataFrame(found[n : n + CHUNK_ROWS], columns=["operation", "changed_at", "object_id", "old_data", "new_data"])
            out["changed_at"] = pd.to_datetime(out["changed_at"], unit="us", utc=True)
            yield out

    def close(self) -> None:
        pass


def ordered_changes(images: DataFrame, late: str, key: str = "id", moment: str = "changed_at", deleted: str = "deleted", tie: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Change records, as ``images_to_changes`` makes them in one batch, from images that come up to
    ``late`` after younger ones. Start the query within ``state_with_timers``."""
    columns = [c for c in images.columns if c not in (moment, deleted, tie)]
    place = F.col(tie).cast("bigint") if tie else F.lit(0).cast("bigint")
    rows = images.withWatermark(moment, late).select(
        F.pmod(F.xxhash64(F.col(key).cast("string")), F.lit(buckets)).alias("bucket"), F.col(key).cast("string").alias("object_id"), F.col(moment), F.unix_micros(moment).alias("at"), place.alias("tie"), F.coalesce(F.col(deleted), F.lit(False)).alias("deleted"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("image")
    )
    return rows.groupBy("bucket").transformWithStateInPandas(statefulProcessor=_Ordered(), outputStructType=StructType.fromDDL(CHANGES), outputMode="Append", timeMode="EventTime")
