"""Streams of changes."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.capture import capture_cdc
from ..sources.store import Engine
from ..spec import Capture


def stream_capture(changes: DataFrame, spec: Capture) -> DataFrame:
    """Capture is one projection, so it holds for streams whose records have both images."""
    return capture_cdc(changes, spec)


def _stream_name(engine: Engine, checkpoint: str) -> str:
    """A name that stays with a checkpoint: written into its folder before the first batch."""
    folder = engine._jvm.org.apache.hadoop.fs.Path(checkpoint)
    fs = folder.getFileSystem(engine.spark.sparkContext._jsc.hadoopConfiguration())
    fs.mkdirs(folder)
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    known = [n for n in names if n.startswith("_stream-")]
    if known:
        return known[0]
    name = f"_stream-{uuid.uuid4().hex}"
    fs.create(engine._jvm.org.apache.hadoop.fs.Path(folder, name), False).close()
    return name


def append_stream(events: DataFrame, engine: Engine, checkpoint: str, **trigger: Any) -> StreamingQuery:
    """Appends each micro-batch to the log, and chains it if the log does. A batch's number is
    committed with its rows, for each checkpoint by itself: a batch that comes again after a
    failure is not written twice, and other streams, or the same one from a new checkpoint, are
    not taken for it."""
    name = _stream_name(engine, checkpoint)

    def write(batch: DataFrame, number: int) -> None:
        engine.append_events(batch, name, number)

    stream = events.writeStream.option("checkpointLocation", checkpoint).foreachBatch(write)
    return (stream.trigger(**trigger) if trigger else stream).start()


def stream_rates(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Events by operation in windows. In append mode a window is given once, when the watermark has
    passed it, and later events are left out; in complete mode none is, and state is kept for ever."""
    return events.withWatermark("changed_at", late).groupBy(F.window("changed_at", width), "operation").agg(F.count("*").alias("events"))


def images_to_changes(images: DataFrame, key: str = "id", moment: str = "changed_at", deleted: str = "deleted", tie: str | None = None) -> DataFrame:
    """Change records from a stream of new images: the last image of each object is its state.
    A batch's images of an object are put in order of their moment, then of ``tie``, and count as
    newer than those of earlier batches, whatever their moment: streams that may be late need
    ``ordered.ordered_changes``, which waits for the watermark. ``deleted``
    marks the end of an object. Gives ``operation``, ``changed_at``, ``object_id`` and both
    images as JSON."""
    columns = [c for c in images.columns if c not in (moment, deleted, tie)]
    place = F.col(tie).cast("bigint") if tie else F.lit(0).cast("bigint")
    rows = images.select(F.col(key).cast("string").alias("object_id"), F.col(moment).alias("changed_at"), place.alias("tie"), F.col(deleted).alias("deleted"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("image"))
    out = "operation string, changed_at timestamp, object_id string, old_data string, new_data string"

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        found = []
        for row in pd.concat(list(parts)).sort_values(["changed_at", "tie"], kind="stable").itertuples():
            if row.deleted:
                if last is not None:
                    found.append(("DELETE", row.changed_at, key[0], last, None))
                last = None
            elif last is None or json.loads(last) != json.loads(row.image):
                found.append(("INSERT" if last is None else "UPDATE", row.changed_at, key[0], last, row.image))
                last = row.image
        if last is None:
            state.remove()
        else:
            state.update((last,))
        yield pd.DataFrame(found, columns=["operation", "changed_at", "object_id", "old_data", "new_data"])

    return rows.groupBy("object_id").applyInPandasWithState(step, StructType.fromDDL(out), StructType.fromDDL("image string"), "append", GroupStateTimeout.NoTimeout)
