"""A log as a feed of its commits: a data source with a batch and a stream reader.

An offset is the number of a commit, and each commit's rows are given once, in the order of
commits over micro-batches. A part of the feed is one file; whose month, table or object a filter
rules out is not opened, or is read with the filter. Readers open files by the Arrow file system
of the log's address (local folders, HDFS, S3, GCS), not by Spark's.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..plans.months import MONTH
from ..schema import AUDIT_LOG
from .store import BATCH, commit_of

NAME = "palimpsest_log"
SCHEMA = StructType([*AUDIT_LOG.fields, StructField(MONTH, StringType()), StructField("commit", LongType())])
#: Columns whose equality is checked in the file, and comparisons of months.
_IN_FILE = ("table_name", "object_id", "operation", "context_id")
_MONTHS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


@dataclass
class File(InputPartition):
    path: str
    month: str
    commit: int


@dataclass
class Wanted:
    """What filters ask for."""

    equal: dict[str, Any] = field(default_factory=dict)
    months: list[tuple[type, str]] = field(default_factory=list)

    def take(self, own: Filter) -> bool:
        """Whether a filter is wholly answered here."""
        column = own.attribute[0] if len(getattr(own, "attribute", ())) == 1 else None
        if isinstance(own, EqualTo) and column in _IN_FILE and column not in self.equal:
            self.equal[column] = own.value
            return True
        if type(own) in _MONTHS and column == MONTH:
            self.months.append((type(own), own.value))
            return True
        return False

    def month(self, month: str) -> bool:
        return all(_MONTHS[kind](month, value) for kind, value in self.months)


class _Commits:
    def __init__(self, path: str):
        self.path = path

    def _open(self) -> tuple[pafs.FileSystem, str]:
        return pafs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (pafs.LocalFileSystem(), self.path)

    def manifest(self) -> dict[str, Any]:
        fs, root = self._open()
        found = fs.get_file_info(pafs.FileSelector(f"{root}/manifests", allow_not_found=True))
        names = sorted(f.path for f in found if f.base_name.endswith(".json") and f.base_name[:-5].isdigit())
        if not names:
            return {"number": 0, "parts": []}
        with fs.open_input_stream(names[-1]) as stream:
            return json.loads(stream.read())

    def files(self, since: int, until: int, wanted: Wanted) -> list[File]:
        fs, root = self._open()
        out = []
        for month, batch in self.manifest()["parts"]:
            number = commit_of(batch)
            if since < number <= until and wanted.month(month):
                folder = f"{root}/log/{MONTH}={month}/{BATCH}={batch}"
                out += [File(f.path, month, number) for f in fs.get_file_info(pafs.FileSelector(folder)) if f.base_name.endswith(".parquet")]
        return out

    def rows(self, part: File, wanted: Wanted) -> Iterator[pa.RecordBatch]:
        fs, _ = self._open()
        kinds = to_arrow_schema(SCHEMA, timestamp_utc=True)
        condition = None
        for column, value in wanted.equal.items():
            one = pc.field(column) == value
            condition = one if condition is None else condition & one
        own = [n for n in AUDIT_LOG.fieldNames()]
        found = pq.read_table(part.path, columns=own, filesystem=fs, filters=condition, partitioning=None)
        n = found.num_rows
        columns = [found.column(c).cast(kinds.field(c).type, safe=False) for c in own]
        full = pa.table([*columns, pa.array([part.month] * n, pa.string()), pa.array([part.commit] * n, pa.int64())], names=SCHEMA.fieldNames())
        yield from full.to_batches(8192)


class _Reader(DataSourceReader):
    def __init__(self, path: str, since: int, until: int | None):
        self.commits, self.since, self.until, self.wanted = _Commits(path), since, until, Wanted()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        return (f for f in filters if not self.wanted.take(f))

    def partitions(self) -> list[File]:
        last = self.commits.manifest()["number"]
        return self.commits.files(self.since, last if self.until is None else self.until, self.wanted) or [File("", "", 0)]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        return self.commits.rows(partition, self.wanted) if partition.path else iter(())


class _StreamReader(DataSourceStreamReader):
    def __init__(self, path: str, since: int):
        self.commits, self.since = _Commits(path), since

    def initialOffset(self) -> dict[str, int]:
        return {"commit": self.since}

    def latestOffset(self) -> dict[str, int]:
        return {"commit": max(self.since, self.commits.manifest()["number"])}

    def partitions(self, start: dict[str, int], end: dict[str, int]) -> list[File]:
        return self.commits.files(start["commit"], end["commit"], Wanted()) or [File("", "", 0)]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        return self.commits.rows(partition, Wanted()) if partition.path else iter(())


class LogFeed(DataSource):
    """Options: ``path`` of the log, ``since`` (a commit, itself left out) and, for a batch, ``until``."""

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> StructType:
        return SCHEMA

    def reader(self, schema: StructType) -> _Reader:
        until = self.options.get("until")
        return _Reader(self.options["path"], int(self.options.get("since", 0)), None if until is None else int(until))

    def streamReader(self, schema: StructType) -> _StreamReader:
        return _StreamReader(self.options["path"], int(self.options.get("since", 0)))


def register(spark: SparkSession) -> None:
    """Makes ``spark.read.format("palimpsest_log")`` and its stream known to a session."""
    spark.dataSource.register(LogFeed)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
