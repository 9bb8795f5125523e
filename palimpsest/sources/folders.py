"""Folders that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``. Only a session whose driver
    and executors are one process gets a temporary one where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='spark-')}"
    spark.conf.set("spark.checkpoint.dir", made)
    return made


#: Folders that this process has named, by application.
_NAMED: dict[str, list[str]] = {}


def fresh_folder(spark: SparkSession, tag: str) -> str:
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    _NAMED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_folders(spark: SparkSession, keep: int = 0) -> int:
    """Deletes the intermediate folders of this application but the last ``keep`` ones; how many.
    For callers whose results are written: tables that still read from a folder lose it."""
    named = _NAMED.get(spark.sparkContext.applicationId, [])
    gone = named[: len(named) - keep]
    del named[: len(gone)]
    for path in gone:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return len(gone)
