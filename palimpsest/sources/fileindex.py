"""Which files of a log have rows of an object, a user or a context.

A log's files are ranges of month, table and object, so for an object its files follow from the
range of objects in each. Users and contexts are spread over all files; for them there is a row
for each value and file, sorted by value, so a lookup reads few row groups of it. Within a file,
Parquet's own Bloom filters and statistics skip the row groups without the value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

RANGES = "table_name string, least string, most string, nulls boolean, path string"
KEYS = "kind string, value string, path string"
#: A lookup that finds more files than this reads the log as a whole: the list goes to the driver.
MOST_FILES = 10_000
#: Parquet options of files whose lookups are to be fast.
BLOOM = {"parquet.bloom.filter.adaptive.enabled": "true"} | {f"parquet.bloom.filter.enabled#{c}": "true" for c in ("object_id", "user_id", "context_id")}


def _path() -> Column:
    """A file's place below the log's folder."""
    return F.regexp_extract(F.col("_metadata.file_path"), r"/log/(changed_month=[^/]*/.*)$", 1)


def object_ranges(rows: DataFrame) -> DataFrame:
    """The objects of each table in each file of some rows that were read from files."""
    found = rows.select("table_name", "object_id", _path().alias("path")).groupBy("table_name", "path")
    return found.agg(F.min("object_id").alias("least"), F.max("object_id").alias("most"), F.bool_or(F.col("object_id").isNull()).alias("nulls")).select("table_name", "least", "most", "nulls", "path")


def value_files(rows: DataFrame) -> DataFrame:
    """Users and contexts and the files that have them."""
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).cast("string").alias("value")) for k, c in (("user", "user_id"), ("context", "context_id"))])
    each = rows.select(F.explode(pairs).alias("x"), _path().alias("path")).where("x.value is not null")
    return each.select("x.kind", "x.value", "path").distinct().repartitionByRange("kind", "value").sortWithinPartitions("kind", "value")


def with_object(ranges: DataFrame, table: str, object_id: str) -> DataFrame:
    return ranges.where((F.col("table_name") == table) & (F.col("least") <= object_id) & (F.col("most") >= object_id)).select("path")


def with_value(values: DataFrame, kind: str, value: str) -> DataFrame:
    return values.where((F.col("kind") == kind) & (F.col("value") == value)).select("path")
