"""All history that belongs to a subject: along references from row to row.

A reference says that a field of one table's rows holds the id of a row of another. Every value
that the field ever had counts, in old images and new ones. From the subject's own rows the search
goes from step to step to the rows that refer to what was found last, until nothing new is found,
so references may form cycles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..identifiers import validate_identifier


@dataclass(frozen=True)
class Reference:
    """``table.field`` holds ids of ``target``."""

    table: str
    field: str
    target: str

    def __post_init__(self) -> None:
        for name in (self.table, self.field, self.target):
            validate_identifier(name, "reference")


def links(log: DataFrame, references: Iterable[Reference]) -> DataFrame:
    """Which row refers to which, by any image; a log is read once, whatever the references."""
    each = [F.struct(F.lit(r.table).alias("table"), F.lit(r.target).alias("target"), F.get_json_object("image", f"$.{r.field}").alias("target_id")) for r in references]
    images = log.select("table_name", "object_id", F.explode(F.array("old_data", "new_data")).alias("image")).where("image is not null and object_id is not null")
    found = images.select("table_name", "object_id", F.explode(F.array(*each)).alias("x")).where("x.table = table_name and x.target_id is not null")
    return found.select("table_name", "object_id", "x.target", "x.target_id").distinct()


def subject_rows(log: DataFrame, start: DataFrame, references: Iterable[Reference], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``table_name``, ``object_id`` and ``step`` of all rows that belong to those of ``start``. Each
    step is written by ``stage``, so that the plan does not grow with the number of steps."""
    edges = stage(links(log, references))
    last = stage(start.select("table_name", F.col("object_id").cast("string").alias("object_id")).distinct().withColumn("step", F.lit(0)))
    steps = [last]
    while last.limit(1).count():
        known = reduce(DataFrame.unionByName, steps).select("table_name", "object_id")
        reached = edges.join(last.select(F.col("table_name").alias("target"), F.col("object_id").alias("target_id")), ["target", "target_id"], "left_semi")
        fresh = reached.select("table_name", "object_id").distinct().join(known, ["table_name", "object_id"], "left_anti")
        last = stage(fresh.withColumn("step", F.lit(len(steps))))
        steps.append(last)
    return reduce(DataFrame.unionByName, steps)


def subject_export(log: DataFrame, start: DataFrame, references: Iterable[Reference], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All events of those rows, with the step at which each row was found."""
    rows = stage(subject_rows(log, start, references, stage))
    return log.join(rows, ["table_name", "object_id"])
