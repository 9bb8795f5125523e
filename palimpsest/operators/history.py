"""A composable query over the log."""

from __future__ import annotations

from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import payload
from ..plans.months import since, until


class History:
    """Filters that chain; ``df`` is the lazy result."""

    def __init__(self, log: DataFrame):
        self.df = log

    def filter(self, condition: Column | str) -> History:
        return History(self.df.where(condition))

    def by_table(self, table: str) -> History:
        return self.filter(F.col("table_name") == table)

    for_model = by_table

    def for_object(self, table: str, pk: Any) -> History:
        return self.by_table(table).filter(F.col("object_id") == str(pk))

    def for_user(self, user_id: int | None) -> History:
        return self.filter(F.col("user_id").isNull() if user_id is None else F.col("user_id") == int(user_id))

    def for_context(self, context_id: Any) -> History:
        return self.filter(F.col("context_id") == str(context_id))

    def operation(self, *operations: str) -> History:
        return self.filter(F.col("operation").isin(*operations))

    def touching(self, field: str) -> History:
        return self.filter(payload.touches(field))

    def changed(self, field: str, side: str, value: str) -> History:
        return self.filter(payload.diff_contains(field, side, value))

    def since(self, at: datetime | str) -> History:
        return self.filter(since(self.df, at))

    def until(self, at: datetime | str) -> History:
        return self.filter(until(self.df, at))

    def within(self, seconds: float, now: Column | None = None) -> History:
        moment = now if now is not None else F.current_timestamp()
        return self.filter(F.col("changed_at") > moment - F.make_dt_interval(secs=F.lit(seconds)))

    def object_contains(self, text: str) -> History:
        return self.filter(F.col("object_id").contains(text))

    def table_like(self, pattern: str) -> History:
        """LIKE with ``#`` as escape."""
        quoted = pattern.replace("'", "''")
        return self.filter(F.expr(f"table_name LIKE '{quoted}' ESCAPE '#'"))

    def recent(self, limit: int = 100) -> DataFrame:
        return self.df.orderBy(F.desc("changed_at"), F.desc("id")).limit(limit)

    def page(self, number: int, size: int = 20) -> DataFrame:
        """Newest first; pages before the first are the first, those beyond the last the last."""
        pages = max(1, -(-self.df.count() // size))
        number = min(max(1, number), pages)
        return self.df.orderBy(F.desc("changed_at"), F.desc("id")).offset((number - 1) * size).limit(size)

    def trail(self, context_id: Any) -> DataFrame:
        return self.for_context(context_id).df.orderBy("changed_at", "id")

    def facets(self) -> DataFrame:
        return self.df.groupBy("table_name", "operation").count()

    def with_context(self, contexts: DataFrame) -> DataFrame:
        return self.df.join(contexts.select(F.col("id").alias("context_id"), "metadata"), "context_id", "left")

    def linked_to(self, contexts: DataFrame, key: str, value: str) -> DataFrame:
        """Events whose context has a metadata value; the null-rejecting filter makes it inner."""
        return self.with_context(contexts).where(payload.metadata_value(key) == value)

    def of_subjects(self, ids: DataFrame) -> DataFrame:
        """All events of the objects listed in ``ids`` (object_id)."""
        return self.df.join(ids.select("object_id"), "object_id", "left_semi")
