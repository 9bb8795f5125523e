"""What a retention rule leaves."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, functions as F

from ..functions.intervals import cutoff
from ..plans.months import moment_column, since, utc


def survivors(log: DataFrame, now: datetime, older_than: str) -> DataFrame:
    """Events that a purge keeps: those of the cutoff's moment and later."""
    return log.where(since(log, cutoff(now, older_than)))


def month_end(month: str) -> datetime | None:
    """The first moment after a month in UTC; none for what isn't a month."""
    try:
        first = datetime.strptime(month, "%Y-%m").replace(tzinfo=timezone.utc)
    except ValueError:
        return None
    return first.replace(year=first.year + (first.month == 12), month=first.month % 12 + 1)


def droppable_months(months: list[str], now: datetime, older_than: str) -> list[str]:
    """Months whose end is not after the cutoff; what isn't a month is never dropped."""
    edge = utc(cutoff(now, older_than))
    return [m for m in sorted(months) if (end := month_end(m)) is not None and end <= edge]


def lag_behind(log: DataFrame, now: datetime, older_than: str) -> DataFrame:
    """Seconds that the oldest event is older than the rule allows; negative if it is younger."""
    kind = log.schema["changed_at"].dataType
    edge = F.unix_micros(moment_column(cutoff(now, older_than), kind).cast("timestamp"))
    oldest = F.min(F.unix_micros(F.col("changed_at").cast("timestamp")))
    return log.agg(((edge - oldest) / 1_000_000).alias("seconds_behind"))
