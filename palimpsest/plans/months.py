"""Month partitions: every bound on time also bounds the partition column.

Months are those of UTC, whatever the session's zone. A datetime without a zone is UTC; a text
without one is in the session's zone, as anywhere in SQL.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType, TimestampNTZType

MONTH = "changed_month"


def utc(moment: datetime) -> datetime:
    return moment.replace(tzinfo=timezone.utc) if moment.tzinfo is None else moment.astimezone(timezone.utc)


def month_of(moment: Column, kind: DataType) -> Column:
    """The month in UTC; dates are formatted without a zone."""
    if isinstance(kind, TimestampNTZType):
        return F.date_format(moment, "yyyy-MM")
    days = F.floor(F.unix_micros(moment) / F.lit(86_400_000_000)).cast("int")
    return F.date_format(F.date_from_unix_date(days), "yyyy-MM")


def with_month(df: DataFrame) -> DataFrame:
    return df.withColumn(MONTH, month_of(F.col("changed_at"), df.schema["changed_at"].dataType))


def moment_column(at: datetime | str, kind: DataType) -> Column:
    """A moment as a constant of the log's type."""
    if isinstance(at, datetime):
        at = utc(at).replace(tzinfo=None).isoformat(sep=" ") + ("" if isinstance(kind, TimestampNTZType) else "+00:00")
    return F.lit(at).cast(kind)


def until(df: DataFrame, at: datetime | str) -> Column:
    """Events up to a moment, itself included; months after it are not read."""
    kind = df.schema["changed_at"].dataType
    moment = moment_column(at, kind)
    condition = F.col("changed_at") <= moment
    return condition & (F.col(MONTH) <= month_of(moment, kind)) if MONTH in df.columns else condition


def since(df: DataFrame, at: datetime | str, inclusive: bool = True) -> Column:
    kind = df.schema["changed_at"].dataType
    moment = moment_column(at, kind)
    condition = F.col("changed_at") >= moment if inclusive else F.col("changed_at") > moment
    return condition & (F.col(MONTH) >= month_of(moment, kind)) if MONTH in df.columns else condition


def before(df: DataFrame, at: datetime | str) -> Column:
    """Events before a moment; months after it are not read."""
    kind = df.schema["changed_at"].dataType
    moment = moment_column(at, kind)
    condition = F.col("changed_at") < moment
    return condition & (F.col(MONTH) <= month_of(moment, kind)) if MONTH in df.columns else condition
