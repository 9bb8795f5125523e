"""Shared parts of the registered queries: the test log in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A fixed moment stands for now, so that results can be compared.
NOW, AT = "2024-01-31 00:00:00", "2024-01-15 00:00:00"
#: The object whose history is asked for.
OBJECT = "7"

LOG = """
WITH e AS (SELECT *, LAG(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events),
o AS (SELECT *, CASE WHEN event_type = 'error' THEN CASE WHEN before IS NULL OR before = 'error' THEN NULL ELSE 'DELETE' END
                     WHEN before IS NULL OR before = 'error' THEN 'INSERT' ELSE 'UPDATE' END AS operation,
             CAST(regexp_extract(props, '-?[0-9]+') AS BIGINT) AS k FROM e),
c AS (SELECT *, LAG(event_type) OVER w AS last_type, LAG(value) OVER w AS last_value, LAG(k) OVER w AS last_k
      FROM o WHERE operation IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
audit AS (SELECT event_id AS id, operation, ts AS changed_at, epoch_us(ts) AS changed_us, CAST(user_id AS VARCHAR) AS object_id, user_id AS owner,
      CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 THEN CAST(user_id AS INTEGER) END AS user_id,
      CASE WHEN event_id % 5 <> 0 THEN md5(concat(CAST(user_id AS VARCHAR), '|', strftime(ts, '%Y-%m-%d'))) END AS context_id,
      CASE WHEN operation <> 'DELETE' THEN event_type END AS event_type, CASE WHEN operation <> 'DELETE' THEN value END AS value, CASE WHEN operation <> 'DELETE' THEN k END AS k,
      CASE WHEN operation <> 'INSERT' THEN last_type END AS old_type, CASE WHEN operation <> 'INSERT' THEN last_value END AS old_value, CASE WHEN operation <> 'INSERT' THEN last_k END AS old_k FROM c),
ctx AS (SELECT md5(concat(CAST(user_id AS VARCHAR), '|', day)) AS id, CAST(user_id AS VARCHAR) AS number, concat('u', CAST(user_id AS VARCHAR)) AS username, concat('day ', day) AS reason,
      CASE user_id % 3 WHEN 0 THEN 'http' WHEN 1 THEN 'job' ELSE 'shell' END AS source
      FROM (SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE event_id % 5 <> 0))
"""

#: Length and text of a value, as the hash chain writes it.
def sql_field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-;' ELSE concat(CAST(length({value}) AS VARCHAR), ':', {value}, ';') END"


def micros(column: str = "changed_at") -> Column:
    return F.unix_micros(F.col(column).cast("timestamp"))


def image(df: DataFrame, *more: str) -> DataFrame:
    """Typed columns of images (object_id, data)."""
    get = lambda n, k: F.get_json_object("data", f"$.{n}").cast(k).alias(n)
    return df.select("object_id", *more, get("event_type", "string"), get("value", "double"), get("k", "bigint"))


def event_columns() -> list[Column]:
    """Typed columns of events."""
    get = lambda side, n, k, name: F.get_json_object(side, f"$.{n}").cast(k).alias(name)
    return [
        F.col("id"), F.col("operation"), micros().alias("changed_us"), F.col("object_id"), F.col("user_id"), F.col("context_id"),
        get("new_data", "event_type", "string", "event_type"), get("new_data", "value", "double", "value"), get("new_data", "k", "bigint", "k"),
        get("old_data", "event_type", "string", "old_type"), get("old_data", "value", "double", "old_value"), get("old_data", "k", "bigint", "old_k"),
    ]


EVENT_SQL = "id, operation, changed_us, object_id, user_id, context_id, event_type, value, k, old_type, old_value, old_k"


class Registered:
    """Collects queries with their SQL."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None, log: bool = True):
        def add(function):
            name = function.__name__
            self.queries[name] = function
            if sql is not None:
                self.sql[name] = (LOG if log else "") + sql
            return function

        return add
