"""Every registered query of the core against its SQL, on the smallest data."""

import duckdb
import pytest

from palimpsest import queries

TABLES = ("nation", "customer", "orders", "lineitem", "events", "conversations")


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value if value is None or isinstance(value, (int, str, bool)) else str(value)


@pytest.fixture(scope="module")
def oracle(data):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{data}/{t}.parquet'")
    return c


#: The same functions under a second name.
SECOND = {n for n in queries.QUERIES if n.startswith("chain_") and not n.startswith("chain_log_") and n != "chain_switch"}


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - SECOND))
def test_query_equals_sql(name, spark, data, oracle):
    got = queries.QUERIES[name](spark, data)
    want = oracle.sql(queries.SQL[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    at = [want.columns.index(c) for c in columns]
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_plans(spark, data):
    from palimpsest.operators.timetravel import row_as_of, table_as_of
    from palimpsest.sources import testlog

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    log = testlog.log(spark, data)
    assert "WindowGroupLimit" in plan(table_as_of(log, "events", "2024-01-15 00:00:00"))
    assert "TakeOrderedAndProject" in plan(row_as_of(log, "events", "7", "2024-01-15 00:00:00"))
    assert "Python" not in plan(log) and "Arrow" not in plan(log)
