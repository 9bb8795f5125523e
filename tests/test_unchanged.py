"""Events that are like the ones before: updates that change nothing, which the SQL has as well."""

import os
from pathlib import Path

import duckdb
import pytest

from palimpsest import queries
from palimpsest.spec import Capture

from test_queries import TABLES, plain

NAMES = ("actor_label", "append_ids", "append_late", "append_merged", "append_stream_twice", "bulk_detection", "capture_in_context", "capture_log", "chain_log_build", "chain_log_legacy_rows", "drop_old_months", "event_counts_window",
         "blame_lines", "change_summary", "diff_exclude", "history_report", "log_condition_context", "log_condition_null_logs", "meta_projection", "stream_capture_equals_batch")


@pytest.fixture(scope="module")
def repeated(data, tmp_path_factory):
    """The smallest tables with some events twice in a row."""
    folder = tmp_path_factory.mktemp("repeated")
    for table in Path(data).glob("*.parquet"):
        if table.name != "events.parquet":
            os.symlink(table, folder / table.name)
    events = f"'{data}/events.parquet'"
    again = "event_id + 5000 AS event_id, ts + INTERVAL 1 MICROSECOND AS ts"
    duckdb.sql(f"COPY (SELECT * FROM {events} UNION ALL SELECT * REPLACE ({again}) FROM {events} WHERE event_id % 17 = 3 OR (user_id = 7 AND event_id % 3 = 0)) TO '{folder}/events.parquet'")
    return str(folder)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(name, spark, repeated):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{repeated}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, repeated), c.sql(queries.SQL[name])
    columns = sorted(got.columns)
    at = [want.columns.index(x) for x in columns]
    rows = sorted((tuple(plain(r[x]) for x in columns) for r in got.collect()), key=repr)
    assert rows == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_plans_tell_whether_unchanged_updates_are_kept():
    own, other = Capture("t").plan(), Capture("t", unchanged=True).plan()
    assert own.checksum != other.checksum and "unchanged" not in own.text
