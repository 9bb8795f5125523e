"""Events that the order of ids leaves tied get the same ids however their rows lie."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from palimpsest.sources.folders import fresh_folder
from palimpsest.sources.store import Engine

SCHEMA = "operation string, changed_at timestamp, object_id string, table_name string, user_id int, meta map<string,string>"


@pytest.mark.parametrize("tied", ["meta", "user_id"])
def test_tied_events_keep_their_ids(tied, spark):
    rows = [("UPDATE", datetime(2024, 1, 2), "7", "events", n if tied == "user_id" else None, {"event": str(n), "a": "b"} if tied == "meta" else None) for n in range(300)]
    found = []
    for turn in (rows, rows[::-1], sorted(rows, key=repr)[150:] + sorted(rows, key=repr)[:150]):
        engine = Engine(spark, fresh_folder(spark, "log"))
        engine.bootstrap()
        engine.append_events(spark.createDataFrame(turn, SCHEMA))
        number = F.col("meta")["event"].cast("int") if tied == "meta" else F.col("user_id")
        found.append(sorted(tuple(r) for r in engine.log.select("id", number).collect()))
    assert len({r[0] for r in found[0]}) == 300
    assert found[0] == found[1] == found[2]
