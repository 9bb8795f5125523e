"""Quantiles are exact over any number of values."""

from pyspark.sql import functions as F

from palimpsest.operators.metrics import latency_quantiles
from palimpsest.queries.logs import made_once
from palimpsest.queries.reports import value_quantiles


def found(rows):
    return {r[0]: tuple(r)[1:] for r in latency_quantiles(rows, "value", "g", made_once).collect()}


def test_more_values_than_a_sketch_keeps(spark, tmp_path):
    n = 60_000
    kind = F.when(F.col("id") < n, "a").alias("event_type")
    spark.range(2 * n).select(kind, (F.col("id") * 7919 % n).cast("double").alias("value")).repartition(7).write.parquet(f"{tmp_path}/events.parquet")
    exact = tuple(float(n * percent // 100 - 1) for percent in (50, 95, 99))
    assert sorted(map(tuple, value_quantiles(spark, str(tmp_path)).collect()), key=str) == [("a", *exact), (None, *exact)]


def test_odd_values(spark):
    nan, inf = float("nan"), float("inf")
    groups = {"one": [3.0], "none": [None, None], "some": [None, 5.0, 5.0, 1.0], "far": [-inf, 0.0, inf], "twenty": [float(x) for x in range(20)] + [None] * 9, "nan": [1.0, nan]}
    got = found(spark.createDataFrame([(g, v) for g, values in groups.items() for v in values], "g string, value double"))
    assert got.pop("nan")[0] == 1.0
    assert got == {"one": (3.0,) * 3, "none": (None,) * 3, "some": (5.0,) * 3, "far": (0.0, inf, inf), "twenty": (9.0, 18.0, 19.0)}


def test_no_rows(spark):
    assert found(spark.createDataFrame([], "g string, value double")) == {}
