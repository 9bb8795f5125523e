"""Quantiles and heavy hitters by month, kept as sketches that merge.

A month's sketch is made once, from its own events, in one pass with partial sketches before the
shuffle; any window of months is then a merge of a few rows, without the events.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.months import MONTH, with_month

#: Size of a quantile sketch; its ranks are off by about 1.33 % at this size (99 % confidence).
K, RANK_ERROR = 200, 0.0133
#: Items that a heavy-hitter sketch follows.
TRACKED = 10_000


def by_month(log: DataFrame, value: Column | str, by: str) -> DataFrame:
    """A sketch of a number for each month and group."""
    rows = log if MONTH in log.columns else with_month(log)
    number = (F.col(value) if isinstance(value, str) else value).cast("double")
    return rows.groupBy(MONTH, by).agg(F.kll_sketch_agg_double(number, F.lit(K)).alias("sketch"), F.count(number).alias("n"))


def merged(sketches: DataFrame, by: str, first: str | None = None, last: str | None = None) -> DataFrame:
    """One sketch a group over a window of months, both ends included."""
    if first is not None:
        sketches = sketches.where(F.col(MONTH) >= first)
    if last is not None:
        sketches = sketches.where(F.col(MONTH) <= last)
    return sketches.where(F.col("n") > 0).groupBy(by).agg(F.kll_merge_agg_double("sketch", F.lit(K)).alias("sketch"), F.sum("n").alias("n"))


def quantiles(one: DataFrame, by: str, ranks: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """A row for each group and rank."""
    asked = F.array(*[F.lit(float(r)) for r in ranks])
    each = F.arrays_zip(asked.alias("rank"), F.kll_sketch_get_quantile_double("sketch", asked).alias("value"))
    return one.select(by, "n", F.explode(each).alias("x")).select(by, "n", "x.rank", "x.value")


def rank_errors(estimates: DataFrame, log: DataFrame, value: Column | str, by: str) -> DataFrame:
    """How far the exact ranks of estimated values are from those asked for: a value has all ranks
    from the share below it to the share up to it."""
    number = (F.col(value) if isinstance(value, str) else value).cast("double")
    rows = log.select(F.col(by), number.alias("_x")).where(F.col("_x").isNotNull()).groupBy(by, "_x").agg(F.count("*").alias("_n"))
    counts = rows.join(F.broadcast(estimates.select(by, "rank", "value")), by).groupBy(by, "rank", "value").agg(
        F.sum(F.when(F.col("_x") < F.col("value"), F.col("_n")).otherwise(0)).alias("_below"), F.sum(F.when(F.col("_x") <= F.col("value"), F.col("_n")).otherwise(0)).alias("_up_to"), F.sum("_n").alias("n")
    )
    low, high = F.col("_below") / F.col("n"), F.col("_up_to") / F.col("n")
    return counts.select(by, "rank", "value", "n", F.greatest(F.lit(0.0), low - F.col("rank"), F.col("rank") - high).alias("rank_error"))


def hitters_by_month(log: DataFrame, item: str) -> DataFrame:
    """A sketch of the most frequent items of each month."""
    rows = log if MONTH in log.columns else with_month(log)
    return rows.groupBy(MONTH).agg(F.expr(f"approx_top_k_accumulate({item}, {TRACKED})").alias("sketch"))


def top_items(sketches: DataFrame, k: int) -> DataFrame:
    """The ``k`` most frequent items over all months of some sketches, with their counts: exact up
    to ``TRACKED`` different items, too high by a bounded share beyond."""
    one = sketches.agg(F.expr(f"approx_top_k_combine(sketch, {TRACKED})").alias("sketch"))
    return one.select(F.explode(F.expr(f"approx_top_k_estimate(sketch, {k})")).alias("x")).select("x.*")
