"""Connected components of a table of links, by contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import join_counted, written


def connected(links: DataFrame) -> DataFrame:
    """``id`` and ``root`` of every id in ``links`` (a, b); ids of a component have one root.

    In each round every id moves to the least of itself and its neighbours in a hashed order and
    links follow; a hashed order shrinks paths as well as stars by a constant share a round. Hot
    ids only meet in a minimum that is pre-aggregated. Rounds are cut by written tables.
    """
    both = links.select("a", "b").where("a <> b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")).where("a <> b"))
    both = written(both.distinct(), "links")
    labels = None
    while both.limit(1).count():
        least = both.groupBy("a").agg(F.min(F.struct(F.xxhash64("b").alias("k"), F.col("b").alias("to"))).alias("m"), F.count("*").alias("members"))
        own = F.struct(F.xxhash64("a").alias("k"), F.col("a").alias("to"))
        moves = written(least.select(F.col("a").alias("id"), F.least("m", own)["to"].alias("root"), "members"), "moves")
        # Links stand in both directions, so an id has as many on either side.
        to = lambda c: moves.select(F.col("id").alias(c), F.col("root").alias(f"{c}_to"), "members")
        half = written(join_counted(both, to("a"), ["a"]), "half")
        both = written(join_counted(half, to("b"), ["b"]).select(F.col("a_to").alias("a"), F.col("b_to").alias("b")).where("a <> b").distinct(), "links")
        moves = moves.select("id", "root")
        if labels is None:
            labels = moves
        else:
            sizes = labels.groupBy("root").agg(F.count("*").alias("members"))
            again = written(moves.select(F.col("id").alias("root"), F.col("root").alias("next")).join(sizes, "root", "right").select("root", F.coalesce("next", "root").alias("next"), "members"), "again")
            labels = written(join_counted(labels, again, ["root"]).select("id", F.col("next").alias("root")), "labels")
    return labels if labels is not None else links.select(F.col("a").alias("id"), F.col("b").alias("root")).limit(0)
