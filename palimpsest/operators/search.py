"""Substring search by trigrams.

The index has a row for each trigram and event that has it in its object's id or in a value of its
diff, sorted by trigram, and how often each trigram stands. A search looks at the rarest trigrams
of what it is asked for, keeps the events that have all of those, and reads their texts to be sure.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

GRAM = 3
#: As many of the rarest trigrams are intersected.
RAREST = 3


def texts() -> Column:
    """What is searched of an event: its object's id and both sides of its diff's values."""
    values = F.map_values("diff")
    sides = F.concat(F.transform(values, lambda v: v["old"]), F.transform(values, lambda v: v["new"]))
    return F.filter(F.concat(F.array("object_id"), F.coalesce(sides, F.array().cast("array<string>"))), lambda t: t.isNotNull())


def grams(text: Column) -> Column:
    """Distinct trigrams of a text."""
    places = F.when(F.length(text) >= GRAM, F.sequence(F.lit(1), F.length(text) - (GRAM - 1))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, F.lit(GRAM))))


def index(log: DataFrame) -> DataFrame:
    """``gram``, ``id``: to be written as it is sorted."""
    own = F.array_distinct(F.flatten(F.transform(texts(), grams)))
    return log.select("id", F.explode(own).alias("gram")).select("gram", "id").repartitionByRange("gram", "id").sortWithinPartitions("gram", "id")


def frequencies(postings: DataFrame) -> DataFrame:
    return postings.groupBy("gram").agg(F.count("*").alias("n"))


def search(log: DataFrame, postings: DataFrame, counts: DataFrame, text: str) -> DataFrame:
    """Events that have a text in their object's id or in a value of their diff. Shorter texts than a
    trigram are looked for in all events."""
    found = F.exists(texts(), lambda t: t.contains(text))
    wanted = sorted({text[i : i + GRAM] for i in range(len(text) - GRAM + 1)})
    if not wanted:
        return log.where(found)
    # At most as many rows as the text has trigrams.
    known = {r["gram"]: r["n"] for r in counts.where(F.col("gram").isin(wanted)).collect()}
    if len(known) < len(wanted):
        return log.where(F.lit(False))
    rare = sorted(wanted, key=lambda g: (known[g], g))[:RAREST]
    ids = postings.where(F.col("gram").isin(rare)).groupBy("id").agg(F.count("*").alias("_n")).where(F.col("_n") == len(rare)).select("id")
    return log.join(ids, "id", "left_semi").where(found)
