"""Older diffs in today's form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

TEXTS = "map<string,string>"


def _paired(values: Column) -> Column:
    """Whether all values of a diff are objects of old and new; only what looks like an object is parsed."""
    sides = lambda v: F.array_sort(F.json_object_keys(v)) == F.array(F.lit("new"), F.lit("old"))
    return F.size(values).isNotNull() & F.forall(F.map_values(values), lambda v: F.coalesce(F.when(v.startswith("{"), sides(v)), F.lit(False)))


def is_paired(diff_json: str = "diff") -> Column:
    return F.transform(F.array(F.from_json(diff_json, TEXTS)), _paired)[0]


def paired(log: DataFrame, diff_json: str = "diff") -> DataFrame:
    """Diffs of new values only become pairs, with old values from the old image; paired ones
    stay. Running it twice changes nothing. The result's diff is a map. Each text is parsed once
    for a row: the parsed maps are rows of an explode, which later steps cannot be folded into."""
    texts = F.struct(*[F.from_json(c, TEXTS).alias(n) for n, c in (("values", diff_json), ("old", "old_data"), ("new", "new_data"))])
    x, nothing = F.col("_parsed"), F.lit(None).cast("string")
    side = lambda v, name: F.get_json_object(v, f"$.{name}")
    kept = F.transform_values(x["values"], lambda k, v: F.struct(side(v, "old").alias("old"), side(v, "new").alias("new")))
    pairs = (
        F.when(F.col("operation") == "UPDATE", F.transform_values(x["values"], lambda k, v: F.struct(F.when(x["old"].isNotNull(), x["old"][k]).alias("old"), v.alias("new"))))
        .when(F.col("operation") == "INSERT", F.transform_values(x["new"], lambda k, v: F.struct(nothing.alias("old"), v.alias("new"))))
        .when(F.col("operation") == "DELETE", F.transform_values(x["old"], lambda k, v: F.struct(v.alias("old"), nothing.alias("new"))))
    )
    upgraded = F.when(_paired(x["values"]), kept).otherwise(pairs)
    return log.withColumn("_parsed", F.explode(F.array(texts))).withColumn(diff_json, upgraded).drop("_parsed")
