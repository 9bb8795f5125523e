"""Images and diffs as VARIANT: binary JSON, whose paths are read without parsing a text.

Images come straight from typed rows; a log that has texts only parses each of them once.
Variants cannot be compared with ``=``, so values are brought to a form that can: numbers of any
kind by value, everything else as JSON.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: A diff: field to both sides, each a variant.
DIFF = "map<string, struct<old: variant, new: variant>>"
_NUMBER = "decimal(38,10)"


def captured(changes: DataFrame) -> DataFrame:
    """Change records (``OLD`` and ``NEW`` structs) with both images as variants."""
    side = lambda c: F.when(F.col(c).isNotNull(), F.to_variant_object(F.col(c)))
    return changes.withColumns({"old_image": side("OLD"), "new_image": side("NEW")})


def parsed(log: DataFrame) -> DataFrame:
    """A log's JSON texts as variants, each parsed once; what is no JSON gives null."""
    return log.withColumns({"old_image": F.try_parse_json("old_data"), "new_image": F.try_parse_json("new_data")})


def comparable(value: Column) -> Column:
    """A text that is equal for equal values: ``1`` and ``1.00`` are, ``1`` and ``"1"`` are not."""
    kind = F.schema_of_variant(value)
    number = kind.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)")
    exact = F.try_variant_get(value, "$", _NUMBER)
    return F.when(value.isNull(), None).when(number & exact.isNotNull(), F.concat(F.lit("#"), exact.cast("string"))).otherwise(F.to_json(value))


def diff(old: Column, new: Column) -> Column:
    """Fields of ``new`` whose values differ, with both; a missing field differs from a null one.
    Without differences, null."""
    sides = F.struct(old.cast("map<string,variant>").alias("old"), new.cast("map<string,variant>").alias("new"))

    def changed(x: Column) -> Column:
        had = lambda k: F.coalesce(F.map_contains_key(x["old"], k), F.lit(False))
        same = lambda k, v: had(k) & comparable(x["old"][k]).eqNullSafe(comparable(v))
        found = F.map_filter(x["new"], lambda k, v: ~same(k, v))
        return F.transform_values(found, lambda k, v: F.struct(x["old"][k].alias("old"), v.alias("new")))

    found = F.transform(F.array(sides), changed)[0]
    return F.when(F.size(found) > 0, found)


def value(field: str, side: str, kind: str = "string", column: str = "diff") -> Column:
    """One side of one field of a diff."""
    return F.try_variant_get(F.col(column)[field][side], "$", kind)


def contains(field: str, side: str, wanted: object, kind: str = "string", column: str = "diff") -> Column:
    return F.coalesce(value(field, side, kind, column) == F.lit(wanted), F.lit(False))


def path(image: str, where: str, kind: str = "string") -> Column:
    """A value at a path of an image."""
    return F.try_variant_get(F.col(image), where, kind)
