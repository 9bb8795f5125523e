"""Short texts for people: actors, changes and values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

NOTHING, LONGEST, CUT = "∅", 40, 37


def actor(user_id: Column, metadata: Column) -> Column:
    """User with name, user, name alone, source, or the system."""
    name, source = F.get_json_object(metadata, "$.username"), F.get_json_object(metadata, "$.source")
    number = user_id.cast("string")
    return F.coalesce(
        F.when(number.isNotNull() & name.isNotNull(), F.concat(F.lit("user="), number, F.lit(" ("), name, F.lit(")"))),
        F.concat(F.lit("user="), number),
        F.concat(F.lit("user="), name),
        F.concat(F.lit("source="), source),
        F.lit("system"),
    )


def value(text: Column) -> Column:
    """Null as a sign, long texts cut, quoted."""
    short = F.when(F.length(text) > LONGEST, F.concat(F.substring(text, 1, CUT), F.lit("..."))).otherwise(text)
    return F.when(text.isNull(), F.lit(NOTHING)).otherwise(F.concat(F.lit('"'), F.regexp_replace(F.regexp_replace(short, r"\\", r"\\\\"), '"', r'\\"'), F.lit('"')))


def field_change(operation: Column, change: Column) -> Column:
    return (
        F.when(operation == "INSERT", F.concat(F.lit("→ "), value(change["new"])))
        .when(operation == "DELETE", F.concat(value(change["old"]), F.lit(" → "), F.lit(NOTHING)))
        .otherwise(F.concat(value(change["old"]), F.lit(" → "), value(change["new"])))
    )


def row_change(operation: Column, diff: Column) -> Column:
    count = F.coalesce(F.size(diff), F.lit(0)).cast("string")
    return (
        F.when(operation == "INSERT", F.concat(F.lit("inserted ("), count, F.lit(" fields)")))
        .when(operation == "DELETE", F.concat(F.lit("deleted ("), count, F.lit(" fields)")))
        .otherwise(F.concat(F.lit("changed: "), F.array_join(F.array_sort(F.map_keys(diff)), ", ")))
    )


def change_lines(diff: Column) -> Column:
    """One line for each field: name, old value, new value."""
    entries = F.array_sort(F.map_entries(diff))
    return F.transform(entries, lambda e: F.concat(e["key"], F.lit(": "), value(e["value"]["old"]), F.lit(" → "), value(e["value"]["new"])))


def escape_markup(text: Column) -> Column:
    return F.replace(text, F.lit("["), F.lit("\\["))
