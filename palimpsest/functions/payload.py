"""Row images and diffs as JSON text and maps."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, functions as F

#: Nulls are kept, and timestamps keep their microseconds.
JSON_OPTIONS = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def row_json(row: Column) -> Column:
    return F.to_json(row, JSON_OPTIONS)


def value_text(value: Column, kind: str) -> Column:
    """A value as it stands in a diff: nested ones as JSON, others as text."""
    return row_json(value) if kind.startswith(("struct", "array", "map")) else value.cast("string")


def has_key(document: Column, name: str) -> Column:
    """Whether a JSON object has a key, be its value null or not."""
    return F.coalesce(F.array_contains(F.json_object_keys(document), name), F.lit(False))


def _map_or_null(entries: list[Column]) -> Column:
    """A map of the entries that are not null; null if there are none."""
    found = F.filter(F.array(*entries), lambda e: e.isNotNull())
    return F.when(F.size(found) > 0, F.map_from_entries(found))


def paired_diff(columns: dict[str, str], old: str, new: str, which: str) -> Column:
    """Map of field to (old, new). UPDATE has fields whose typed values are distinct, null and
    value being distinct; INSERT and DELETE have all fields, with one side null."""
    if not columns:
        return F.lit(None).cast("map<string,struct<old:string,new:string>>")
    nothing = F.lit(None).cast("string")

    def entry(name: str, kind: str) -> Column:
        before, after = F.col(f"{old}.{name}"), F.col(f"{new}.{name}")
        sides = {"INSERT": (nothing, value_text(after, kind)), "DELETE": (value_text(before, kind), nothing), "UPDATE": (value_text(before, kind), value_text(after, kind))}[which]
        pair = F.struct(F.lit(name).alias("key"), F.struct(sides[0].alias("old"), sides[1].alias("new")).alias("value"))
        # Maps cannot be compared, so their JSON is; everything else is compared by value.
        same = value_text(before, kind).eqNullSafe(value_text(after, kind)) if "map<" in kind else before.eqNullSafe(after)
        return pair if which != "UPDATE" else F.when(~same, pair)

    return _map_or_null([entry(name, kind) for name, kind in columns.items()])


def json_diff(old: Column, new: Column) -> Column:
    """The same for JSON objects: keys of the new one whose values differ; keys that only the old
    one has are not reported, a missing key differs from null. Each text is parsed once."""
    sides = F.struct(F.from_json(old, "map<string,string>").alias("old"), F.from_json(new, "map<string,string>").alias("new"))

    def changed(x: Column) -> Column:
        had = lambda k: F.coalesce(F.map_contains_key(x["old"], k), F.lit(False))
        differs = F.map_filter(x["new"], lambda k, v: ~(had(k) & x["old"][k].eqNullSafe(v)))
        return F.transform_values(differs, lambda k, v: F.struct(x["old"][k].alias("old"), v.alias("new")))

    found = F.transform(F.array(sides), changed)[0]
    return F.when(F.size(found) > 0, found)


def touches(field: str) -> Column:
    return F.coalesce(F.map_contains_key("diff", field), F.lit(False))


def diff_contains(field: str, side: str, value: str) -> Column:
    """Containment of one side of one field's change."""
    return F.coalesce(F.col("diff")[field][side] == value, F.lit(False))


def metadata_value(name: str, column: str = "metadata") -> Column:
    return F.get_json_object(column, f"$.{name}")


def metadata_user(column: Column) -> Column:
    """The user's number in metadata; anything that isn't a whole number gives null."""
    text = F.get_json_object(column, "$.user_id")
    return F.when(text.rlike(r"^\s*[+-]?[0-9]+\s*$"), text.try_cast("int"))


def hmac_hex(key: str, text: Column) -> Column:
    """HMAC-SHA256 of a text column, in hex. The plan shows the padded key: give it one that was
    derived for this use, not a master key."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ p for b in raw)) for p in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, text.cast("binary")), 256))), 256)
