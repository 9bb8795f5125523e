"""Who changed a row or field, when and why."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import render
from ..functions.payload import JSON_OPTIONS, has_key, touches
from ..identifiers import validate_identifier


def own_events(log: DataFrame, table: str, object_id: str, limit: int = 200) -> DataFrame:
    """A row's first events, oldest first."""
    validate_identifier(table, "table")
    return log.where((F.col("table_name") == table) & (F.col("object_id") == str(object_id))).orderBy("changed_at", "id").limit(limit)


def blame(log: DataFrame, contexts: DataFrame, table: str, object_id: str, field: str | None = None, limit: int = 200) -> DataFrame:
    """Events of a row, oldest first, with their context. The limit counts events of the row;
    narrowing to a field comes after it."""
    named = own_events(log, table, object_id, limit).join(contexts.select(F.col("id").alias("context_id"), "metadata"), "context_id", "left")
    if field is not None:
        keep = F.when(F.col("operation") == "UPDATE", touches(field)).when(F.col("operation") == "INSERT", has_key(F.col("new_data"), field)).when(F.col("operation") == "DELETE", has_key(F.col("old_data"), field))
        named = named.where(F.coalesce(keep, F.lit(False)))
    change = render.row_change(F.col("operation"), F.col("diff")) if field is None else render.field_change(F.col("operation"), F.col("diff")[field])
    return named.select(
        "id",
        "changed_at",
        "operation",
        "user_id",
        "context_id",
        "metadata",
        F.get_json_object("metadata", "$.change_reason").alias("change_reason"),
        "diff",
        render.actor(F.col("user_id"), F.col("metadata")).alias("actor"),
        change.alias("change"),
    ).orderBy("changed_at", "id")


def text_lines(found: DataFrame) -> DataFrame:
    """``id``, ``changed_at`` and an aligned ``line`` for each event; actors have the width of the longest."""
    width = found.agg(F.coalesce(F.max(F.length("actor")), F.lit(0))).scalar()
    padded = F.concat("actor", F.repeat(F.lit(" "), width - F.length("actor")))
    reason = F.when(F.col("change_reason") != "", F.concat(F.lit("  ("), "change_reason", F.lit(")"))).otherwise("")
    context = F.when(F.col("context_id").isNotNull(), F.concat(F.lit("  ctx="), F.substring("context_id", 1, 8))).otherwise("")
    whole = F.concat(F.date_format("changed_at", "yyyy-MM-dd HH:mm"), F.lit("  "), F.rpad("operation", 6, " "), F.lit("  "), padded, F.lit("  "), F.coalesce("change", F.lit("")), reason, context)
    return found.select("id", "changed_at", F.rtrim(whole).alias("line"))


def json_rows(found: DataFrame) -> DataFrame:
    """``id``, ``changed_at`` and each event as a JSON object with an ISO moment."""
    entry = F.struct("id", "changed_at", "operation", "user_id", "context_id", F.from_json("metadata", "map<string,string>").alias("metadata"), "change_reason", "diff", "actor")
    return found.select("id", "changed_at", F.to_json(entry, JSON_OPTIONS).alias("entry"))


def format_blame(found: DataFrame, table: str, object_id: str, fmt: str = "text", markup: bool = False) -> str:
    """Aligned lines under a header, or a JSON array; as many rows as ``blame`` was limited to."""
    if fmt == "json":
        return "[" + ", ".join(r["entry"] for r in json_rows(found).orderBy("changed_at", "id").collect()) + "]"
    lines = [r["line"] for r in text_lines(found).orderBy("changed_at", "id").collect()]
    text = "\n".join([f"{table}#{object_id}", *(lines or ["(no events found)"])])
    return text.replace("[", "\\[") if markup else text


def context_report(contexts: DataFrame, log: DataFrame) -> DataFrame:
    """Contexts with their source, user, reason and number of events."""
    counts = log.where(F.col("context_id").isNotNull()).groupBy("context_id").agg(F.count("*").alias("events"))
    value = lambda k: F.coalesce(F.get_json_object("metadata", f"$.{k}"), F.lit("—"))
    joined = contexts.join(counts, contexts["id"] == counts["context_id"], "left")
    return joined.select("id", value("source").alias("source"), value("username").alias("user"), value("change_reason").alias("reason"), F.coalesce("events", F.lit(0)).alias("events"))


def history_report(log: DataFrame, contexts: DataFrame) -> DataFrame:
    """Newest first, with source and reason of the context and a line for each field."""
    joined = log.join(contexts.select(F.col("id").alias("context_id"), "metadata"), "context_id", "left")
    return joined.select("id", "changed_at", "operation", F.get_json_object("metadata", "$.source").alias("source"), F.get_json_object("metadata", "$.change_reason").alias("reason"), render.change_lines(F.col("diff")).alias("changes")).orderBy(F.desc("changed_at"), F.desc("id"))


def image_changes(log: DataFrame) -> DataFrame:
    """Fields whose values differ between the images, over the union of their keys."""
    old, new = (F.coalesce(F.from_json(c, "map<string,string>"), F.create_map().cast("map<string,string>")) for c in ("old_data", "new_data"))
    pairs = F.map_zip_with(old, new, lambda _, a, b: F.struct(a.alias("old"), b.alias("new")))
    changed = F.map_filter(pairs, lambda _, v: ~v["old"].eqNullSafe(v["new"]))
    return log.select("id", "operation", F.explode(changed).alias("field", "change")).select("id", "operation", "field", "change.old", "change.new")


def labelled(found: DataFrame, lookup: DataFrame, key: str, label: str) -> DataFrame:
    """Replaces a key by its row's label; keys that have none stay as text."""
    names = lookup.select(F.col(key).cast("string").alias("_key"), F.col(label).alias("_label"))
    return found.join(names, found["value"] == names["_key"], "left").withColumn("value", F.coalesce("_label", "value")).drop("_key", "_label")
