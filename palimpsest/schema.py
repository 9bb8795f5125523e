"""Tables of the engine."""

from __future__ import annotations

from pyspark.sql import types as T

CHANGE = T.StructType([T.StructField("old", T.StringType()), T.StructField("new", T.StringType())])

AUDIT_LOG = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("operation", T.StringType(), False),
    T.StructField("changed_at", T.TimestampType(), False),
    T.StructField("object_id", T.StringType()),
    T.StructField("table_name", T.StringType(), False),
    T.StructField("user_id", T.IntegerType()),
    T.StructField("old_data", T.StringType()),
    T.StructField("new_data", T.StringType()),
    T.StructField("diff", T.MapType(T.StringType(), CHANGE)),
    T.StructField("context_id", T.StringType()),
    T.StructField("meta", T.MapType(T.StringType(), T.StringType())),
    T.StructField("row_hash", T.StringType()),
    T.StructField("prev_hash", T.StringType()),
    T.StructField("chain_seq", T.LongType()),
])

#: Versions of contexts; ``seq`` orders the versions of one id.
CONTEXT = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("metadata", T.StringType(), False),
    T.StructField("written_at", T.TimestampType(), False),
    T.StructField("seq", T.LongType(), False),
])

REGISTRY = T.StructType([
    T.StructField("name", T.StringType(), False),
    T.StructField("table_name", T.StringType(), False),
    T.StructField("checksum", T.StringType(), False),
    T.StructField("applied_at", T.TimestampType()),
    T.StructField("plan", T.StringType()),
])

OPERATIONS = ("INSERT", "UPDATE", "DELETE")
