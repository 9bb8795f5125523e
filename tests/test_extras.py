"""Variants, sketches, trigram search, linked export and ordered streams on small cases."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from palimpsest.operators import linked, search, sketches, variants
from palimpsest.streaming.ordered import ordered_changes, state_with_timers

LOG = "id bigint, object_id string, diff map<string, struct<old: string, new: string>>"


def test_variant_diffs_by_value(spark):
    rows = [
        ('{"a": 1, "b": "x", "c": null, "d": {"e": [1, 2]}}', '{"a": 1.00, "b": "y", "c": null, "d": {"e": [1, 2]}}', {"b"}),
        ('{"a": 1}', '{"a": "1", "n": null}', {"a", "n"}),
        ('{"a": null}', '{"a": 0}', {"a"}),
        ('{"a": 1, "gone": 2}', '{"a": 1}', None),
        (None, '{"a": 1}', {"a"}),
        ('{"a": 1}', None, None),
        ("no json", "{", None),
        ('{"a": 123456789012345678901}', '{"a": 123456789012345678902}', {"a"}),
    ]
    df = variants.parsed(spark.createDataFrame([(o, n) for o, n, _ in rows], "old_data string, new_data string"))
    found = df.select(F.map_keys(variants.diff(F.coalesce("old_image", F.parse_json(F.lit("{}"))), F.col("new_image"))).alias("k")).collect()
    assert [set(r["k"]) if r["k"] is not None else None for r in found] == [k for _, _, k in rows]


def test_sketches_of_months_merge(spark):
    rng = random.Random(1)
    rows = [(datetime(2024, 1 + i % 5, 3), "a" if i % 3 else "b", rng.gauss(0, 1) if i % 17 else None) for i in range(30_000)]
    log = spark.createDataFrame(rows, "changed_at timestamp, g string, v double")
    kept = sketches.by_month(log, "v", "g").cache()
    assert kept.count() == 10
    found = sketches.quantiles(sketches.merged(kept, "g", "2024-02", "2024-04"), "g", (0.0, 0.1, 0.5, 0.99, 1.0))
    window = log.where("month(changed_at) between 2 and 4")
    errors = sketches.rank_errors(found, window, "v", "g").collect()
    assert len(errors) == 10 and max(r["rank_error"] for r in errors) < 2 * sketches.RANK_ERROR
    assert {(r["g"], r["n"]) for r in errors} == {(r["g"], r["n"]) for r in window.where("v is not null").groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert sketches.merged(kept.limit(0), "g").count() == 0


def test_search_equals_a_scan(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abé ") for _ in range(rng.randrange(0, 9)))
    rows = [(i, rng.choice([word(), None]), rng.choice([None, {}, {"f": (word(), None)}, {"f": (None, word()), "g": (word(), word())}])) for i in range(400)]
    log = spark.createDataFrame(rows, LOG)
    postings = search.index(log).cache()
    counts = search.frequencies(postings).cache()
    for text in ("", "a", "ab", "abé", "aba", "é a ", "bbbb", "zzz"):
        want = [i for i, o, d in rows if any(text in t for t in [o, *(x for v in (d or {}).values() for x in v)] if t is not None)]
        got = search.search(log, postings, counts, text).select("id").collect()
        assert sorted(r["id"] for r in got) == want, text


def test_links_in_a_cycle_and_of_old_values(spark):
    rows = [
        ("a", "1", None, '{"b": 1}'), ("b", "1", None, '{"a": 2}'), ("a", "2", '{"b": 1}', '{"b": 9}'), ("b", "9", None, '{"a": 7}'),
        ("a", "3", None, '{"b": 8}'), ("a", "4", None, None), ("c", "1", None, '{"a": 1, "b": 1}'), ("b", None, None, '{"a": 1}'),
    ]
    log = spark.createDataFrame(rows, "table_name string, object_id string, old_data string, new_data string")
    references = [linked.Reference("a", "b", "b"), linked.Reference("b", "a", "a"), linked.Reference("c", "a", "a")]
    start = spark.createDataFrame([("b", 1)], "table_name string, object_id int")
    found = {(r["table_name"], r["object_id"]): r["step"] for r in linked.subject_rows(log, start, references, lambda df: df.cache()).collect()}
    assert found == {("b", "1"): 0, ("a", "1"): 1, ("a", "2"): 1, ("c", "1"): 2}
    assert linked.subject_export(log, start.limit(0), references, lambda df: df.cache()).count() == 0


def test_images_out_of_order_over_restarts(spark, tmp_path):
    """Every run takes what files there are; state and timers outlive it. An image behind the
    watermark is left out."""
    schema = "id bigint, v string, changed_at timestamp, deleted boolean"
    start = datetime(2024, 1, 1)
    batches = [
        [(1, "a", 0, False), (1, "c", 20, False), (2, "x", 5, False)],
        [(1, "b", 10, False), (2, None, 15, True), (2, "y", 18, False)],
        [(1, "c", 30, False), (1, "d", 500, False)],
        [(1, "too late", 40, False), (3, None, 9_000, True)],
    ]
    got = []

    def keep(batch, _):
        got.extend((r["object_id"], r["operation"], (r["changed_at"] - start).total_seconds() / 60, r["old_data"], r["new_data"]) for r in batch.collect())

    for k, rows in enumerate(batches):
        spark.createDataFrame([(i, v, start + timedelta(minutes=m), d) for i, v, m, d in rows], schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"b={k}"))
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
        with state_with_timers(spark):
            query = ordered_changes(stream, "60 minutes").writeStream.option("checkpointLocation", str(tmp_path / "check")).foreachBatch(keep).trigger(availableNow=True).start()
            query.awaitTermination()
    image = lambda i, v: f'{{"id":{i},"v":"{v}"}}'
    assert sorted(got, key=repr) == sorted([
        ("1", "INSERT", 0, None, image(1, "a")), ("1", "UPDATE", 10, image(1, "a"), image(1, "b")), ("1", "UPDATE", 20, image(1, "b"), image(1, "c")), ("1", "UPDATE", 500, image(1, "c"), image(1, "d")),
        ("2", "INSERT", 5, None, image(2, "x")), ("2", "DELETE", 15, image(2, "x"), None), ("2", "INSERT", 18, None, image(2, "y")),
    ], key=repr)
