"""The index by words against brute force, and against the search that looks at each document by itself."""

import numpy as np
import pytest

from palimpsest.llm import decontaminate, postings
from test_decontaminate import EDITS, PHRASE, near


def rows(frame):
    return sorted((tuple(r) for r in frame.collect()), key=repr)


@pytest.mark.parametrize("values", [[], [0], [127, 128, 0, 16_383, 16_384, (1 << 35) + 5, 1], list(range(0, 70_000, 7))])
def test_numbers_come_back(values):
    data, size = postings.to_bytes(np.array(values, np.int64))
    back, last = postings.from_bytes(data)
    assert back.tolist() == values and (np.cumsum(size) - 1).tolist() == last.tolist()


def test_lists_hold_every_position(spark, monkeypatch):
    monkeypatch.setattr(postings, "STEP_BYTES", 64)
    texts = ["a b a", None, "", "the " * 400 + "end", "b", "a b a"]
    index = postings.store_index(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").coalesce(1))
    sizes = [3, 0, 0, 401, 1, 3]
    assert [r["n_words"] for r in index.documents.orderBy("kept.k0").collect()] == sizes
    found = sorted((r["block"], r["n"], postings.from_bytes(np.frombuffer(r["positions"], np.uint8))[0].cumsum().tolist()) for r in index.lists.where("term <> 0").collect())
    assert sum(n for _, n, _ in found) == sum(sizes) and all(n == len(p) for _, n, p in found)
    assert any(p == list(range(400)) or p == list(range(3, 403)) for _, _, p in found)


def test_proximity_of_any_word(spark):
    rng = np.random.default_rng(4)
    texts = [*EDITS.values(), PHRASE[::-1], PHRASE[:7], ["so", *PHRASE, "it"]]
    texts += [[PHRASE[j] if j < 10 else f"w{j}" for j in rng.integers(0, 12, 30)] for _ in range(300)]
    # Most words one or two places off, a common one at its place.
    texts += [[PHRASE[j] for j in np.argsort(np.arange(10) + rng.uniform(-2, 2, 10)).tolist()] for _ in range(100)]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id bigint, text string")
    found = postings.search(postings.store_index(docs), spark.createDataFrame([(1, " ".join(PHRASE))], "item_id bigint, text string"))
    got = {r["doc_id"]: (bool(r["items"]), bool(r["near_items"])) for r in found.collect()}
    for k, (text, want) in enumerate(zip(texts, near(texts))):
        whole = any(text[i : i + 10] == PHRASE for i in range(len(text)))
        assert got[k] == (whole, want and not whole), text


def test_exact_matches_equal_those_by_document(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text")
    long = " ".join(r["text"] for r in docs.limit(60).collect())
    odd = spark.createDataFrame([(None, None), (-1, ""), (-2, long), (-2, long), (7, "7 ..."), (-3, "é" * 9000)], "doc_id bigint, text string")
    docs = decontaminate.written(docs.unionByName(odd), "docs")
    benchmark = spark.read.parquet(f"{data}/benchmark.parquet").select("item_id", "text")
    more = spark.createDataFrame([(None, "of the"), ("same", "of the"), ("none", None), ("blank", " . "), ("one", "é" * 9000), ("absent", "zzzz yyyy")], "item_id string, text string")
    benchmark = benchmark.select(benchmark["item_id"].cast("string"), "text").unionByName(more)
    want = rows(decontaminate.phrase_matches(docs, benchmark).drop("near_items"))
    near_rows = decontaminate.phrase_matches(docs, benchmark).select("doc_id", "near_items").collect()
    monkeypatch.setattr(postings, "STEP_BYTES", 20_000)
    index = postings.store_index(docs)
    found = postings.search(index, benchmark)
    assert rows(found.drop("near_items")) == want and any(r[2] for r in want)
    assert {(r["doc_id"], x) for r in near_rows for x in r["near_items"]} <= {(r["doc_id"], x) for r in found.collect() for x in r["near_items"]}
    # Several blocks of the benchmark, and another benchmark over the same index.
    assert rows(postings.search(index, benchmark, block_bytes=2000)) == rows(found)
    assert rows(postings.search(index, more).drop("near_items")) == rows(decontaminate.phrase_matches(docs, more).drop("near_items"))
    assert not any(r["hit_spans"] or r["near_items"] for r in postings.search(index, benchmark.limit(0)).collect())


def test_clashing_columns_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 7, 8, 9), (1, "a b", "x", 7, 8, 9), (None, None, None, None, None, None)], "doc_id bigint, text string, items string, n bigint, block bigint, term bigint")
    benchmark = spark.createDataFrame([(1, "a b"), (1, "a b")], "item_id bigint, text string")
    found = postings.search(postings.store_index(docs, keep=tuple(docs.columns)), benchmark)
    assert found.columns == ["doc_id", "text", "n", "block", "term", "n_words", "hit_spans", "items", "near_items"]
    assert rows(found)[:2] == [(1, "a b", 7, 8, 9, 2, [(0, 2)], ["1"], [])] * 2 and rows(found)[2][5:] == (0, [], [], [])
    assert postings.search(postings.store_index(docs.where("false")), benchmark).count() == 0
