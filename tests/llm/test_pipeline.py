"""Every stage of the pipeline against a plain version, on odd rows, and on an empty table."""

import hashlib
import re

import pytest

import corpus_pipeline
from palimpsest.llm import langid
from test_operators import components

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, items string, score double, _id string, terms string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))


@pytest.fixture(scope="module")
def folder(spark, data, tmp_path_factory):
    """Documents with clashing columns, nulls, empty texts and repeated rows, and the benchmark."""
    out = str(tmp_path_factory.mktemp("sf") / "sf")
    rows = [(r["doc_id"], r["text"], r["lang"], r["source"], r["n_chars"]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    base = rows[0]
    rows += [base, base, (None, base[1], "aa", None, None), (base[0], "a text of its own under a key that is there already " * 3, base[2], None, 1), (None, None, None, None, None), (900, "", "aa", "s", 0)]
    rows = [(*r, f"i{k % 3}", 0.5, "x", None) for k, r in enumerate(rows)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.read.parquet(f"{data}/benchmark.parquet").write.parquet(f"{out}/benchmark.parquet")
    return out


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    spans = langid.identify(docs, langid.train(docs), keep=("doc_id", "text")).collect()
    right = {(r["doc_id"], r["text"]) for r in spans if r["lang_pred"] != "und" and r["score"] >= 0.5}
    kept = corpus_pipeline.language_stage(spark, docs, folder)
    assert kept.columns == columns and rows_of(kept) == [r for r in rows_of(docs) if (r[0], r[1]) in right]
    assert {r[8] for r in rows_of(kept)} == {None} and {r[6] for r in rows_of(kept)} == {0.5}

    docs = corpus_pipeline.written(docs, "again")  # all rows, nulls and all
    cut = corpus_pipeline.line_stage(spark, docs, folder)
    assert cut.columns == columns and cut.count() == docs.count() and all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in cut.collect())

    one = rows_of(corpus_pipeline.near_duplicate_stage(spark, docs, folder))
    numbered = rows_of(docs)
    component = components(dict(enumerate(r[1] for r in numbered)))
    want: dict[int, tuple] = {}
    for k, r in enumerate(numbered):
        n, root = component[k]
        rank = (r[0] is None, r[0], hashlib.md5((r[1] or "").encode()).hexdigest())
        if n == 0:
            want[-1 - k] = (rank, r)
        elif root not in want or rank < want[root][0]:
            want[root] = (rank, r)
    key = lambda rows: sorted(((r[0], r[1]) for r in rows), key=repr)
    assert key(one) == key(r for _, r in want.values()) and set(one) <= set(numbered)

    phrases = {tuple(w[i : i + 10]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect() if (w := words(r["text"])) for i in range(max(1, len(w) - 9))}
    sizes = {len(p) for p in phrases}
    clean = [r for r in rows_of(docs) if not any(tuple(w[i : i + n]) in phrases for w in [words(r[1])] for n in sizes for i in range(len(w) - n + 1))]
    assert rows_of(corpus_pipeline.decontamination_stage(spark, docs, folder)) == clean

    last = corpus_pipeline.token_stage(spark, docs, folder)
    assert last.count() == docs.count() and last.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_empty_table(spark, folder, data, tmp_path):
    spark.read.parquet(f"{folder}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    spark.read.parquet(f"{data}/benchmark.parquet").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
