"""Corpus operators against brute force, with edge cases in one table."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import regex
from pyspark.sql import functions as F

import public_tokenizers
from palimpsest.llm import bpe, decontaminate, jaccard, langid, licenses, lines, pii, quality, queries, repeats, tiff

SCHEMA = "doc_id bigint, text string, lang string, source string, id string, n bigint"


@pytest.fixture(scope="module")
def docs(spark, data, tmp_path_factory):
    """The smallest documents, with nulls, empty, long and repeated texts, ties and clashing
    column names, read from files."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").collect()]
    base = rows[5][1]
    extra = [None, "", "  \n\n ", "One", "ONE", "a b c d e", "A b c d e", base, base + " more", base.replace("the", "thE", 3), "x" * 30_000, "ab " * 9_000, "é" * 60, "shared line of many words here 17\n" + "tail one", "shared line of many words here 18\n" + "tail two"]
    extra += [f"request {k} of user u{k} took {k} ms\nown words number {w} only" for k, w in enumerate(["red", "blue", "green", "pink", "grey", "gold", "teal"])]
    rows += [(100_000 + k, t) for k, t in enumerate(extra)]
    out = str(tmp_path_factory.mktemp("docs") / "d")
    spark.createDataFrame([(k, t, "en", None, "clash", 1) for k, t in rows], SCHEMA).write.parquet(out)
    return spark.read.schema(SCHEMA).parquet(out)


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] for r in docs.collect()}


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("empty") / "d")
    spark.createDataFrame([], SCHEMA).write.parquet(out)
    return spark.read.schema(SCHEMA).parquet(out)


def lowered(text):
    return (text or "").translate({c: c + 32 for c in range(65, 91)})


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def components(texts):
    sets = {k: shingle_set(t) for k, t in texts.items()}
    root = {k: k for k in sets}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = sorted(k for k in sets if sets[k])
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            both = len(sets[a] & sets[b])
            if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {k: (len(sets[k]), top(k)) for k in sets}


def test_jaccard(docs, texts, empty):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(docs).collect()}
    assert got == components(texts)
    assert jaccard.jaccard_components(empty).count() == 0


def test_jaccard_group_of_near_copies(spark, tmp_path):
    """Copies that link to one text but often not to each other, and a chain of links."""
    rng = np.random.default_rng(7)
    base = [f"w{i}" for i in range(200)]
    rows = [" ".join(base)]
    for k in range(60):
        words = list(base)
        for at in rng.choice(200, 4 if k % 3 else 7, replace=False):
            words[at] = f"x{k}_{at}"
        rows.append(" ".join(words))
    rows += [" ".join([f"c{i}" for i in range(k * 8, k * 8 + 120)]) for k in range(10)]
    texts = dict(enumerate(rows))
    spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").write.parquet(str(tmp_path / "d"))
    frame = spark.read.parquet(str(tmp_path / "d"))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(frame).collect()}
    assert got == components(texts)
    sets = {k: shingle_set(t) for k, t in texts.items()}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert {(r["a"], r["b"]) for r in jaccard.jaccard_pairs(frame).collect()} == want


def test_pseudonyms(spark, docs, texts, empty):
    rows = [(1, "card 4428353510103350, 4428 3535 1010 3350, no card 4428353510103351"), (2, "card 4428353510103350 +1 (244) 555-4688 9.8.7.6 999.1.1.1"), (3, "2024-02-29 3/14/1999 31.12.2001 2023-02-30 123-45-6789 000-12-1234"), (4, None), (5, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = pii.pseudonymise(df, "key")
    got = {r["doc_id"]: r for r in found.collect()}
    card = re.findall(r"\d{16}", got[1]["text"])[0]
    assert card in got[2]["text"] and card != "4428353510103350" and "4428353510103351" in got[1]["text"]
    digits = [int(c) for c in card][::-1]
    assert sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(digits)) % 10 == 0
    assert got[2]["kinds"] == "card,ip,phone" and "999.1.1.1" in got[2]["text"] and "9.8.7.6" not in got[2]["text"]
    assert got[3]["n_private"] == 4 and "2023-02-30" in got[3]["text"] and "000-12-1234" in got[3]["text"]
    assert got[4]["text"] is None and got[5]["text"] == "" and got[4]["n_private"] == 0
    back = {r["doc_id"]: r["text"] for r in pii.pseudonymise(found, "key", invert=True).collect()}
    assert back[1] == rows[0][1] and back[2] == rows[1][1] and back[3] == rows[2][1].replace("3/14/1999", "3/14/1999" if "3/14/1999" in back[3] else "03/14/1999")
    other = {r["doc_id"]: r["text"] for r in pii.pseudonymise(df, "other").collect()}
    assert other[1] != got[1]["text"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    whole = {r["doc_id"]: r for r in pii.pseudonymise(docs, "key").collect()}
    for k, t in texts.items():
        for mail in re.findall(r"[\w.]+@mail\d\.example\.com", t or ""):
            assert mail not in whole[k]["text"]
        if not re.search(r"[0-9@]", t or ""):
            assert whole[k]["text"] == t
    assert pii.pseudonymise(empty, "key").count() == 0


def test_feistel_permutes(spark):
    pairs = spark.range(21).select(pii.feistel((F.col("id") / 3).cast("bigint"), F.col("id") % 3, 7, 3, "k", "t").alias("p"))
    assert len({tuple(r["p"]) for r in pairs.collect()}) == 21


def test_bpe(docs, texts, empty):
    tiktoken = pytest.importorskip("tiktoken")
    import base64

    path = queries.RANK_FILE
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = bpe.bpe_decode(bpe.bpe_encode(docs, path), path).collect()
    assert len(got) == len(texts)
    for r in got:
        text = texts[r["doc_id"]] or ""
        ids = np.frombuffer(r["token_ids"], "<u4")
        if len(text) < 20_000:
            assert ids.tolist() == known.encode_ordinary(text)
        assert bytes(r["decoded"]) == text.encode() and r["n_tokens"] == len(ids)
    assert bpe.bpe_encode(empty, path).count() == 0


def test_split_pattern():
    pattern = regex.compile(public_tokenizers.PATTERN)
    rng = np.random.default_rng(3)
    alphabet = list("aZé9 \n\t'sdmrelv.,!٣你  ") + ["'re", "'ll", "  "]
    for _ in range(60):
        text = "".join(rng.choice(alphabet, rng.integers(0, 40)))
        data = np.frombuffer(text.encode(), np.uint8)
        cuts, _ = bpe.pretokenise(data, np.array([0, len(data)]))
        at = [*cuts.tolist(), len(data)]
        assert [text.encode()[a:b].decode() for a, b in zip(at, at[1:])] == pattern.findall(text)


def test_repeats(docs, texts, empty):
    seen: set[bytes] = set()
    want = {}
    for k in sorted(texts):
        b = (texts[k] or "").encode()
        own = [b[i : i + 50] for i in range(len(b) - 49)]
        gone = bytearray(len(b))
        for i, w in enumerate(own):
            if w in seen:
                gone[i : i + 50] = b"\1" * 50
        seen.update(own)
        kept = bytes(c for c, g in zip(b, gone) if not g)
        want[k] = (len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept)
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in repeats.remove_repeats(docs).collect()}
    assert got == want
    assert repeats.remove_repeats(empty).count() == 0


def test_run_index():
    rng = np.random.default_rng(1)
    parts = [bytes(rng.integers(97, 99, rng.integers(12, 30)).astype(np.uint8)) for _ in range(40)]
    text = np.frombuffer(b"".join(p + b"\xff" for p in parts), np.uint8)
    size = np.array([len(p) for p in parts])
    begin = np.cumsum(size + 1) - size - 1
    index = repeats.RunIndex(text, np.repeat(np.arange(40), size + 1), 12)
    assert index.n_runs < index.n
    for pattern, offset, document in index.first_documents(text, begin, begin + size, 12):
        for p, o, d in zip(pattern.tolist(), offset.tolist(), document.tolist()):
            piece = parts[p][o : o + 12]
            assert d == next(i for i, x in enumerate(parts) if piece in x)


def test_lines(docs, texts, empty):
    got = {r["doc_id"]: r for r in lines.drop_recurring_lines(docs, min_documents=5).collect()}
    assert len(got) == len(texts) and got[100_000]["text"] is None and got[100_001]["text"] == ""
    first = 100_015
    assert got[first]["text"] == texts[first]
    for k in range(1, 7):
        assert not got[first + k]["text"].startswith("request") and got[first + k]["n_lines_dropped"] >= 1
    for k, t in texts.items():
        assert got[k]["text"] is None or set(got[k]["text"].split("\n")) <= set((t or "").split("\n")) | {""}
    exact = Counter(x for t in texts.values() for x in {y for y in (t or "").split("\n") if len(y.split()) >= 4})
    for k, t in texts.items():
        for line in set((t or "").split("\n")):
            if exact[line] >= 5 and line in (got[k]["text"] or "").split("\n"):
                assert k == min(i for i, u in texts.items() if line in (u or "").split("\n"))
    assert lines.drop_recurring_lines(empty).count() == 0


def test_licenses(docs, texts, empty):
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    got = {r["doc_id"]: r for r in licenses.license_digest(licenses.license_scan(docs)).collect()}
    for k, t in texts.items():
        own = words.findall(lowered(t))
        places = [(i, label) for phrase, label in licenses.BASE_PHRASES.items() for i in range(len(own)) if own[i : i + len(phrase.split())] == phrase.split()]
        r = got[k]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(own), len(places), ",".join(sorted({x for _, x in places})))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
    fuzzy = licenses.Scanner({}, licenses.NOTICES).scan("relased under the mit lisense")
    assert fuzzy and fuzzy[0].label == "mit" and fuzzy[0].errors == 2
    assert licenses.license_scan(empty).count() == 0


def test_language(spark, data, empty):
    r = queries.op7_language_id(spark, data.replace("sf0.001", "sf0.01")).join(spark.read.parquet(f"{data.replace('sf0.001', 'sf0.01')}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null")
    right, n = r.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert n > 100 and right > 0.95
    model = langid.train(empty)
    assert langid.identify(empty, model).count() == 0
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "12 34 !")], "doc_id bigint, text string")
    assert {(x["lang_pred"], x["score"]) for x in langid.identify(odd, model).collect()} == {("und", 0.0)}


def test_tiff(docs, texts, empty):
    pages = tiff.tiff_pages(tiff.tiff_encode(docs)).collect()
    assert len(pages) == len(texts)
    for r in pages:
        b = (texts[r["doc_id"]] or "").encode()
        padded = b.ljust(max(1, -(-len(b) // 64)) * 64, b"\0")
        assert bytes(r["samples"]) == padded and r["n_bytes"] == len(b) and r["error"] is None
    assert tiff.tiff_pages(tiff.tiff_encode(empty)).count() == 0
    rng = np.random.default_rng(0)
    page = [rng.integers(0, 4, (33, 50)).astype(np.uint8), np.zeros((5, 7), np.uint8)]
    for compression in (tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS):
        for tile in (0, 16):
            file = tiff.write_tiff(page, compression, 2, 8, tile)
            back = [tiff.read_page(file, order, fields)[:, :, 0] for order, fields in tiff.directories(file)]
            assert all(np.array_equal(a, b) for a, b in zip(page, back)) and len(back) == 2
    long = rng.integers(0, 256, 20_000).astype(np.uint8).tobytes()
    assert tiff.lzw_decode(tiff.lzw_encode(long), len(long)) == long


def test_decontamination(spark, data, docs, texts, empty):
    words = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    benchmark = spark.read.parquet(f"{data}/benchmark.parquet")
    windows = {}
    for r in benchmark.collect():
        own = words.findall(lowered(r["text"]))
        for i in range(max(1, len(own) - 9) if own else 0):
            windows.setdefault(tuple(own[i : i + 10]), set()).add(str(r["item_id"]))
    got = {r["doc_id"]: r for r in decontaminate.contamination(decontaminate.phrase_matches(docs, benchmark)).collect()}
    for k, t in texts.items():
        own, hit, items = words.findall(lowered(t)), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(own) - size + 1):
                if found := windows.get(tuple(own[i : i + size])):
                    hit |= set(range(i, i + size))
                    items |= found
        r = got[k]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) == (len(own), len(hit), len(items), decontaminate.items_digest(items))
        assert r["contaminated"] == bool(hit)
    assert decontaminate.phrase_matches(empty, benchmark).count() == 0
    assert all(r["n_items"] == 0 for r in decontaminate.contamination(decontaminate.phrase_matches(docs, benchmark.limit(0))).collect())
    blocks = {r["doc_id"]: r["n_hit"] for r in decontaminate.contamination(decontaminate.phrase_matches(docs, benchmark, block_bytes=1500)).collect()}
    assert blocks == {k: r["n_hit"] for k, r in got.items()}


def test_quality(spark, data, empty):
    path = data.replace("sf0.001", "sf0.1")
    r = queries.op10_quality(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").where("held_out")
    right, n = r.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert n > 500 and right > 0.95
    stats = quality.document_statistics(empty)
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    model = quality.train(stats, labels)
    some = quality.document_statistics(spark.createDataFrame([(1, None), (2, "")], "doc_id bigint, text string"))
    assert [x["score"] for x in quality.score(some, model).collect()] == [0.5, 0.5]
    assert quality.pool_adjacent(np.ones(4), np.array([0, 0.6, 0.4, 1.0])).tolist() == [0, 0.5, 0.5, 1.0]


def test_held_out(spark):
    rows = spark.range(50).select("id", langid.held_out("id").alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in rows)


def test_pipeline(spark, data):
    import corpus_pipeline

    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        before = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
        docs = corpus_pipeline.written(stage(spark, docs, data), name)
        after = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert after <= set(before)
        if name == "ngram_jaccard_join":
            assert after == {k for k, (_, c) in components(before).items() if k == c}
        if name == "line_dedup":
            assert after == set(before)
        if name != "byte_level_bpe":
            assert docs.columns == columns
        else:
            for r in docs.collect():
                assert r["decoded_sha256"] == hashlib.sha256((before[r["doc_id"]] or "").encode()).hexdigest()
    assert corpus_pipeline.run(spark, data).count() == docs.count()
