"""Several blocks of the benchmark give the same rows as one."""

import pytest

from palimpsest.llm import decontaminate


@pytest.mark.parametrize("keep", [("doc_id",), ("doc_id", "text")])
def test_blocks_keep_equal_rows_apart(spark, keep):
    a = "one two three four five six seven eight nine ten"
    b = "red blue green pink grey gold teal lime rust sand"
    docs = spark.createDataFrame([(1, a), (1, a), (1, f"so {b} it is"), (2, "clean"), (2, "clean"), (3, None)], "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(7, a), (8, a), (None, a), (9, b), *((k, f"other item {k}") for k in range(20, 40))], "item_id bigint, text string")

    def found(block_bytes):
        matches = decontaminate.phrase_matches(docs, benchmark, keep=keep, block_bytes=block_bytes)
        return sorted((tuple(r) for r in matches.collect()), key=repr)

    one = found(1 << 20)
    assert len(one) == 6 and found(64) == one
    assert [r[-2] for r in one if r[0] == 1] == [["7", "8"], ["7", "8"], ["9"]]


def test_repeated_items_are_one_text(spark):
    benchmark = spark.createDataFrame([(k, "the same words again") for k in range(500)], "item_id bigint, text string")
    (block,) = decontaminate.blocks_of(decontaminate.benchmark_items(benchmark, "item_id", "text"), 1 << 20)
    assert len(block.names) == 1 and len(block.names[0]) == 500


PHRASE = "one two three four five six seven eight nine ten".split()
EDITS = {
    "put in": [*PHRASE[:5], "extra", *PHRASE[5:]],
    "left out": PHRASE[:4] + PHRASE[5:],
    "replaced": [*PHRASE[:3], "other", *PHRASE[4:8], "word", PHRASE[9]],
    "swapped": [*PHRASE[:4], PHRASE[5], PHRASE[4], *PHRASE[6:]],
}


def near(texts, **more):
    """Brute force: a word at its place, and eight of the ten within three words of theirs."""
    out = []
    for words in texts:
        found = any(sum(any(0 <= s + k + d < len(words) and words[s + k + d] == PHRASE[k] for d in range(-3, 4)) for k in range(10)) >= 8 for s in range(-9, len(words)) if any(0 <= s + k < len(words) and words[s + k] == PHRASE[k] for k in range(10)))
        out.append(found)
    return out


def test_proximity(spark):
    rng = __import__("numpy").random.default_rng(4)
    texts = [*EDITS.values(), PHRASE[::-1], PHRASE[:7], ["so", *PHRASE, "it"]]
    texts += [[PHRASE[j] if j < 10 else f"w{j}" for j in rng.integers(0, 14, 30)] for _ in range(200)]
    docs = spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(texts)], "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(1, " ".join(PHRASE))], "item_id bigint, text string")
    got = {r["doc_id"]: (bool(r["items"]), bool(r["near_items"])) for r in decontaminate.phrase_matches(docs, benchmark).collect()}
    want = near(texts)
    assert all(want[: len(EDITS)]) and not want[len(EDITS)]
    for k, text in enumerate(texts):
        whole = any(text[i : i + 10] == PHRASE for i in range(len(text)))
        assert got[k][0] == whole
        # A match may be found from one of the three rarest words only; the brute force takes any word.
        assert not got[k][1] or want[k]
        if k < len(EDITS):
            assert got[k][1], list(EDITS)[k]


def test_all_words_are_indexed_beyond_the_vocabulary_bound(spark, monkeypatch):
    docs = spark.createDataFrame([(1, "a b c d"), (None, None), (1, "x " + " ".join(PHRASE))], "doc_id bigint, text string")
    benchmark = spark.createDataFrame([(1, " ".join(PHRASE)), (2, "b c")], "item_id bigint, text string")
    rows = lambda: sorted((tuple(r) for r in decontaminate.phrase_matches(docs, benchmark).collect()), key=repr)
    few = rows()
    monkeypatch.setattr(decontaminate, "VOCABULARY_WORDS", 2)
    assert rows() == few and [r[3] for r in few if r[0] == 1] == [["1"], ["2"]] and len(few) == 3


def test_results_replace_kept_columns_of_their_name(spark):
    docs = spark.createDataFrame([(1, "a b", "x", 7)], "doc_id bigint, text string, items string, row bigint")
    benchmark = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    first = decontaminate.phrase_matches(docs, benchmark, keep=("doc_id", "text", "items"))
    assert first.first()["items"] == ["1"] and decontaminate.phrase_matches(first, benchmark, keep=tuple(first.columns)).first()["items"] == ["1"]
