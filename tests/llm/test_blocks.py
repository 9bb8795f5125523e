"""Fixed-block dedup against a plain search, and hashes of long words."""

import random
import re

import numpy as np
import pytest

from palimpsest.llm import blocks, decontaminate, jaccard
from palimpsest.llm.common import span_hashes

SCHEMA = "doc_id bigint, text string, id string, row int, marks string, kept string"


def stored(spark, tmp_path, rows, parts=3):
    spark.createDataFrame([(k, t, "i", 1, "m", "k") for k, t in rows], SCHEMA).repartition(parts).write.parquet(str(tmp_path / "d"))
    return spark.read.schema(SCHEMA).parquet(str(tmp_path / "d"))


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain(rows, window=13):
    first = {}
    for k, t in rows:
        own = words(t)
        if k is not None:
            for i in range(len(own) - window + 1):
                passage = tuple(own[i : i + window])
                first[passage] = min(first.get(passage, k), k)
    out = []
    for k, t in rows:
        own, gone = words(t), set()
        if k is not None:
            for i in range(len(own) - window + 1):
                if first[tuple(own[i : i + window])] < k:
                    gone |= set(range(i, i + window))
        spans = sum(i - 1 not in gone for i in gone)
        out.append((k, len(own), len(gone), spans, " ".join(w for i, w in enumerate(own) if i not in gone).encode()))
    return sorted(out, key=repr)


def found(df, **options):
    rows = blocks.remove_repeated_words(df, **options).collect()
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["n_spans"], bytes(r["kept"])) for r in rows), key=repr)


@pytest.mark.parametrize("window", [2, 5, 13])
def test_random_texts(spark, tmp_path, window):
    """Passages at any offset, of any length around the window, with other white space."""
    rng = random.Random(window)
    passages = [[rng.choice("abcdefgh") * rng.randrange(1, 12) for _ in range(rng.randrange(window - 1, 3 * window))] for _ in range(12)]
    rows = []
    for k in range(120):
        text = []
        for _ in range(rng.randrange(0, 5)):
            text += [f"w{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 9))] + rng.choice(passages)[: rng.randrange(1, 40)]
        rows.append((rng.choice([k, k, rng.randrange(60)]), "".join(w + rng.choice([" ", "\t", " \n ", "  "]) for w in text)))
    got = found(stored(spark, tmp_path, rows), window=window)
    assert got == plain(rows, window) and sum(r[2] for r in got) > 100


def test_edges(spark, tmp_path):
    one = " ".join(f"é{i}" for i in range(14))
    long = " ".join(f"x{i}" for i in range(60_000))
    rows = [(1, one), (2, one), (2, "y " + one), (2, one), (3, None), (None, one), (4, ""), (5, " \t\n"), (6, "a " * 400), (7, "a " * 13), (8, "a " * 12), (-5, "a " * 20), (9, long), (10, "q " + long + " q"), (11, one.replace(" ", "\n\n")), (12, one.upper())]
    assert found(stored(spark, tmp_path, rows)) == plain(rows)


def test_copies_over_many_partitions(spark, tmp_path):
    text = " ".join(f"w{i}" for i in range(50))
    rows = [(k, text if k % 3 else text.replace("w20 ", f"n{k} ")) for k in range(400)]
    assert found(stored(spark, tmp_path, rows, 9)) == plain(rows)


def test_empty_table(spark, tmp_path):
    assert found(stored(spark, tmp_path, [], 1)) == []


def test_a_window_needs_two_words(spark, tmp_path):
    with pytest.raises(ValueError):
        blocks.remove_repeated_words(stored(spark, tmp_path, []), window=1)


def hashes(*texts):
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t.encode()) for t in texts])
    return span_hashes(data, ends - [len(t.encode()) for t in texts], ends).tolist()


def thue_morse(n, swap):
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


def test_no_arrangement_cancels_out():
    x, y = "x" + "a" * 4095, "y" + "a" * 4095
    assert len(set(hashes(x + y, y + x, x + x, y + y))) == 4
    for n in (64, 1024, 2048, 4096, 65_536):
        assert len(set(hashes(thue_morse(n, 0), thue_morse(n, 1)))) == 2
    assert len(set(hashes("", "a", "a\0", "aaaaaaaa", "aaaaaaaab", "b"))) == 6
    assert hashes("word", "other", "word")[0] == hashes("word")[0] == hashes("x", "word")[1]


def test_long_words_do_not_meet(spark, tmp_path):
    """Words that a sum of powers cannot tell apart: no false link and no false hit."""
    rows = [(1, thue_morse(2048, 0)), (2, thue_morse(2048, 1)), (3, "x" + "a" * 4095 + "y" + "a" * 4095)]
    docs = stored(spark, tmp_path, rows)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(docs).collect()} == {1: 1, 2: 2, 3: 3}
    items = spark.createDataFrame([(1, "y" + "a" * 4095 + "x" + "a" * 4095), (2, thue_morse(2048, 1))], "item_id bigint, text string")
    found = decontaminate.contamination(decontaminate.phrase_matches(docs, items)).collect()
    assert {r["doc_id"]: r["n_hit"] for r in found} == {1: 0, 2: 1, 3: 0}
