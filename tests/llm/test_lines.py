"""Line templates: fields in leaves of any size, numeric rows, short lines."""

import numpy as np
import pytest

from palimpsest.llm import lines

SCHEMA = "doc_id bigint, text string"


def cut(spark, tmp_path, texts, **more):
    out = str(tmp_path / "d")
    spark.createDataFrame(list(enumerate(texts)), SCHEMA).write.parquet(out)
    found = lines.drop_recurring_lines(spark.read.schema(SCHEMA).parquet(out), **more)
    return [r["text"] for r in found.orderBy("doc_id").collect()]


@pytest.mark.parametrize("n", [500, 50_000])
@pytest.mark.parametrize("values", [20, 1000, None])
def test_fields_in_a_leaf_of_any_size(n, values):
    """Five constant tokens and three fields of so many values, or of unique ones: one template."""
    rng = np.random.default_rng(n)
    tokens = np.arange(8, dtype=np.uint64)[None, :].repeat(n, 0)
    for p in (4, 5, 7):
        tokens[:, p] = lines.mixed(rng.integers(0, values, n).astype(np.uint64) + np.uint64(100 * p)) if values else lines.mixed(np.arange(n, dtype=np.uint64) + np.uint64(n * p + 99))
    _, one, same = np.unique(tokens, axis=0, return_index=True, return_inverse=True)
    documents = np.bincount(same.ravel())
    line = lines.mixed(np.arange(len(one), dtype=np.uint64) + np.uint64(7))
    found = lines.generalise(np.full(len(one), 5, np.uint64), line, documents, tokens[one], 5, 0.6)
    assert len(np.unique(found)) == 1


def test_fields_of_named_values(spark, tmp_path):
    """Every value of every field is in more than five documents, no combination is."""
    names = [f"{a}{b}" for a in "bdfgkl" for b in ("ane", "ore", "ist", "ull", "ent")]
    rng = np.random.default_rng(3)
    texts = [" ".join(["entry", "made", "by", names[i], "for", names[j], "in", names[k]]) for i, j, k in rng.integers(0, 30, (3000, 3))]
    got = cut(spark, tmp_path, texts)
    assert got[0] == texts[0] and not any(got[1:])


def test_numeric_rows_go_by_their_real_text(spark, tmp_path):
    texts = [f"{k} {k + 1} {k * k} {k + 7}\n9 8 7 6\nrow {k}" for k in range(1, 8)]
    got = cut(spark, tmp_path, texts)
    assert got[0] == texts[0] and got[1:] == [t.replace("9 8 7 6\n", "") for t in texts[1:]]


def test_leading_tokens_alone_make_no_template(spark, tmp_path):
    words = ["apple stew", "green tea", "warm bread", "cold milk", "plain rice", "fresh fish", "roast corn"]
    texts = [f"we all like {w}\nwe all like {w.split()[0]}" for w in words]
    assert cut(spark, tmp_path, texts) == texts


def test_short_lines_go_by_their_real_text(spark, tmp_path):
    texts = [f"Read more\nPage {k}\n \nown{k}" for k in range(6)]
    got = cut(spark, tmp_path, texts)
    assert got[0] == texts[0] and got[1:] == [t.replace("Read more\n", "") for t in texts[1:]]
    assert cut(spark, tmp_path / "few", texts[:4]) == texts[:4]


def test_large_leaves_give_the_same(spark, tmp_path):
    """Leaves that are spread over tasks, against leaves that lie in one; fields at several shares."""
    rng = np.random.default_rng(11)
    names = [f"{a}{b}" for a in "bdfgklmnprst" for b in ("ane", "ore", "ist", "ull", "ent")]
    texts = []
    for k in range(900):
        i, j = rng.integers(0, len(names), 2)
        common = ["alpha", "beta", "gamma"][int(rng.integers(0, 3))]
        texts.append("\n".join([f"entry made by {names[i]} for {names[j]} in {common}", f"entry made by {common} on {k} of {names[i % 7]}", f"the same line number {'ABCDEF'[k % 6]} here", names[i] + " " + names[j] + " one two three", "Read more", f"{k} {k + 1} 3 4"]))
    texts[3] = ""
    one = cut(spark, tmp_path / "one", texts)
    assert one != texts and cut(spark, tmp_path / "all", texts, leaf_bytes=0) == one
    assert cut(spark, tmp_path / "some", texts, leaf_bytes=40_000) == one
