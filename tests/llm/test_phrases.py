"""Collocations against plain counting."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from palimpsest.llm import phrases

SCHEMA = "doc_id bigint, text string, lang string, n bigint, phrase string"


def stored(spark, tmp_path, rows, parts=3):
    spark.createDataFrame([(i, t, lang, 1, "x") for i, (t, lang) in enumerate(rows)], SCHEMA).repartition(parts).write.parquet(str(tmp_path / "d"))
    return spark.read.schema(SCHEMA).parquet(str(tmp_path / "d"))


def plain(rows, least, longest=5, best=2000):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for size in range(1, longest + 1):
                counts[lang or "und"].update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    out = []
    for lang, found in counts.items():
        often = {p: a for p, a in found.items() if len(p) > 1 and a >= least}
        rows_ = []
        for p, a in often.items():
            inner = any(a == b and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in often.items())
            if not inner:
                score, _, l, r = min((1000 * a * total[lang] // (found[p[:k]] * found[p[k:]]), k, found[p[:k]], found[p[k:]]) for k in range(1, len(p)))
                rows_.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(rows_)[:best], 1)]
    return sorted(out)


def found(df, **options):
    rows = phrases.collocations(df, **options).collect()
    return sorted((r["lang"], r["rank"], r["phrase"], r["a"], r["l"], r["r"], r["n"], r["score"]) for r in rows)


def texts(seed, n=200):
    rng = random.Random(seed)
    words = ["the", "The", "of", "New", "york", "times", "é", "É", "x-y", "a" * 70, "(b)"]
    out = []
    for _ in range(n):
        text = ""
        for _ in range(rng.randrange(0, 40)):
            text += rng.choice(["new york times square", "of the", *words]) + rng.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", ""])
        out.append((text, rng.choice(["en", "en", "fr", None])))
    return out


@pytest.mark.parametrize("share", [phrases.HOT_SHARE, 2])
def test_random_texts(spark, tmp_path, monkeypatch, share):
    """Also where nearly every prefix is hot, so that shorter ones are counted over several tasks."""
    monkeypatch.setattr(phrases, "HOT_SHARE", share)
    monkeypatch.setattr(phrases, "STEP_BYTES", 3000)
    rows = texts(share)
    docs = stored(spark, tmp_path, rows)
    for least in (5, 20):
        assert found(docs, least=least) == plain(rows, least)
    assert found(docs, least=5, longest=3, best=4) == plain(rows, 5, 3, 4)


def test_defined_cases(spark, tmp_path):
    rows = [(None, "en"), ("", None), ("a b" * 3, None), (" . , ", "x"), ("a b. a b. a b", "en"), ("a b", "en"), ("one word " * 3000, "long"), ("Z" * 200_000 + " q", "long")]
    assert found(stored(spark, tmp_path, rows), least=3) == plain(rows, 3)


def test_empty_table(spark, tmp_path):
    assert found(stored(spark, tmp_path, [], 1)) == []


def test_scores_beyond_64_bits(spark, monkeypatch):
    """Counts are made up; products of them need over 64 bits, and a floor decides a tie."""
    big = 3_000_000_000_000
    rows = [("l", 0, "", 10**15), ("l", 1, "a", big), ("l", 1, "b", big), ("l", 2, "a b", big), ("l", 1, "c", 7), ("l", 2, "b c", 7), ("l", 3, "a b c", 6)]
    frame = spark.createDataFrame(rows, phrases.GROWN)
    monkeypatch.setattr(phrases, "frequent_phrases", lambda *_: frame)
    got = {r["phrase"]: (r["a"], r["l"], r["r"], r["score"]) for r in phrases.collocations(frame).collect()}
    f = {r[2]: r[3] for r in rows}
    score = lambda p, x, y: 1000 * f[p] * 10**15 // (f[x] * f[y])
    assert got == {"a b": (big, big, big, score("a b", "a", "b")), "b c": (7, big, 7, score("b c", "b", "c")), "a b c": (6, big, 7, score("a b c", "a", "b c"))}


def test_growth_is_depth_first_and_partial_below():
    cells = np.array([[0, 0, 0, 1], [1, 1, 2, -1], [2, -1, -1, -1]], np.int32)
    counts = np.array([5, 1, 1, 9])
    assert list(phrases.grow(cells, counts, 5, 1)) == [((1,), 9), ((0,), 7), ((0, 1), 6), ((0, 1, 2), 5)]
    assert [p for p, _ in phrases.grow(cells, counts, 5, 2)] == [(1,), (0,), (0, 1), (0, 1, 2)]
    assert ((0, 2), 1) in list(phrases.grow(cells, counts, 5, 3))
