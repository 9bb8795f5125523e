"""Language identification with spans of mixed-language text.

Training counts byte n-grams of words per language. Each word of a text then gets a
log-likelihood per language; the scripts of its letters narrow the candidates to languages seen
in that script; a Viterbi pass with a penalty for every switch labels spans of words.

Every language that has a row to learn from is learned. The model has three tables of
``2 ** BUCKETS_LOG2`` numbers for each, and the words looked at together get fewer with many
languages, so that a step's memory stays the same.

Defined results: a null text, or one without letters, is ``und`` with score 0; languages are
learned from rows with a non-null text and language only, and repeated rows count as often as they
stand; texts of any length are labelled whole; of equally good languages the first by name counts;
equal texts give equal results; extra columns are dropped unless named in ``keep``, where one with
the name of a result is replaced by it; an empty table gives an empty table, and without any row
to learn from everything is ``und``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import CHUNK_BYTES, byte_slices, held_out, learnable, map_arrow, schema_of, string_buffers, text_rows, written  # noqa: F401

UNKNOWN = "und"
#: Buckets of hashed n-grams of each length: the model's size is fixed by this.
BUCKETS_LOG2, ORDERS = 15, (1, 2, 3)
#: About so many documents of each language are learned from; fewer if there are fewer.
TRAIN_DOCUMENTS_PER_LANGUAGE = 2000
#: Languages that a step of ``CHUNK_BYTES`` is meant for; with more of them steps are shorter.
STEP_LANGUAGES = 16
#: Nats that a change of language costs, and the count added to every bucket.
SWITCH_PENALTY, SMOOTHING = 12.0, 0.5
# First and last code points of the main scripts.
SCRIPTS = {"latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)], "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)], "cyrillic": [(0x400, 0x52F)], "hebrew": [(0x590, 0x5FF)], "arabic": [(0x600, 0x6FF), (0x750, 0x77F)], "indic": [(0x900, 0xDFF)], "thai": [(0xE00, 0xE7F)], "kana": [(0x3040, 0x30FF)], "han": [(0x3400, 0x9FFF), (0x20000, 0x2FFFF)], "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)]}
OTHER_SCRIPT = len(SCRIPTS)
#: A language is a candidate in a script that holds at least this share of its letters.
SCRIPT_SHARE = 1e-4


@lru_cache(maxsize=1)
def script_table() -> np.ndarray:
    """Script of each code point plus one; 0 where it is not a letter."""
    out = np.fromiter(((OTHER_SCRIPT + 1) if unicodedata.category(chr(c))[0] == "L" else 0 for c in range(0x110000)), np.uint8, 0x110000)
    for number, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            part = out[a : b + 1]
            part[part > 0] = number + 1
    return out


@dataclass
class Words:
    """Letters of a chunk in words: runs of letters."""

    script: np.ndarray
    first: np.ndarray
    letters: np.ndarray
    grams: list[tuple[np.ndarray, np.ndarray]]


@lru_cache(maxsize=1)
def lower_table() -> np.ndarray:
    return np.fromiter((ord(x) if len(x := chr(c).lower()) == 1 else c for c in range(0x3000)), np.uint32, 0x3000)


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    lead = (data & 0xC0) != 0x80
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.searchsorted(np.flatnonzero(lead), offsets)
    low = points < 0x3000
    points = np.where(low, lower_table()[np.where(low, points, 0)], points)
    scripts = script_table()[points]
    is_letter = scripts > 0
    begins = is_letter.copy()
    begins[1:] &= ~is_letter[:-1]
    inner = at[1:-1]
    inner = inner[inner < len(points)]
    begins[inner] |= is_letter[inner]
    letters = np.flatnonzero(is_letter)
    word = np.cumsum(begins)[letters] - 1
    n = int(word[-1]) + 1 if len(word) else 0
    starts = np.flatnonzero(begins)
    # A word's letters follow each other, so the letters before one within its word are neighbours.
    code = points[letters].astype(np.uint64) + np.uint64(1)
    index_in = letters - starts[word] if n else letters
    grams, value = [], code
    for order in ORDERS:
        if order > 1:
            earlier = np.zeros(len(code), np.uint64)
            earlier[order - 1 :] = code[: len(code) - order + 1]
            earlier[index_in < order - 1] = 0
            value = value * np.uint64(1_000_003) + earlier
        hashed = (value * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS_LOG2)
        grams.append((word, hashed.astype(np.int64)))
    return Words(scripts[starts].astype(np.int64) - 1, np.searchsorted(starts, at), np.diff(np.append(np.searchsorted(letters, starts), len(letters))), grams)


def train_rows(df: DataFrame, text: str, lang: str, key: str, per_language: int) -> DataFrame:
    """A bounded sample of each language's rows that may be learned from, alike at every size: all
    rows of a language that has few, and a share by a hash of key and text of one that has more."""
    learn = df.where(learnable(key) & F.col(text).isNotNull() & F.col(lang).isNotNull())
    learn = learn.select(F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("_text"), F.xxhash64(key, text).alias("place"))
    scale = 1_000_000
    share = F.ceil(F.lit(per_language * scale) / F.col("n"))
    often = written(learn.groupBy("lang").agg(F.count("*").alias("n")).where(F.col("n") > per_language).select("lang", share.alias("share")), "languages")
    shared = learn.join(often, "lang", "left")
    return shared.where(F.pmod("place", F.lit(scale)) < F.coalesce("share", F.lit(scale))).select("lang", "_text")


@dataclass
class Model:
    languages: list[str]
    scores: list[np.ndarray]
    allowed: np.ndarray


def train(df: DataFrame, text: str = "text", lang: str = "lang", key: str = "doc_id", per_language: int = TRAIN_DOCUMENTS_PER_LANGUAGE) -> Model:
    """Sums n-gram counts over the sample's partitions; the sums have a fixed size."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[np.ndarray]] = {}
        for part in byte_slices(batches, "_text"):
            names = part.column("lang").to_pylist()
            words = words_of(*string_buffers(part.column("_text")))
            doc = np.searchsorted(words.first, np.arange(len(words.script)), side="right") - 1
            for name in set(names):
                own = np.array([x == name for x in names])[doc] if len(doc) else np.zeros(0, bool)
                into = sums.setdefault(name, [np.zeros(1 << BUCKETS_LOG2, np.int64) for _ in ORDERS] + [np.zeros(OTHER_SCRIPT + 1, np.int64)])
                for k, (word, hashed) in enumerate(words.grams):
                    into[k] += np.bincount(hashed[own[word]], minlength=1 << BUCKETS_LOG2)
                into[-1] += np.bincount(words.script[own], weights=words.letters[own], minlength=OTHER_SCRIPT + 1).astype(np.int64)
        for name, arrays in sums.items():
            for k, array in enumerate(arrays):
                used = np.flatnonzero(array)
                if len(used):
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(used)), pa.array([k] * len(used), pa.int32()), pa.array(used, pa.int64()), pa.array(array[used], pa.int64())], names=["lang", "part", "bucket", "n"])

    counted = map_arrow(train_rows(df, text, lang, key, per_language), count, "lang string, part int, bucket bigint, n bigint")
    rows = counted.groupBy("lang", "part", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows["lang"].unique().tolist())
    number = {x: i for i, x in enumerate(languages)}
    scores = []
    for k in range(len(ORDERS)):
        table = np.full((1 << BUCKETS_LOG2, len(languages)), SMOOTHING)
        part = rows[rows["part"] == k]
        table[part["bucket"].to_numpy(), part["lang"].map(number).to_numpy(np.int64)] += part["n"].to_numpy()
        scores.append(np.log(table / table.sum(axis=0)).astype(np.float32) if languages else table.astype(np.float32))
    seen = np.zeros((OTHER_SCRIPT + 1, len(languages)))
    part = rows[rows["part"] == len(ORDERS)]
    seen[part["bucket"].to_numpy(), part["lang"].map(number).to_numpy(np.int64)] = part["n"].to_numpy()
    return Model(languages, scores, seen / np.maximum(1, seen.sum(axis=0)) >= SCRIPT_SHARE)


def word_scores(words: Words, model: Model) -> np.ndarray:
    """Log-likelihood of each word in each language, relative to the word's best; minus infinity
    for languages outside its script; all zero for words of scripts that no language uses."""
    n, m = len(words.script), len(model.languages)
    out = np.zeros((n, m), np.float64)
    if not n:
        return out
    starts = np.cumsum(words.letters) - words.letters
    for (_, hashed), table in zip(words.grams, model.scores):
        out += np.add.reduceat(table[hashed], starts, axis=0)
    out /= len(ORDERS)
    allowed = model.allowed[words.script]
    out[~allowed] = -np.inf
    nobody = ~allowed.any(axis=1)
    out -= np.where(nobody, 0, out.max(axis=1, initial=-np.inf))[:, None]
    out[nobody] = 0
    return out


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Best language of each word when every change of language costs ``penalty``."""
    n, m = scores.shape
    came = np.empty((n, m), np.int32)
    best = scores[0].copy()
    own = np.arange(m)
    for t in range(1, n):
        top = int(best.argmax())
        switch = best[top] - penalty
        came[t] = np.where(best >= switch, own, top)
        best = np.maximum(best, switch) + scores[t]
    path = np.empty(n, np.int32)
    path[-1] = int(best.argmax())
    for t in range(n - 1, 0, -1):
        path[t - 1] = came[t, path[t]]
    return path


def label_spans(scores: np.ndarray, penalty: float = SWITCH_PENALTY) -> np.ndarray:
    """The Viterbi path. If no stretch of words gains as much as one switch costs by leaving the
    best single language, staying in it is optimal, and no pass over the words is needed."""
    total = scores.sum(axis=0)
    stay = int(total.argmax())
    if np.isfinite(total[stay]):
        with np.errstate(invalid="ignore"):
            gain = np.cumsum(np.append(0, scores.max(axis=1) - scores[:, stay]))
        # Scores are relative to each word's best, so the gain of leaving never falls.
        if gain[-1] < penalty:
            return np.full(len(scores), stay, np.int32)
        others = np.delete(scores, stay, axis=1) - scores[:, [stay]]
        if others.shape[1]:
            rise = np.cumsum(np.append(0, others.max(axis=1)))
            if (rise - np.minimum.accumulate(rise)).max() < penalty:
                return np.full(len(scores), stay, np.int32)
    return viterbi(scores, penalty)


RESULT = "lang_pred string, score double, n_words bigint, spans array<struct<start: bigint, end: bigint, lang: string>>"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))


def identify(df: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",), penalty: float = SWITCH_PENALTY) -> DataFrame:
    """``keep`` columns, the language of most letters, its share as score, and spans of words."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    limit = CHUNK_BYTES * STEP_LANGUAGES // max(STEP_LANGUAGES, len(model.languages))
    keep, name, rows = text_rows(df, keep, text, RESULT)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part in byte_slices(batches, name, limit):
            words = words_of(*string_buffers(part.column(name)))
            scores = word_scores(words, model)
            names, shares, spans = [], [], []
            for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
                if a == b or not model.languages:
                    names.append(UNKNOWN)
                    shares.append(0.0)
                    spans.append([])
                    continue
                path = label_spans(scores[a:b], penalty)
                weight = np.bincount(path, weights=words.letters[a:b], minlength=len(model.languages))
                top = int(weight.argmax())
                names.append(model.languages[top])
                shares.append(float(weight[top] / weight.sum()))
                cuts = [0, *(np.flatnonzero(np.diff(path)) + 1).tolist(), b - a]
                spans.append([{"start": x, "end": y, "lang": model.languages[path[x]]} for x, y in zip(cuts, cuts[1:])])
            yield pa.RecordBatch.from_arrays(
                [*part.columns[:-1], pa.array(names, pa.string()), pa.array(shares, pa.float64()), pa.array(np.diff(words.first), pa.int64()), pa.array(spans, SPANS)],
                names=[*keep, "lang_pred", "score", "n_words", "spans"],
            )

    return map_arrow(rows, run, schema_of(df, keep, RESULT))
