"""Quality classifier: random Fourier features, ridge regression and isotonic calibration.

Every document becomes a short vector of statistics of its text. Random Fourier features of the
standardised vector approximate a Gaussian kernel; the normal equations of a ridge regression on
them are summed by partition, so that only matrices of a fixed size meet; the raw scores are
calibrated by isotonic regression over a fixed grid of score bins. Labelled rows are split by a
hash of their key: most fit the ridge, the rest calibrate it.

Defined results: a null text counts as empty; empty texts get a score like any other; texts of any
length are taken whole; labels that are null or belong to no document are not learned from,
repeated rows and labels count as often as they stand; without any label every score is 0.5; equal
texts get equal scores, and equal raw scores are one step of the calibration; extra columns are
dropped unless named in ``keep``, where one with the name of a result is replaced by it; an empty
table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import LOWER, NOT_SPACE, byte_slices, distinct_in_rows, learnable, map_arrow, mixed, per_row, schema_of, span_hashes, string_buffers, text_rows, token_spans, written

#: Random features, width of the Gaussian in standard deviations of all statistics, ridge weight.
N_FEATURES, WIDTH, RIDGE, SEED = 384, 1.2, 1e-3, 20_240_229
#: Bins of raw scores that calibration pools, over this range.
BINS, LOW, HIGH = 1024, -0.5, 1.5
#: One in so many labelled rows that may be learned from calibrates instead of fitting.
CALIBRATION_SHARE = 4
CHUNK_ROWS = 4096

STATISTICS = (
    "log_bytes", "log_words", "log_lines", "upper", "digit", "space", "stop", "symbol", "foreign", "word_length", "word_spread",
    "long_words", "capital_words", "distinct_words", "distinct_pairs", "same_as_last", "distinct_lines", "line_length", "ends_sentence", "symbol_words", "upper_words",
)


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars.encode(), np.uint8)] = True
    return out


_UPPER, _DIGIT, _STOP = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _table("0123456789"), _table(".,;:!?'\"()-")
_SYMBOL = _table("#$%&*+/<=>@[\\]^_`{|}~")
_NOT_BREAK = np.ones(256, bool)
_NOT_BREAK[10] = False


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of ``STATISTICS`` for each text."""
    n = len(offsets) - 1
    share = lambda part, whole: part / np.maximum(1, whole)
    size = np.diff(offsets)
    starts, ends, first = token_spans(data, offsets, NOT_SPACE)
    words, length = np.diff(first), (ends - starts).astype(np.float64)
    hashes = span_hashes(LOWER[data], starts, ends)
    line_at, line_end, line_first = token_spans(data, offsets, _NOT_BREAK)
    lines = np.diff(line_first)
    mean = share(per_row(length, first), words)
    spread = np.sqrt(np.maximum(0, share(per_row(length**2, first), words) - mean**2))
    row = np.repeat(np.arange(n), words)
    follows = np.zeros(len(starts), bool)
    follows[1:] = row[1:] == row[:-1]
    same = np.zeros(len(starts), bool)
    same[1:] = follows[1:] & (hashes[1:] == hashes[:-1])
    pair = hashes.copy()
    pair[1:] = mixed(hashes[1:] + np.uint64(3) * np.where(follows[1:], hashes[:-1], np.uint64(0)))
    different = lambda values, bounds: np.diff(distinct_in_rows(values, bounds)[1])
    count = lambda table: per_row(table[data], offsets)
    ends_well = _table(".!?")[data[line_end - 1]] if len(line_end) else np.zeros(0, bool)
    odd = _SYMBOL[data].astype(np.int64)
    upper = _UPPER[data].astype(np.int64)
    in_word = lambda flags: np.add.reduceat(flags, starts) if len(starts) else np.zeros(0, np.int64)
    return np.column_stack([
        np.log1p(size), np.log1p(words), np.log1p(lines),
        share(count(_UPPER), size), share(count(_DIGIT), size), share(count(~NOT_SPACE), size), share(count(_STOP), size), share(count(_SYMBOL), size), share(per_row(data >= 128, offsets), size),
        mean, spread, share(per_row(length > 12, first), words), share(per_row(_UPPER[data[starts]] if len(starts) else np.zeros(0, bool), first), words),
        share(different(hashes, first), words), share(different(pair, first), words), share(per_row(same, first), words),
        share(different(span_hashes(data, line_at, line_end), line_first), lines), np.log1p(share(per_row((line_end - line_at).astype(np.float64), line_first), lines)), share(per_row(ends_well, line_first), lines),
        share(per_row(in_word(odd) > 0, first), words), share(per_row(in_word(upper) > 1, first), words),
    ]).astype(np.float64).reshape(n, len(STATISTICS))


def document_statistics(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns and ``stats``, packed 64-bit floats."""
    keep, name, texts = text_rows(df, keep, text, "stats binary, score double")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, name):
            rows = statistics(*string_buffers(part.column(name)))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array([r.tobytes() for r in rows], pa.binary())], names=[*keep, "stats"])

    return map_arrow(texts, run, schema_of(df, keep, "stats binary"))


@dataclass
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    phases: np.ndarray
    ridge: np.ndarray
    raw: np.ndarray
    level: np.ndarray

    def features(self, stats: np.ndarray) -> np.ndarray:
        """A constant, then cosines of random directions."""
        x = np.clip((stats - self.centre) / self.scale, -4, 4)
        z = np.cos(x @ self.weights + self.phases) * np.sqrt(2 / len(self.phases))
        return np.column_stack([np.ones(len(z)), z])

    def raw_scores(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.ridge

    def scores(self, stats: np.ndarray) -> np.ndarray:
        return np.clip(np.round(np.interp(self.raw_scores(stats), self.raw, self.level), 6), 0, 1)


def _stats_of(batch: pa.RecordBatch) -> np.ndarray:
    joined = b"".join(x.as_py() for x in batch.column("stats"))
    return np.frombuffer(joined, np.float64).reshape(-1, len(STATISTICS))


def _partition_sums(rows: DataFrame, sums) -> list[np.ndarray]:
    """Sum over partitions of the matrix that ``sums(batches)`` gives each; its rows meet by
    their number, and only the total comes to the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = sums(batches)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["k", "v"])

    def add(table: pa.Table) -> pa.Table:
        parts = np.array([np.frombuffer(x.as_py(), np.float64) for x in table.column("v")])
        parts = parts[np.lexsort(parts.T[::-1])]  # in a fixed order, so that a repeated run gives the same sum
        return pa.table({"k": table.column("k").slice(0, 1), "v": pa.array([parts.sum(axis=0).tobytes()], pa.binary())})

    got = rows.mapInArrow(run, "k int, v binary").groupBy("k").applyInArrow(add, "k int, v binary").collect()
    return [np.frombuffer(r["v"], np.float64) for r in sorted(got, key=lambda r: r["k"])]


def pool_adjacent(weight: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Isotonic regression: the rising step function closest to ``value``."""
    blocks: list[list[float]] = []
    for w, v in zip(weight.tolist(), value.tolist()):
        blocks.append([w, v, 1])
        while len(blocks) > 1 and blocks[-2][1] >= blocks[-1][1]:
            w2, v2, n2 = blocks.pop()
            w1, v1, n1 = blocks[-1]
            blocks[-1] = [w1 + w2, (w1 * v1 + w2 * v2) / (w1 + w2), n1 + n2]
    return np.repeat([b[1] for b in blocks], [int(b[2]) for b in blocks])


def train(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", n_features: int = N_FEATURES, width: float = WIDTH, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """Learns from labelled rows that are not held out; ``stats`` has ``key`` and ``stats``."""
    rows = labels.where(F.col(label).isNotNull() & learnable(key)).select(key, F.col(label).cast("double").alias("y")).join(stats.select(key, "stats"), key)
    rows = rows.select("stats", "y", (F.pmod(F.xxhash64(F.col(key)), F.lit(CALIBRATION_SHARE)) == 0).alias("calibrates"))
    rows = written(rows, "quality-rows")
    rng = np.random.default_rng(seed)
    p = len(STATISTICS)
    model = Model(np.zeros(p), np.ones(p), rng.standard_normal((p, n_features)) / (width * np.sqrt(p)), rng.uniform(0, 2 * np.pi, n_features), np.zeros(n_features + 1), np.array([0.0]), np.array([0.5]))

    def moments(batches: Iterable[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in batches:
            x = _stats_of(batch)
            now = np.array([np.full(p, len(x)), x.sum(axis=0), (x**2).sum(axis=0)])
            total = now if total is None else total + now
        return total

    found = _partition_sums(rows, moments)
    if not found or not found[0][0]:
        return model
    n, one, two = found
    model.centre = one / n
    model.scale = np.sqrt(np.maximum(two / n - model.centre**2, 1e-8))

    def equations(batches: Iterable[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(at, CHUNK_ROWS)
                z = model.features(_stats_of(part))
                both = np.column_stack([z, part.column("y").to_numpy(zero_copy_only=False)])
                total = z.T @ both if total is None else total + z.T @ both
        return total

    def solved(which: DataFrame) -> np.ndarray | None:
        got = _partition_sums(which, equations)
        if not got:
            return None
        both = np.array(got)
        a, b = both[:, :-1], both[:, -1]
        penalty = np.full(len(a), ridge * a[0, 0])
        penalty[0] = 0
        return np.linalg.solve(a + np.diag(penalty), b)

    model.ridge = solved(rows.where("not calibrates"))
    if model.ridge is None:
        model.ridge = solved(rows)

    def binned(batches: Iterable[pa.RecordBatch]) -> np.ndarray | None:
        total = None
        for batch in batches:
            raw = model.raw_scores(_stats_of(batch))
            place = np.clip(((raw - LOW) / (HIGH - LOW) * BINS).astype(int), 0, BINS - 1)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            now = np.array([np.bincount(place, minlength=BINS), np.bincount(place, weights=y, minlength=BINS), np.bincount(place, weights=raw, minlength=BINS)], np.float64)
            total = now if total is None else total + now
        return total

    got = _partition_sums(rows.where("calibrates"), binned) or _partition_sums(rows, binned)
    n, positive, raw = got
    used = np.flatnonzero(n)
    model.raw = np.maximum.accumulate(raw[used] / n[used])
    model.level = pool_adjacent(n[used], positive[used] / n[used])
    return model


def score(stats: DataFrame, model: Model) -> DataFrame:
    """The columns of ``stats`` with the packed vector replaced by ``score``."""
    shared = stats.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in stats.columns if c != "stats"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK_ROWS):
                part = batch.slice(at, CHUNK_ROWS)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(shared.value.scores(_stats_of(part)))], names=[*keep, "score"])

    return map_arrow(stats.select(*keep, "stats"), run, schema_of(stats, keep, "score double"))
