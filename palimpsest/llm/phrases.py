"""Phrase collocations by contiguous pattern growth.

Each occurrence of a word is a pointer to the words that follow it in its piece, up to the longest
phrase. A map step writes pointers as numbers of a small dictionary of its own, counts equal ones
together and deals them by the hash of their prefix, so a task gets all pointers of its prefixes.
It grows each prefix by itself, depth first: the pointers of a frequent prefix are projected on the
next word, and each word that follows often enough gives a longer frequent prefix with its own
pointers, until phrases are long enough or pointers run out. Nothing else is ever counted.

A prefix with a large share of all pointers does not go to one task: its pointers are dealt by
their first two words, and if such a pair is hot again by three, and so on. The counts of the
shorter prefixes are then sums over tasks. Equal words are found by their bytes, never by a hash.

Scores need the counts of all parts of a phrase, which are frequent as the phrase is, and are
joined by phrase. All arithmetic is exact (128 bits in a decimal).

Defined results: a null text counts as empty and a null language as ``und``; words and texts of any
length are taken whole; languages, ties and repeated rows count as they stand; extra columns are
ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import LOWER, MIX, map_arrow, mixed, span_hashes, string_buffers, token_spans, written

LEAST, LONGEST, BEST = 100, 5, 2000
NO_LANGUAGE = "und"
#: Text bytes of a map step, of a task's pointers, and of a part of the ranking.
STEP_BYTES, SHARD_BYTES, RANK_PARTS = 4 << 20, 16 << 20, 64
#: A prefix is hot with more than one in so many pointers (or in four shards, if that is less), so
#: there cannot be more hot prefixes than this of each length.
HOT_SHARE = 1 << 14

_BREAKS = np.zeros(256, bool)
_BREAKS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_IN_WORD = ~_BREAKS
_IN_WORD[[0x20, 0x09]] = False
_PLACES = mixed(np.arange(1, 65, dtype=np.uint64) * MIX) | np.uint64(1)
_NONE = np.uint64(0x5851F42D4C957F2D)

POINTERS = "lang string, depth int, shard bigint, n bigint, sizes binary, words binary, cells binary, counts binary"
GROWN = "lang string, n_words int, phrase string, n bigint"


def _steps(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, pa.Array]]:
    """Languages and their texts, of steps of about ``STEP_BYTES``."""
    held, size = [], 0

    def by_language() -> Iterator[tuple[str, pa.Array]]:
        table = pa.Table.from_batches(held).combine_chunks()
        texts = table.column("_text").combine_chunks()
        for lang in pc.unique(table.column("lang")).to_pylist():
            yield lang, texts.filter(pc.equal(table.column("lang"), lang).combine_chunks())

    for batch in batches:
        start = 0
        while start < batch.num_rows:
            own = batch.slice(start, 200)
            held.append(own)
            size += int(pc.sum(pc.binary_length(own.column("_text"))).as_py() or 0)
            start += 200
            if size >= STEP_BYTES:
                yield from by_language()
                held, size = [], 0
    if held:
        yield from by_language()


class Pointers:
    """All occurrences of words in some texts, each with the words that follow in its piece."""

    def __init__(self, texts: pa.Array, longest: int):
        data, at = string_buffers(texts)
        lower = LOWER[data]
        starts, ends, first = token_spans(lower, at, _IN_WORD)
        self.n, self.longest = len(starts), longest
        if not self.n:
            return
        compact = np.zeros(len(lower) + 1, np.int64)
        np.add.at(compact, starts, 1)
        np.add.at(compact, ends, -1)
        edges = np.append(0, np.cumsum(ends - starts)).astype(np.int32)
        words = lower[np.cumsum(compact[:-1]) > 0]
        encoded = pa.Array.from_buffers(pa.binary(), self.n, [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(words.tobytes())]).dictionary_encode()
        self.words, codes = encoded.dictionary, encoded.indices.to_numpy().astype(np.int32)
        breaks = np.append(0, np.cumsum(_BREAKS[lower]))
        new = np.ones(self.n, bool)
        new[1:] = breaks[starts[1:]] != breaks[starts[:-1]]
        new[first[:-1][first[:-1] < self.n]] = True
        pieces = np.flatnonzero(new)
        end = np.append(pieces[1:], self.n)[np.cumsum(new) - 1]
        padded = np.append(codes, np.zeros(longest, np.int32))
        place = np.arange(self.n)
        self.cells = np.stack([np.where(place + j < end, padded[j : j + self.n], -1) for j in range(longest)])
        data, at = string_buffers(self.words)
        self.hashes = np.append(span_hashes(data, at[:-1], at[1:]), _NONE)

    def prefix_hashes(self) -> Iterator[np.ndarray]:
        """Hashes of the prefixes of one word, two words and so on."""
        total = np.zeros(self.n, np.uint64)
        for j in range(self.longest):
            total = total + self.hashes[self.cells[j]] * _PLACES[j]
            yield mixed(total + np.uint64(j))


def _language(lang: Column) -> Column:
    return F.coalesce(lang.cast("string"), F.lit(NO_LANGUAGE))


def _hot_prefixes(docs: DataFrame, longest: int, shards: int) -> list[np.ndarray]:
    """Hashes of the hot prefixes of each length but the last. They only settle where pointers go."""
    share = min(4 * shards, HOT_SHARE)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _steps(batches):
            pointers = Pointers(texts, longest)
            # Length 0 stands for all pointers.
            found, depths, counts = [np.zeros(1, np.uint64)], [np.zeros(1, np.int64)], [np.array([pointers.n])]
            for depth, hashes in enumerate(pointers.prefix_hashes() if pointers.n else (), 1):
                if depth == longest:
                    break
                own, n = np.unique(hashes, return_counts=True)
                often = n * 2 * share > pointers.n
                found.append(own[often])
                depths.append(np.full(int(often.sum()), depth))
                counts.append(n[often])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(depths)), pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(counts))], names=["depth", "hash", "n"])

    counted = map_arrow(docs, run, "depth bigint, hash bigint, n bigint")
    counted = written(counted.groupBy("depth", "hash").agg(F.sum("n").alias("n")), "prefixes")
    total = counted.where("depth = 0").agg(F.sum("n")).first()[0] or 0
    rows = counted.where((F.col("depth") > 0) & (F.col("n") * share > total)).collect()
    return [np.sort(np.array([r["hash"] for r in rows if r["depth"] == d], np.int64).view(np.uint64)) for d in range(1, longest)]


def _dealt(lang: str, pointers: Pointers, hot: list[np.ndarray], shards: int) -> pa.RecordBatch | None:
    """One row for each shard with pointers of these texts."""
    if not pointers.n:
        return None
    depth = np.ones(pointers.n, np.int64)
    key = None
    for d, hashes in enumerate(pointers.prefix_hashes(), 1):
        key = hashes.copy() if key is None else np.where(depth == d, hashes, key)
        if d < pointers.longest:
            depth[(depth == d) & np.isin(key, hot[d - 1])] = d + 1
    whole = hashes  # of all words of the pointer
    shard = ((key >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((whole, shard, depth))
    cells, shard, depth = pointers.cells[:, order], shard[order], depth[order]
    new = np.ones(pointers.n, bool)
    new[1:] = (cells[:, 1:] != cells[:, :-1]).any(axis=0) | (depth[1:] != depth[:-1])
    at = np.flatnonzero(new)
    cells, shard, depth, counts = cells[:, at], shard[at], depth[at], np.diff(np.append(at, pointers.n))
    group = depth * shards + shard
    cuts = np.flatnonzero(np.diff(group, prepend=-1))
    out = {c: [] for c in ("n", "sizes", "words", "cells", "counts")}
    data, word_at = string_buffers(pointers.words)
    size, raw, word_at = np.diff(word_at), data.tobytes(), word_at.tolist()
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(at)]):
        used, local = np.unique(cells[:, a:b], return_inverse=True)
        local = local.reshape(-1)
        if used[0] < 0:
            used, local = used[1:], local - 1
        wide = "<i2" if len(used) < 32_000 else "<i4"
        out["n"].append(int(counts[a:b].sum()))
        out["sizes"].append(size[used].astype("<u4").tobytes())
        out["words"].append(b"".join([raw[word_at[w] : word_at[w + 1]] for w in used.tolist()]))
        out["cells"].append(local.astype(wide).tobytes())
        out["counts"].append(counts[a:b].astype("<u4").tobytes())
    return pa.RecordBatch.from_arrays(
        [pa.array([lang] * len(cuts), pa.string()), pa.array(depth[cuts], pa.int32()), pa.array(shard[cuts], pa.int64()), pa.array(out["n"], pa.int64()), *(pa.array(out[c], pa.binary()) for c in ("sizes", "words", "cells", "counts"))],
        names=["lang", "depth", "shard", *out],
    )


def grow(cells: np.ndarray, counts: np.ndarray, least: int, whole_from: int) -> Iterator[tuple[tuple[int, ...], int]]:
    """Frequent prefixes of pointers and their counts, depth first. ``cells`` has a row for each
    place; prefixes shorter than ``whole_from`` words are counted in part, so none is left out."""
    projected: list[tuple[np.ndarray, tuple[int, ...]]] = [(np.arange(cells.shape[1]), ())]
    while projected:
        pointers, prefix = projected.pop()
        following = cells[len(prefix)][pointers]
        there = following >= 0
        pointers, following = pointers[there], following[there]
        if not len(pointers):
            continue
        order = np.argsort(following, kind="stable")
        pointers, following = pointers[order], following[order]
        begin = np.flatnonzero(np.diff(following, prepend=-1))
        end = np.append(begin[1:], len(following))
        total = np.add.reduceat(counts[pointers], begin)
        for k in np.flatnonzero(total >= least if len(prefix) + 1 >= whole_from else total > 0)[::-1].tolist():
            longer = (*prefix, int(following[begin[k]]))
            yield longer, int(total[k])
            if len(longer) < len(cells):
                projected.append((pointers[begin[k] : end[k]], longer))


def _grown(least: int, longest: int):
    def run(table: pa.Table) -> pa.Table:
        column = lambda c: table.column(c).to_pylist()
        known: dict[bytes, int] = {}
        cells = []
        for sizes, words, own in zip(column("sizes"), column("words"), column("cells")):
            edge = np.append(0, np.cumsum(np.frombuffer(sizes, "<u4"), dtype=np.int64)).tolist()
            number = np.array([*(known.setdefault(words[a:b], len(known)) for a, b in zip(edge, edge[1:])), -1], np.int32)
            local = np.frombuffer(own, "<i2" if len(edge) - 1 < 32_000 else "<i4")
            cells.append(number[local].reshape(longest, -1))
        counts = np.frombuffer(b"".join(column("counts")), "<u4").astype(np.int64)
        text = [w.decode("utf-8", "replace") for w in known]
        found = list(grow(np.concatenate(cells, axis=1), counts, least, column("depth")[0]))
        phrases = ["", *(" ".join([text[w] for w in p]) for p, _ in found)]
        return pa.table({
            "lang": pa.array([column("lang")[0]] * len(phrases), pa.string()),
            "n_words": pa.array([0, *(len(p) for p, _ in found)], pa.int32()),
            "phrase": pa.array(phrases, pa.string()),
            "n": pa.array([sum(column("n")), *(n for _, n in found)], pa.int64()),
        })

    return run


def frequent_phrases(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST) -> DataFrame:
    """``lang``, ``n_words``, ``phrase`` and its occurrences ``n``, of all phrases of up to
    ``longest`` words that occur ``least`` times; phrases of no words have the number of all words."""
    docs = df.select(_language(F.col(f"`{lang}`")).alias("lang"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("_text"))
    total = int(docs.agg(F.sum(F.octet_length("_text"))).first()[0] or 0)
    shards = max(32, total // SHARD_BYTES)
    hot = docs.sparkSession.sparkContext.broadcast(_hot_prefixes(docs, longest, shards))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, texts in _steps(batches):
            dealt = _dealt(own, Pointers(texts, longest), hot.value, shards)
            if dealt is not None:
                yield dealt

    grown = map_arrow(docs, run, POINTERS).groupBy("lang", "depth", "shard").applyInArrow(_grown(least, longest), GROWN)
    return grown.groupBy("lang", "n_words", "phrase").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("n_words") == 0))


def _words_between(phrase: Column, begin: Column, size: Column) -> Column:
    return F.array_join(F.slice(F.split(phrase, " "), begin, size), " ")


def collocations(df: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, best: int = BEST, closed_percent: int = 100) -> DataFrame:
    """The ``best`` phrases of each language by the lowest score of their cuts: ``lang``, ``rank``,
    ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``. A phrase goes if a longer one holds it that
    has ``closed_percent`` of its occurrences."""
    found = written(frequent_phrases(df, text, lang, least, longest), "phrases")
    words = found.where("n_words = 0").select("lang", "n")
    candidates = found.where("n_words >= 2").select("lang", "n_words", "phrase", F.col("n").alias("a"))
    parts = found.where(F.col("n_words").between(1, longest - 1)).select("lang", "phrase", "n")
    cuts = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _words_between(F.col("phrase"), F.lit(1), F.col("k")).alias("first"), _words_between(F.col("phrase"), F.col("k") + 1, F.col("n_words") - F.col("k")).alias("rest"))
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("first"), F.col("n").alias("l")), ["lang", "first"])
    cuts = cuts.join(parts.select("lang", F.col("phrase").alias("rest"), F.col("n").alias("r")), ["lang", "rest"]).join(words, "lang")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    above = (F.lit(1000).cast("decimal(4,0)") * wide("a")).cast("decimal(23,0)") * wide("n")
    cuts = cuts.withColumn("_above", above.cast("decimal(38,0)")).withColumn("_below", (wide("l") * wide("r")).cast("decimal(38,0)"))
    scored = cuts.withColumn("score", F.expr("_above div _below"))
    lowest = scored.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = candidates.where("n_words >= 3").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("n_words") - 1)))
    inner = inner.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("size") + 1)))
    inner = inner.groupBy("lang", _words_between(F.col("phrase"), F.col("at"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longer"))
    open_ones = lowest.join(inner, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < closed_percent * F.col("a")))
    rows = open_ones.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # The best of each part of a language first, so that the last step has a bounded number of rows.
    part = F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS))
    few = rows.withColumn("_part", part).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= best)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).where(F.col("rank") <= best)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
