"""Benchmark decontamination by a distributed positional inverted index.

The index is a stored table. Each document's row has its postings: the distinct words that the
benchmark uses, by hash, and the positions of each, in order; so documents are spread over tasks,
and all postings of one document lie together. How often each word stands in the whole corpus is
counted on the stored table. A window of consecutive benchmark words is answered from its rarest
word there: that word's list, moved by its offset in the window, gives the possible starts, and
the other words' lists, rarest first, are intersected with them. The benchmark goes over the
index in blocks of bounded size, and the texts are read once, whatever their number.

Starts where all words stand are exact phrase matches. A proximity match is found from any of the
window's rarest words, as many as may be missing and one more: with it at its place, so many of
the window's words must stand within ``NEAR_DISTANCE`` words of theirs, before or after. Words
that were put in, left out or swapped move the others by a few places only.

Defined results: null or empty texts have no words and no hits; texts of any length are indexed
whole; benchmark rows without words are ignored; a null item_id counts for hits but cannot be
listed; repeated items and ties count once per item_id; each row counts by itself, whether keys
repeat or are null; extra columns are dropped unless named in ``keep``, where one with the name of
a result is replaced by it; an empty benchmark leaves every document clean, and an empty table
gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from .common import byte_slices, map_arrow, schema_of, span_hashes, string_buffers, text_rows, written

WINDOW_WORDS = 10
#: Benchmark text of one broadcast block, in bytes; a longer single item is a block of its own.
BLOCK_BYTES = 2 << 20
#: Of ten words, so many make a proximity match; how far each may be from its place.
NEAR_SHARE, NEAR_DISTANCE = 0.8, 3
#: Distinct benchmark words up to which the index leaves all other words out (8 bytes each are
#: broadcast); beyond that it has every word, and results are the same.
VOCABULARY_WORDS = 1 << 20
#: Candidate starts, and words of documents, that are looked at together.
STEP, STEP_WORDS = 1 << 18, 1 << 17

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.zeros(256, bool)
_IS_WORD[48:58] = _IS_WORD[97:123] = _IS_WORD[128:] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts and ends of words, and each document's first word. No word
    crosses a document's end."""
    lower = _LOWER[data]
    inside = np.zeros(len(lower) + 1, bool)
    inside[:-1] = _IS_WORD[lower]
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    cut = offsets[1:-1]
    cut = cut[cut < len(lower)]
    begins[cut] |= inside[cut]
    starts = np.flatnonzero(begins)
    finish = inside[:-1] & ~inside[1:]
    ends_at = cut[(cut > 0)] - 1
    finish[ends_at] |= inside[ends_at]
    return lower, starts, np.flatnonzero(finish) + 1, np.searchsorted(starts, offsets)


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column of texts, and each text's first word."""
    lower, starts, ends, first = word_spans(*string_buffers(column))
    return span_hashes(lower, starts, ends), first


#: The index's own columns, beside those that are kept.
INDEX = "_index_words bigint, _index_terms array<bigint>, _index_many binary, _index_positions binary"
INDEX_COLUMNS = ("_index_words", "_index_terms", "_index_many", "_index_positions")


def store_index(df: DataFrame, vocabulary: np.ndarray | None, keep: tuple[str, ...], text: str) -> DataFrame:
    """Writes the index: ``keep`` columns, ``row`` (a number of the row), the number of words, the
    distinct words' hashes, how often each stands, and the positions of each in turn."""
    keep, name, rows = text_rows(df, keep, text, f"_index_row bigint, {INDEX}, {RESULT}")
    shared = rows.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for part in byte_slices(batches, name):
            hashes, first = words_of(part.column(name))
            doc = np.repeat(np.arange(part.num_rows), np.diff(first))
            position = np.arange(len(hashes)) - first[doc]
            if known is not None:
                place = np.minimum(np.searchsorted(known, hashes), max(0, len(known) - 1))
                used = known[place] == hashes if len(known) else np.zeros(len(hashes), bool)
                hashes, doc, position = hashes[used], doc[used], position[used]
            order = np.lexsort((hashes, doc))  # stable, so that positions rise in each list
            hashes, doc, position = hashes[order], doc[order], position[order].astype("<i4")
            new = np.ones(len(hashes), bool)
            new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
            at = np.flatnonzero(new)
            many = np.diff(np.append(at, len(hashes))).astype("<i4")
            lists, ends = np.searchsorted(doc[at], np.arange(part.num_rows + 1)), np.searchsorted(doc, np.arange(part.num_rows + 1))
            pieces = lambda x, bounds: pa.array([x[a:b].tobytes() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())], pa.binary())
            terms = pa.ListArray.from_arrays(pa.array(lists, pa.int32()), pa.array(hashes[at].view(np.int64)))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(np.diff(first), pa.int64()), terms, pieces(many, lists), pieces(position, ends)], names=[*keep, "_index_words", "_index_terms", "_index_many", "_index_positions"])

    indexed = map_arrow(rows, run, schema_of(df, keep, INDEX))
    return written(indexed.select(F.monotonically_increasing_id().alias("_index_row"), "*"), "postings")


@dataclass
class Block:
    """Benchmark items of one block: hashes of their words, each item's first word, and its names."""

    hashes: np.ndarray
    first: np.ndarray
    names: list[list[str]]


class Windows:
    """Windows of a block: term numbers by offset (-1 beyond a short item's end), and the order of
    their words from rare to frequent in the corpus."""

    def __init__(self, block: Block, found: np.ndarray, how_often: np.ndarray, width: int):
        self.known, number = np.unique(block.hashes, return_inverse=True)
        size = np.diff(block.first)
        many = np.where(size > 0, np.maximum(1, size - width + 1), 0)
        self.items = np.repeat(np.arange(len(size)), many)
        start = block.first[self.items] + np.arange(len(self.items)) - np.repeat(np.cumsum(many) - many, many)
        self.sizes = np.minimum(width, size[self.items])
        column = start[:, None] + np.arange(width)
        inside = np.arange(width) < self.sizes[:, None]
        self.terms = np.where(inside, number[np.minimum(column, max(0, len(number) - 1))] if len(number) else -1, -1).astype(np.int32)
        frequency = np.zeros(len(self.known) + 1, np.int64)
        frequency[np.searchsorted(self.known, found)] = how_often
        frequency[-1] = np.iinfo(np.int64).max
        self.ranked = np.argsort(frequency[self.terms], axis=1, kind="stable").astype(np.int8)
        self.names = block.names


class Postings:
    """Lists of some documents' words, met by term; documents stand a gap apart."""

    def __init__(self, windows: Windows, n_words: np.ndarray, terms: np.ndarray, terms_first: np.ndarray, many: np.ndarray, positions: np.ndarray, gap: int):
        self.doc_start = gap + np.cumsum(n_words + gap) - n_words - gap
        size = int(self.doc_start[-1] + n_words[-1]) + gap if len(n_words) else gap
        doc = np.repeat(np.arange(len(n_words)), np.diff(terms_first))
        place = np.minimum(np.searchsorted(windows.known, terms), max(0, len(windows.known) - 1))
        used = windows.known[place] == terms if len(windows.known) else np.zeros(len(terms), bool)
        term = np.repeat(np.where(used, place, -1), many)
        at = positions + np.repeat(self.doc_start[doc], many)
        self.term_at = np.full(size + gap, -2, np.int32)
        self.term_at[at] = term
        kept = np.flatnonzero(term >= 0)
        by_term = kept[np.argsort(term[kept], kind="stable")]
        self.lists = at[by_term]
        self.begin = np.searchsorted(term[by_term], np.arange(len(windows.known) + 1))

    def match(self, windows: Windows, near_share: float, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Rows (window, start, place of the word it was found from, exact) of all matches."""
        terms, ranked, sizes = windows.terms, windows.ranked, windows.sizes
        length = np.append(np.diff(self.begin), 0)
        need = np.minimum(sizes, np.ceil(near_share * sizes).astype(np.int64))
        possible = np.flatnonzero((length[terms] > 0).sum(axis=1) >= need)
        # A proximity match may lack some words, so the next rarest ones may find it as well.
        finders = sizes - need + 1
        out: list[tuple[np.ndarray, ...]] = []
        for rank in range(int(finders[possible].max(initial=0))):
            rows = possible[finders[possible] > rank]
            offset = ranked[rows, rank].astype(np.int64)
            term = terms[rows, offset]
            fits = length[term] > 0
            rows, offset, term = rows[fits], offset[fits], term[fits]
            ends = np.cumsum(length[term])
            begin = 0
            while begin < len(rows):
                base = ends[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, base + STEP, side="right")))
                counts = length[term[begin:end]]
                within = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
                w, found = np.repeat(rows[begin:end], counts), self.lists[np.repeat(self.begin[term[begin:end]], counts) + within]
                out.append(self._agree(windows, w, found - np.repeat(offset[begin:end], counts), found, need, distance))
                begin = end
        if not out:
            return tuple(np.zeros(0, np.int64) for _ in range(3)) + (np.zeros(0, bool),)
        w, s, found, exact = (np.concatenate(x) for x in zip(*out))
        _, one = np.unique(w * np.int64(len(self.term_at)) + s, return_index=True)
        return w[one], s[one], found[one], exact[one]

    def _agree(self, windows: Windows, w: np.ndarray, s: np.ndarray, found: np.ndarray, need: np.ndarray, distance: int) -> tuple[np.ndarray, ...]:
        """Those starts at which enough of the window's words stand near their places."""
        near, exact = np.zeros(len(w), np.int32), np.ones(len(w), bool)
        alive = np.arange(len(w))
        for k in range(windows.terms.shape[1]):
            own = w[alive]
            offset = windows.ranked[own, k].astype(np.int64)
            term = windows.terms[own, offset]
            real = term >= 0
            place = s[alive] + offset
            hit = self.term_at[place] == term
            exact[alive[real & ~hit]] = False
            for d in range(1, distance + 1):
                left = np.flatnonzero(real & ~hit & (need[own] < windows.sizes[own]))
                if not len(left):
                    break
                hit[left] = (self.term_at[place[left] - d] == term[left]) | (self.term_at[place[left] + d] == term[left])
            near[alive] += real & hit
            lost = np.minimum(k + 1, windows.sizes[own]) - near[alive]
            alive = alive[lost <= windows.sizes[own] - need[own]]
            if not len(alive):
                break
        return w[alive], s[alive], found[alive], exact[alive]


RESULT = "n_words bigint, hit_spans array<struct<start: bigint, end: bigint>>, items array<string>, near_items array<string>"
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def blocks_of(items: DataFrame, block_bytes: int) -> Iterator[Block]:
    """Distinct benchmark texts (``text``, ``items``) in blocks of bounded size."""
    column, names, size = [], [], 0

    def block() -> Block:
        return Block(*words_of(pa.array(column, pa.string())), names)

    for row in items.toLocalIterator():
        if column and size + len(row["text"]) > block_bytes:
            yield block()
            column, names, size = [], [], 0
        column.append(row["text"])
        names.append(row["items"])
        size += len(row["text"])
    yield block()


def benchmark_items(benchmark: DataFrame, item: str, text: str) -> DataFrame:
    rows = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).cast("string").alias("text")).where("text is not null")
    return written(rows.groupBy("text").agg(F.array_sort(F.collect_set("item")).alias("items")), "benchmark")


def benchmark_words(items: DataFrame) -> DataFrame:
    """Distinct words of the benchmark, by hash (``term``)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "text"):
            hashes, _ = words_of(part.column("text"))
            yield pa.RecordBatch.from_arrays([pa.array(np.unique(hashes).view(np.int64))], names=["term"])

    return written(map_arrow(items.select("text"), run, "term bigint").distinct(), "words")


def _block_matches(index: DataFrame, kept: tuple[str, ...], block: Block, frequency: DataFrame, width: int, near_share: float, distance: int) -> DataFrame:
    spark = index.sparkSession
    own = np.unique(block.hashes)
    known = spark.createDataFrame(pd.DataFrame({"term": own.view(np.int64)}), "term bigint")
    found = frequency.join(known, "term").toPandas()  # as many rows as the block has words at most
    shared = spark.sparkContext.broadcast((block, found["term"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(*shared.value, width)
        for batch in batches:
            total = np.append(0, np.cumsum(batch.column("_index_words").to_numpy()))
            start = 0
            while start < batch.num_rows:
                end = max(start + 1, int(np.searchsorted(total, total[start] + STEP_WORDS, side="right")) - 1)
                yield _answers(batch.slice(start, end - start), windows)
                start = end

    def _answers(part: pa.RecordBatch, windows: Windows) -> pa.RecordBatch:
        n_words = part.column("_index_words").to_numpy()
        packed = lambda c: np.frombuffer(b"".join(part.column(c).to_pylist()), "<i4").astype(np.int64)
        lists = part.column("_index_terms")
        first = np.append(0, np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False)))
        postings = Postings(windows, n_words, lists.flatten().to_numpy().view(np.uint64), first, packed("_index_many"), packed("_index_positions"), width + distance)
        w, s, place, exact = postings.match(windows, near_share, distance)
        doc = np.searchsorted(postings.doc_start, place, side="right") - 1
        order = np.lexsort((s, doc))
        w, s, exact, doc = w[order], s[order], exact[order], doc[order]
        spans: list[list] = [[] for _ in range(part.num_rows)]
        full: list[set] = [set() for _ in range(part.num_rows)]
        some: list[set] = [set() for _ in range(part.num_rows)]
        for d, window, begin, whole in zip(doc.tolist(), w.tolist(), s.tolist(), exact.tolist()):
            names = windows.names[windows.items[window]]
            if not whole:
                some[d].update(names)
                continue
            full[d].update(names)
            a = begin - int(postings.doc_start[d])
            b = a + int(windows.sizes[window])
            if spans[d] and a <= spans[d][-1]["end"]:
                spans[d][-1]["end"] = max(b, spans[d][-1]["end"])
            else:
                spans[d].append({"start": a, "end": b})
        strings = pa.list_(pa.string())
        more = [part.column("_index_words"), pa.array(spans, SPANS), pa.array([sorted(x) for x in full], strings), pa.array([sorted(y - x) for x, y in zip(full, some)], strings)]
        return pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *more], names=[*kept, "n_words", "hit_spans", "items", "near_items"])

    return map_arrow(index.select(*[F.col(f"`{c}`") for c in kept], *INDEX_COLUMNS), run, schema_of(index, kept, RESULT))


def phrase_matches(df: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item: str = "item_id", item_text: str = "text", width: int = WINDOW_WORDS, near_share: float = NEAR_SHARE, distance: int = NEAR_DISTANCE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` columns, ``n_words``, ``hit_spans`` (word ranges of exact phrases, merged),
    ``items`` with exact phrases and ``near_items`` with proximity matches only.

    Each block of the benchmark is one pass over the stored index; answers of several blocks meet
    by the number of the row in it.
    """
    items = benchmark_items(benchmark, item, item_text)
    words = benchmark_words(items)
    few = words.count() <= VOCABULARY_WORDS
    vocabulary = np.sort(words.toPandas()["term"].to_numpy(np.int64).view(np.uint64)) if few else None
    index = store_index(df, vocabulary, keep, text)
    kept = tuple(c for c in index.columns if c not in ("_index_row", *INDEX_COLUMNS))
    lists = index.select(F.explode("_index_terms").alias("term"))
    frequency = written(lists.groupBy("term").agg(F.count("*").alias("n")), "frequencies")
    blocks = blocks_of(items, block_bytes)
    block, following = next(blocks), next(blocks, None)
    if following is None:
        return _block_matches(index, kept, block, frequency, width, near_share, distance)
    together = None
    for own in (block, following, *blocks):
        part = _block_matches(index, ("_index_row",), own, frequency, width, near_share, distance)
        together = part if together is None else together.unionByName(part)
    together = together.groupBy("_index_row").agg(
        F.max("n_words").alias("n_words"),
        F.array_sort(F.flatten(F.collect_list("hit_spans"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("near_items")))).alias("near_items"),
    )
    merged = F.expr(
        "aggregate(spans, cast(array() as array<struct<start: bigint, end: bigint>>), (done, x) -> "
        "case when size(done) > 0 and x.start <= element_at(done, -1).end "
        "then concat(slice(done, 1, size(done) - 1), array(struct(element_at(done, -1).start as start, greatest(element_at(done, -1).end, x.end) as end))) "
        "else concat(done, array(x)) end)"
    )
    answers = together.select("_index_row", "n_words", merged.alias("hit_spans"), "items", F.array_except("near_items", "items").alias("near_items"))
    return index.select("_index_row", *[F.col(f"`{c}`") for c in kept]).join(answers, "_index_row").drop("_index_row")


def contamination(matches: DataFrame, key: str = "doc_id") -> DataFrame:
    """Hit words, items and their digest for each document."""
    hit = F.aggregate("hit_spans", F.lit(0).cast("bigint"), lambda n, x: n + x["end"] - x["start"])
    return matches.select(
        key,
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )


def items_digest(names: Iterable[object]) -> str:
    """The digest of a set of items, as ``contamination`` gives it."""
    return hashlib.sha256(",".join(sorted({str(x) for x in names})).encode()).hexdigest()
