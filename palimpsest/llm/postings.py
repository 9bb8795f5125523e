"""A distributed positional inverted index of all words, and phrase and proximity search over it.

Documents are gathered in blocks of about ``STEP_BYTES`` of text. The index is a stored table of
posting lists: for each word and block, the word's positions there, as differences of one to five
bytes. It is dealt and sorted by word; a word that would fill much of a partition is split over
more of them by block. One more list in each block has its documents' lengths, and a table beside
it says where each document lies. Nothing in it depends on a benchmark, so any number of them can
be searched later.

A window of consecutive benchmark words is looked for from its rarest words in the corpus. First
only the lists of those words are read, met by block, and intersected after moving them by their
offsets in the window: of the ``spare + 2`` rarest words of a window that may lack ``spare``, two
must stand near their places. The lists of the windows' frequent words are then fetched for those
blocks only where such starts were found, and every word is held against its place.

A start where all words stand is an exact phrase match. A proximity match is a start at which one
of the words stands at its place, and enough of them stand within ``NEAR_DISTANCE`` words of
theirs, whichever words these are. The benchmark is broadcast in blocks of bounded size, each of
which is one search.

Defined results: null or empty texts have no words and no hits; texts of any length are indexed
whole; benchmark rows without words are ignored; a null item_id counts for hits but cannot be
listed; repeated items and ties count once per item_id; each row counts by itself, whether keys
repeat or are null; extra columns are dropped unless named in ``keep``, where one with the name of
a result is replaced by it; an empty benchmark leaves every document clean, and an empty table
gives an empty table. Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..sources.folders import fresh_folder
from .common import byte_slices, map_arrow, schema_of, text_rows, written
from .decontaminate import BLOCK_BYTES, NEAR_DISTANCE, NEAR_SHARE, STEP, WINDOW_WORDS, Block, Windows, benchmark_items, benchmark_words, blocks_of, words_of
from .fragments import text_bytes

#: Text bytes of a block of documents, and of a partition of the index; a longer text is a block of its own.
STEP_BYTES, PARTITION_BYTES = 2 << 20, 128 << 20
#: The word number of a block's list of documents; no word has it.
DOCUMENTS = 0

PLACES, LISTS = "doc bigint, n_words bigint", "term bigint, n bigint, positions binary"
RESULT = "n_words bigint, hit_spans array<struct<start: bigint, end: bigint>>, items array<string>, near_items array<string>"
ANSWER = "block bigint, doc bigint, hit_spans array<struct<start: bigint, end: bigint>>, items array<string>, near_items array<string>"
CANDIDATES = "block bigint, windows binary, starts binary, docs binary"


def to_bytes(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0, seven bits a byte, the last byte of each below 128; and the bytes of each."""
    size = np.ones(len(values), np.int64)
    for bits in range(7, 64, 7):
        more = values >= (1 << bits)
        if not more.any():
            break
        size += more
    at = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    for k in range(int(size.max(initial=0))):
        has = np.flatnonzero(size > k)
        out[at[has] + k] = (values[has] >> (7 * k)) & 127 | np.where(size[has] > k + 1, 128, 0)
    return out, size


def from_bytes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers, and for each the place of its last byte."""
    last = np.flatnonzero(data < 128)
    if not len(last):
        return np.zeros(0, np.int64), last
    first = np.append(0, last[:-1] + 1)
    shift = 7 * (np.arange(len(data)) - np.repeat(first, last - first + 1))
    return np.add.reduceat((data & 127).astype(np.int64) << shift, first), last


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.append(0, ends).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))])


def _lists_of(hashes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Words of a block, how often each stands, its positions and how many bytes they take; first the documents."""
    order = np.argsort(hashes, kind="stable")
    hashes = hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    first = np.flatnonzero(new)
    step = np.diff(order, prepend=0)
    step[first] = order[first]
    data, size = to_bytes(np.concatenate([sizes, step]))
    bounds = np.append(0, len(sizes) + np.append(first, len(hashes)))
    ends = np.append(0, np.cumsum(size))[bounds[1:]]
    terms = np.append(np.uint64(DOCUMENTS), hashes[first])
    return terms.view(np.int64), np.diff(bounds), _binary(data, ends), np.diff(ends, prepend=0)


@dataclass
class Index:
    """The stored lists, and a row for each document with its place and its number of words."""

    lists: DataFrame
    documents: DataFrame
    keep: tuple[str, ...]


def _named(hashes: np.ndarray) -> np.ndarray:
    """Hashes of words without the number that stands for a block's documents."""
    return np.where(hashes == DOCUMENTS, np.uint64(1), hashes)


def store_index(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text") -> Index:
    """Writes the index: texts are read once for their size and once to be indexed; the lists are
    shuffled once, with the kept columns."""
    spark = df.sparkSession
    keep, name, rows = text_rows(df, keep, text, RESULT)
    # Kept columns go by number in a struct, so that none meets one of the index's.
    rows = rows.select(F.struct(F.lit(0).alias("row"), *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]).alias("kept"), F.col(name).alias("text"))
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), text_bytes(rows, "text") // PARTITION_BYTES + 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for part in byte_slices(batches, "text", STEP_BYTES):
            hashes, first = words_of(part.column("text"))
            sizes = np.diff(first).astype(np.int64)
            terms, n, positions, size = _lists_of(_named(hashes), sizes)
            # A word with over a quarter of a partition's share of the block is split, by blocks.
            salt = (number * 0x9E3779B97F4A7C15 >> 32 & 0xFFFFFFFF) % (1 + size * 4 * partitions // STEP_BYTES)
            yield _rows(number, kept=part.column("kept"), doc=pa.array(np.arange(part.num_rows)), n_words=pa.array(sizes), salt=pa.repeat(pa.scalar(number, pa.int64()), part.num_rows))
            yield _rows(number, kept=pa.nulls(len(terms), part.schema.field("kept").type), term=pa.array(terms), n=pa.array(n.astype(np.int64)), positions=positions, salt=pa.array(salt.astype(np.int64)))
            number += 1

    path = fresh_folder(spark, "index")
    indexed = map_arrow(rows, run, schema_of(rows, ("kept",), f"{PLACES}, {LISTS}, block bigint, salt bigint"))
    # Lists of documents are dealt by block, like the documents.
    dealt = indexed.withColumn("salt", F.when(F.col("term") == DOCUMENTS, F.col("block")).otherwise(F.col("salt"))).repartition(partitions, "term", "salt")
    parted = dealt.drop("salt").withColumn("part", F.when(F.col("term").isNull(), "documents").otherwise("lists"))
    parted.sortWithinPartitions("part", "term", "block").write.partitionBy("part").parquet(path)
    read = spark.read.schema(parted.schema).parquet(path)
    return Index(read.where("part = 'lists'").select("term", "block", "n", "positions"), read.where("part = 'documents'").select("kept", "block", "doc", "n_words"), keep)


def _rows(block: int, **columns: pa.Array) -> pa.RecordBatch:
    """Rows of documents or of lists; columns that are not given are null."""
    many = len(columns["salt"])
    kinds = {"doc": pa.int64(), "n_words": pa.int64(), "term": pa.int64(), "n": pa.int64(), "positions": pa.binary()}
    own = {"kept": columns["kept"], **{c: columns.get(c, pa.nulls(many, kind)) for c, kind in kinds.items()}}
    own |= {"block": pa.repeat(pa.scalar(block, pa.int64()), many), "salt": columns["salt"]}
    return pa.RecordBatch.from_pydict(own)


class Lists:
    """Decoded lists of one block, by the number of the word among the windows' words; documents
    stand a gap apart, so that no lookup from a word of one reaches another."""

    def __init__(self, windows: Windows, terms: np.ndarray, positions: list[bytes], width: int, distance: int):
        gap = width + 3 * distance + 1
        (place,) = np.flatnonzero(terms == DOCUMENTS)
        sizes, _ = from_bytes(np.frombuffer(positions[place], np.uint8))
        begin = np.cumsum(sizes) - sizes
        self.doc_start = begin + gap * (1 + np.arange(len(sizes)))
        chosen = [k for k in range(len(terms)) if k != place]
        number = np.searchsorted(windows.known, terms[chosen])
        data = np.frombuffer(b"".join(positions[k] for k in chosen), np.uint8)
        value, last = from_bytes(data)
        bytes_end = np.cumsum([len(positions[k]) for k in chosen], dtype=np.int64)
        ends = np.searchsorted(last, bytes_end)
        counts = np.diff(ends, prepend=0)
        at = np.cumsum(value)
        first = ends - counts
        at -= np.repeat(at[first] - value[first], counts)
        doc = np.searchsorted(begin, at, side="right") - 1
        at += gap * (1 + doc)
        term = np.repeat(number, counts)
        self.term_at = np.full((int(self.doc_start[-1] + sizes[-1]) if len(sizes) else 0) + 2 * gap, -2, np.int32)
        self.term_at[at] = term
        order = np.argsort(term, kind="stable")
        self.places = at[order]
        self.begin = np.searchsorted(term[order], np.arange(len(windows.known) + 1))

    def agree(self, windows: Windows, w: np.ndarray, s: np.ndarray, ranks: np.ndarray, spare: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
        """Which windows ``w`` lack at most ``spare`` of their ``ranks`` rarest words when they start
        at ``s``, and how many words stand at their places. Without ``spare`` all must do so."""
        near, there, alive = np.zeros(len(w), np.int32), np.zeros(len(w), np.int32), np.ones(len(w), bool)
        for k in range(int(ranks.max(initial=0))):
            at = np.flatnonzero(alive & (ranks > k))
            if not len(at):
                break
            offset = windows.ranked[w[at], k].astype(np.int64)
            term, place = windows.terms[w[at], offset], s[at] + offset
            hit = self.term_at[place] == term
            there[at] += hit
            for d in range(1, reach + 1):
                left = np.flatnonzero(~hit & (spare[at] > 0))
                if not len(left):
                    break
                hit[left] = (self.term_at[place[left] - d] == term[left]) | (self.term_at[place[left] + d] == term[left])
            near[at] += hit
            alive[at[k + 1 - near[at] > spare[at]]] = False
        return alive, there

    def candidates(self, windows: Windows, plan: Plan, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows, starts and documents where enough of the rarest words stand near their places."""
        length = np.append(np.diff(self.begin), 0)
        lack = np.zeros(len(plan.possible), np.int64)
        for k in range(int(plan.ranks[plan.possible].max(initial=0))):
            term = windows.terms[plan.possible, windows.ranked[plan.possible, k]]
            lack += (k < plan.ranks[plan.possible]) & (length[term] == 0)
        possible = plan.possible[lack <= plan.spare[plan.possible]]
        out: list[tuple[np.ndarray, ...]] = []
        for rank in range(int(plan.spare[possible].max(initial=-1)) + 1):
            rows = possible[plan.spare[possible] >= rank]
            offset = windows.ranked[rows, rank].astype(np.int64)
            term = windows.terms[rows, offset]
            ends, begin = np.cumsum(length[term]), 0
            while begin < len(rows):
                base = ends[begin - 1] if begin else 0
                end = max(begin + 1, int(np.searchsorted(ends, base + STEP, side="right")))
                counts = length[term[begin:end]]
                within = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
                w, found = np.repeat(rows[begin:end], counts), self.places[np.repeat(self.begin[term[begin:end]], counts) + within]
                s = found - np.repeat(offset[begin:end], counts)
                # Two words near their places are within twice the distance of each other's.
                alive, _ = self.agree(windows, w, s, plan.ranks[w], plan.spare[w], 2 * distance)
                w, s, found = w[alive], s[alive], found[alive]
                for d in range(-distance, distance + 1):
                    moved = np.flatnonzero((plan.spare[w] > 0) | (d == 0))
                    alive, _ = self.agree(windows, w[moved], s[moved] + d, plan.ranks[w[moved]], plan.spare[w[moved]], distance)
                    moved = moved[alive]
                    out.append((w[moved], s[moved] + d, found[moved]))
                begin = end
        if not out:
            return tuple(np.zeros(0, np.int64) for _ in range(3))
        w, s, found = (np.concatenate(x) for x in zip(*out))
        _, one = np.unique(w * np.int64(len(self.term_at)) + s, return_index=True)
        return w[one], s[one], np.searchsorted(self.doc_start, found[one], side="right") - 1


class Plan:
    """How many words each window may lack, how many of its rarest words are met first, and which
    windows the corpus has enough words for."""

    def __init__(self, windows: Windows, found: np.ndarray, near_share: float):
        need = np.minimum(windows.sizes, np.ceil(near_share * windows.sizes).astype(np.int64))
        self.spare = windows.sizes - need
        self.ranks = np.minimum(windows.sizes, self.spare + 2)
        known = np.append(np.isin(windows.known, found), False)
        self.possible = np.flatnonzero(known[windows.terms].sum(axis=1) >= need)

    def first_terms(self, windows: Windows) -> np.ndarray:
        """Words whose lists are read first."""
        terms = np.take_along_axis(windows.terms, windows.ranked.astype(np.int64), axis=1)[self.possible]
        return windows.known[np.unique(terms[np.arange(terms.shape[1]) < self.ranks[self.possible, None]])]


def _columns(table: pa.Table) -> tuple[np.ndarray, list[bytes]]:
    return table.column("term").to_numpy().view(np.uint64), table.column("positions").to_pylist()


def _search(index: Index, block: Block, frequency: DataFrame, width: int, near_share: float, distance: int) -> DataFrame:
    """Answers of one benchmark block: a row for each document with matches."""
    spark = index.lists.sparkSession
    of_terms = lambda x: F.broadcast(spark.createDataFrame(pd.DataFrame({"term": np.append(np.uint64(DOCUMENTS), x).view(np.int64)}), "term bigint"))
    own = np.unique(block.hashes)
    found = frequency.join(of_terms(own), "term").toPandas()  # as many rows as the block has words at most
    terms, often = found["term"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    windows = Windows(block, terms, often, width)
    plan = Plan(windows, terms, near_share)
    shared = spark.sparkContext.broadcast((windows, plan))

    def first(table: pa.Table) -> pa.Table:
        windows, plan = shared.value
        lists = Lists(windows, *_columns(table), width, distance)
        w, s, doc = lists.candidates(windows, plan, distance)
        rows = [table.column("block")[0].as_py()] if len(w) else []
        packed = lambda x, kind: pa.array([x.astype(kind).tobytes()] if len(w) else [], pa.binary())
        return pa.table({"block": pa.array(rows, pa.int64()), "windows": packed(w, "<i4"), "starts": packed(s, "<i8"), "docs": packed(doc, "<i4")})

    candidates = written(index.lists.join(of_terms(plan.first_terms(windows)), "term", "left_semi").groupBy("block").applyInArrow(first, CANDIDATES), "starts")

    def pairs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, _ = shared.value
        for batch in batches:
            for number, packed in zip(batch.column("block").to_pylist(), batch.column("windows").to_pylist()):
                terms = np.unique(windows.terms[np.unique(np.frombuffer(packed, "<i4"))])
                terms = np.append(np.uint64(DOCUMENTS), windows.known[terms[terms >= 0]])
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.repeat(pa.scalar(number, pa.int64()), len(terms))], names=["term", "block"])

    def second(starts: pa.Table, table: pa.Table) -> pa.Table:
        windows, plan = shared.value
        lists = Lists(windows, *_columns(table), width, distance)
        w, s, doc = (np.frombuffer(starts.column(c)[0].as_py(), kind).astype(np.int64) for c, kind in (("windows", "<i4"), ("starts", "<i8"), ("docs", "<i4")))
        alive, there = lists.agree(windows, w, s, windows.sizes[w], plan.spare[w], distance)
        alive &= there > 0
        w, s, doc, exact = w[alive], s[alive], doc[alive], (there == windows.sizes[w])[alive]
        return _answers(starts.column("block")[0].as_py(), windows, w, s - lists.doc_start[doc], doc, exact)

    wanted = map_arrow(candidates.select("block", "windows"), pairs, "term bigint, block bigint")
    lists = index.lists.select("term", "block", "positions").join(of_terms(own), "term", "left_semi").join(wanted, ["term", "block"], "left_semi")
    return candidates.groupBy("block").cogroup(lists.groupBy("block")).applyInArrow(second, ANSWER)


def _answers(block: int, windows: Windows, w: np.ndarray, s: np.ndarray, doc: np.ndarray, exact: np.ndarray) -> pa.Table:
    """Merged word ranges and item names of each document with matches."""
    order = np.lexsort((s, doc))
    docs, first = np.unique(doc[order], return_index=True)
    spans, full, near = [], [], []
    for rows in np.split(order, first[1:]) if len(docs) else ():
        whole = rows[exact[rows]]
        start, end = s[whole], np.maximum.accumulate(s[whole] + windows.sizes[w[whole]]) if len(whole) else s[whole]
        cut = np.flatnonzero(np.append(True, start[1:] > end[:-1])) if len(whole) else np.zeros(0, np.int64)
        last = np.append(cut[1:], len(whole)) - 1 if len(whole) else cut
        spans.append([{"start": a, "end": b} for a, b in zip(start[cut].tolist(), end[last].tolist())])
        names = lambda x: {name for i in np.unique(windows.items[w[x]]).tolist() for name in windows.names[i]}
        has = names(whole)
        full.append(sorted(has))
        near.append(sorted(names(rows[~exact[rows]]) - has))
    strings = pa.list_(pa.string())
    return pa.table({"block": pa.array([block] * len(docs), pa.int64()), "doc": pa.array(docs.astype(np.int64)), "hit_spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), "items": pa.array(full, strings), "near_items": pa.array(near, strings)})


def _one_answer(answers: DataFrame) -> DataFrame:
    """Answers of several benchmark blocks, as one row for each document."""
    # A span starts a new range if it lies beyond the end of all before it.
    spans = answers.select("block", "doc", F.explode("hit_spans").alias("span"))
    ranges = spans.groupBy("block", "doc").agg(F.array_sort(F.collect_set("span")).alias("spans"))
    last = lambda done: F.element_at(done, -1)
    merged = F.aggregate(
        F.slice("spans", 2, F.greatest(F.size("spans") - 1, F.lit(0))),
        F.slice("spans", 1, 1),
        lambda done, x: F.when(x["start"] > last(done)["end"], F.concat(done, F.array(x))).otherwise(
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(last(done)["start"].alias("start"), F.greatest(last(done)["end"], x["end"]).alias("end"))))
        ),
    )
    names = answers.groupBy("block", "doc").agg(*[F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c) for c in ("items", "near_items")])
    return names.withColumn("near_items", F.array_except("near_items", "items")).join(ranges.select("block", "doc", merged.alias("hit_spans")), ["block", "doc"], "left")


def search(index: Index, benchmark: DataFrame, item: str = "item_id", item_text: str = "text", width: int = WINDOW_WORDS, near_share: float = NEAR_SHARE, distance: int = NEAR_DISTANCE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Kept columns, ``n_words``, ``hit_spans`` (word ranges of exact phrases, merged), ``items``
    with exact phrases and ``near_items`` with proximity matches only."""
    items = benchmark_items(benchmark, item, item_text)
    words = benchmark_words(items)
    frequency = written(index.lists.select("term", "n").join(words, "term", "left_semi").groupBy("term").agg(F.sum("n").alias("n")), "frequencies")
    found = None
    for k, block in enumerate(blocks_of(items, block_bytes)):
        block.hashes = _named(block.hashes)
        answers = _search(index, block, frequency, width, near_share, distance)
        found = answers if found is None else found.unionByName(answers)
    if k:
        found = _one_answer(found)
    spans, strings = "array<struct<start: bigint, end: bigint>>", "array<string>"
    filled = [F.coalesce(c, F.array().cast(kind)).alias(c) for c, kind in (("hit_spans", spans), ("items", strings), ("near_items", strings))]
    own = [F.col(f"kept.k{i}").alias(c) for i, c in enumerate(index.keep)]
    return index.documents.join(found, ["block", "doc"], "left").select(*own, "n_words", *filled)
