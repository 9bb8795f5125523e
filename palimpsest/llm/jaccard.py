"""N-gram Jaccard join by vertical partitioning.

The global order of shingles is cut into fragments. A first count, over the fragments of the
order's lower half, sums for each document how many of its shingles others have: a document can
miss at most a fifth of its shingles in a partner, so those that miss more there have none. The
documents left, one for each set of shingles, are ordered from rare to frequent shingles; two that
link share one of their rarest ones. Pairs found so are counted fragment by fragment, and the
partial overlaps are summed for each pair and held against the threshold.

Large groups of near copies do not make all pairs: in each list of documents with a rare shingle,
all are first compared with the list's most central one; then only documents that are still in
different components are compared with each other. No pair of different components is left out,
so components are those of all links.

Every set of shingles is one class, whatever rows have it, and all of this happens among classes;
rows only meet their class at the end. So keys may repeat or be null.

Defined results: null texts and texts without words have no shingles, link with nothing and form
their own component; texts with fewer words than a shingle are one shingle; texts of any length
are taken whole; equal sets are one class; the smallest key of a component stands for it, where
rows with a null key take part but cannot stand for it (null if no row of it has a key); each row
of a repeated key counts by itself; ties of frequency are settled by the shingle's hash; extra
columns are ignored; an empty table gives an empty table. The input must be a scan that repeats
(files, or a written table), as lost tasks are run again.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import LOWER, MIX, NOT_SPACE, byte_slices, distinct_in_rows, join_counted, map_arrow, mixed, name_beside, per_row, span_hashes, string_buffers, token_spans, written
from .components import connected
from .fragments import DEALT, STEP_BYTES, deal, fragments_for, shared_values, text_bytes

WORDS, PERCENT = 5, 80
#: Cells of the sketch of shingle frequencies that orders them, and fragments of a pair's count.
CELLS_LOG2, COUNT_FRAGMENTS = 20, 4
#: Documents of a block's sides, on the average.
FEW, MANY = 64, 256
#: About so many bytes of text make a shingle.
BYTES_PER_SHINGLE = 7
_GAPS = np.cumprod(np.full(64, np.uint64(0xA0761D6478BD642F), np.uint64), dtype=np.uint64)


def shingles(data: np.ndarray, offsets: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and their bounds."""
    lower = LOWER[data]
    starts, ends, first = token_spans(lower, offsets, NOT_SPACE)
    hashes = span_hashes(lower, starts, ends)
    n = len(hashes)
    end = np.repeat(first[1:], np.diff(first))
    place = np.arange(n)
    padded = np.append(hashes, np.zeros(words, np.uint64))
    total = np.zeros(n, np.uint64)
    for j in range(words):
        total += np.where(place + j < end, padded[j : j + n], np.uint64(0)) * _GAPS[j]
    size = np.minimum(end - place, words)
    begin = np.repeat(first[:-1], np.diff(first))
    keep = (size == words) | (place == begin)
    values = mixed(total + size.astype(np.uint64) * MIX)[keep]
    kept_before = np.append(0, np.cumsum(keep))
    return distinct_in_rows(values, kept_before[first])


def may_miss(n: np.ndarray, percent: int) -> np.ndarray:
    """Shingles of n that a linked partner may lack."""
    return n - (n * percent + 99) // 100


def _signatures(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    sums = []
    for salt in (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)):
        total = np.append(np.uint64(0), np.cumsum(mixed(values ^ salt), dtype=np.uint64))
        sums.append((total[bounds[1:]] - total[bounds[:-1]]).astype(np.int64))
    return sums[0], sums[1]


def shingle_sets(df: DataFrame, text: str, key: str, words: int = WORDS) -> DataFrame:
    """``id``, ``n`` and the packed sorted shingles of each text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "_text"):
            values, bounds = shingles(*string_buffers(part.column("_text")), words)
            at = bounds.tolist()
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(bounds), pa.int64()), pa.array([values[a:b].tobytes() for a, b in zip(at, at[1:])], pa.binary())], names=["id", "n", "shingles"])

    return map_arrow(df.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("_text")), run, "id bigint, n bigint, shingles binary")


SIZES = "id bigint, digest string, n bigint, low bigint, sig1 bigint, sig2 bigint"


def _sizes(docs: DataFrame, words: int) -> DataFrame:
    """Number of shingles, of those in the lower half of the order, and a signature of the set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "_text"):
            values, bounds = shingles(*string_buffers(part.column("_text")), words)
            numbers = (np.diff(bounds), per_row(values < np.uint64(1 << 63), bounds), *_signatures(values, bounds))
            yield pa.RecordBatch.from_arrays([part.column("id"), part.column("digest"), *(pa.array(x, pa.int64()) for x in numbers)], names=["id", "digest", "n", "low", "sig1", "sig2"])

    return map_arrow(docs, run, "id bigint, digest string, n bigint, low bigint, sig1 bigint, sig2 bigint")


def _deal_low(docs: DataFrame, words: int, fragments: int) -> DataFrame:
    """Entries of the order's lower half by fragments; sets go by their signature, and equal ones
    of a step are dealt once."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "_text", STEP_BYTES):
            values, bounds = shingles(*string_buffers(part.column("_text")), words)
            one, _ = _signatures(values, bounds)
            first = np.zeros(part.num_rows, bool)
            first[np.unique(one, return_index=True)[1]] = True
            owner = np.repeat(np.arange(part.num_rows), np.diff(bounds))
            used = (values < np.uint64(1 << 63)) & first[owner]
            ends = np.append(0, np.cumsum(np.bincount(owner[used], minlength=part.num_rows)))
            yield from deal(one, ends, values[used] << np.uint64(1), fragments, False)

    return map_arrow(docs.select("_text"), run, DEALT)


def _frequency_order(sets: DataFrame) -> np.ndarray:
    """Counts of shingles in a fixed number of cells: rare cells come first in the order."""
    blocks, size = 256, (1 << CELLS_LOG2) // 256

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << CELLS_LOG2, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                values = np.frombuffer(b"".join(batch.column("shingles").slice(at, 2048).to_pylist()), np.uint64)
                total += np.bincount(values >> np.uint64(64 - CELLS_LOG2), minlength=1 << CELLS_LOG2)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(blocks), pa.int32()), pa.array([x.tobytes() for x in total.reshape(blocks, size)], pa.binary())], names=["k", "v"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int64) for x in table.column("v"))
        return pa.table({"k": table.column("k").slice(0, 1), "v": pa.array([total.tobytes()], pa.binary())})

    got = sets.select("shingles").mapInArrow(count, "k int, v binary").groupBy("k").applyInArrow(add, "k int, v binary").collect()
    out = np.zeros((blocks, size), np.int64)
    for row in got:
        out[row["k"]] = np.frombuffer(row["v"], np.int64)
    return out.ravel()


def _in_order(sets: DataFrame, percent: int) -> DataFrame:
    """``id``, ``n``, ``prefix`` (shingles of which linked documents share one), ``central`` and
    the packed shingles of each fragment of the order, from rare to frequent."""
    counts = _frequency_order(sets)
    rising = np.sort(counts)
    total = np.cumsum(rising)
    cuts = rising[np.searchsorted(total, total[-1] * np.arange(1, COUNT_FRAGMENTS) / COUNT_FRAGMENTS)]
    shared = sets.sparkSession.sparkContext.broadcast((counts, cuts))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, cuts = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                prefixes, central, pieces = [], [], [[] for _ in range(COUNT_FRAGMENTS)]
                for n, raw in zip(part.column("n").to_pylist(), part.column("shingles").to_pylist()):
                    values = np.frombuffer(raw, np.uint64)
                    often = counts[values >> np.uint64(64 - CELLS_LOG2)]
                    order = np.lexsort((values, often))
                    prefixes.append(values[order[: int(may_miss(np.array(n), percent)) + 1]].view(np.int64).tolist())
                    central.append(int(np.minimum(often, 1 << 30).sum() // max(1, n)))
                    where = np.searchsorted(cuts, often, side="right")
                    for k in range(COUNT_FRAGMENTS):
                        pieces[k].append(values[where == k].tobytes())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("n"), pa.array(prefixes, pa.list_(pa.int64())), pa.array(central, pa.int64()), *(pa.array(p, pa.binary()) for p in pieces)],
                    names=["id", "n", "prefix", "central", *(f"f{k}" for k in range(COUNT_FRAGMENTS))],
                )

    return map_arrow(sets, run, "id bigint, n bigint, prefix array<bigint>, central bigint, " + ", ".join(f"f{k} binary" for k in range(COUNT_FRAGMENTS)))


def _common(pairs: DataFrame, ordered: DataFrame, percent: int) -> DataFrame:
    """Links among candidate pairs (a, b): partial overlaps by fragment, summed for each pair."""
    pieces = [f"f{k}" for k in range(COUNT_FRAGMENTS)]
    side = lambda c: ordered.select(F.col("id").alias(c), F.col("n").alias(f"n_{c}"), F.array(*pieces).alias(f"p_{c}"))
    both = pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    cut = both.select("a", "b", "n_a", "n_b", F.posexplode(F.arrays_zip("p_a", "p_b")).alias("fragment", "p")).select("a", "b", "n_a", "n_b", F.col("p.p_a").alias("x"), F.col("p.p_b").alias("y"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            overlap = [len(np.intersect1d(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), assume_unique=True)) for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(overlap, pa.int64())], names=["a", "b", "n_a", "n_b", "part"])

    parts = map_arrow(cut, count, "a bigint, b bigint, n_a bigint, n_b bigint, part bigint")
    summed = parts.groupBy("a", "b", "n_a", "n_b").agg(F.sum("part").alias("overlap"))
    return summed.where(F.col("overlap") * 100 >= (F.col("n_a") + F.col("n_b") - F.col("overlap")) * percent).select("a", "b", "n_a", "n_b", "overlap")


def _near_size(x: str, y: str, percent: int):
    return F.least(x, y) * 100 >= F.greatest(x, y) * percent


def _prefix_rows(ordered: DataFrame) -> DataFrame:
    more = ["root"] if "root" in ordered.columns else []
    return ordered.select("id", "n", "central", *more, F.explode("prefix").alias("shingle"))


def _central_pairs(ordered: DataFrame, percent: int) -> DataFrame:
    """Every document with the most central one of each list of documents with a shingle of
    their prefixes."""
    rows = _prefix_rows(ordered)
    lists = rows.groupBy("shingle").agg(F.count("*").alias("size"), F.max(F.struct("central", (-F.col("id")).alias("low"), "n")).alias("top")).where("size > 1")
    lists = written(lists.select("shingle", (-F.col("top.low")).alias("a"), F.col("top.n").alias("n_a"), F.col("size").alias("members")), "lists")
    found = join_counted(rows, lists, ["shingle"])
    return found.where((F.col("id") != F.col("a")) & _near_size("n", "n_a", percent)).select("a", F.col("id").alias("b")).distinct()


def _all_pairs(ordered: DataFrame, percent: int) -> DataFrame:
    """All pairs that share a shingle of their prefixes."""
    rows = _prefix_rows(ordered)
    other = rows.select("shingle", F.col("id").alias("b"), F.col("n").alias("n_b"))
    found = rows.join(other, "shingle").where((F.col("id") < F.col("b")) & _near_size("n", "n_b", percent))
    return found.select(F.col("id").alias("a"), "b").distinct()


def _block_links(ordered: DataFrame, roots: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join different roots.

    Lists whose documents have several roots are sorted by the root of their most central
    document. Of such a family, the documents of other roots are held against all its documents
    in blocks of bounded size; a block adds up partial overlaps by fragment and gives one link for
    each two roots that it joins, never its pairs.
    """
    rows = written(_prefix_rows(ordered.join(roots, "id", "left")).withColumn("root", F.coalesce("root", "id")), "prefixes")
    lists = rows.groupBy("shingle").agg(F.min("root").alias("least"), F.max("root").alias("most"), F.max(F.struct("central", "root")).alias("top"), F.count("*").alias("members")).where("least < most")
    lists = written(lists.select("shingle", F.col("top.root").alias("main"), "members"), "lists")
    family = written(join_counted(rows, lists, ["shingle"]).select("main", "id", "root").distinct(), "families")
    size = family.groupBy("main").agg(F.ceil(F.count_if(F.col("root") != F.col("main")) / FEW).cast("int").alias("blocks"), F.ceil(F.count("*") / MANY).cast("int").alias("others"), F.count("*").alias("members"))
    sized = join_counted(family, written(size, "sizes"), ["main"])
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.col(n)).cast("int")
    few = sized.where("root <> main").select("main", "id", "root", one("blocks", 1).alias("x"), every("others").alias("y"))
    many = sized.select("main", "id", "root", every("blocks").alias("x"), one("others", 2).alias("y"))
    pieces = ordered.select("id", "n", *[f"f{k}" for k in range(COUNT_FRAGMENTS)])
    by = ("main", "x", "y")

    def compare(left: pa.Table, right: pa.Table) -> pa.Table:
        links: list[tuple[int, int]] = []
        joined: dict[int, int] = {}

        def top(r: int) -> int:
            while joined.get(r, r) != r:
                r = joined[r]
            return r

        ids, root, n = (right.column(c).to_numpy() for c in ("id_", "root_", "n_"))
        fragments = []
        for k in range(COUNT_FRAGMENTS):
            parts = [np.frombuffer(x, np.uint64) for x in right.column(f"f{k}_").to_pylist()]
            fragments.append((np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.repeat(np.arange(len(parts)), [len(p) for p in parts])))
        for row in left.to_pylist():
            overlap = np.zeros(len(ids), np.int64)
            for k, (values, owner) in enumerate(fragments):
                own = np.sort(np.frombuffer(row[f"f{k}"], np.uint64))
                if len(own):
                    at = np.minimum(np.searchsorted(own, values), len(own) - 1)
                    overlap += np.bincount(owner[own[at] == values], minlength=len(ids))
            near = np.flatnonzero((root != row["root"]) & (overlap * 100 >= (n + row["n"] - overlap) * percent))
            for j in near.tolist():
                x, y = top(row["root"]), top(int(root[j]))
                if x != y:
                    joined[max(x, y)] = min(x, y)
                    links.append((row["id"], int(ids[j])))
        return pa.table({"a": pa.array([x for x, _ in links], pa.int64()), "b": pa.array([y for _, y in links], pa.int64())})

    left, right = few.join(pieces, "id"), many.join(pieces, "id")
    right = right.select(*[F.col(c).alias(f"{c}_") for c in right.columns])
    return left.groupBy(*by).cogroup(right.groupBy(*[f"{c}_" for c in by])).applyInArrow(compare, "a bigint, b bigint")


def _digest(text: str) -> Column:
    return F.md5(F.col(text).cast("string").cast("binary"))


def _found(df: DataFrame, text: str, key: str, words: int, percent: int) -> DataFrame:
    """``id``, ``digest`` (of the text), ``n``, ``component_id``, ``least`` (key of its class) and
    ``root`` (a number of the component, null without shingles) of every row."""
    docs = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("_text"), _digest(text).alias("digest"))
    fragments = fragments_for(text_bytes(docs, "_text") / BYTES_PER_SHINGLE / 2)
    sizes = written(_sizes(docs, words), "sizes")
    met = shared_values(_deal_low(docs, words, fragments), fragments, False).groupBy(F.col("key").alias("sig1")).agg(F.sum("n").alias("met"))
    by = ["sig1", "sig2", "n"]
    classes = sizes.where("n > 0").groupBy(*by).agg(F.min("id").alias("least"), F.min(F.struct("id", "digest")).alias("text"), F.max("low").alias("low"), F.count("*").alias("members"))
    slack = F.coalesce("met", F.lit(0)) + F.col("n") - F.floor((F.col("n") * percent + 99) / 100) - F.col("low")
    classes = classes.join(met, "sig1", "left").select(F.monotonically_increasing_id().alias("class"), *by, "least", "text", "members", slack.alias("slack"))
    classes = written(classes, "classes")
    # One row of each class left gives its text: by key and digest, so that copies don't meet.
    left = classes.where("slack >= 0").select("class", F.col("text.id").alias("own"), F.col("text.digest").alias("digest"))
    texts = docs.join(left, (docs["digest"] == left["digest"]) & docs["id"].eqNullSafe(left["own"])).select("class", "_text")
    kept = written(shingle_sets(texts, "_text", "class", words).dropDuplicates(["id"]), "sets")
    ordered = written(_in_order(kept, percent), "ordered")
    links = written(_common(_central_pairs(ordered, percent), ordered, percent), "pairs")
    roots = connected(links)
    more = written(_block_links(ordered, roots, percent), "pairs")
    if more.limit(1).count():
        roots = connected(links.select("a", "b").union(more.select("a", "b")))
    placed = classes.join(roots.select(F.col("id").alias("class"), "root"), "class", "left").select(*by, "least", "members", F.coalesce("root", "class").alias("root"))
    placed = written(placed, "placed")
    least = written(placed.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("classes")), "least")
    named = written(join_counted(placed, least, ["root"], "classes"), "named")
    found = join_counted(sizes.where("n > 0").drop("low"), named, by).select("id", "digest", "n", "component_id", "least", "root")
    alone = sizes.where("n = 0").select("id", "digest", "n", F.col("id").alias("component_id"), F.col("id").alias("least"), F.lit(None).cast("bigint").alias("root"))
    return found.unionByName(alone)


def jaccard_components(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``key``, ``n_shingles``, ``component_id`` and ``representative`` (the smallest key of its
    class of equal sets) of every row."""
    found = _found(df, text, key, words, percent)
    return found.select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id", F.col("least").alias("representative"))


def keep_one(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of ``df`` without near duplicates: of each component the row with the smallest key
    stays (one without a key only if no row has one), and rows without shingles stay. Of rows with
    that key and the same text one stays, whichever; others of a repeated key go by their own text."""
    found = written(_found(df, text, key, words, percent).where("root is not null").select("id", "digest", "root"), "found")
    same = ["id", "digest"]
    rank = F.struct(F.col("id").isNull().alias("bare"), "id", "digest")
    first = written(found.groupBy("root").agg(F.min(rank).alias("first"), F.count("*").alias("members")), "firsts")
    placed = join_counted(found, first, ["root"]).withColumn("stays", F.col("id").eqNullSafe(F.col("first.id")) & (F.col("digest") == F.col("first.digest")))
    # A key and a text are in one component, so all rows of both go or stay.
    rows = written(placed.groupBy(*same).agg(F.max("stays").alias("stays"), F.count("*").alias("members")), "rows")
    id_, digest_ = name_beside(df.columns, "_id"), name_beside(df.columns, "_digest")
    docs = df.withColumns({id_: F.col(key).cast("bigint"), digest_: _digest(text)})
    match = lambda other: docs[id_].eqNullSafe(other["id"]) & (docs[digest_] == other["digest"])
    gone = rows.where("not stays")
    twice = rows.where("stays and members > 1")
    if not twice.limit(1).count():
        return docs.join(gone, match(gone), "left_anti").select(*df.columns)
    several = rows.where("not stays or members > 1")
    once = docs.join(twice, match(twice), "left_semi").dropDuplicates([id_, digest_])
    return docs.join(several, match(several), "left_anti").unionByName(once).select(*df.columns)


def jaccard_pairs(df: DataFrame, text: str = "text", key: str = "doc_id", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """All links (a, b, n_a, n_b, overlap) between different sets, each standing for its class:
    for callers that need every pair and whose groups are small enough to hold them."""
    sets = shingle_sets(df, text, key, words).where("n > 0").groupBy("shingles").agg(F.min("id").alias("key"), F.first("n").alias("n"))
    sets = written(sets.select(F.monotonically_increasing_id().alias("id"), "key", "n", "shingles"), "sets")
    ordered = written(_in_order(sets.select("id", "n", "shingles"), percent), "ordered")
    found, keys = written(_common(_all_pairs(ordered, percent), ordered, percent), "pairs"), sets.select("id", "key")
    for side in ("a", "b"):
        found = found.join(keys.select(F.col("id").alias(side), F.col("key").alias(f"key_{side}")), side)
    swap = F.col("key_a") > F.col("key_b")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return found.select(pick("key_a", "key_b").alias("a"), pick("key_b", "key_a").alias("b"), pick("n_a", "n_b").alias("n_a"), pick("n_b", "n_a").alias("n_b"), "overlap")
