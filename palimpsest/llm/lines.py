"""Line dedup by a fixed-depth tree of log templates.

A line's path in the tree is its number of tokens and its first tokens, where tokens with digits
are variable fields from the start. In a leaf, a token is a fixed part of its place if a share of
the leaf's documents have it there; other tokens are variable fields. The share is halved step by
step, from a half down to ``min_documents``: a line takes the first, most general template that
leaves most of its places fixed and that enough documents have, so that the same fields are found
in a leaf of any size. Only constant tokens count as fixed, and a third of the places beyond the
leading ones must be. A line without such a template stands for itself; one that cannot have any,
as it is short or mostly of digits, does so by its real tokens. A template that enough
documents have is recurring: its lines go from every document but the first, the one of the
smallest key.

Step by step: equal lines meet within a map step, then by leaf, so that a line that a third of
all documents have makes one entry for each step. The lines of a leaf have the same leading tokens,
so an entry has the hashes of the others, and how many of the leading ones are constant. Leaves go to tasks in buckets; a leaf of more
bytes than a bucket should hold is generalised by joins and sums over its lines instead, by the
same rule, share by share. Templates' documents are counted exactly in joins on the line, with
hot lines salted; every document is rewritten from the hashes of its own dropped lines.

Defined results: null texts stay null, empty texts empty; texts of any length are taken whole;
lines of fewer tokens than ``min_tokens`` have no fields; lines without tokens stay; a document's
own repetition alone drops nothing; rows with a null key stay as they are; rows of equal keys
count as one document, and each loses its own lines; of a template's documents the one with the
smallest key keeps its lines, and ties of templates go to the more general one; all columns of the
input are kept, but for one named ``n_lines_dropped``, which is replaced; an empty table gives an
empty table. The input must be a scan that repeats.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import MIX, NOT_SPACE, byte_slices, join_counted, join_salted, map_arrow, mixed, name_beside, span_hashes, string_buffers, token_spans, written
from .fragments import STEP_BYTES, text_bytes

LEADING, MIN_TOKENS, MIN_DOCUMENTS, FIXED_SHARE = 3, 4, 5, 0.6
#: Text bytes whose lines a bucket of leaves should hold, and bytes of entries of a leaf that may lie in one.
BUCKET_BYTES, LEAF_BYTES = 16 << 20, 16 << 20
#: Entries of a step in a bucket: lines and their documents; of the ``n_open`` first ones, which may have a
#: template, also leaf, number of tokens, constant leading tokens, and hashes of the others.
_ENTRIES = {"line": "<u8", "documents": "<i4", "leaf": "<u8", "size": "<i4", "lead": "<i2", "tokens": "<u8"}
_DEALT = ", ".join(f"{c} binary" for c in _ENTRIES)
_NOT_BREAK = np.ones(256, bool)
_NOT_BREAK[10] = False
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_VARIABLE = np.uint64(0x5851F42D4C957F2D)
_GAP = np.uint64(0xA0761D6478BD642F)
_REAL = np.uint64(0x8EBC6AF09C88C6E3)


def enough_fixed(fixed: np.ndarray, beyond: np.ndarray, size: np.ndarray | int, fixed_share: float, leading: int) -> np.ndarray:
    """Whether so many fixed places, and so many of them beyond the leading ones, make a template."""
    return (fixed / size >= fixed_share) & (3 * beyond >= size - leading)


class Lines:
    """Lines of a step with any tokens: place in the text, document, tokens, whether they may have
    a template."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, fixed_share: float, leading: int, min_tokens: int):
        starts, ends, first = token_spans(data, offsets, _NOT_BREAK)
        words, word_ends, _ = token_spans(data, offsets, NOT_SPACE)
        real = span_hashes(data, words, word_ends)
        constant = np.add.reduceat(_DIGIT[data], words, dtype=np.int64) == 0 if len(words) else np.zeros(0, bool)
        hashes = np.where(constant, real, _VARIABLE)
        self.all_starts, self.all_ends = starts, ends
        begin, end = np.searchsorted(words, starts), np.searchsorted(words, ends)
        self.kept = np.flatnonzero(end > begin)
        begin, end = begin[self.kept], end[self.kept]
        self.doc = np.searchsorted(first, self.kept, side="right") - 1
        self.count = end - begin
        place = np.arange(len(hashes)) - np.repeat(np.searchsorted(words, starts), np.diff(np.append(np.searchsorted(words, starts), len(words)))) if len(starts) else np.zeros(0, np.int64)
        turn = (place.astype(np.uint64) + np.uint64(1)) * MIX
        running = lambda x: np.append(x.dtype.type(0), np.cumsum(x, dtype=x.dtype))
        total, total_real, constants = running(mixed(hashes + turn)), running(mixed(real + turn)), running(constant.astype(np.int64))
        sized = self.count.astype(np.uint64) * _GAP
        beyond = np.minimum(begin + leading, end)
        self.open = (self.count >= min_tokens) & enough_fixed(constants[end] - constants[begin], constants[end] - constants[beyond], self.count, fixed_share, leading)
        itself = mixed((total_real[end] - total_real[begin] + sized) ^ _REAL)
        self.line = np.where(self.open, mixed(total[end] - total[begin] + sized), itself)
        self.leaf = np.where(self.open, mixed(total[beyond] - total[begin] + sized), itself)
        self.hashes, self.begin, self.beyond, self.end = hashes, begin, beyond, end
        self.lead = constants[beyond] - constants[begin]


def _deal(df: DataFrame, fixed_share: float, leading: int, min_tokens: int, buckets: int) -> DataFrame:
    """Distinct lines of each step, by buckets of leaves: leaf, line, documents, token hashes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "_text", STEP_BYTES):
            lines = Lines(*string_buffers(part.column("_text")), fixed_share, leading, min_tokens)
            if not len(lines.kept):
                continue
            pair = np.lexsort((lines.doc, lines.line))
            line, doc = lines.line[pair], lines.doc[pair]
            new_line = np.ones(len(line), bool)
            new_line[1:] = line[1:] != line[:-1]
            new_doc = new_line.copy()
            new_doc[1:] |= doc[1:] != doc[:-1]
            at = np.flatnonzero(new_line)
            documents = np.add.reduceat(new_doc, at, dtype=np.int64)
            which = pair[at]
            bucket = ((lines.leaf[which] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.lexsort((~lines.open[which], bucket))
            which, documents, bucket = which[order], documents[order], bucket[order]
            cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
            tokens = lines.hashes.astype("<u8")
            rows = {c: [] for c in _ENTRIES}
            for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(bucket)).tolist()):
                w = which[a:b]
                own = {"line": lines.line[w], "documents": documents[a:b]}
                w = w[lines.open[w]]
                pieces = [tokens[x:y] for x, y in zip(lines.beyond[w].tolist(), lines.end[w].tolist())]
                own |= {"leaf": lines.leaf[w], "size": lines.count[w], "lead": lines.lead[w], "tokens": np.concatenate(pieces) if pieces else tokens[:0]}
                for c, kind in _ENTRIES.items():
                    rows[c].append(own[c].astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts]), *(pa.array(v, pa.binary()) for v in rows.values())], names=["bucket", *rows])

    return map_arrow(df, run, f"bucket bigint, {_DEALT}")


def _large_leaves(df: DataFrame, fixed_share: float, leading: int, min_tokens: int, buckets: int, leaf_bytes: int) -> DataFrame:
    """By bucket, the leaves with more bytes of entries than a task should get."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "_text", STEP_BYTES):
            lines = Lines(*string_buffers(part.column("_text")), fixed_share, leading, min_tokens)
            _, one = np.unique(lines.line, return_index=True)
            one = one[lines.open[one]]
            leaf, which = np.unique(lines.leaf[one], return_inverse=True)
            size = np.bincount(which, weights=24 + 8 * lines.count[one], minlength=len(leaf)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(leaf.view(np.int64)), pa.array(size)], names=["leaf", "size"])

    sizes = map_arrow(df, run, "leaf bigint, size bigint").groupBy("leaf").agg(F.sum("size").alias("size")).where(F.col("size") > leaf_bytes)
    bucket = F.shiftright(F.shiftrightunsigned("leaf", 32) * F.lit(buckets), 32)
    return sizes.groupBy(bucket.alias("bucket")).agg(F.collect_set("leaf").alias("large"))


def _entries(row: dict, leading: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Columns of a dealt row, and how many token hashes each entry with a leaf has."""
    columns = {c: np.frombuffer(row[c], kind) for c, kind in _ENTRIES.items()}
    return columns, np.maximum(columns["size"] - leading, 0)


def _without_large(dealt: DataFrame, leading: int) -> DataFrame:
    """Dealt rows without the lines of their ``large`` leaves."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                columns, n_tokens = _entries(row, leading)
                stays = ~np.isin(columns["leaf"].view(np.int64), np.array(row["large"], np.int64))
                every = np.append(stays, np.ones(len(columns["line"]) - len(stays), bool))
                chosen = {"line": every, "documents": every, "tokens": np.repeat(stays, n_tokens)}
                rows.append({"bucket": row["bucket"]} | {c: columns[c][chosen.get(c, stays)].tobytes() for c in _ENTRIES})
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("bucket", pa.int64()), *((c, pa.binary()) for c in _ENTRIES)]))

    return map_arrow(dealt, run, f"bucket bigint, {_DEALT}")


def _large_lines(dealt: DataFrame, leading: int) -> DataFrame:
    """One row a line of the ``large`` leaves of dealt rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                columns, n_tokens = _entries(row, leading)
                goes = np.flatnonzero(np.isin(columns["leaf"].view(np.int64), np.array(row["large"], np.int64)))
                kept = columns["tokens"][np.repeat(np.isin(np.arange(len(n_tokens)), goes), n_tokens)]
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n_tokens[goes])), pa.int32()), pa.array(kept.view(np.int64)))
                numbers = [pa.array(columns[c][goes].astype(np.int64) if c in ("documents", "size", "lead") else columns[c][goes].view(np.int64)) for c in ("leaf", "line", "documents", "size", "lead")]
                yield pa.RecordBatch.from_arrays([*numbers, lists], names=["leaf", "line", "documents", "size", "lead", "tokens"])

    return map_arrow(dealt, run, "leaf bigint, line bigint, documents bigint, size bigint, lead bigint, tokens array<bigint>")


def generalise_large(lines: DataFrame, min_documents: int, fixed_share: float, leading: int = LEADING) -> DataFrame:
    """What ``generalise`` finds, for leaves of any number of lines: ``line``, ``template`` and the
    line's ``members`` (documents). ``lines`` has ``leaf``, ``line``, ``documents``, ``size``,
    ``lead`` (constant leading tokens) and the other ``tokens``, several rows a line.

    Each share is a sum over templates and a join back, with hot templates apart; as the share
    is halved, their number is the logarithm of the largest leaf's documents.
    """
    lines = written(lines.groupBy("leaf", "line").agg(F.sum("documents").alias("documents"), *[F.first(c).alias(c) for c in ("size", "lead", "tokens")]), "large_lines")
    leaves = written(lines.groupBy("leaf").agg(F.sum("documents").alias("in_leaf"), F.count("*").alias("members")), "large_leaves")
    places = written(lines.select("leaf", "line", "documents", F.posexplode("tokens").alias("place", "token")).where(F.col("token") != int(_VARIABLE.view(np.int64))), "large_places")
    have = places.groupBy("leaf", "place", "token").agg(F.sum("documents").alias("have"), F.count("*").alias("members"))
    have = written(have.where(F.col("have") >= min_documents), "large_tokens")
    of_line = join_counted(places.drop("documents"), have, ["leaf", "place", "token"]).groupBy("line").agg(F.sort_array(F.collect_list(F.struct("place", "token", "have"))).alias("have"))
    left = written(join_counted(lines.drop("tokens"), leaves, ["leaf"]).join(of_line, "line"), "large_have")
    most = left.agg(F.max("in_leaf")).first()[0] or 0

    found, share = [], 0.5
    while most:
        least = F.greatest(F.lit(float(min_documents)), F.lit(share) * F.col("in_leaf"))
        fixed = F.transform(F.filter("have", lambda x: x["have"] >= F.col("least")), lambda x: F.struct(x["place"].alias("place"), x["token"].alias("token")))
        n_fixed = F.when(F.col("in_leaf") >= min_documents, F.col("lead")).otherwise(0) + F.size("fixed")
        enough_places = (n_fixed / F.col("size") >= fixed_share) & (3 * F.size("fixed") >= F.col("size") - leading)
        level = left.withColumn("least", least).withColumn("fixed", fixed).withColumn("template", F.when(enough_places, F.xxhash64("leaf", "fixed")))
        level = written(level.drop("fixed"), "large_level")
        enough = level.where("template is not null").groupBy("template").agg(F.sum("documents").alias("in_template"), F.count("*").alias("members"))
        enough = written(enough.where(F.col("in_template") >= min_documents).drop("in_template"), "large_enough")
        decided = written(join_counted(level, enough, ["template"]).select("line", "template", F.col("documents").alias("members")), "large_found")
        found.append(decided)
        if min_documents >= share * most:
            break
        left = level.where(F.col("least") > min_documents).drop("template", "least").join(decided.select("line"), "line", "left_anti")
        share /= 2
    itself = lines.select("line", F.col("line").alias("template"), F.col("documents").alias("members"))
    if not found:
        return itself
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.unionByName(itself.join(every.select("line"), "line", "left_anti").where(F.col("members") >= min_documents))


def generalise(leaf: np.ndarray, line: np.ndarray, documents: np.ndarray, tokens: np.ndarray, min_documents: int, fixed_share: float, leading: int = LEADING) -> np.ndarray:
    """Templates of distinct lines of equal length (``tokens`` is a matrix), in leaves."""
    n, size = tokens.shape
    _, number = np.unique(leaf, return_inverse=True)
    in_leaf = np.bincount(number, weights=documents)[number]
    have = np.empty((n, size), np.int64)
    for p in range(size):
        _, value = np.unique(mixed(leaf + tokens[:, p] * MIX), return_inverse=True)
        have[:, p] = np.where(tokens[:, p] == _VARIABLE, 0, np.bincount(value, weights=documents)[value])
    template = line.copy()
    left = np.arange(n)
    share = 0.5
    while len(left):
        least = np.maximum(min_documents, share * in_leaf[left])
        fixed = have[left] >= least[:, None]
        open_rows = enough_fixed(fixed.sum(axis=1), fixed[:, leading:].sum(axis=1), size, fixed_share, leading)
        rows, fixed = left[open_rows], fixed[open_rows]
        places = np.zeros(len(rows), np.uint64)
        for p, turn in enumerate(np.arange(1, size + 1, dtype=np.uint64) * MIX):
            places += np.where(fixed[:, p], mixed(tokens[rows, p] + turn), np.uint64(0))
        found = mixed(leaf[rows] + places * _GAP)
        _, group = np.unique(found, return_inverse=True)
        enough = np.bincount(group, weights=documents[rows])[group] >= min_documents if len(rows) else np.zeros(0, bool)
        template[rows[enough]] = found[enough]
        done = least <= min_documents
        done[np.flatnonzero(open_rows)[enough]] = True
        left, share = left[~done], share / 2
    return template


def _templates(min_documents: int, fixed_share: float, leading: int):
    def run(table: pa.Table) -> pa.Table:
        parts = [_entries(row, leading) for row in table.select(list(_ENTRIES)).to_pylist()]
        column = lambda c: np.concatenate([x[c] for x, _ in parts])
        padded = lambda c: np.concatenate([np.append(x[c], np.zeros(len(x["line"]) - len(x[c]), x[c].dtype)) for x, _ in parts])
        line, documents, tokens, size, lead = column("line"), column("documents"), column("tokens"), padded("size").astype(np.int64), padded("lead")
        # A line that can have no template is a leaf of its own.
        leaf = np.where(size > 0, padded("leaf"), line)
        n_tokens = np.maximum(size - leading, 0)
        at = np.cumsum(n_tokens) - n_tokens
        line, one, same = np.unique(line, return_index=True, return_inverse=True)
        documents = np.bincount(same, weights=documents).astype(np.int64)
        leaf, size, lead, at = leaf[one], size[one], lead[one], at[one]
        _, number = np.unique(leaf, return_inverse=True)
        often = np.flatnonzero(np.bincount(number, weights=documents)[number] >= min_documents) if len(number) else np.zeros(0, np.int64)
        out_line, out_template, out_members = [], [], []
        for length in np.unique(size[often]):
            rows = often[size[often] == length]
            template = line[rows]
            if length:
                # Any hashes do for the leading tokens, as they are the same in a leaf.
                first = np.where(np.arange(min(leading, length)) < lead[rows][:, None], np.uint64(1), _VARIABLE)
                others = tokens[at[rows][:, None] + np.arange(max(length - leading, 0))]
                template = generalise(leaf[rows], template, documents[rows], np.hstack([first, others]), min_documents, fixed_share, leading)
            _, group = np.unique(template, return_inverse=True)
            enough = np.bincount(group, weights=documents[rows])[group] >= min_documents
            out_line.append(line[rows[enough]])
            out_template.append(template[enough])
            out_members.append(documents[rows[enough]])
        out = [np.concatenate(x).view(np.int64) if x else np.zeros(0, np.int64) for x in (out_line, out_template, out_members)]
        return pa.table(out, names=["line", "template", "members"])

    return run


def _document_lines(df: DataFrame, fixed_share: float, leading: int, min_tokens: int) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, "_text", STEP_BYTES):
            lines = Lines(*string_buffers(part.column("_text")), fixed_share, leading, min_tokens)
            ids = part.column("id").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(ids[lines.doc], pa.int64()), pa.array(lines.line.view(np.int64))], names=["id", "line"])

    return map_arrow(df, run, "id bigint, line bigint")


def recurring_lines(df: DataFrame, text: str = "text", key: str = "doc_id", min_documents: int = MIN_DOCUMENTS, fixed_share: float = FIXED_SHARE, leading: int = LEADING, min_tokens: int = MIN_TOKENS, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """``id``, ``line`` (hash) and ``template`` of every line that goes."""
    docs = df.select(F.col(key).cast("bigint").alias("id"), F.col(text).cast("string").alias("_text")).where("id is not null")
    buckets = max(8, text_bytes(docs, "_text") // BUCKET_BYTES + 1)
    dealt = _deal(docs, fixed_share, leading, min_tokens, buckets)
    large = written(_large_leaves(docs, fixed_share, leading, min_tokens, buckets, leaf_bytes), "large")
    small, found = dealt, []
    if not large.isEmpty():
        dealt = written(dealt, "dealt")
        with_large = dealt.join(large, "bucket")
        found.append(generalise_large(_large_lines(with_large, leading), min_documents, fixed_share, leading))
        small = dealt.join(large, "bucket", "left_anti").unionByName(_without_large(with_large, leading))
    found.append(small.groupBy("bucket").applyInArrow(_templates(min_documents, fixed_share, leading), "line bigint, template bigint, members bigint"))
    found = written(found[0] if len(found) == 1 else found[0].unionByName(found[1]), "templates")
    places = written(join_salted(_document_lines(docs, fixed_share, leading, min_tokens), found, "line", "id").select("id", "line", "template").distinct(), "places")
    first = places.groupBy("template", "id").agg(F.lit(1).alias("one")).groupBy("template").agg(F.count("*").alias("documents"), F.min("id").alias("first"))
    lines = places.groupBy("template").agg(F.count("*").alias("members"))
    first = written(first.where(F.col("documents") >= min_documents).join(lines, "template").select("template", "first", "members"), "first")
    return join_counted(places, first, ["template"]).where("id <> first").select("id", "line", "template")


def drop_recurring_lines(df: DataFrame, text: str = "text", key: str = "doc_id", min_documents: int = MIN_DOCUMENTS, fixed_share: float = FIXED_SHARE, leading: int = LEADING, min_tokens: int = MIN_TOKENS, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """All columns, the text without recurring lines, and ``n_lines_dropped``. Leaves of more than
    ``leaf_bytes`` of entries are spread over tasks; results don't depend on it."""
    gone = recurring_lines(df, text, key, min_documents, fixed_share, leading, min_tokens, leaf_bytes)
    names = [c for c in df.columns if c != "n_lines_dropped"]
    place, own_id, own_lines = names.index(text), name_beside(names, "_id"), name_beside(names, "_lines")
    gone = gone.groupBy(F.col("id").alias(own_id)).agg(F.collect_set("line").alias(own_lines))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, text):
            data, at = string_buffers(part.column(text))
            lines = Lines(data, at, fixed_share, leading, min_tokens)
            raw, texts, dropped = data.tobytes(), [], []
            bounds = np.searchsorted(lines.doc, np.arange(part.num_rows + 1))
            valid = part.column(text).is_valid().to_pylist()
            hashes = lines.line.view(np.int64)
            for d, own in enumerate(part.column(own_lines).to_pylist()):
                rows = slice(bounds[d], bounds[d + 1])
                hit = np.flatnonzero(np.isin(hashes[rows], np.array(own, np.int64))) if own else ()
                dropped.append(len(hit))
                if not valid[d]:
                    texts.append(None)
                    continue
                pieces, start = [], int(at[d])
                for k in lines.kept[rows][hit].tolist() if len(hit) else ():
                    pieces.append(raw[start : lines.all_starts[k]])
                    start = min(int(lines.all_ends[k]) + 1, int(at[d + 1]))
                pieces.append(raw[start : at[d + 1]])
                texts.append(b"".join(pieces).decode("utf-8"))
            columns = [pa.array(texts, pa.string()) if i == place else part.column(i) for i in range(len(names))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(dropped, pa.int64())], names=[*names, "n_lines_dropped"])

    joined = df.join(gone, df[key].cast("bigint") == gone[own_id], "left").select(*[df[c] for c in names], own_lines)
    schema = ", ".join([f"`{c}` {'string' if c == text else df.schema[c].dataType.simpleString()}" for c in names] + ["n_lines_dropped bigint"])
    return map_arrow(joined, run, schema)
