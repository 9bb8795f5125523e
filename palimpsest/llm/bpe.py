"""Byte-level BPE encoding and decoding.

Pre-tokenisation is vectorised: every code point becomes a class symbol (with the look-ahead
it needs), a symbol is a function on the automaton's states, and functions compose
associatively. A block-wise scan over compositions gives the state before every code point, and
from it the token boundaries - no regular expression runs. The slices between boundaries then
feed pair merging behind a cache.

Defined results: a null text counts as empty (no tokens); texts of any length are encoded whole,
a piece without a boundary in it by a heap; equal and repeated rows give equal results, and ties
of pairs merge from the left; extra columns of the input are dropped unless named in ``keep``,
where a column with the name of a result is replaced by it; an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
import zlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from .common import byte_slices, map_arrow, schema_of, string_buffers, text_rows

# Code point classes.
LETTER, NUMBER, OTHER, BREAK, SPACE, QUOTE, END = range(7)
# Fixed values of the split pattern: white space, and the endings after an apostrophe.
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
ONE_LETTER_ENDINGS, TWO_LETTER_ENDINGS = "stmd", ("re", "ve", "ll")
# Symbols of the automaton: what a code point is, together with what follows it.
S_LETTER, S_NUMBER, S_OTHER, S_QUOTE1, S_QUOTE2, S_WHITE, S_LAST_BREAK, S_LAST_SPACE, S_END, S_NONE = range(10)
# States: the token that is open before a code point.
CLOSED, IN_LETTERS, IN_NUMBERS, IN_OTHERS, AFTER_SPACE, IN_WHITE, ENDING1, ENDING2 = range(8)
N_STATES, N_SYMBOLS = 8, 10
BLOCK = 256
#: Memory of each of two generations of cached pieces in a Python worker, in bytes; what an entry
#: takes besides its own bytes; the longest piece that is cached.
CACHE_BYTES, ENTRY_BYTES, CACHE_PIECE_BYTES = 32 << 20, 200, 64


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    kinds = {"L": LETTER, "N": NUMBER}
    out = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], OTHER) for c in range(0x110000)), np.uint8, 0x110000)
    out[WHITE_SPACE] = BREAK
    out[0x20], out[0x27] = SPACE, QUOTE
    return out


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a token starts at this code point."""
    run = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS, S_OTHER: IN_OTHERS}
    if symbol == S_NONE:
        return state, False
    if symbol == S_LETTER and state in (ENDING1, ENDING2):
        return (ENDING1 if state == ENDING2 else CLOSED), False
    if symbol in run:
        return run[symbol], state not in (run[symbol], AFTER_SPACE)
    if symbol in (S_QUOTE1, S_QUOTE2):
        if state in (IN_OTHERS, AFTER_SPACE):
            return IN_OTHERS, False
        return (ENDING1 if symbol == S_QUOTE1 else ENDING2), True
    if symbol == S_WHITE:
        return IN_WHITE, state != IN_WHITE
    return {S_LAST_BREAK: CLOSED, S_LAST_SPACE: AFTER_SPACE, S_END: CLOSED}[symbol], True


@lru_cache(maxsize=1)
def automaton() -> tuple[np.ndarray, ...]:
    """Next-state and starts tables by (state, symbol); the functions that symbols compose to,
    and the table that composes two of them."""
    steps = [[_step(s, x) for x in range(N_SYMBOLS)] for s in range(N_STATES)]
    nxt = np.array([[t[0] for t in row] for row in steps], np.uint8)
    starts = np.array([[t[1] for t in row] for row in steps], bool)
    found = {tuple(int(v) for v in nxt[:, x]): None for x in range(N_SYMBOLS)}
    functions = list(found)
    for f in functions:  # grows while it is walked: the closure under composition
        for x in range(N_SYMBOLS):
            both = tuple(int(nxt[s, x]) for s in f)
            if both not in found:
                found[both] = None
                functions.append(both)
    number = {f: i for i, f in enumerate(functions)}
    compose = np.array([[number[tuple(g[s] for s in f)] for g in functions] for f in functions], np.uint16)
    symbol_function = np.array([number[tuple(int(v) for v in nxt[:, x])] for x in range(N_SYMBOLS)], np.uint16)
    return nxt, starts, np.array(functions, np.uint8), compose, symbol_function


def symbols_of(points: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Automaton symbols; every class END is a document's end."""
    out = np.array([S_LETTER, S_NUMBER, S_OTHER, S_LAST_BREAK, S_LAST_SPACE, S_OTHER, S_END], np.uint8)[classes]
    after = np.append(classes[1:], END)
    white = (classes == BREAK) | (classes == SPACE)
    out[white & ((after == BREAK) | (after == SPACE) | (after == END))] = S_WHITE
    quotes = np.flatnonzero(classes == QUOTE)
    if len(quotes):
        padded = np.append(points, [0, 0])
        first, second = padded[quotes + 1], padded[quotes + 2]
        out[quotes[np.isin(first, [ord(c) for c in ONE_LETTER_ENDINGS])]] = S_QUOTE1
        for a, b in TWO_LETTER_ENDINGS:
            out[quotes[(first == ord(a)) & (second == ord(b))]] = S_QUOTE2
    return out


def token_starts(symbols: np.ndarray) -> np.ndarray:
    """For every symbol, whether a token starts there: compose functions within blocks, scan the
    blocks' functions, then run all blocks side by side from their known first states."""
    nxt, starts, functions, compose, symbol_function = automaton()
    n, many = len(symbols), len(functions)
    blocks = -(-n // BLOCK)
    grid = np.full(blocks * BLOCK, S_NONE, np.uint8)
    grid[:n] = symbols
    columns = np.ascontiguousarray(grid.reshape(blocks, BLOCK).T)
    flat = compose.ravel()
    total = symbol_function[columns[0]].astype(np.intp)
    for column in columns[1:]:
        total = flat[total * many + symbol_function[column]].astype(np.intp)
    reach = 1
    while reach < blocks:
        total[reach:] = flat[total[:-reach] * many + total[reach:]]
        reach *= 2
    state = np.append(np.uint8(CLOSED), functions[total[:-1], CLOSED]) if blocks else np.zeros(0, np.uint8)
    out = np.empty((BLOCK, blocks), bool)
    next_flat, starts_flat = nxt.ravel(), starts.ravel()
    for j, column in enumerate(columns):
        at = state.astype(np.intp) * N_SYMBOLS + column
        out[j], state = starts_flat[at], next_flat[at]
    return out.T.ravel()[:n]


def pretokenise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte positions where tokens start, and for each document the index of its first one."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    ends = np.searchsorted(lead, offsets[1:])
    n_docs = len(ends)
    place = np.arange(len(points)) + np.repeat(np.arange(n_docs), np.diff(np.append(0, ends)))
    all_points = np.zeros(len(points) + n_docs, np.uint32)
    classes = np.full(len(points) + n_docs, END, np.uint8)
    all_points[place], classes[place] = points, class_table()[points]
    cuts = lead[np.flatnonzero(token_starts(symbols_of(all_points, classes))[place])]
    return cuts, np.searchsorted(cuts, offsets)


class Decoder:
    """The tokens' bytes in one string, by offsets."""

    def __init__(self, tokens: list[bytes]):
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths
        self.joined = np.frombuffer(b"".join(tokens), np.uint8)

    def decode(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of a run of ids and the offset at which each id's bytes end."""
        size = self.lengths[ids]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        source = np.repeat(self.begins[ids] - (ends - size), size) + np.arange(total)
        return self.joined[source], ends


def tokens_of(ranks: dict[bytes, int]) -> list[bytes]:
    """Tokens by rank; ranks without a token are empty."""
    out = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        out[rank] = token
    return out


class Encoder:
    """Ranks of byte strings, and merging behind a cache."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.none = ranks, max(ranks.values(), default=-1) + 1
        self.cache: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.held = 0

    def merge(self, piece: bytes) -> bytes:
        """Ids of one piece, little-endian: the lowest rank merges first, the leftmost of equals."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return whole.to_bytes(4, "little")
        return self.merge_short(piece) if len(piece) <= CACHE_PIECE_BYTES else self.merge_long(piece)

    def merge_short(self, piece: bytes) -> bytes:
        rank_of, none = self.ranks.get, self.none
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [rank_of(piece[i : i + 2], none) for i in range(len(piece) - 1)]
        while pairs and (low := min(pairs)) < none:
            i = pairs.index(low)
            parts[i] += parts.pop(i + 1)
            del pairs[i]
            if i < len(pairs):
                pairs[i] = rank_of(parts[i] + parts[i + 1], none)
            if i:
                pairs[i - 1] = rank_of(parts[i - 1] + parts[i], none)
        return b"".join([self.ranks[p].to_bytes(4, "little") for p in parts])

    def merge_long(self, piece: bytes) -> bytes:
        """The same with a heap: a piece can be a whole text without white space."""
        ranks, n = self.ranks, len(piece)
        ends, after, before = list(range(1, n + 1)), [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = bytearray(b"\1" * n)
        while heap:
            _, i, end = heapq.heappop(heap)
            if not alive[i] or (j := after[i]) < 0 or ends[j] != end:
                continue
            ends[i], alive[j], after[i] = end, 0, after[j]
            if after[j] >= 0:
                before[after[j]] = i
                if (r := ranks.get(piece[i : ends[after[j]]])) is not None:
                    heapq.heappush(heap, (r, i, ends[after[j]]))
            if (h := before[i]) >= 0 and (r := ranks.get(piece[h:end])) is not None:
                heapq.heappush(heap, (r, h, end))
        out, i = [], 0
        while i >= 0:
            out.append(ranks[piece[i : ends[i]]])
            i = after[i]
        return np.array(out, "<u4").tobytes()

    def miss(self, piece: bytes) -> bytes:
        """Looks among the older pieces, then merges; two generations keep the cache's bytes bounded."""
        if (ids := self.older.get(piece)) is None:
            ids = self.merge(piece)
        if len(piece) <= CACHE_PIECE_BYTES:
            if self.held >= CACHE_BYTES:
                self.older, self.held = dict(self.cache), 0
                self.cache.clear()
            self.cache[piece] = ids
            self.held += len(piece) + len(ids) + ENTRY_BYTES
        return ids

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """Packed ids of each document of a chunk."""
        cuts, first = pretokenise(data, offsets)
        raw, known, miss = data.tobytes(), self.cache, self.miss
        at = [*cuts.tolist(), len(raw)]
        ids = [known.get(p := raw[a:b]) or miss(p) for a, b in zip(at, at[1:])]
        first = first.tolist()
        return [b"".join(ids[a:b]) for a, b in zip(first, first[1:])]


_KNOWN: dict[int, tuple[dict[bytes, int], dict[str, object]]] = {}


def _tools(shared) -> tuple[dict[bytes, int], dict[str, object]]:
    """Ranks, and what was made of them: once for a Python worker, which keeps it between tasks."""
    number, lines = shared.value
    if number not in _KNOWN:
        _KNOWN.clear()
        pairs = [line.split() for line in lines.splitlines() if line.strip()]
        _KNOWN[number] = ({base64.b64decode(token): int(rank) for token, rank in pairs}, {})
    return _KNOWN[number]


def _encoder(shared) -> Encoder:
    ranks, made = _tools(shared)
    return made.setdefault("encoder", made.get("encoder") or Encoder(ranks))


def _decoder(shared) -> Decoder:
    ranks, made = _tools(shared)
    return made.setdefault("decoder", made.get("decoder") or Decoder(tokens_of(ranks)))


def _share(df: DataFrame, rank_file: str):
    """The rank file's size is fixed by the vocabulary, never by the corpus."""
    with open(rank_file, "rb") as f:
        lines = f.read()
    return df.sparkSession.sparkContext.broadcast((zlib.crc32(lines), lines))


ENCODED, DECODED = "token_ids binary, n_tokens bigint", "decoded binary, token_ends binary"


def _encoded(encoder: Encoder, column: pa.Array) -> list[bytes]:
    return encoder.encode(*string_buffers(column))


def bpe_encode(df: DataFrame, rank_file: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``token_ids`` (packed little-endian unsigned 32-bit) and ``n_tokens``."""
    shared = _share(df, rank_file)
    keep, name, rows = text_rows(df, keep, text, ENCODED)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(shared)
        for part in byte_slices(batches, name):
            ids = _encoded(encoder, part.column(name))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64())], names=[*keep, "token_ids", "n_tokens"])

    return map_arrow(rows, run, schema_of(df, keep, ENCODED))


def bpe_decode(encoded: DataFrame, rank_file: str) -> DataFrame:
    """Adds ``decoded`` (bytes) and ``token_ends`` (packed unsigned 32-bit byte offsets)."""
    shared = _share(encoded, rank_file)
    given = StructType.fromDDL(DECODED).fieldNames()
    keep = [c for c in encoded.columns if c not in given]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = _decoder(shared)
        for batch in batches:
            both = [decoder.decode(np.frombuffer(row.as_py() or b"", "<u4")) for row in batch.column("token_ids")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([t.tobytes() for t, _ in both], pa.binary()), pa.array([e.astype("<u4").tobytes() for _, e in both], pa.binary())],
                names=[*keep, *given],
            )

    return map_arrow(encoded.select(*[F.col(f"`{c}`") for c in keep]), run, schema_of(encoded, keep, DECODED))


def bpe_round_trip(df: DataFrame, rank_file: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Encodes every text and decodes its ids again, in one pass of one worker: ``keep`` columns,
    ``token_ids``, ``n_tokens`` and ``decoded``."""
    shared = _share(df, rank_file)
    more = f"{ENCODED}, decoded binary"
    keep, name, rows = text_rows(df, keep, text, more)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = _encoder(shared), _decoder(shared)
        for part in byte_slices(batches, name):
            ids = _encoded(encoder, part.column(name))
            texts = [decoder.decode(np.frombuffer(x, "<u4"))[0].tobytes() for x in ids]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(texts, pa.binary())], names=[*keep, "token_ids", "n_tokens", "decoded"])

    return map_arrow(rows, run, schema_of(df, keep, more))


def unpacked_ids(column) -> F.Column:
    """``token_ids`` as array<int>, for callers that want elements."""
    hexed = F.hex(column)
    count = (F.length(column) / 4).cast("int")

    def one(i):
        at = i * 8
        parts = [F.substring(hexed, at + 7 - 2 * k, 2) for k in range(4)]
        return F.conv(F.concat(*parts), 16, 10).cast("int")

    return F.when(count == 0, F.array().cast("array<int>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), one))
