"""TIFF media columns.

``tiff_encode`` stores bytes as an 8-bit grey image; ``tiff_pages`` walks the image directories
of a stored file (either byte order), decodes PackBits, LZW or deflate strips and tiles of 1, 4, 8
or 16 bits a sample, undoes the horizontal predictor and gives one row per page. Samples of 1 and
4 bits are given as bytes; other predictors and layouts are refused.

Defined results: a null text counts as empty and still gives one page; texts of any length are
stored whole; a null or damaged file gives a row with null samples and the reason in ``error``,
after the pages before the damage, whose number ``page`` says; nothing in a file can make its task
fail, as sizes are checked against ``MAX_BYTES``, which is what a cell can hold, or a lower bound
of the caller's before anything is made, and nothing is unpacked beyond them; equal and repeated inputs give equal files; extra columns are dropped unless named in
``keep``, and a column with the name of a result is replaced by it; an empty table gives an empty
table.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import byte_slices, map_arrow, schema_of, string_buffers, text_rows

WIDTH = 64
ROWS_PER_STRIP = 512
#: Bytes of a page's samples at most, as no cell can hold more; a file that claims more is damaged.
MAX_BYTES = (1 << 31) - 1024
# Fixed values of the format: tags, field sizes, compression schemes.
TAG_WIDTH, TAG_LENGTH, TAG_BITS, TAG_COMPRESSION, TAG_PHOTOMETRIC = 256, 257, 258, 259, 262
TAG_STRIP_OFFSETS, TAG_SAMPLES, TAG_ROWS_PER_STRIP, TAG_STRIP_COUNTS = 273, 277, 278, 279
TAG_PLANAR, TAG_PREDICTOR, TAG_TILE_WIDTH, TAG_TILE_LENGTH, TAG_TILE_OFFSETS, TAG_TILE_COUNTS = 284, 317, 322, 323, 324, 325
FIELD_BYTES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
FIELD_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}
NONE, LZW, DEFLATE, PACKBITS, OLD_DEFLATE = 1, 5, 8, 32773, 32946


def pack_bits(data: bytes) -> bytes:
    """PackBits: runs of equal bytes, and literals between them."""
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 1:
            out += bytes((257 - run, data[i]))
            i += run
            continue
        j = i + 1
        while j < n and j - i < 128 and not (j + 1 < n and data[j] == data[j + 1]):
            j += 1
        out.append(j - i - 1)
        out += data[i:j]
        i = j
    return bytes(out)


def unpack_bits(data: bytes, limit: int) -> bytes:
    out, i = bytearray(), 0
    while i < len(data) and len(out) < limit:
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + 2 + head]
            i += 2 + head
        elif head > 128:
            out += data[i + 1 : i + 2] * (257 - head)
            i += 2
        else:
            i += 1
    return bytes(out)


def lzw_encode(data: bytes) -> bytes:
    """Most significant bit first, codes of 9 to 12 bits, clear 256 and end 257."""
    bits, held, out = 0, 0, bytearray()

    def put(code: int, width: int) -> None:
        nonlocal bits, held
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append((held >> bits) & 255)
        held &= (1 << bits) - 1

    codes, width, prefix = {bytes((i,)): i for i in range(256)}, 9, b""
    put(256, 9)
    following = 258
    for i in range(len(data)):
        longer = prefix + data[i : i + 1]
        if longer in codes:
            prefix = longer
            continue
        put(codes[prefix], width)
        codes[longer] = following
        following += 1
        if following == 4094:
            put(256, width)
            codes, width, following = {bytes((k,)): k for k in range(256)}, 9, 258
        elif following >= (1 << width):
            width += 1
        prefix = data[i : i + 1]
    if prefix:
        put(codes[prefix], width)
        following += 1
        if following >= (1 << width) and width < 12:
            width += 1
    put(257, width)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


def lzw_decode(data: bytes, limit: int) -> bytes:
    first = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, last, out = list(first), 9, b"", []
    held = bits = made = 0
    for byte in data:
        if made >= limit:
            break
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = list(first), 9, b""
            continue
        if last == b"":
            last = table[code]
        else:
            if code > len(table):
                raise ValueError("LZW code out of range")
            now = table[code] if code < len(table) else last + last[:1]
            table.append(last + now[:1])
            last = now
        out.append(last)
        made += len(last)
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    return b"".join(out)


def inflate(data: bytes, limit: int) -> bytes:
    """No more than ``limit`` bytes, whatever the data would unpack to."""
    return zlib.decompressobj().decompress(data, limit)


#: Each takes the stored bytes and how many samples' bytes are wanted at most.
DECODERS = {NONE: lambda b, limit: b[:limit], LZW: lzw_decode, DEFLATE: inflate, OLD_DEFLATE: inflate, PACKBITS: unpack_bits}
ENCODERS = {NONE: bytes, LZW: lzw_encode, DEFLATE: lambda b: zlib.compress(b, 1), PACKBITS: pack_bits}


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 2, rows_per_strip: int = ROWS_PER_STRIP, tile: int = 0) -> bytes:
    """A little-endian file of 8-bit grey pages in strips, or in square tiles of ``tile`` samples."""
    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for page in pages:
        height, width = page.shape
        if tile:
            down, across = -(-height // tile), -(-width // tile)
            padded = np.zeros((down * tile, across * tile), np.uint8)
            padded[:height, :width] = page
            pieces = [padded[y * tile : (y + 1) * tile, x * tile : (x + 1) * tile] for y in range(down) for x in range(across)]
        else:
            pieces = [page[y : y + rows_per_strip] for y in range(0, height, rows_per_strip)]
        offsets, counts = [], []
        for piece in pieces:
            if predictor == 2:
                piece = np.diff(piece, axis=1, prepend=np.zeros((len(piece), 1), np.uint8))
            stored = ENCODERS[compression](piece.tobytes())
            offsets.append(len(out))
            counts.append(len(stored))
            out += stored
            out += b"\0" * (len(out) % 2)
        places = [(TAG_TILE_WIDTH, [tile]), (TAG_TILE_LENGTH, [tile]), (TAG_TILE_OFFSETS, offsets), (TAG_TILE_COUNTS, counts)] if tile else [(TAG_STRIP_OFFSETS, offsets), (TAG_ROWS_PER_STRIP, [rows_per_strip]), (TAG_STRIP_COUNTS, counts)]
        plain = [(TAG_WIDTH, [width]), (TAG_LENGTH, [height]), (TAG_BITS, [8]), (TAG_COMPRESSION, [compression]), (TAG_PHOTOMETRIC, [1]), (TAG_SAMPLES, [1]), (TAG_PREDICTOR, [predictor])]
        fields = []
        for tag, values in sorted(plain + places):
            stored = struct.pack(f"<{len(values)}I", *values)
            if len(stored) > 4:
                stored, at = struct.pack("<I", len(out)), stored
                out += at
            fields.append(struct.pack("<HHI", tag, 4, len(values)) + stored)
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(fields)) + b"".join(fields)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """Byte order and integer fields of each image directory, following the links."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("not a TIFF file")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("the directories form a loop")
        seen.add(at)
        (count,) = struct.unpack_from(order + "H", data, at)
        fields: dict[int, tuple] = {}
        for k in range(count):
            where = at + 2 + 12 * k
            tag, kind, n = struct.unpack_from(order + "HHI", data, where)
            if kind in FIELD_CODES:
                if FIELD_BYTES[kind] * n > 4:
                    (value_at,) = struct.unpack_from(order + "I", data, where + 8)
                else:
                    value_at = where + 8
                fields[tag] = struct.unpack_from(f"{order}{n}{FIELD_CODES[kind]}", data, value_at)
        yield order, fields
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * count)


def _samples(raw: bytes, rows: int, per_row: int, bits: int, order: str) -> np.ndarray:
    """Rows of samples; each row of less than a byte a sample begins with a byte of its own."""
    if bits in (8, 16):
        kind = np.dtype(order + ("u1" if bits == 8 else "u2"))
        return np.frombuffer(raw, kind, count=rows * per_row).reshape(rows, per_row).astype(kind.newbyteorder("="))
    row_bytes = -(-per_row * bits // 8)
    packed = np.frombuffer(raw, np.uint8, count=rows * row_bytes).reshape(rows, row_bytes)
    if bits == 1:
        return np.unpackbits(packed, axis=1)[:, :per_row]
    return np.stack([packed >> 4, packed & 15], axis=2).reshape(rows, -1)[:, :per_row]


def read_page(data: bytes, order: str, fields: dict[int, tuple], max_bytes: int = MAX_BYTES) -> np.ndarray:
    """Samples of one page as height x width x samples."""
    one = lambda tag, default=None: fields.get(tag, (default,))[0]
    width, height, samples, bits = one(TAG_WIDTH), one(TAG_LENGTH), one(TAG_SAMPLES, 1), one(TAG_BITS, 1)
    if not width or not height or bits not in (1, 4, 8, 16) or len(set(fields.get(TAG_BITS, (1,)))) > 1 or (one(TAG_PLANAR, 1) != 1 and samples > 1):
        raise ValueError("unsupported layout")
    decode, predictor = DECODERS.get(one(TAG_COMPRESSION, NONE)), one(TAG_PREDICTOR, 1)
    if decode is None:
        raise ValueError("unsupported compression")
    if predictor not in (1, 2) or (predictor == 2 and bits < 8):
        raise ValueError("unsupported predictor")
    size = 2 if bits == 16 else 1
    if width < 0 or height < 0 or samples < 1 or width * height * samples * size > max_bytes:
        raise ValueError("the page is too large")
    tiled = TAG_TILE_OFFSETS in fields
    piece_w = one(TAG_TILE_WIDTH) if tiled else width
    piece_h = one(TAG_TILE_LENGTH) if tiled else min(one(TAG_ROWS_PER_STRIP, height), height)
    if not piece_w or not piece_h or piece_w < 0 or piece_h < 0 or piece_w * piece_h * samples * size > max_bytes:
        raise ValueError("strips or tiles have no size, or too large a one")
    across, down = -(-width // piece_w), -(-height // piece_h)
    if down * piece_h * across * piece_w * samples * size > 4 * max_bytes:
        raise ValueError("strips or tiles are too large for the page")
    page = np.zeros((height, width, samples), np.uint16 if bits == 16 else np.uint8)
    starts = fields[TAG_TILE_OFFSETS if tiled else TAG_STRIP_OFFSETS]
    counts = fields[TAG_TILE_COUNTS if tiled else TAG_STRIP_COUNTS]
    row_bytes = -(-piece_w * samples * bits // 8)
    for k in range(across * down):
        y, x = k // across * piece_h, k % across * piece_w
        rows = piece_h if tiled else min(piece_h, height - y)
        raw = decode(data[starts[k] : starts[k] + counts[k]], rows * row_bytes)
        piece = _samples(raw, rows, piece_w * samples, bits, order).reshape(rows, piece_w, samples)
        if predictor == 2:
            piece = np.cumsum(piece, axis=1, dtype=page.dtype)
        page[y : y + rows, x : x + piece_w] = piece[: height - y, : width - x]
    return page


def feature(page: np.ndarray) -> str:
    """Shape, mean, spread, mean horizontal step and entropy of the high nibbles."""
    flat = page.ravel()
    share = np.bincount(flat >> 4 if page.dtype == np.uint8 else flat >> 12, minlength=16) / flat.size
    used = share[share > 0]
    step = np.abs(np.diff(page.astype(np.int32), axis=1)).mean() if page.shape[1] > 1 else 0.0
    return f"{page.shape[1]}x{page.shape[0]};mean={flat.mean():.4f};std={flat.std():.4f};step={step:.4f};entropy={float(-(used * np.log2(used)).sum()):.4f}"


def payload(text: bytes) -> np.ndarray:
    """The text's bytes with zeros up to a positive multiple of the width, in rows."""
    rows = max(1, -(-len(text) // WIDTH))
    return np.frombuffer(text.ljust(rows * WIDTH, b"\0"), np.uint8).reshape(rows, WIDTH)


ENCODED = "n_bytes bigint, media binary"


def tiff_encode(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), compression: int = DEFLATE) -> DataFrame:
    """``keep`` columns, ``n_bytes`` of the text and the file in ``media``."""
    keep, name, texts = text_rows(df, keep, text, ENCODED)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in byte_slices(batches, name):
            data, at = string_buffers(part.column(name))
            raw, at = data.tobytes(), at.tolist()
            files = [write_tiff([payload(raw[a:b])], compression) for a, b in zip(at, at[1:])]
            sizes = [b - a for a, b in zip(at, at[1:])]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=[*keep, "n_bytes", "media"])

    return map_arrow(texts, run, schema_of(df, keep, ENCODED))


PAGE_FIELDS = "page int, width int, height int, samples_per_pixel int, samples binary, feature string, error string"


def pages_of(data: bytes | None, max_bytes: int = MAX_BYTES) -> Iterator[tuple]:
    """A file's pages in the order of ``PAGE_FIELDS``; damage ends them with a row that says why."""
    number = 0
    try:
        if data is None:
            raise ValueError("no file")
        for order, fields in directories(data):
            page = read_page(data, order, fields, max_bytes)
            yield number, page.shape[1], page.shape[0], page.shape[2], page.tobytes(), feature(page[:, :, 0]), None
            number += 1
        if not number:
            raise ValueError("no pages")
    except Exception as why:  # noqa: BLE001 - any bytes may come; the row tells what happened
        yield number, None, None, None, None, None, f"{type(why).__name__}: {why}"


def tiff_pages(df: DataFrame, media: str = "media", max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per page: the input's columns, the page's number, shape, samples and features. For
    files of unknown origin, ``max_bytes`` bounds what one page may take in memory."""
    given = [f.split()[0] for f in PAGE_FIELDS.split(", ")]
    names = [c for c in df.columns if c not in given]
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.string(), pa.string())

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                rows, pages = [], []
                for i, file in enumerate(part.column(media)):
                    own = list(pages_of(file.as_py(), max_bytes))
                    pages += own
                    rows += [i] * len(own)
                kept = part.take(pa.array(rows, pa.int32()))
                new = [pa.array([p[k] for p in pages], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*kept.columns, *new], names=[*names, *given])

    return map_arrow(df.select(*[F.col(f"`{c}`") for c in names]), run, schema_of(df, names, PAGE_FIELDS))
