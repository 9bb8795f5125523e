"""TIFF layouts beyond what the encoder writes, and notices beside better ones."""

import struct

import numpy as np
import pytest
import regex

from palimpsest.llm import licenses, tiff


def tiff_file(fields, data, order="<"):
    """A file of one page: its data, then its directory."""
    head = (b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8 + len(data))
    own = sorted((fields | {tiff.TAG_STRIP_OFFSETS: 8, tiff.TAG_STRIP_COUNTS: len(data)}).items())
    return head + data + struct.pack(order + "H", len(own)) + b"".join(struct.pack(order + "HHII", tag, 4, 1, v) for tag, v in own) + b"\0\0\0\0"


def shape(width, height, bits, **more):
    names = {"compression": tiff.TAG_COMPRESSION, "predictor": tiff.TAG_PREDICTOR, "rows": tiff.TAG_ROWS_PER_STRIP}
    return {tiff.TAG_WIDTH: width, tiff.TAG_LENGTH: height, tiff.TAG_BITS: bits} | {names[k]: v for k, v in more.items()}


@pytest.mark.parametrize("order", "<>")
@pytest.mark.parametrize("compression", [tiff.NONE, tiff.PACKBITS, tiff.LZW, tiff.DEFLATE])
@pytest.mark.parametrize("width", [1, 7, 8, 13])
def test_one_and_four_bits(order, compression, width):
    rng = np.random.default_rng(width)
    for bits in (1, 4):
        page = rng.integers(0, 1 << bits, (5, width))
        text = ["".join(format(v, f"0{bits}b") for v in row) for row in page.tolist()]
        rows = b"".join(int(t.ljust(-(-len(t) // 8) * 8, "0"), 2).to_bytes(-(-len(t) // 8)) for t in text)
        file = tiff_file(shape(width, 5, bits, compression=compression), tiff.ENCODERS[compression](rows), order)
        (_, w, h, samples, data, feature, error), = tiff.pages_of(file)
        assert (w, h, samples, error) == (width, 5, 1, None) and list(data) == page.ravel().tolist() and feature


def test_one_bit_is_the_default():
    file = tiff_file({tiff.TAG_WIDTH: 8, tiff.TAG_LENGTH: 1}, b"\xa5")
    assert list(next(tiff.pages_of(file))[4]) == [1, 0, 1, 0, 0, 1, 0, 1]


@pytest.mark.parametrize("fields", [shape(4, 2, 8, predictor=3), shape(4, 2, 8, predictor=0), shape(8, 1, 1, predictor=2), shape(4, 2, 2), shape(4, 2, 32), shape(4, 2, 8, compression=7)])
def test_what_is_not_known_is_refused(fields):
    (row,) = tiff.pages_of(tiff_file(fields, bytes(8)))
    assert row[4] is None and "unsupported" in row[6]


def test_sizes_are_checked_first():
    for fields in (shape(1 << 20, 1 << 20, 8), shape(1 << 31, 1, 8), shape(100_000, 30_000, 8)):
        (row,) = tiff.pages_of(tiff_file(fields, bytes(8)))
        assert "too large" in row[6]
    (row,) = tiff.pages_of(tiff_file(shape(64, 64, 8), bytes(4096)), max_bytes=4095)
    assert "too large" in row[6]


def test_more_samples_than_the_old_bound():
    """A page of 2^28 samples and a row more, mostly zeros."""
    text = b"begin" + bytes((1 << 28) + 10) + b"end"
    page = tiff.payload(text)
    ((_, width, height, _, data, _, error),) = [(*p[:5], None, p[6]) for p in tiff.pages_of(tiff.write_tiff([page]))]
    assert error is None and (width, height) == page.shape[::-1] and data[: len(text)] == text


def spans(scanner, text):
    return sorted((m.start, m.end, m.errors) for m in scanner.scan(text))


def plain(notice, text):
    """Best matches one after another, each in what the ones before have left."""
    errors = max(1, len(notice) // licenses.CHARACTERS_PER_ERROR)
    pattern = regex.compile(f"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={errors}}}")
    found, left = [], [(0, len(text))]
    while left:
        a, b = left.pop()
        if m := pattern.search(text, a, b):
            found.append((*m.span(), sum(m.fuzzy_counts)))
            left += [(a, m.start()), (m.end(), b)]
    return sorted(found)


def test_a_better_match_hides_no_other():
    scanner = licenses.Scanner({}, {"all rights reserved": "x"})
    text = "all rightz reserved all rihts reserved all rights reserved"
    assert spans(scanner, text) == [(0, 19, 1), (20, 38, 1), (39, 58, 0)] == plain("all rights reserved", text)


def test_spans_equal_a_search_of_the_whole_text():
    """Notices with errors close to each other, words between them."""
    rng = np.random.default_rng(4)
    notice = "all rights reserved"
    scanner = licenses.Scanner({}, {notice: "x"})
    for _ in range(150):
        parts = []
        for _ in range(rng.integers(1, 7)):
            own = list(notice)
            if rng.integers(2):
                own[rng.integers(len(own))] = "qz"[rng.integers(2)]
            parts.append("".join(own) if rng.integers(3) else "word" * int(rng.integers(1, 9)))
        text = " ".join(parts)
        assert spans(scanner, text) == plain(notice, text), text


def test_catalogue_has_no_notice_within_its_own_words():
    """Each notice is found in itself, with its own label."""
    scanner = licenses.Scanner({}, licenses.NOTICES)
    for notice, label in licenses.NOTICES.items():
        assert label in {m.label for m in scanner.scan(notice)}
