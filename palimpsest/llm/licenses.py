"""License scans: fuzzy search for short notices.

A notice of length m that may hold k errors is cut into k + 1 pieces; by the pigeonhole
principle one of them stands in every match unchanged. One pass of a multi-pattern automaton
finds these exact seeds, and only around them the regex library's bounded-error matching
verifies the edits and gives the spans. Exact phrases are found by their words as well.

Seeds of a notice that lie close together are verified in windows of a few times its length, which
overlap by as much as a match can take, so that the work grows with the text, however many notices
it holds. Of matches of one notice that overlap, the one with the fewest errors counts, then the
first; left and right of it the search goes on, so that a better match elsewhere hides none.

Defined results: null and empty texts have no words, no places and score 0; texts of any length
are scanned whole; equal and repeated rows give equal results; extra columns are dropped unless
named in ``keep``, where one with the name of a result is replaced by it; an empty table gives an
empty table.
"""

from __future__ import annotations

from bisect import bisect
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import byte_slices, map_arrow, schema_of, string_buffers, text_rows

#: Phrases whose words must stand consecutively, with their labels.
BASE_PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Short notices that may hold errors.
NOTICES = {
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "creative commons attribution noncommercial": "cc-by-nc",
    "licensed under the gnu general public license version 3": "gpl-3",
    "licensed under the gnu general public license version 2": "gpl-2",
    "redistribution and use in source and binary forms with or without modification": "bsd",
    "mozilla public license version 2 0": "mpl-2",
    "all rights reserved": "all-rights-reserved",
    "this software is provided by the copyright holders and contributors as is": "bsd",
    "neither the name of the copyright holder nor the names of its contributors": "bsd-3-clause",
    "the software is provided as is without warranty of any kind express or implied": "mit",
    "permission to use copy modify and or distribute this software for any purpose": "isc",
    "this program is free software you can redistribute it and or modify": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "gnu free documentation license": "gfdl",
    "eclipse public license version 2 0": "epl-2",
    "european union public licence": "eupl",
    "boost software license version 1 0": "bsl-1",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution 4 0 international": "cc-by",
    "cc0 1 0 universal public domain dedication": "cc0",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "the artistic license 2 0": "artistic-2",
    "python software foundation license": "psf",
    "common development and distribution license": "cddl",
    "open database license": "odbl",
    "sil open font license version 1 1": "ofl-1.1",
}
#: One error is allowed for so many characters of a notice.
CHARACTERS_PER_ERROR = 10

# Lower-cases A-Z and turns every other byte that is not part of a word into a space.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def normalise(text: bytes) -> str:
    """The text's words with single spaces between them."""
    return b" ".join(text.translate(_WORDS).split()).decode("utf-8")


@dataclass(frozen=True)
class Match:
    label: str
    first_word: int
    last_word: int
    start: int
    end: int
    errors: int
    likeness: float
    exact: bool


class Scanner:
    def __init__(self, phrases: dict[str, str], notices: dict[str, str], characters_per_error: int = CHARACTERS_PER_ERROR):
        import ahocorasick
        import regex

        self.phrases = phrases
        self.automaton = ahocorasick.Automaton()
        self.notices = []
        seeds: dict[str, list] = {}
        for phrase in phrases:
            seeds.setdefault(phrase, []).append((None, phrase))
        for number, (notice, label) in enumerate(notices.items()):
            errors = max(1, len(notice) // characters_per_error)
            self.notices.append((notice, label, errors, regex.compile(f"(?b)(?:{regex.escape(notice, literal_spaces=True)}){{e<={errors}}}")))
            cuts = [round(i * len(notice) / (errors + 1)) for i in range(errors + 2)]
            for a, b in zip(cuts, cuts[1:]):
                seeds.setdefault(notice[a:b], []).append((number, a))
        for seed, uses in seeds.items():
            self.automaton.add_word(seed, (len(seed), uses))
        self.automaton.make_automaton()

    def scan(self, text: str) -> list[Match]:
        """Matches in a normalised text, without order."""
        exact: list[tuple[str, int, int]] = []
        windows: dict[int, list[list[int]]] = {}
        n = len(text)
        for last, (size, uses) in self.automaton.iter(text):
            start = last + 1 - size
            for number, what in uses:
                if number is None:
                    if (start == 0 or text[start - 1] == " ") and (last + 1 == n or text[last + 1] == " "):
                        exact.append((what, start, last + 1))
                    continue
                notice, _, errors, _ = self.notices[number]
                a, b = max(0, start - what - errors), min(n, start - what + len(notice) + errors)
                spans = windows.setdefault(number, [])
                if spans and a <= spans[-1][1]:
                    spans[-1][0], spans[-1][1] = min(a, spans[-1][0]), max(b, spans[-1][1])
                else:
                    spans.append([a, b])
        fuzzy = [(number, *m) for number, spans in windows.items() for m in self._verified(number, text, spans)]
        if not exact and not fuzzy:
            return []
        # A place's word is the number of spaces before it.
        spaces = np.flatnonzero(np.frombuffer(text.encode("utf-32-le"), "<u4") == 32)
        word = lambda at: int(np.searchsorted(spaces, at))
        found = [Match(self.phrases[p], word(a), word(a) + p.count(" "), a, b, 0, 1.0, True) for p, a, b in exact]
        for number, errors, a, b in fuzzy:
            notice, label, _, _ = self.notices[number]
            found.append(Match(label, word(a), word(b), a, b, errors, 1 - errors / len(notice), False))
        return found

    def _verified(self, number: int, text: str, spans: list[list[int]]) -> list[tuple[int, int, int]]:
        """Errors, start and end of a notice's matches within spans."""
        notice, _, errors, pattern = self.notices[number]
        longest = len(notice) + errors
        matches: set[tuple[int, int, int]] = set()
        for a, b in spans:
            for begin in range(a, max(a + 1, b - longest), 2 * longest):
                open_parts = [(begin, min(b, begin + 3 * longest))]
                while open_parts:
                    low, high = open_parts.pop()
                    m = pattern.search(text, low, high) if high - low >= len(notice) - errors else None
                    if m is not None:
                        matches.add((sum(m.fuzzy_counts), *m.span()))
                        open_parts += [(low, m.start()), (m.end(), high)]
        taken: list[tuple[int, int]] = []
        kept = []
        for match in sorted(matches):
            _, a, b = match
            at = bisect(taken, (a, b))
            if (at == 0 or taken[at - 1][1] <= a) and (at == len(taken) or b <= taken[at][0]):
                taken.insert(at, (a, b))
                kept.append(match)
        return kept


MATCH_TYPE = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("errors", pa.int32()), ("likeness", pa.float64()), ("exact", pa.bool_())]))
MATCH_SCHEMA = "array<struct<label: string, first_word: bigint, last_word: bigint, errors: int, likeness: double, exact: boolean>>"


RESULT = f"n_words bigint, matches {MATCH_SCHEMA}"


def license_scan(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), phrases: dict[str, str] = BASE_PHRASES, notices: dict[str, str] = NOTICES, characters_per_error: int = CHARACTERS_PER_ERROR) -> DataFrame:
    """``keep`` columns, ``n_words`` and ``matches``: spans in words, with their errors."""
    keep, name, rows = text_rows(df, keep, text, RESULT)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(phrases, notices, characters_per_error)
        for part in byte_slices(batches, name):
            data, at = string_buffers(part.column(name))
            raw, at = data.tobytes(), at.tolist()
            counts, matches = [], []
            for a, b in zip(at, at[1:]):
                words = normalise(raw[a:b])
                counts.append(words.count(" ") + 1 if words else 0)
                found = sorted(scanner.scan(words), key=lambda m: (m.first_word, m.last_word, m.label, m.errors, m.exact))
                matches.append([{"label": m.label, "first_word": m.first_word, "last_word": m.last_word, "errors": m.errors, "likeness": m.likeness, "exact": m.exact} for m in found])
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(counts, pa.int64()), pa.array(matches, MATCH_TYPE)], names=[*keep, "n_words", "matches"])

    return map_arrow(rows, run, schema_of(df, keep, RESULT))


def license_digest(scanned: DataFrame) -> DataFrame:
    """Counts, labels and score of each document from its matches."""
    exact = F.filter("matches", lambda m: m["exact"])
    labels = lambda of: F.array_join(F.array_sort(F.array_distinct(F.transform(of, lambda m: m["label"]))), ",")
    starts = F.transform(exact, lambda m: m["first_word"])
    return scanned.select(
        "doc_id",
        "n_words",
        F.size(exact).cast("bigint").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels(exact).alias("base_labels"),
        labels(F.col("matches")).alias("labels"),
        F.coalesce(F.array_max(F.transform("matches", lambda m: m["likeness"])), F.lit(0.0)).alias("score"),
    )
