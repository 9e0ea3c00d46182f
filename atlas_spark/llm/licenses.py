"""License notices in running text: exact seeds locate candidates, bounded-error matching verifies them and reports spans.

A notice of m characters may be found with up to one edit per EDIT_EVERY characters.  Cut into one piece more than
edits are allowed, at least one piece stands unchanged in every match; one automaton finds the pieces of all notices in
one pass, and only the windows around them are matched by the ``regex`` library.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cached_property

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: Characters of a notice per allowed edit; shorter notices are matched exactly.
EDIT_EVERY = 12

#: Base phrases and their labels (fixed values).
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Short notices (fixed values): label, words that may be misspelt, words after them that must stand as they are.
NOTICES = (
    ("mit", "released under the mit license", ""),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ""),
    ("apache-2", "licensed under the apache license version", "2"),
    ("bsd-2-clause", "redistribution and use in source and binary forms with or without modification are permitted", ""),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse", ""),
    ("gpl-2", "gnu general public license version", "2"),
    ("gpl-3", "gnu general public license version", "3"),
    ("lgpl-2.1", "gnu lesser general public license version", "2 1"),
    ("lgpl-3", "gnu lesser general public license version", "3"),
    ("agpl-3", "gnu affero general public license version", "3"),
    ("mpl-2.0", "mozilla public license version", "2 0"),
    ("epl-2.0", "eclipse public license version", "2 0"),
    ("cc0-1.0", "creative commons zero public domain dedication", ""),
    ("cc-by-4.0", "creative commons attribution", "4 0"),
    ("cc-by-sa-4.0", "creative commons attribution sharealike", "4 0"),
    ("cc-by-nc-4.0", "creative commons attribution noncommercial", "4 0"),
    ("cc-by-nc-4.0", "licensed under cc by nc", "4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa", "4 0"),
    ("cc-by-4.0", "licensed under cc by", "4 0"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ""),
    ("unlicense", "this is free and unencumbered software released into the public domain", ""),
    ("all-rights-reserved", "all rights reserved", ""),
)

_WORD_BYTES = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
_RUN = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

Match = tuple[int, int, int, int]  # start, end (characters of the normal form), edits, notice


@dataclass(frozen=True)
class Notices:
    """Notices with their seeds; made once per worker process."""
    table: Sequence[tuple[str, str, str]] = NOTICES
    edit_every: int = EDIT_EVERY

    def edits(self, k: int) -> int:
        return len(self.table[k][1]) // self.edit_every

    @cached_property
    def patterns(self) -> list[regex.Pattern]:
        """The best fit of each notice from a word's start to a word's end, with its exact words behind it."""
        out = []
        for k, (_, loose, exact) in enumerate(self.table):
            body = f"(?:{regex.escape(loose, special_only=True)}){{e<={self.edits(k)}}}"
            out.append(regex.compile(rf"(?b)(?<=\ ){body}{regex.escape(' ' + exact, special_only=True) if exact else ''}(?=\ )"))
        return out

    @cached_property
    def seeds(self) -> ahocorasick.Automaton:
        """Automaton of the pieces; a piece carries the notices it comes from and its place in them."""
        places: dict[str, list[tuple[int, int]]] = {}
        for k, (_, loose, _) in enumerate(self.table):
            pieces = self.edits(k) + 1
            cut = [len(loose) * i // pieces for i in range(pieces + 1)]
            for a, b in zip(cut, cut[1:]):
                places.setdefault(loose[a:b], []).append((k, a))
        found = ahocorasick.Automaton()
        for piece, where in places.items():
            found.add_word(piece, (len(piece), where))
        found.make_automaton()
        return found

    def windows(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(notice, first, last): where a match of the notice may begin; starts that lie close together come as one window of
        bounded length."""
        starts: dict[int, list[int]] = {}
        for end, (size, where) in self.seeds.iter(text):
            for k, at in where:
                starts.setdefault(k, []).append(end + 1 - size - at)
        for k, found in starts.items():
            first = last = None
            for p in sorted(found):
                if first is None or p - first > 2 * self.edits(k):
                    if first is not None:
                        yield k, first, last
                    first = p
                last = p
            yield k, first, last

    def matches(self, text: str) -> list[Match]:
        """Verified matches in a normal form (words with a blank before, between and after), the better one where two overlap:
        fewer edits, then the longer, then the first, then the earlier notice."""
        found: set[Match] = set()
        for k, first, last in self.windows(text):
            e, (_, loose, exact) = self.edits(k), self.table[k]
            a, b = max(first - e - 1, 0), last + len(loose) + e + len(exact) + 3
            for m in self.patterns[k].finditer(text, a, min(b, len(text))):
                found.add((m.start(), m.end(), sum(m.fuzzy_counts), k))
        kept: list[Match] = []
        for group in _overlapping(sorted(found)):
            taken: list[Match] = []
            for m in sorted(group, key=lambda m: (m[2], m[0] - m[1], m[0], m[3])):
                if all(m[1] <= t[0] or m[0] >= t[1] for t in taken):
                    taken.append(m)
            kept += sorted(taken)
        return kept


def _overlapping(matches: list[Match]) -> Iterator[list[Match]]:
    """Runs of matches, sorted by start, that are chained by overlaps."""
    group: list[Match] = []
    end = 0
    for m in matches:
        if group and m[0] >= end:
            yield group
            group = []
        group.append(m)
        end = max(end, m[1]) if len(group) > 1 else m[1]
    if group:
        yield group


def normal_form(text: bytes) -> bytes:
    """Words in lower case (A-Z only) with one blank before, between and after them."""
    return b" " + b" ".join(text.translate(_WORD_BYTES).split()) + b" "


def _places(norm: bytes, phrase: bytes) -> list[int]:
    """Where the phrase's words begin in the normal form."""
    out, at = [], norm.find(b" " + phrase + b" ")
    while at >= 0:
        out.append(at + 1)
        at = norm.find(b" " + phrase + b" ", at + 1)
    return out


def scan(text: bytes, notices: Notices, base: dict[str, str] = BASE) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, spans) of one text in UTF-8.

    Spans are (label, first code point, code point after the last, edits) in the original text.
    """
    norm = normal_form(text)
    n_words = norm.count(b" ") - 1 if len(norm) > 2 else 0
    exact = {p: found for p in base if (found := _places(norm, p.encode()))}
    starts = sorted(x for found in exact.values() for x in found)
    matches = notices.matches(norm.decode("latin-1"))
    spans: list[tuple[str, int, int, int]] = []
    score = 1.0 if exact else 0.0
    if exact or matches:
        runs = [(m.start(), m.end()) for m in _RUN.finditer(text)]
        blanks = np.flatnonzero(np.frombuffer(norm, np.uint8) == 0x20)
        points = np.concatenate([[0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)])

        def span(a: int, b: int) -> tuple[int, int]:
            i, j = int(np.searchsorted(blanks, a)) - 1, int(np.searchsorted(blanks, b)) - 1
            return int(points[runs[i][0]]), int(points[runs[j][1]])
        spans = [(base[p], *span(x, x + len(p)), 0) for p, found in exact.items() for x in found]
        for a, b, edits, k in matches:
            spans.append((notices.table[k][0], *span(a, b), edits))
            score = max(score, 1 - edits / len(notices.table[k][1]))
        spans = sorted(set(spans), key=lambda s: (s[1], s[2], s[0]))
    word = [norm.count(b" ", 0, x) - 1 for x in (starts[:1] + starts[-1:])]
    labels = {base[p] for p in exact}
    return (n_words, len(starts), word[0] if word else None, word[-1] if word else None, ",".join(sorted(labels)),
            ",".join(sorted(labels | {s[0] for s in spans})), score, spans)


SCHEMA = ("doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, "
          "spans array<struct<label: string, start: bigint, end: bigint, edits: int>>")
_SPANS = pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())]))


def license_scan(docs: DataFrame, notices: Notices = Notices(), base: dict[str, str] = BASE) -> DataFrame:
    """A row per row of ``docs(doc_id, text)`` with its base phrases, labels, best score and spans; no shuffle.

    A NULL or empty text has no words, no labels and the score 0; repeated rows give repeated results and other columns are
    not read.  Texts are searched whole; a match never leaves its text.
    """
    table, every = tuple(notices.table), notices.edit_every

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Notices(table, every)
        types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64(), _SPANS]
        names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                b = batch.slice(first, 1000)
                out = []
                for i, text in zip(b.column("doc_id").to_pylist(), b.column("text")):
                    *values, spans = scan((text.as_py() or "").encode(), own, base)
                    out.append((i, *values, [dict(zip(("label", "start", "end", "edits"), s)) for s in spans]))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)
