"""Personal data: patterns propose spans, checksums confirm them, nearby words move the score."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone", "iban")
BASE = KINDS[:4]

_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# every match begins at the first digit of its run, so later starts inside a long run need no trial
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_NOT_DIGIT = re.compile(r"[^0-9]+")

#: words that speak for a kind (fixed values), found in the CONTEXT code points before a span
WORDS = {
    "email": ("mail", "contact", "correo", "adresse"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "credit", "tarjeta", "carte", "karte"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
}
CONTEXT = 40
START = {"email": 0.8, "ip": 0.5, "card": 0.6, "phone": 0.5, "iban": 0.8}
LIFT = 0.2
_NEAR = {k: re.compile(r"\b(?:" + "|".join(v) + r")", re.I) for k, v in WORDS.items()}


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def mod97(iban: str) -> bool:
    """ISO 7064 check of an account number without blanks: the rearranged number leaves 1."""
    rest = 0
    for c in iban[4:] + iban[:4]:
        v = int(c, 36)
        rest = (rest * (100 if v > 9 else 10) + v) % 97
    return rest == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the address pattern, from each @ outwards: linear in the text."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        at = text.find("@", max(at + 1, done))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p := g.lstrip("0")) <= 3 and int(p or 0) <= 255 for g in m.groups()):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14:
            d = _NOT_DIGIT.sub("", m[0])
            if 14 <= len(d) <= 19 and luhn(d):
                yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """The longest proposal whose checksum holds, up to each blank: the words after a number may look like groups of it."""
    m = _IBAN.search(text)
    while m:
        start, end, after = m.start(), m.end(), m.start() + 1
        while end - start >= 15:
            s = text[start:end].replace(" ", "")
            if 15 <= len(s) <= 34 and mod97(s):
                yield start, end
                after = end
                break
            end = text.rfind(" ", start, end)
        m = _IBAN.search(text, after)


_FINDERS = (_emails, _ips, _cards, _phones, _ibans)


def find(text: str | None) -> list[tuple[int, int, int, float]]:
    """(start, end, number of the kind, score) by start, then kind; code points, end exclusive."""
    if not text:
        return []
    out = []
    for k, finder in enumerate(_FINDERS):
        for a, b in finder(text):
            near = _NEAR[KINDS[k]].search(text, max(0, a - CONTEXT), a)
            out.append((a, k, b, min(1.0, START[KINDS[k]] + LIFT * bool(near))))
    return [(a, b, k, s) for a, k, b, s in sorted(out)]


def pii(docs: DataFrame) -> DataFrame:
    """(doc_id, found array<struct<kind, start, end, score>>) per row of ``docs(doc_id, text, ...)``.

    NULL and empty texts have an empty array.  Spans of one kind do not overlap; spans of different kinds may.
    Repeated rows come out once each; a NULL doc_id stays NULL; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": a, "end": b, "score": s} for a, b, k, s in find(t.as_py())] for t in batch.column("text")]
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, kind)], ["doc_id", "found"])
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return d.mapInArrow(run, "doc_id bigint, found array<struct<kind: string, start: bigint, end: bigint, score: double>>")


def printed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def sha256(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()
