"""Zstandard WARC archives: one frame per record, the dictionary in a leading skippable frame.

Archives are ordinary files that Spark's own committer writes: a task gives whole archives as bytes, one per output
file.  The text writer ends every file with a line feed; each archive therefore ends in the header of a skippable frame of
one byte, which that line feed fills, so the file is valid Zstandard to its last byte.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

DICT_MAGIC = 0x184D2A5D   # fixed values of the format
SKIP_MAGIC = 0x184D2A50
FRAME_MAGIC = 0xFD2FB528
ZDICT_MAGIC = 0xEC30A437
ARCHIVE_BYTES = 8 << 20
DICT_BYTES = 64 << 10
SAMPLE_ROWS = 400
SAMPLE_BYTES = 8000
DIGESTS = ("md5", "sha1", "sha256", "sha384", "sha512")
LENGTH = "x-payload-length"  # of a revisit this is the length of the record that it refers to
DATE = "2000-01-01T00:00:00Z"


class WarcError(ValueError):
    """A record or frame that does not keep to the format."""


def train_dictionary(pages: DataFrame) -> bytes:
    """Dictionary from a bounded sample: the SAMPLE_ROWS different beginnings of payloads with the least hashes; empty if too few.

    Only hashes and ids are ranked; the beginnings, of SAMPLE_BYTES, are fetched for the chosen ids.
    """
    begin = F.expr(f"substring(payload, 1, {SAMPLE_BYTES})")
    hashes = pages.select("page_id", begin.alias("p")).filter(F.length("p") >= 64).select("page_id", F.xxhash64("p").alias("k"))
    least = hashes.groupBy("k").agg(F.min("page_id").alias("i")).orderBy("k").limit(SAMPLE_ROWS)
    held = pages.join(F.broadcast(least), F.col("page_id").eqNullSafe(F.col("i"))).select("k", begin.alias("p"))  # SAMPLE_ROWS pairs of numbers
    rows = held.filter(F.xxhash64("p") == F.col("k")).groupBy("k").agg(F.first("p").alias("p")).orderBy("k").collect()
    parts = [bytes(r["p"])[i:i + 2000] for r in rows for i in range(0, len(r["p"]), 2000)]
    if len(parts) < 64:
        return b""
    try:
        return zstandard.train_dictionary(DICT_BYTES, parts, threads=0, level=3, d=8, k=256, steps=1).as_bytes()
    except zstandard.ZstdError:  # too little variety for a dictionary
        return b""


def _uri(url: str | None) -> str:
    return quote(url or "urn:none", safe="%/:?#[]@!$&'()*+,;=~-._")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """Bytes of one record; a revisit has no block, its full payload is that of the record that it refers to."""
    block = b"" if refers_to is not None else payload
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
            f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>".encode(),
            b"WARC-Target-URI: " + _uri(url).encode(), f"WARC-Date: {DATE}".encode(),
            f"WARC-Payload-Digest: sha1:{digest}".encode(), f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}".encode(),
            f"X-Payload-Length: {len(payload)}".encode(), b"Content-Type: text/html; charset=utf-8"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>".encode(),
                 b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}".encode())
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


_NEEDED = ("warc-type", "warc-record-id", "warc-date", "content-length")


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """(headers by lower-case name, block) of one record; raises WarcError on a wrong header, length or digest."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not sep or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise WarcError("no WARC version line")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not re.fullmatch(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+", name):
            raise WarcError(f"bad header line {line[:60]!r}")
        headers[name.decode().lower()] = value.strip().decode("utf-8")
    for name in _NEEDED:
        if name not in headers:
            raise WarcError(f"header {name} is missing")
    if not headers["content-length"].isdigit() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise WarcError("Content-Length does not match the record")
    block = rest[:-4]
    if not same_digest(headers.get("warc-block-digest", ""), block):
        raise WarcError("block digest differs")
    if headers["warc-type"] == "response":
        held = payload_of(headers, block)
        if not same_digest(headers.get("warc-payload-digest", ""), held):
            raise WarcError("payload digest differs")
        if headers.get(LENGTH, str(len(held))) != str(len(held)):
            raise WarcError("payload length differs")
    return headers, block


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The block, without the HTTP head where it is an HTTP message."""
    if headers.get("content-type", "").split(";")[0].strip().lower() != "application/http":
        return block
    return block.partition(b"\r\n\r\n")[2]


def same_digest(wanted: str, data: bytes) -> bool:
    """Whether ``algorithm:value`` is the digest of the data, in hexadecimal or base32; an empty one or an algorithm unknown here is not judged."""
    name, _, value = wanted.partition(":")
    name = name.strip().lower().replace("sha-", "sha")
    if not value or name not in DIGESTS:
        return True
    made = hashlib.new(name, data).digest()
    return value.lower() == made.hex() or value.upper().rstrip("=") == base64.b32encode(made).decode().rstrip("=")


def _skippable(payload: bytes, magic: int) -> bytes:
    return struct.pack("<II", magic, len(payload)) + payload


def read_archive(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of one archive.  A compressed dictionary is decompressed first; frames without a dictionary are read as well."""
    at, n = 0, len(data)
    loaded = None
    if n >= 8 and struct.unpack_from("<I", data)[0] == DICT_MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        if 8 + size > n:
            raise WarcError("dictionary frame is cut off")
        raw, at = data[8:8 + size], 8 + size
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        if raw:
            loaded = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if raw[:4] == struct.pack("<I", ZDICT_MAGIC) else zstandard.DICT_TYPE_RAWCONTENT)
    reader = zstandard.ZstdDecompressor(dict_data=loaded) if loaded else zstandard.ZstdDecompressor()
    view = memoryview(data)
    while at < n:
        if n - at < 8:
            raise WarcError("trailing bytes")
        magic, size = struct.unpack_from("<II", data, at)
        if magic & 0xFFFFFFF0 == SKIP_MAGIC:
            if at + 8 + size > n:
                raise WarcError("skippable frame is cut off")
            at += 8 + size
            continue
        if magic != FRAME_MAGIC:
            raise WarcError(f"unknown frame at byte {at}")
        one = reader.decompressobj()
        out, start = [], at
        while not one.eof:
            if at >= n:
                raise WarcError("frame is cut off")
            step = view[at:at + 65536]
            try:
                out.append(one.decompress(step))
            except zstandard.ZstdError as error:
                raise WarcError(f"frame at byte {start}: {error}") from error
            at += len(step)
        at -= len(one.unused_data)
        yield parse_record(b"".join(out))


def payloads(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload) of ``pages(page_id, url, html)``; other columns are left out."""
    return pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.coalesce(F.encode(F.col("html"), "utf-8"), F.lit(b"")).alias("payload"))


def with_revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """``pages`` with payload, digest and refers_to: the largest page_id of an equal payload of ``least_bytes`` or more.

    Only narrow rows are grouped, with partial maxima, and only digests that occur twice are joined back.
    """
    d = payloads(pages).withColumn("digest", F.sha1("payload"))
    twice = (d.filter(F.length("payload") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("n"))
             .filter("n > 1").select("digest", "keeper"))
    d = d.join(twice, "digest", "left")
    # rows without an id cannot be named, so they are kept whole; of repeated ids every row of the largest id is kept whole
    refers = F.when(F.col("page_id").isNotNull() & (F.col("page_id") < F.col("keeper")), F.col("keeper"))
    return d.withColumn("refers_to", refers).drop("keeper")


def write_archives(pages: DataFrame, path: str, least_bytes: int = 1000, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write ``pages(page_id, url, html)`` as archives below ``path``, one record per row.

    NULL html is an empty payload, a NULL url becomes ``urn:none``, a NULL page_id ``urn:page:none``.
    """
    d = with_revisits(pages, least_bytes)
    trained = train_dictionary(payloads(pages))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loaded = zstandard.ZstdCompressionDict(trained) if trained else None
        writer = zstandard.ZstdCompressor(level=3, dict_data=loaded) if loaded else zstandard.ZstdCompressor(level=3)
        lead = _skippable(trained, DICT_MAGIC)
        tail = struct.pack("<II", SKIP_MAGIC, 1)
        held, size = [lead], 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to"))):
                held.append(writer.compress(record(*(x.as_py() for x in row))))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join([*held, tail])], pa.binary())], ["value"])
                    held, size = [lead], 0
        if size:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join([*held, tail])], pa.binary())], ["value"])
    out = d.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(run, "value binary")
    # a binary cast to string keeps its bytes, and the text writer writes them as they are
    out.select(F.col("value").cast("string").alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path``: record_id, record_type, url, payload_digest, payload_bytes, refers_to, block."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).filter("length > 0").select("content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column("content"):
                rows, size = [], 0
                for h, block in read_archive(cell.as_buffer().to_pybytes()):
                    rows.append((h["warc-record-id"], h["warc-type"], h.get("warc-target-uri"), h.get("warc-payload-digest", "").removeprefix("sha1:"),
                                 _length(h, block), h.get("warc-refers-to"), block))
                    size += len(block)
                    if size > 4 << 20:
                        yield _rows(rows)
                        rows, size = [], 0
                yield _rows(rows)
    return files.mapInArrow(run, "record_id string, record_type string, url string, payload_digest string, payload_bytes bigint, refers_to string, block binary")


def _length(headers: dict[str, str], block: bytes) -> int:
    """Bytes of a record's payload; a revisit says the length of the payload that it refers to, or 0."""
    if headers["warc-type"] != "revisit":
        return len(payload_of(headers, block))
    told = headers.get(LENGTH, "0")
    if not re.fullmatch("[0-9]+", told):
        raise WarcError("payload length is no number")
    return int(told)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    names = ["record_id", "record_type", "url", "payload_digest", "payload_bytes", "refers_to", "block"]
    kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names)
