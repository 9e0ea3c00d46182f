"""Repeated passages: paragraph MinHash banding, exact Jaccard of colliding paragraphs, removal by components, and winnowed word runs.

A paragraph is a sentence with the short sentences after it on its line: its borders depend only on the words around them,
so a passage that was pasted into different texts gives the same inner paragraphs in all of them.

Paragraphs find edited copies but need stops.  Equal words are found without them: of every REACH neighbouring runs of SEED words
the one with the least hash is a seed, so two texts that share SPAN words in a row share a seed, wherever their sentences end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window as W, functions as F

from ..session import cut_lineage
from . import cells as C, text as T
from .components import components

SHINGLE = 5
PERCENT = 80
RECALL = 0.99
SHORT = 5        # sentences of fewer words belong to the one before
PARAGRAPH = 8    # paragraphs of fewer words are never taken as repeated by themselves
SPAN = 20        # words of a repeated passage, gaps of short paragraphs left out
SEED = PARAGRAPH
REACH = SPAN - SEED + 1

_GAP = 0xFFFF     # longer gaps between words are cut: a border may lie anywhere in one
_LOW = 2**32 - 1
_STOP = np.zeros(256, bool)
_STOP[[ord("."), ord("!"), ord("?")]] = True


def tuned_bands(threshold: float, recall: float, most_rows: int = 4) -> tuple[int, int]:
    """(rows, bands) with the fewest bands that find a pair at the threshold with this probability; more rows where equal."""
    need = {r: math.ceil(math.log(1 - recall) / math.log(1 - threshold ** r)) for r in range(1, most_rows + 1)}
    rows = min(need, key=lambda r: (need[r], -r))
    return rows, need[rows]


def paragraphs(a: pa.Array) -> tuple[T.Words, np.ndarray]:
    """(words, number of the first word of each paragraph and the end) of several texts."""
    w = T.words(a)
    n = len(w.hash)
    if not n:
        return w, np.zeros(1, np.int64)
    lines = np.concatenate([[0], np.cumsum(w.raw == 10)])
    new_line = np.ones(n, bool)
    new_line[1:] = lines[w.start[1:]] > lines[w.end[:-1]]
    new_line[w.first[:-1][w.first[:-1] < n]] = True
    begin = new_line.copy()
    begin[1:] |= _STOP[w.raw[w.end[:-1] - 1]]
    at = np.flatnonzero(begin)
    size = np.diff(np.append(at, n))
    at = at[new_line[at] | (size >= SHORT)]
    return w, np.append(at, n)


def _sets(w: T.Words, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shingle hashes, offsets by paragraph, content hash by paragraph)."""
    h, off = T.shingles(w, SHINGLE, at)
    k = np.arange(len(w.hash)) - np.repeat(at[:-1], np.diff(at))
    power = T._powers(int(np.diff(at).max()) if len(at) > 1 else 1)
    u = np.add.reduceat(w.hash * power[k], at[:-1]) if len(at) > 1 else np.zeros(0, np.uint64)
    return h, off, T._mixed(u + np.diff(at).astype(np.uint64)) & np.uint64(2**63 - 1)


def seeds(w: T.Words) -> tuple[np.ndarray, np.ndarray]:
    """(first word, content hash below 0) of the seeds: runs of SEED words with the least hash, the last of equal ones, of some REACH neighbouring runs."""
    count = np.maximum(np.diff(w.first) - SEED + 1, 0)
    n = int(count.sum())
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    inside = np.arange(n) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(w.first[:-1], count) + inside
    h = np.zeros(n, np.uint64)
    for k, power in enumerate(T._powers(SEED, np.uint64(0xC2B2AE3D27D4EB4F))):
        h += w.hash[at + k] * power
    h = T._mixed(h)
    room = np.repeat(count, count) - 1 - inside
    before, after = np.zeros(n, np.int8), np.zeros(n, np.int8)
    left, right = np.ones(n, bool), np.ones(n, bool)
    for d in range(1, min(REACH, n)):
        left[:d] = False
        left[d:] &= (h[:-d] >= h[d:]) & (inside[d:] >= d)
        right[-d:] = False
        right[:-d] &= (h[d:] > h[:-d]) & (room[:-d] >= d)
        before += left
        after += right
    keep = np.flatnonzero(before + after + 1 >= REACH)
    return at[keep], -1 - (h[keep] >> np.uint64(1)).astype(np.int64)


def _owner(w: T.Words, at: np.ndarray) -> np.ndarray:
    return np.searchsorted(w.first, at[:-1], "right") - 1


def bands(docs: DataFrame, rows: int, count: int) -> DataFrame:
    """(g, id, doc_id): band value, paragraph content and a document that holds it, without repeats inside a chunk."""
    seeds = T._mixed(np.arange(1, rows * count + 1, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.pieces(batch):
                w, at = paragraphs(part.column("text"))
                if len(at) < 2:
                    continue
                h, off, u = _sets(w, at)
                keep = np.flatnonzero(np.diff(at) >= PARAGRAPH)
                u, first = np.unique(u[keep], return_index=True)
                keep = keep[first]
                doc = part.column("doc_id").to_numpy(zero_copy_only=False)[_owner(w, at)[keep]]
                g = []
                for b in range(count):
                    key = np.full(len(keep), b, np.uint64)
                    for s in seeds[b * rows:(b + 1) * rows]:
                        key = T._mixed(key + np.minimum.reduceat(T._mixed(h ^ s), off[:-1])[keep])
                    g.append(key.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(g)), pa.array(np.tile(u, count).view(np.int64)), pa.array(np.tile(doc, count))], ["g", "id", "doc_id"])
    return _plain(docs).filter("doc_id is not null").mapInArrow(run, "g bigint, id bigint, doc_id bigint")


def located(docs: DataFrame) -> DataFrame:
    """(doc_id, size, word, point, id) of the paragraphs and seeds, whose ids are below 0, text by text.

    The numbers of a place are packed so that what neighbouring rows share comes first, as most rows go by the first shuffle and
    its blocks are compressed: ``size`` is the number of words and of code points up to the words before and after, ``word`` the
    first word over the row's hash, ``point`` the number of code points over the first one.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in T.pieces(batch):
                w, at = paragraphs(part.column("text"))
                if len(at) < 2:
                    continue
                _, _, u = _sets(w, at)
                keep = np.flatnonzero(np.diff(at) >= PARAGRAPH)
                seed, v = seeds(w)
                a, b = np.concatenate([at[keep], seed]), np.concatenate([at[keep + 1] - 1, seed + SEED - 1])
                order = np.argsort(a, kind="stable")
                a, b, unit = a[order], b[order], np.concatenate([u[keep].view(np.int64), v])[order]
                own = np.searchsorted(w.first, a, "right") - 1
                point = np.concatenate([[0], np.cumsum((w.raw & 0xC0) != 0x80)])
                raw_off = T.offsets(part.column("text"))[1][own]
                start, end = point[w.start[a]], point[w.end[b]]
                before = np.where(a > w.first[own], start - point[w.end[a - 1]], 0)
                after = np.where(b + 1 < w.first[own + 1], point[w.start[np.minimum(b + 1, len(w.start) - 1)]] - end, 0)
                word = ((a - w.first[own]) << 32) + part.column("row").to_numpy(zero_copy_only=False)[own]
                size = ((b - a + 1) << 32) + (np.minimum(before, _GAP) << 16) + np.minimum(after, _GAP)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(own)), pa.array(size), pa.array(word), pa.array(((end - start) << 32) + start - point[raw_off]), pa.array(unit)],
                    ["doc_id", "size", "word", "point", "id"])
    d = _plain(docs).withColumn("row", F.xxhash64("doc_id", "text").bitwiseAND(F.lit(2**31 - 1)))
    return d.mapInArrow(run, "doc_id bigint, size bigint, word bigint, point bigint, id bigint")


def _joined(doc: np.ndarray, row: np.ndarray, first: np.ndarray, last: np.ndarray, start: np.ndarray, end: np.ndarray, before: np.ndarray, after: np.ndarray,
            cluster: np.ndarray, removed: np.ndarray, span: int) -> list[np.ndarray]:
    """Columns of the spans of whole texts, whose units come text by text: a word is removed if any unit over it is; seeds have clusters below 0."""
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (row[1:] != row[:-1])])
    text = np.cumsum(new) - 1
    room = np.maximum.reduceat(last.astype(np.int64), np.flatnonzero(new)) + 2 + PARAGRAPH  # so that texts never touch
    base = (np.cumsum(room) - room)[text]
    a, b = first + base, last + base + 1
    for kind in (False, True):  # seeds of one kind reach to the next one
        i = np.flatnonzero((cluster < 0) & (removed == kind))
        gap = a[i[1:]] - b[i[:-1]]
        near = np.flatnonzero((gap > 0) & (gap < PARAGRAPH))
        b[i[near]] = a[i[near + 1]]
    points, where = np.unique(np.concatenate([a, b]), return_index=True)
    begins, stops = np.concatenate([start, end + after])[where], np.concatenate([start - before, end])[where]
    unit = np.concatenate([np.arange(len(a))] * 2)[where]
    ia, ib = np.searchsorted(points, a), np.searchsorted(points, b)

    def over(chosen):
        return np.cumsum(np.bincount(ia[chosen], minlength=len(points)) - np.bincount(ib[chosen], minlength=len(points)))[:-1] > 0
    state = over(np.ones(len(a), bool)).astype(np.int8) + over(removed)
    at = np.flatnonzero(state)
    gap = points[at[1:]] - points[at[:-1] + 1]
    opens = np.flatnonzero(np.concatenate([[True], (gap >= PARAGRAPH) | (state[at[1:]] != state[at[:-1]])]))
    # an end beyond the first or last whole paragraph counts from REACH words on, and where the rest would be too short
    size, k = points[at + 1] - points[at], np.arange(len(at))
    so_far, whole = np.concatenate([[0], np.cumsum(size)]), over(cluster >= 0)[at]
    stop = np.append(opens[1:], len(at))
    head, tail = np.minimum.reduceat(np.where(whole, k, len(at)), opens), np.maximum.reduceat(np.where(whole, k, -1), opens) + 1
    head, tail = np.where(tail > 0, head, opens), np.where(tail > 0, tail, stop)
    head, tail = np.where(so_far[head] - so_far[opens] < REACH, head, opens), np.where(so_far[stop] - so_far[tail] < REACH, tail, stop)
    short = so_far[tail] - so_far[head] < span
    head, tail = np.where(short, opens, head), np.where(short, stop, tail)
    words, lo, hi = so_far[tail] - so_far[head], at[head], at[tail - 1]
    # the least cluster, paragraphs before seeds, of the units of a span's state that begin in it or reach into it
    least = np.full(len(lo), np.iinfo(np.uint64).max, np.uint64)
    of = np.searchsorted(points[hi + 1], a, "right")
    for step in range(2 + int((np.searchsorted(points[lo], b, "left") - 1 - of).max(initial=0))):
        k = of + step
        ok = (k < len(lo)) & (points[lo[np.minimum(k, len(lo) - 1)]] < b)
        ok &= (state[lo[np.minimum(k, len(lo) - 1)]] == 2) == removed
        np.minimum.at(least, k[ok], cluster[ok].view(np.uint64))
    keep = np.flatnonzero(words >= span)
    u = unit[lo[keep]]
    return [doc[u], begins[lo[keep]], stops[hi[keep] + 1], words[keep], least[keep].view(np.int64), state[lo[keep]] == 2]


def _spans(units: DataFrame, span: int) -> DataFrame:
    """Spans of the repeated units, read text by text."""
    names = ["doc_id", "word", "point", "size", "cluster_id", "removed"]
    out = ["doc_id", "start", "end", "words", "cluster_id", "removed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(doc, word, point, size, cluster, removed):
            first, start = word & _LOW, point & _LOW
            held = doc, word >> 32, first, first + (size >> 32) - 1, start, start + (point >> 32), size >> 16 & _GAP, size & _GAP, cluster, removed
            return pa.RecordBatch.from_arrays([pa.array(x) for x in _joined(*held, span)], out)
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            more = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
            held = more if held is None else [np.concatenate(x) for x in zip(held, more)]
            doc, row = held[0], held[1] >> 32
            cut = np.flatnonzero((doc[1:] != doc[:-1]) | (row[1:] != row[:-1]))
            if len(cut):  # the last text may go on in the next batch
                yield batch_of(*[x[:cut[-1] + 1] for x in held])
                held = [x[cut[-1] + 1:] for x in held]
        if held is not None:
            yield batch_of(*held)
    rows = units.select(*names).repartition("doc_id").sortWithinPartitions("doc_id", "word")
    return rows.mapInArrow(run, "doc_id bigint, start bigint, end bigint, words bigint, cluster_id bigint, removed boolean")


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _small(docs: DataFrame) -> DataFrame:
    """(doc_id, z): texts as Zstandard frames, for a shuffle of whole texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frame = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for part in T.pieces(batch):
                z = [frame.compress(x.as_buffer() or b"") for x in part.column("text")]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(z, pa.binary())], ["doc_id", "z"])
    return _plain(docs).filter("doc_id is not null and text is not null").mapInArrow(run, "doc_id bigint, z binary")


def _whole(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Batches of ``text`` and the other columns, from batches with ``z``; a batch holds ``limit`` bytes and one text more."""
    open_ = zstandard.ZstdDecompressor()
    for batch in batches:
        rest = batch.select([c for c in batch.schema.names if c != "z"])
        texts, size, lo = [], 0, 0
        for i, z in enumerate(batch.column("z")):
            texts.append(open_.decompress(z.as_buffer()))
            size += len(texts[-1])
            if size >= limit or i == batch.num_rows - 1:
                text = pa.array(texts, pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([text, *rest.slice(lo, i + 1 - lo).columns], ["text", *rest.schema.names])
                texts, size, lo = [], 0, i + 1


def _hash_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, bin, aux) of the wanted (id, doc_id) paragraphs, cut again from the documents that hold them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _whole(batches):
            for part in T.pieces(batch):
                w, at = paragraphs(part.column("text"))
                if len(at) < 2:
                    continue
                h, off, u = _sets(w, at)
                own, asked = _owner(w, at), [set(x) for x in part.column("ids").to_pylist()]
                ids, bins = [], []
                for i, (o, x) in enumerate(zip(own.tolist(), u.tolist())):
                    if x in asked[o]:
                        asked[o].discard(x)
                        ids.append(x)
                        bins.append(np.unique(h[off[i]:off[i + 1]]).tobytes())
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(bins, pa.binary()), pa.array([0] * len(ids), pa.int64())], ["id", "bin", "aux"])
    asked = wanted.groupBy("doc_id").agg(F.collect_set("id").alias("ids"))  # no more than the paragraphs of one document
    d = _small(docs).join(asked, "doc_id").select("z", "ids")
    return d.mapInArrow(run, "id bigint, bin binary, aux bigint").dropDuplicates(["id"])


def _linked(percent: int):
    def linked(i, j, sets, full, aux, cache):
        a, b = len(sets[i]), len(sets[j])
        if 100 * min(a, b) < percent * max(a, b):
            return False
        both = len(full[i] & full[j])
        return 100 * both >= percent * (a + b - both)
    return linked


def substring_dedup(docs: DataFrame, percent: int = PERCENT, recall: float = RECALL, span: int = SPAN) -> DataFrame:
    """Repeated passages of ``docs(doc_id, text, ...)``: (doc_id, start, end, words, cluster_id, removed).

    Paragraphs are joined into clusters by equal words or by a Jaccard similarity of ``percent`` or more of their distinct 5-word
    shingles, found by bands tuned to ``recall`` and checked exactly; seeds are clusters of equal words.  The first member of a
    cluster, by (doc_id, start), is kept; the words of the others are removed.  Neighbouring repeated words with at most PARAGRAPH - 1
    words between them make one span; spans of fewer than ``span`` words are left out.  A run of SPAN or more equal words in two places is
    always found, but for at most REACH - 1 words at either end, or 2 * (REACH - 1) beyond a repeated paragraph.  Words are compared in lower case of A-Z, by 64-bit hashes.

    NULL and empty texts, and rows with a NULL doc_id, have no spans; rows that repeat a doc_id are
    texts of their own, and an equal row (same id and text) counts once.  Other columns are not read.
    """
    rows, count = tuned_bands(percent / 100, recall)
    members = C.shared(bands(docs, rows, count), "doc_id")
    groups = cut_lineage(C.distinct_groups(members))
    wanted = groups.groupBy("id").agg(F.min("doc_id").alias("doc_id"))
    edges = cut_lineage(C.link_cells(C.into_cells(groups), _hash_sets(docs, wanted), _linked(percent)))
    near = components(edges).select(F.col("node").alias("id"), "label")
    own = W.partitionBy("id")
    here = located(docs).filter("doc_id is not null")
    place = F.struct("doc_id", "word")
    here = here.withColumn("several", F.min(place).over(own) != F.max(place).over(own)).filter("several or id >= 0").join(near, "id", "left")
    here = here.withColumn("word", F.shiftleft(F.col("word").bitwiseAND(F.lit(_LOW)), 32) + F.shiftright("word", 32))  # the row's hash over the first word
    here = cut_lineage(here.filter("several or label is not null").withColumn("cluster_id", F.coalesce("label", "id")).drop("label", "several", "id"))
    first = here.groupBy("cluster_id").agg(F.min(place).alias("kept"))
    return _spans(here.join(first, "cluster_id").withColumn("removed", place != F.col("kept")), span)
