"""Threshold-scaled document sketches in plain DataFrame functions: every shingle hash below a fixed fraction.

The kept hashes of a union are the union of the kept hashes, so sketches merge, and the share of a small document's
hashes found in a large one's estimates containment whatever the sizes.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window as W, functions as F

WORDS = 5
SCALE = 8
ROWS_PER_BUCKET = 2000
MAX_BUCKETS = 4096


def _below(h: Column, scale: int) -> Column:
    return h < F.lit(-(1 << 63) + (1 << 64) // scale)


def word_hashes(text: Column) -> Column:
    """Hash of every word between white space, in lower case."""
    return F.transform(F.filter(F.split(F.lower(text), r"[ \t-\r]+", -1), lambda w: w != ""), lambda w: F.xxhash64(w))


def sketch_of(hashes: Column, words: int = WORDS, scale: int = SCALE) -> Column:
    """Sorted distinct kept hashes of word shingles; the least hash is kept even above the threshold.

    A text of fewer words is one shingle; one without words has an empty sketch.
    """
    def kept(a: Column) -> Column:
        least = F.array_min(a)
        return F.transform(F.array(least), lambda m: F.sort_array(F.array_distinct(F.filter(a, lambda h: _below(h, scale) | (h == m)))))[0]

    def every(w: Column) -> Column:
        n = F.size(w)
        shingle = F.transform(F.sequence(F.lit(0), F.greatest(n - words, F.lit(0))), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(words)]))
        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(shingle)
    # the inner functions must see variables: an expression in their place would be evaluated again for every element
    bound = F.transform(F.array(hashes), every)
    return F.coalesce(F.transform(bound, kept)[0], F.array().cast("array<bigint>"))


def merged(a: Column, b: Column, scale: int = SCALE) -> Column:
    """Sketch of the union of two documents' shingles."""
    both = F.struct(F.array_union(a, b).alias("u"), F.least(F.array_min(a), F.array_min(b)).alias("m"))
    return F.transform(F.array(both), lambda x: F.sort_array(F.filter(x["u"], lambda h: _below(h, scale) | (h == x["m"]))))[0]


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity, 0 to 1; two empty sketches are alike."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / (F.size(a) + F.size(b) - both)).cast("double")


def containment(a: Column, b: Column) -> Column:
    """Estimated share of a's shingles that b holds, 0 to 1; an empty sketch is contained in all."""
    return F.when(F.size(a) == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / F.size(a)).cast("double")


def printed(a: Column) -> Column:
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), ",")


def _bucket(cuts: list[int]) -> Column:
    """Number of cuts at or below doc_id (NULL: 0), found among every 64th cut first."""
    if not cuts:
        return F.lit(0)
    every, coarse = F.lit(cuts), F.lit(cuts[63::64]) if len(cuts) >= 64 else None
    at = F.lit(0) if coarse is None else 64 * F.size(F.filter(coarse, lambda c: c <= F.col("doc_id")))
    fine = F.size(F.filter(F.slice(every, at + 1, F.lit(64)), lambda c: c <= F.col("doc_id")))
    return F.when(F.col("doc_id").isNull(), 0).otherwise(at + fine)


def with_next(docs: DataFrame, columns: list[str], rows_per_bucket: int = ROWS_PER_BUCKET) -> DataFrame:
    """``docs`` with ``next_<c>`` of the following row by (doc_id, text); after the last row comes the first.

    doc_id is cut into ranges at its own quantiles; a window sees one range, and the first row of each range, fetched
    by a join, follows the last row of the range before.  At most MAX_BUCKETS ranges, so no other table grows.
    """
    n = docs.count()
    parts = max(1, min(MAX_BUCKETS, math.ceil(n / rows_per_bucket)))
    grid = [i / parts for i in range(1, parts)]
    cuts = sorted({*docs.select(F.percentile_approx("doc_id", grid, max(10_000, 10 * parts)).alias("q")).first()["q"]} if grid and n else ())
    d = docs.withColumn("_bucket", _bucket([int(c) for c in cuts if c is not None]))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first()]
    w = W.partitionBy("_bucket").orderBy(*order)
    out = d.withColumns({f"next_{c}": F.lead(c).over(w) for c in columns} | {"_last": F.lead(F.lit(1)).over(w).isNull()})
    # the first row of each range: its least doc_id, and among repeated ids the least text
    least = d.groupBy("_bucket").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("m")).select("_bucket", "m.doc_id")
    ring = W.orderBy("_bucket")  # at most MAX_BUCKETS rows, so the table may be broadcast as well
    least = least.withColumn("_before", F.coalesce(F.lag("_bucket").over(ring), F.max("_bucket").over(W.partitionBy())))
    least = least.withColumnRenamed("doc_id", "_id").withColumnRenamed("_bucket", "_b")
    first = d.join(F.broadcast(least), (d["_bucket"] == least["_b"]) & d["doc_id"].eqNullSafe(least["_id"]))
    first = first.groupBy("_before").agg(F.min(F.struct("text", *[c for c in columns if c != "text"])).alias("f"))
    first = first.select(F.col("_before").alias("_bucket"), *[F.col(f"f.{c}").alias(f"_first_{c}") for c in columns])
    out = out.join(first, "_bucket", "left")
    return out.withColumns({f"next_{c}": F.when(F.col("_last"), F.col(f"_first_{c}")).otherwise(F.col(f"next_{c}")) for c in columns}) \
        .select(*docs.columns, *[f"next_{c}" for c in columns])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, text, edited, sketch, edited_sketch, next_sketch) per row of ``docs(doc_id, text, ...)``.

    NULL texts count as empty.  ``edited`` is the text with its last quarter of code points (rounded down) replaced
    by as many of the next row's first ones.  Rows with a NULL doc_id come first, repeated ids in the order of their texts; a
    single row follows itself.  Other columns, clashing names included, are not read.
    """
    d = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    d = with_next(d.withColumn("sketch", sketch_of(word_hashes(F.col("text")))), ["text", "sketch"])
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut), F.substring(F.col("next_text"), F.lit(1), cut))
    d = d.select("doc_id", n.cast("bigint").alias("n_chars"), "text", edited.alias("edited"), "sketch", "next_sketch")
    return d.withColumn("edited_sketch", sketch_of(word_hashes(F.col("edited"))))
