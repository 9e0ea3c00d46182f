"""Lines that are boilerplate of their site: site-relative page frequency."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .text import fresh

RATIO = 0.08
NEWLINE = "\n"


def _lines(text: str) -> Column:
    return F.split(F.col(text), NEWLINE, -1)


def boilerplate(docs: DataFrame, host: str, text: str = "text", ratio: float = RATIO) -> DataFrame:
    """(host, lines): the keys of each host's boilerplate lines.

    One page of those that hold a line has it for itself; the line is boilerplate if the others are more than ``ratio`` of the
    host's pages.  So a line on one page alone never is, two pages are enough up to 12 of them, and on a large host the page left out does not count.

    Pages that hold a line are counted per (host, line) with partial sums, so neither a large host nor a common line
    meets in one task.  At most (mean lines per page) / ratio lines can pass, so a host's array stays short.
    """
    key = F.md5(F.encode("line", "utf-8"))
    page = docs.select(F.col(host).alias("host"), F.explode(F.array_distinct(_lines(text))).alias("line")).filter("line <> ''")
    held = page.groupBy("host", key.alias("line")).agg(F.count("*").alias("holding"))
    pages = docs.groupBy(F.col(host).alias("host")).agg(F.count("*").alias("pages"))
    often = held.filter("holding > 1").join(pages.withColumnRenamed("host", "h"), F.col("host").eqNullSafe(F.col("h")))
    return often.filter(F.col("holding") - 1 > F.lit(ratio) * F.col("pages")).groupBy("host").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def line_dedup(docs: DataFrame, host: str, text: str = "text", ratio: float = RATIO, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``, and the columns ``counts``: its lines and how many were dropped.

    A line is dropped from every page of a host where over ``ratio`` of the host's pages and one page more
    hold it (a page counts once however often it repeats the line).  Lines are compared whole; blank ones stay.
    A NULL text stays NULL with 0 lines; an empty text has one empty line; rows with a NULL host form one site.
    Repeated rows are pages of their own.  Texts do not move when the lists are small; other columns pass through,
    but for columns named like ``counts``, which are replaced.
    """
    site, boiler, every, kept = fresh(docs, "host", "boiler", "all", "kept")
    lists = boilerplate(docs, host, text, ratio).select(F.col("host").alias(site), F.col("lines").alias(boiler))
    d = docs.join(lists, F.col(host).eqNullSafe(F.col(site)), "left").withColumn(every, _lines(text))
    d = d.withColumn(kept, F.when(F.col(boiler).isNull(), F.col(every)).otherwise(
        F.filter(every, lambda x: (x == "") | ~F.array_contains(boiler, F.md5(F.encode(x, "utf-8"))))))
    size = F.when(F.col(text).isNull(), 0).otherwise(F.size(every)).cast("bigint")
    dropped = F.when(F.col(text).isNull(), 0).otherwise(F.size(every) - F.size(kept)).cast("bigint")
    taken = {c.lower() for c in counts}
    rest = [F.array_join(kept, NEWLINE).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken]
    return d.select(*rest, size.alias(counts[0]), dropped.alias(counts[1]))
