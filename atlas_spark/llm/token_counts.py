"""Token totals kept up by signed changes: a log of committed batches and the sums over it.

A change adds (sign +1) or takes away (sign -1) one document's count under one tokenizer version; a revised count
is the pair of both.  A batch is reduced to one row per (source, lang, version) and written to a folder
of its own; the marker that Spark's committer writes last makes it count, so a failed write counts for
nothing and a batch that is sent again is skipped.  Totals are plain sums, so order does not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

KEYS = ["source", "lang", "version"]
TOTALS = ["docs", "tokens"]
_SCHEMA = "source string, lang string, version string, docs bigint, tokens bigint"

Counter = Callable[[Column], Column]

#: tokenizer versions that plain expressions can count; any function of the text column may be added
COUNTERS: dict[str, Counter] = {
    "words-1": lambda t: F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]+")),
    "pieces-2": lambda t: F.regexp_count(t, F.lit(r"[A-Za-z]+|[0-9]+|[!-/:-@\[-`{-~]")),
}
#: a later count of the first version: words without a letter or digit are no tokens
REVISED: Counter = lambda t: F.regexp_count(t, F.lit(r"[^\x20\x09-\x0D]*[0-9A-Za-z][^\x20\x09-\x0D]*"))


def changes(docs: DataFrame, versions: Mapping[str, Counter], sign: int = 1) -> DataFrame:
    """One signed change per document and version; a NULL text has 0 tokens, NULL sources and languages are groups.

    Repeated rows are documents of their own; other columns than source, lang and text are not read.
    """
    d = docs.select("source", "lang", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    each = F.array(*[F.struct(F.lit(v).alias("version"), c(F.col("text")).cast("bigint").alias("n")) for v, c in versions.items()])
    d = d.select("source", "lang", F.explode(each).alias("e"))
    return d.select("source", "lang", "e.version", F.lit(sign).cast("bigint").alias("docs"), (F.lit(sign) * F.col("e.n")).alias("tokens"))


def counted(docs: DataFrame, counters: Mapping[str, Counter], *keep: str) -> DataFrame:
    """A narrow row per document, (kept columns, source, lang, counts by name): later batches read it instead of the text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    named = [x for name, c in counters.items() for x in (F.lit(name), c(text).cast("bigint"))]
    return docs.select(*keep, "source", "lang", F.create_map(*named).alias("counts"))


def signed(counts: DataFrame, steps: Sequence[tuple[str, str, int]]) -> DataFrame:
    """Changes out of ``counted`` rows: per (version, name of the count, sign) one signed change of each document."""
    each = F.array(*[F.struct(F.lit(v).alias("version"), F.lit(s).cast("bigint").alias("docs"), (s * F.col("counts")[name]).alias("tokens"))
                     for v, name, s in steps])
    return counts.select("source", "lang", F.explode(each).alias("e")).select("source", "lang", "e.version", "e.docs", "e.tokens")


def revisions(docs: DataFrame, version: str, old: Counter, new: Counter) -> DataFrame:
    """Signed pairs that replace each document's old count under ``version`` by its new one."""
    return changes(docs, {version: old}, -1).unionByName(changes(docs, {version: new}, 1))


def rollup(delta: DataFrame) -> DataFrame:
    return delta.groupBy(*KEYS).agg(*[F.sum(c).cast("bigint").alias(c) for c in TOTALS])


class Ledger:
    """Committed batches below one folder, in any file system that Spark can write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, batch: str) -> str:
        return f"{self.root}/batches/batch={quote(batch, safe='')}"

    def _exists(self, path: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def committed(self, batch: str) -> bool:
        return self._exists(self._path(batch) + "/_SUCCESS")

    def commit(self, batch: str, delta: DataFrame) -> bool:
        """Add a batch once; False where it had been committed before (its rows are not read again)."""
        if self.committed(batch):
            return False
        rollup(delta).write.mode("overwrite").option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true").parquet(self._path(batch))
        return True

    def batches(self) -> list[str]:
        """Paths of the committed batches; a folder without its marker is a failed write and is left out."""
        top = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/batches")
        fs = top.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(top):
            return []
        found = [s.getPath().toString() for s in fs.listStatus(top)]
        return sorted(p for p in found if self._exists(p + "/_SUCCESS"))

    def totals(self) -> DataFrame:
        """Live totals per (source, lang, version); groups whose documents have all gone are left out."""
        paths = self.batches()
        if not paths:
            return self.spark.createDataFrame([], _SCHEMA)
        return rollup(self.spark.read.schema(_SCHEMA).parquet(*paths)).filter("docs <> 0 or tokens <> 0")
