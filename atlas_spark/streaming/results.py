"""Incremental intake of field-of-view results with Structured Streaming."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

EVENT_SCHEMA = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


def result_stream(spark: SparkSession, folder: str, schema: str = EVENT_SCHEMA, files_per_trigger: int = 100, glob: str | None = None) -> DataFrame:
    """New result files as (fov_id, kind, ts, value)."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger)
    if glob:
        r = r.option("pathGlobFilter", glob)
    ev = r.parquet(folder)
    return ev.select(F.floor(F.col("event_id") / 5).cast("bigint").alias("fov_id"), F.col("event_type").alias("kind"), F.col("ts").cast("timestamp").alias("ts"), "value")


def first_results(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """First result per field and kind; state is dropped once the watermark has passed."""
    return stream.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["fov_id", "kind"])


def window_counts(stream: DataFrame, length: str = "7 days", slide: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Results per kind in sliding windows."""
    s = stream.withWatermark("ts", delay)
    return s.groupBy(F.window("ts", length, slide).alias("w"), "kind").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "kind", "n")


def run_available(df: DataFrame, sink: str, checkpoint: str, mode: str = "append"):
    """Process everything that has arrived, write parquet, stop."""
    q = df.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def upsert_batches(stream: DataFrame, table: str, checkpoint: str, keys: list[str]):
    """Append each micro-batch under its number; the newest batch of a key holds its value.

    A batch writes only its own rows, and a repeated batch overwrites its own folder.
    """
    def apply(batch: DataFrame, epoch: int) -> None:
        latest_rows(batch, keys).write.mode("overwrite").parquet(os.path.join(table, f"epoch={epoch}"))

    q = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def latest_rows(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Largest row per key; columns are compared in order, so the first one should be the time."""
    return rows.groupBy(*keys).agg(F.max(F.struct(*[c for c in rows.columns if c not in keys])).alias("r")).select(*keys, "r.*")


def read_table(spark: SparkSession, table: str, keys: list[str]) -> DataFrame:
    """Current rows of an upserted table."""
    rows = spark.read.parquet(table)
    newest = latest_rows(rows.select("epoch", *[c for c in rows.columns if c != "epoch"]), keys)
    return newest.drop("epoch")


def compact(spark: SparkSession, table: str, target: str, keys: list[str]) -> None:
    """Write the current rows as a new table, for when many batches have gathered."""
    read_table(spark, table, keys).write.mode("overwrite").parquet(os.path.join(target, "epoch=-1"))
