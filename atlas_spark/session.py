"""Session settings shared by the bench, the tests and command-line use."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, shuffle_partitions: int | None = None) -> SparkSession:
    """Session with adaptive execution; on a cluster leave both arguments unset."""
    b = (SparkSession.builder.appName("atlas_spark")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if master:
        b = (b.master(master).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", os.environ.get("ATLAS_DRIVER_MEMORY", "6g")))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, which every executor can reach; empty where none is set."""
    sc = spark.sparkContext
    return (spark.conf.get("spark.checkpoint.dir", "") or sc.getConf().get("spark.checkpoint.dir", "") or sc.getCheckpointDir() or "")


def own_folder(master: str, prefix: str) -> str:
    """Temporary folder of this machine, which only a local master's tasks can all reach."""
    if not re.match(r"local(\[|$)", master):
        raise RuntimeError(f"set spark.checkpoint.dir to a folder that all executors of {master} share")
    return tempfile.mkdtemp(prefix=prefix)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's folder; choose a temporary one only where none is set and the master is local."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark) or own_folder(spark.sparkContext.master, "atlas-checkpoint-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name below the one that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: survives the loss of executors and truncates the plan of a loop."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)
