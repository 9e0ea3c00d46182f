"""Sinks: edge files, versioned result tables, the interaction table download."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import cols as C
from ..session import own_folder, shared_dir


def scratch_path(spark: SparkSession) -> str:
    """New folder for intermediate files: in the cluster's shared folder when one is set."""
    return os.path.join(shared_dir(spark) or own_folder(spark.sparkContext.master, "atlas-"), f"files-{uuid.uuid4().hex}")


def edge_lines(edges: DataFrame, target: str = "target", prey: str = "prey") -> DataFrame:
    return edges.select(F.lit("EDGE").alias("edge"), F.col(target), F.col(prey))


def write_edg(edges: DataFrame, path: str, target: str = "target", prey: str = "prey") -> None:
    """Tab file 'EDGE target prey' without header."""
    edge_lines(edges, target, prey).write.mode("overwrite").csv(path, sep="\t", header=False)


def write_results(df: DataFrame, path: str, fdr_level: str, version: str) -> None:
    """One dynamic-overwritten partition per version and level; other partitions stay as they are."""
    (df.withColumn("version", F.lit(version)).withColumn("fdr_level", F.lit(fdr_level))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("version", "fdr_level").parquet(path))


def interaction_table(nodes: DataFrame) -> DataFrame:
    """Download form of network nodes (pulldown_id, type, gene_name, bait_name, scores, cluster ids)."""
    def text(c):
        return F.coalesce(F.col(c).cast("string"), F.lit("None"))
    bait_first = F.col("type").isin("hit", "bait")
    return nodes.select(
        "pulldown_id",
        F.when(bait_first, F.col("bait_name")).otherwise(F.col("gene_name")).alias("bait_gene_name"),
        F.when(F.col("type") == "hit", F.col("gene_name")).otherwise(F.col("bait_name")).alias("prey_gene_name"),
        F.round("pval", 2).alias("pval_minus_log10"), F.round("enrichment", 2).alias("relative_enrichment"),
        F.round(C.log10_or_null("abundance_stoich"), 2).alias("abundance_stoich_log10"),
        F.round(C.log10_or_null("interaction_stoich"), 2).alias("interaction_stoich_log10"),
        text("cluster_id").alias("cluster_id"), text("subcluster_id").alias("core_complex_id"))
