"""From raw documents to encoded training documents: every stage is written as Parquet and read again as the next one's input."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from atlas_spark.llm import bpe, decontaminate, jaccard_join, line_dedup, quality
from atlas_spark.llm.queries import KEEP, RANKS, quality_model, table, work_folder
from atlas_spark.llm.text import fresh


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores KEEP or more."""
    [score] = fresh(docs, "score")
    return quality.scored(docs, quality_model(spark, sf_dir), score).filter(F.col(score) >= KEEP).select(*docs.columns)


def drop_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; a document of nothing else stays, with an empty text."""
    lines, dropped = fresh(docs, "n_lines", "n_dropped")
    d = line_dedup.line_dedup(docs, "source", counts=(lines, dropped))
    if "n_chars" in docs.columns:
        d = d.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text").cast("bigint")).otherwise(F.col("n_chars")))
    return d.select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the least doc_id; rows without an id stay."""
    found = jaccard_join.jaccard_join(docs.select("doc_id", "text"))
    least = found.filter("doc_id = component_id").select("doc_id").distinct()
    [key] = fresh(docs, "key")
    kept = docs.join(least, "doc_id", "left_semi").withColumn(key, F.md5(F.encode("text", "utf-8"))).dropDuplicates(["doc_id", key]).drop(key)
    return kept.select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their token ids, decoded again as a check."""
    return bpe.bpe(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN, ids=True)


STAGES = [("quality_classifier", quality_classifier), ("line_dedup", drop_boilerplate), ("jaccard_join", near_duplicates),
          ("decontamination", decontaminated), ("bpe", encoded)]

#: SQL has no form for the classifier, the latent search and the merges; tests hold the stages against plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = work_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return docs
