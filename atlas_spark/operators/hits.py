"""Hits and scores: selection, weights, summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import keyed
from .relational import contains_join, fallback_join, member_join


def displayed(flag: Column | str) -> Column:
    """NULL counts as displayed."""
    return F.coalesce(F.col(flag) if isinstance(flag, str) else flag, F.lit(True))


def significant_hits(hits: DataFrame, group_ids: DataFrame | None = None) -> DataFrame:
    out = hits.filter(F.col("is_significant") | F.col("is_minor"))
    return out.join(group_ids, "group_id", "left_semi") if group_ids is not None else out


def hit_class(hits: Column, minor: Column) -> Column:
    return F.when(hits, "significant").when(minor, "minor").otherwise("none")


def nonsignificant_compact(hits: DataFrame) -> DataFrame:
    other = ~(F.coalesce("is_significant", F.lit(False)) | F.coalesce("is_minor", F.lit(False)))
    return hits.filter(other).select("pulldown_id", F.round("pval", 3).alias("pval"), F.round("enrichment", 3).alias("enrichment"))


def nonsig_downsample(points: DataFrame, key: list[str], keep_above: float = 3.0, share: float = 0.5) -> DataFrame:
    """All points above the cut, and a share of the others chosen by their key."""
    return points.filter((F.col("pval") > keep_above) | (keyed.uniform(*key) < share))


def drop_unchosen(hits: DataFrame, chosen: DataFrame) -> DataFrame:
    """Targets with chosen plates lose the rows of their other plates."""
    picked = chosen.select("target", F.col("pick").alias("plate")).distinct()
    return (hits.join(picked, ["target", "plate"], "left_semi")
            .unionByName(hits.join(picked, "target", "left_anti")))


def circle_weight(abundance: Column, interaction: Column, major: float = 0.2) -> Column:
    """10 in the major stoichiometry circle, 4 in the ring between 0.05 and 0.2, else 0.2."""
    near = (abundance > 0.1) & (abundance < 10)
    inner = F.when(near & (interaction > major), 10.0).otherwise(0.0)
    ring = F.when(near & (interaction > 0.05) & (interaction < 0.2), 4.0).otherwise(0.0)
    return F.when(inner + ring == 0, 0.2).otherwise(inner + ring)


def hit_weight(x: Column) -> Column:
    """0.2 for infinite or tiny values, 2.2 for others."""
    return F.when((x == float("inf")) | (x < 0.01), 0.2).when(x > 0, 2.2)


def prep_cluster_edges(hits: DataFrame, metric: str, weigh: bool = True) -> DataFrame:
    """Strip the plate from the target, weigh the metric, drop zeros, keep the largest per pair."""
    m = hit_weight(F.col(metric)) if weigh else F.col(metric)
    e = hits.select(F.split("target", "_")[1].alias("target"), "prey", m.alias(metric))
    return e.filter(F.coalesce(F.col(metric) != 0, F.lit(True))).groupBy("target", "prey").agg(F.max(metric).alias(metric))


def interaction_summary(hits: DataFrame) -> DataFrame:
    """Per target: hits, whether it finds itself, how often it is a prey elsewhere."""
    h = hits.select("target", "prey")
    per = h.groupBy("target").agg(
        F.count("prey").alias("hit_count"),
        F.max(F.when(F.array_contains(F.split("prey", ";"), F.col("target")), 1).otherwise(0)).alias("target_match"))
    # a prey list counts once per row, however often it repeats a name
    seen = h.select(F.explode(F.array_distinct(F.split("prey", ";"))).alias("target")).groupBy("target").agg(F.count("*").alias("preys"))
    out = per.join(seen, "target", "left").withColumn("preys", F.coalesce("preys", F.lit(0)))
    return out.select("target", "hit_count", "preys", "target_match",
                      (F.col("hit_count") - F.col("target_match")).alias("subtracted_hits"),
                      (F.col("preys") - F.col("target_match")).alias("subtracted_preys"))


def hits_within_bait_names(hits: DataFrame, baits: DataFrame) -> DataFrame:
    """(hit gene, bait) where the gene's text occurs in the bait's name."""
    return contains_join(baits, "bait", hits, "gene").select("gene", "bait").distinct()


def bait_group_lookup(baits: DataFrame, exact: DataFrame, by_name: DataFrame, preys: DataFrame) -> DataFrame:
    """protein ids of a bait: (plate, target) lookup, else a gene-name list, else a prey gene list."""
    listed = member_join(by_name, "gene_names", baits.select("target").distinct(), "target")
    prey = member_join(preys, "gene_names", baits.select("target").distinct(), "target")
    by_target = fallback_join(baits.select("target").distinct(), ["target"], [listed, prey], "group_id") \
        .withColumnRenamed("group_id", "_by_target")
    return (fallback_join(baits, ["plate", "target"], [exact], "group_id")
            .join(by_target, "target", "left")
            .withColumn("group_id", F.coalesce("group_id", "_by_target")).drop("_by_target"))
