"""Replicated intensity tables in long form: filters, replicates, imputation, normalisation, QC."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import cols as C, keyed
from ..session import cut_lineage
from .ranking import grouped_quantiles
from .relational import contains_join, few_keys

CELL = ["prey", "bait", "replicate"]


def sparse_matrix(df: DataFrame, row: str, column: str, value: str, columns: list[str]) -> DataFrame:
    """row x column matrix with the largest value per cell and 0 where there is none."""
    return df.groupBy(row).pivot(column, columns).agg(F.max(value)).na.fill(0)


def transform_intensities(df: DataFrame, func=C.log2_or_null, value: str = "value") -> DataFrame:
    """Apply a Column function; infinite results become NULL."""
    v = func(F.col(value))
    return df.withColumn(value, F.when(F.abs(v) < float("inf"), v))


def dedupe_sample_max(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    return df.groupBy(*keys).agg(F.max(value).alias(value))


def filter_valids(df: DataFrame) -> DataFrame:
    """Preys for which at least one bait has a value in every replicate."""
    per_bait = df.groupBy("prey", "bait").agg(F.bool_and(F.col("value").isNotNull()).alias("full"))
    return df.join(per_bait.filter("full").select("prey").distinct(), "prey", "left_semi")


def all_valids(df: DataFrame) -> DataFrame:
    """Preys with some value in every bait of the table."""
    seen = df.filter("value is not null").groupBy("prey").agg(F.count_distinct("bait").alias("n"))
    baits = df.agg(F.count_distinct("bait").alias("n"))
    return df.join(seen.join(F.broadcast(baits), "n").select("prey"), "prey", "left_semi")


def median_replicates(df: DataFrame, mean: bool = False) -> DataFrame:
    """One value per (prey, bait); a cell has one row per replicate, so the group is small by design."""
    f = F.avg if mean else F.median
    return df.groupBy("prey", "bait").agg(f("value").alias("value"))


def consolidate_groups(values: DataFrame, mapping: DataFrame, info: str = "info") -> DataFrame:
    """Synonym ids to their primary id where the map is unambiguous; sums per primary id and sample."""
    clear = mapping.groupBy("protein_id").agg(F.count("*").alias("n"), F.min("primary_id").alias("primary_id")).filter("n = 1").drop("n")
    named = values.join(clear, "protein_id", "left").withColumn("primary_id", F.coalesce("primary_id", "protein_id"))
    return named.groupBy("primary_id", "sample").agg(
        F.min_by(info, F.when(F.col(info).isNotNull(), F.col("protein_id"))).alias(info),
        F.nullif(F.sum("value"), F.lit(0.0)).alias("value"))


def combine_transformed(a: DataFrame, b: DataFrame, key: str, info: str, join: str = "full") -> DataFrame:
    """Two quantified tables on the protein id; info of the first wins."""
    other = b.withColumnRenamed(info, "_info_b")
    return a.join(other, key, join).withColumn(info, F.coalesce(info, "_info_b")).drop("_info_b")


def impute_bait(df: DataFrame, distance: float = 1.8, width: float = 0.3, digits: int = 4) -> DataFrame:
    """NULLs drawn from N(mean - distance*sd, width*sd) of their bait; observed values rounded."""
    return _impute(df, "bait", distance, width, digits, None)


def impute_prey(df: DataFrame, distance: float = 0.0, width: float = 0.3, digits: int = 4, threshold: int = 100) -> DataFrame:
    """The same by prey; preys with more than ``threshold`` observed values stay as they are."""
    return _impute(df, "prey", distance, width, digits, threshold)


def _impute(df, key, distance, width, digits, threshold):
    stats = df.groupBy(key).agg(F.avg("value").alias("_m"), F.stddev_samp("value").alias("_s"), F.count("value").alias("_n"))
    draw = F.col("_m") - distance * F.col("_s") + width * F.col("_s") * keyed.normal(*CELL)
    filled = F.when(F.col("value").isNull(), draw).otherwise(F.round("value", digits))
    missing = F.col("value").isNull()
    if threshold is not None:
        keep = F.col("_n") > threshold
        filled, missing = F.when(keep, F.col("value")).otherwise(filled), missing & ~keep
    return df.join(stats, key).select(*CELL, filled.alias("value"), missing.alias("is_imputed"))


def imputed_flags(df: DataFrame) -> DataFrame:
    """(prey, bait) pairs whose every replicate was imputed."""
    return df.groupBy("prey", "bait").agg(F.bool_and("is_imputed").alias("all_imputed"))


def median_normalize(df: DataFrame, by: list[str]) -> DataFrame:
    """Subtract the median of the sample (bait, replicate) or of the prey."""
    med = grouped_quantiles(df, by, "value", {"_median": 0.5})
    return df.join(med, by).withColumn("value", F.col("value") - F.col("_median")).drop("_median")


def subtract_prey_median(df: DataFrame, factor: float = 1.0) -> DataFrame:
    """Centre on the prey median, then zero what is within factor x mean absolute deviation."""
    med = grouped_quantiles(df, ["prey"], "value", {"_median": 0.5})
    centred = df.join(med, "prey").withColumn("value", F.col("value") - F.col("_median")).drop("_median")
    mean = centred.groupBy("prey").agg(F.avg("value").alias("_m"))
    dev = centred.join(mean, "prey").groupBy("prey").agg(F.avg(F.abs(F.col("value") - F.col("_m"))).alias("_mad"))
    return (centred.join(dev, "prey")
            .withColumn("value", F.when(F.col("value") > factor * F.col("_mad"), F.col("value")).otherwise(0.0)).drop("_mad"))


def standard_scale(df: DataFrame, by: list[str], value: str = "value", clip: float | None = None) -> DataFrame:
    """z-score with the population standard deviation; a constant column becomes 0."""
    s = df.groupBy(*by).agg(F.avg(value).alias("_m"), F.stddev_pop(value).alias("_s"))
    z = (F.col(value) - F.col("_m")) / F.when(F.col("_s") > 0, F.col("_s")).otherwise(1.0)
    if clip is not None:
        z = F.least(z, F.lit(clip))
    return df.join(s, by).withColumn(value, z).drop("_m", "_s")


def total_intensity_norm(df: DataFrame, sample: str = "sample", mode: str = "multiply") -> DataFrame:
    """Scale each sample by its total over the smallest total."""
    totals = df.groupBy(sample).agg(F.sum("value").alias("_t"))
    least = totals.agg(F.min("_t").alias("_least"))
    factor = totals.join(F.broadcast(least), F.lit(True)).select(sample, (F.col("_t") / F.col("_least")).alias("_f"))
    v = F.col("value") * F.col("_f") if mode == "multiply" else F.col("value") / F.col("_f")
    return df.join(factor, sample).withColumn("value", v).drop("_f")


def yield_norm(df: DataFrame, yields: DataFrame, sample: str = "sample") -> DataFrame:
    return df.join(yields, sample).withColumn("value", F.col("value") * F.col("yield")).drop("yield")


def penalty_factor(bait_medians: DataFrame, control: DataFrame, scores: DataFrame) -> DataFrame:
    """Enrichment times (r / median r)^2, r the correlation of a bait with the control medians."""
    neg = grouped_quantiles(control, ["prey"], "value", {"neg": 0.5})
    r = bait_medians.join(neg, "prey").groupBy("bait").agg(F.corr("value", "neg").alias("r"))
    mid = r.agg(F.median("r").alias("r_median"))  # one r per bait
    f = r.join(F.broadcast(mid), F.lit(True)).select("bait", F.pow(F.try_divide("r", "r_median"), 2).alias("penalty"))
    return scores.join(f, "bait").withColumn("enrichment", F.col("enrichment") * F.col("penalty"))


# --- quality control -------------------------------------------------------------------------

def sum_intensity_qc(df: DataFrame, cv_cut: float = 0.05, corr_cut: float = 0.65) -> DataFrame:
    """Per bait: CV of replicate totals, smallest correlation between two replicates, and both flags."""
    totals = df.groupBy("bait", "replicate").agg(F.sum("value").alias("total"))
    cv = totals.groupBy("bait").agg(F.try_divide(F.stddev_samp("total"), F.avg("total")).alias("cv"))
    one = df.filter("value is not null").select("prey", "bait", "replicate", "value")
    # pairs arise inside one (prey, bait) cell, which holds one row per replicate
    cells = one.groupBy("prey", "bait").agg(F.collect_list(F.struct("replicate", "value")).alias("reps"))
    a = cells.select("prey", "bait", "reps", F.explode("reps").alias("a"))
    pairs = a.select("bait", "a", F.explode(F.filter("reps", lambda b: b["replicate"] > F.col("a.replicate"))).alias("b"))
    corr = pairs.groupBy("bait", "a.replicate", F.col("b.replicate").alias("other")).agg(F.corr("a.value", "b.value").alias("r"))
    low = corr.groupBy("bait").agg(F.min("r").alias("min_corr"))
    return cv.join(low, "bait", "full").select(
        "bait", "cv", "min_corr", (F.col("cv") > cv_cut).alias("high_cv"), (F.col("min_corr") < corr_cut).alias("low_corr"))


def target_fraction(df: DataFrame, targets: list[str]) -> DataFrame:
    """Percent of a sample's total in each curated prey and its log2 intensity.

    A prey that is absent or 0 counts as 0.001 percent and as log2(1024).
    """
    totals = df.groupBy("bait", "replicate").agg(F.sum("value").alias("total"))
    grid = totals.withColumn("prey", F.explode(F.array(*[F.lit(x) for x in targets])))
    got = df.filter(F.col("prey").isin(targets)).groupBy("bait", "replicate", "prey").agg(F.sum("value").alias("v"))
    v = F.coalesce("v", F.lit(0.0))
    return grid.join(got, ["bait", "replicate", "prey"], "left").select(
        "bait", "replicate", "prey", F.when(v == 0, 0.001).otherwise(100 * F.try_divide(v, F.col("total"))).alias("percent"),
        F.when(v == 0, 10.0).otherwise(F.log2(v)).alias("log2_intensity"))


def bait_match(df: DataFrame, names: DataFrame) -> DataFrame:
    """Per sample the largest intensity of the prey named like the bait; where no prey has the name,
    the intensity of the first ';' list of names that contains it.

    ``names``: (prey, gene_names); ``df``: (bait_gene, replicate, prey, value).  The rows of the chosen preys are taken first: where ``df``
    is itself a total per bait, replicate and prey, no others are added up.
    """
    genes = cut_lineage(df.select("bait_gene").distinct())
    exact = names.select(F.col("gene_names").alias("bait_gene"), "prey").join(genes, "bait_gene", "left_semi")
    rest = genes.join(exact.select("bait_gene").distinct(), "bait_gene", "left_anti")
    lists = contains_join(names.filter(F.col("gene_names").contains(";")), "gene_names", rest, "bait_gene")
    listed = lists.groupBy("bait_gene").agg(F.min_by("prey", F.struct("gene_names", "prey")).alias("prey"))
    chosen = cut_lineage(exact.withColumn("exact", F.lit(True)).unionByName(listed.withColumn("exact", F.lit(False))))
    own = df.join(few_keys(chosen.select("bait_gene", "prey").distinct()), ["bait_gene", "prey"], "left_semi")
    return own.join(chosen, ["bait_gene", "prey"]).groupBy("bait_gene", "replicate").agg(
        F.max("value").alias("intensity"), F.bool_and("exact").alias("exact"))


def unmatched_baits(df: DataFrame, matched: DataFrame) -> DataFrame:
    return df.select("bait_gene").distinct().join(matched, "bait_gene", "left_anti")


def identification_summary(peptides: DataFrame, proteins: DataFrame, sample: str = "sample") -> DataFrame:
    a = peptides.groupBy(sample).agg(F.count("value").alias("n_peptides"))
    b = proteins.groupBy(sample).agg(F.count_if(F.col("value") != 0).alias("n_proteins"))
    return a.join(b, sample, "full").select(sample, F.coalesce("n_peptides", F.lit(0)).alias("n_peptides"),
                                            F.coalesce("n_proteins", F.lit(0)).alias("n_proteins"))


def pulldown_summary(df: DataFrame, matched: DataFrame) -> DataFrame:
    """log2 total intensity, bait intensity and the 4-character experiment prefix per sample."""
    total = df.groupBy("bait_gene", "replicate").agg(F.log2(F.sum("value")).alias("log2_total"))
    return total.join(matched, ["bait_gene", "replicate"], "left").select(
        "bait_gene", "replicate", F.substring("bait_gene", 1, 4).alias("experiment"), "log2_total",
        F.col("intensity").alias("bait_intensity"))
