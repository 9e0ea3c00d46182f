"""Stoichiometry of interactions and fractionation-based localisation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import cols as C
from .quant import median_replicates

# The fractions of a fractionation run and the classes they fall in.
FRACTION_CLASS = {"01K": "nuclear", "Cyt": "cyto"}
REPLICATES = 6


def group_gene_map(groups: DataFrame, metadata: DataFrame) -> DataFrame:
    """(group_id, ensg_id, uniprot_id): first entry per pair after stripping isoforms."""
    ids = groups.select("group_id", F.explode(F.split("uniprot_ids", ";")).alias("u")).select("group_id", C.strip_isoform("u").alias("uniprot_id")).distinct()
    return ids.join(metadata.select("uniprot_id", "ensg_id"), "uniprot_id").filter("ensg_id is not null") \
              .groupBy("group_id", "ensg_id").agg(F.min("uniprot_id").alias("uniprot_id"))


def theoretical_peptides(groups: DataFrame, sequences: DataFrame, cut: str = "K", ids: str = "uniprot_ids") -> DataFrame:
    """(group_id, n_peptides): median over the group's ids of the number of digestible fragments."""
    n = sequences.groupBy("protein_id").agg(F.count("*").alias("_n"), F.max(C.peptide_count("sequence", cut)).alias("peptides")).filter("_n = 1")
    members = groups.select("group_id", F.explode(F.split(ids, ";")).alias("protein_id"))
    return members.join(n, "protein_id").groupBy("group_id").agg(F.median("peptides").alias("n_peptides"))


def absolute_intensity(medians: DataFrame, peptides: DataFrame) -> DataFrame:
    """2^median over the theoretical number of peptides."""
    n = F.when(F.col("n_peptides") > 0, F.col("n_peptides"))
    return medians.join(peptides, "group_id", "left").withColumn("absolute", C.exp2("value") / n).drop("n_peptides")


def interaction_stoichiometry(absolute: DataFrame, bait_groups: DataFrame) -> DataFrame:
    """Each intensity over the largest one of the bait's own groups; unresolved baits are left out."""
    own = absolute.join(bait_groups, ["bait", "group_id"]).groupBy("bait").agg(F.max("absolute").alias("_own"))
    return absolute.join(own.filter("_own is not null"), "bait").withColumn("interaction_stoi", F.try_divide("absolute", "_own")).drop("_own")


def abundance_by_gene(abundance: DataFrame, group_genes: DataFrame) -> DataFrame:
    """(group_id, abundance): whole-cell abundance summed per ensg id, then per group."""
    per = abundance.groupBy("ensg_id").agg(F.sum("abundance").alias("abundance"))
    got = group_genes.select("group_id", "ensg_id").distinct().join(per, "ensg_id", "left")
    return got.groupBy("group_id").agg(F.sum("abundance").alias("abundance"))


def abundance_by_name(abundance: DataFrame, groups: DataFrame) -> DataFrame:
    """By gene name: a ';' list sums the members that are found; groups with none are left out."""
    per = abundance.groupBy("gene").agg(F.sum("abundance").alias("abundance"))
    names = groups.select("group_id", F.explode(F.array_distinct(F.split("gene_names", ";"))).alias("gene"))
    return names.join(per, "gene").groupBy("group_id").agg(F.sum("abundance").alias("abundance"))


def stoichiometry_table(scores: DataFrame, absolute: DataFrame, bait_groups: DataFrame, group_abundance: DataFrame) -> DataFrame:
    """Scores with the interaction and abundance ratios of each bait-prey pair."""
    inter = interaction_stoichiometry(absolute, bait_groups).select("bait", "group_id", "interaction_stoi")
    own = bait_groups.join(group_abundance, "group_id").groupBy("bait").agg(F.max("abundance").alias("_own"))
    return (scores.join(inter, ["bait", "group_id"], "left").join(group_abundance, "group_id", "left").join(own, "bait", "left")
            .withColumn("abundance_stoi", F.try_divide("abundance", "_own")).drop("abundance", "_own"))


def relative_abundance(scores: DataFrame) -> DataFrame:
    """Abundance over the target's own abundance, per target."""
    own = scores.filter("target = prey").groupBy("target").agg(F.max("abundance").alias("_own"))
    return scores.join(own, "target").withColumn("relative_abundance", F.try_divide("abundance", "_own")).drop("_own")


# --- fractionation -------------------------------------------------------------------------------

def to_noc(df: DataFrame) -> DataFrame:
    """(prey, replicate, compartment, value): nuclear, cytosolic and the sum of all other fractions."""
    kind = reduce(lambda acc, kv: F.when(F.col("fraction") == kv[0], kv[1]).otherwise(acc), FRACTION_CLASS.items(), F.lit("organellar"))
    return df.groupBy("prey", "replicate", kind.alias("compartment")).agg(F.sum("value").alias("value"))


def fraction_proportion(df: DataFrame, part: str = "compartment") -> DataFrame:
    """Value over the replicate's total; 0 where the total is 0."""
    total = df.groupBy("prey", "replicate").agg(F.sum("value").alias("_t"))
    return df.join(total, ["prey", "replicate"]).select("prey", "replicate", part, F.coalesce(F.try_divide("value", "_t"), F.lit(0.0)).alias("value"))


def consistent_median(df: DataFrame, parts: list[str], part: str = "compartment", r_cut: float = 0.9, others: int = 3) -> DataFrame:
    """Element-wise median over replicates that agree (r > r_cut) with at least ``others`` further ones.

    A prey has one short vector per replicate, so its replicates are compared inside one row.
    """
    vec = df.groupBy("prey", "replicate").agg(*[F.coalesce(F.max(F.when(F.col(part) == p, F.col("value"))), F.lit(0.0)).alias(p) for p in parts])
    # centred and scaled to length 1 while still flat columns: a correlation is then one short dot product
    n = float(len(parts))
    vec = vec.withColumn("_m", sum((F.col(p) for p in parts[1:]), F.col(parts[0])) / n)
    length = F.sqrt(sum((F.pow(F.col(p) - F.col("_m"), 2) for p in parts), F.lit(0.0)))
    vec = vec.withColumn("_l", F.when(length > 0, length))
    unit = F.array(*[(F.col(p) - F.col("_m")) / F.col("_l") for p in parts])
    one = vec.groupBy("prey").agg(F.collect_list(F.struct(F.array(*parts).alias("x"), unit.alias("z"))).alias("reps"))

    def corr(a, b):
        return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)

    agree = F.transform("reps", lambda a: F.size(F.filter("reps", lambda b: F.coalesce(F.round(corr(a["z"], b["z"]), 12) > r_cut, F.lit(False)))) - 1)
    kept = one.withColumn("_a", agree).withColumn("kept", F.filter("reps", lambda _, i: F.get("_a", i) >= others))
    def med(k):
        s = F.array_sort(F.transform("kept", lambda v: v["x"][k]))
        m = F.size(s)
        mid = (F.element_at(s, F.floor((m + 1) / 2).cast("int")) + F.element_at(s, F.ceil((m + 1) / 2).cast("int"))) / 2
        return F.when(F.size("kept") > 0, mid).otherwise(0.0)
    return kept.select("prey", F.size("kept").alias("quality"), *[med(k).alias(p) for k, p in enumerate(parts)])


def classify_noc(df: DataFrame) -> DataFrame:
    """Localisation label; the rules are tried in order."""
    n, o, c = F.col("nuclear"), F.col("organellar"), F.col("cyto")
    label = (F.when(n >= 0.85, "N").when(c >= 0.85, "C").when((o > 0.3) & (c < 0.15), "O")
             .when((n < 0.4) & (o > 0.15) & (c > 0.15), "O/C").when((n > 0.15) & (o < 0.1) & (c >= 0.15), "N/C")
             .when(n + o + c == 0, "I").otherwise("B"))
    return df.withColumn("localization", label)


def compartment_label(labels: str):
    """nuc / cyt / org from an atlas label; org is what is neither and not empty."""
    s = F.lower(F.coalesce(F.col(labels), F.lit("")))
    return {"is_nuc": s.contains("nuc"), "is_cyt": s.contains("cyt"), "is_org": ~s.contains("nuc") & ~s.contains("cyt") & (s != "")}
