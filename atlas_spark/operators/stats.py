"""Scoring of bait-prey pairs against leave-out controls, hit thresholds and their validation.

The control of a bait is every other sample of the prey except those of excluded baits.  Nothing is
copied per bait: the control values are ranked once per prey, and the count, mean and squared
deviations of the few excluded baits are subtracted.  The control median, which cannot be subtracted,
is the value at the middle rank moved past the excluded ranks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import cols as C, keyed
from ..functions.pvalue import neglog10p
from ..session import cut_lineage
from .linalg import gram
from .quant import all_valids, median_replicates
from .ranking import HOT_ROWS, grouped_quantiles, grouped_ranks
from .relational import contains_join, top_n

PAIR = ["prey", "bait"]


def t_statistic(n1, m1, q1, n2, m2, q2) -> tuple[Column, Column]:
    """Pooled-variance t and its degrees of freedom from counts, means and squared deviations."""
    df = n1 + n2 - 2
    pooled = F.when((n1 > 0) & (n2 > 0) & (df > 0), (q1 + q2) / F.when(df > 0, df))
    se2 = pooled * (1 / F.when(n1 > 0, n1) + 1 / F.when(n2 > 0, n2))
    t = F.when(se2 > 0, (m1 - m2) / F.sqrt(F.when(se2 > 0, se2)))
    return t, F.when(pooled.isNotNull(), df)


def self_exclusion(values: DataFrame) -> DataFrame:
    b = values.select("bait").distinct()
    return b.select("bait", F.col("bait").alias("other"))


def sample_stats(values: DataFrame) -> DataFrame:
    """(prey, bait, n1, m1, q1, med1); the median is the mean of the middle rows, so that no aggregate holds a pair's values."""
    v = values.filter("value is not null").withColumn("value", F.col("value").cast("double"))
    w = W.partitionBy(*PAIR)
    v = v.withColumns({"_i": F.row_number().over(w.orderBy("value")), "_n": F.count("*").over(w)})
    k1, k2 = middle_ranks(F.col("_n"))
    return v.groupBy(*PAIR).agg(F.count("*").alias("n1"), F.avg("value").alias("m1"), (F.var_pop("value") * F.count("*")).alias("q1"),
                                F.avg(F.when((F.col("_i") == k1) | (F.col("_i") == k2), F.col("value"))).alias("med1"))


def ranked_control(control: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(prey, other, value, rank, all_n, c): the control values of each prey, numbered from 1 in their order, with their count and mean.

    A prey has one value per sample, so a window over a prey sorts as many rows as there are samples; where some prey
    has more than ``hot_rows`` of them, its values are ranked in pieces.
    """
    c = control.filter("value is not null").select("prey", F.col("bait").alias("other"), "replicate", F.col("value").cast("double").alias("value"))
    c = cut_lineage(c)
    totals = c.groupBy("prey").agg(F.count("*").alias("all_n"), F.avg("value").alias("c"))
    if totals.filter(F.col("all_n") > hot_rows).isEmpty():
        w = W.partitionBy("prey")
        ranks = c.select("prey", "other", "value", F.row_number().over(w.orderBy("value", "other", "replicate")).cast("bigint").alias("rank"),
                         F.count("*").over(w).alias("all_n"), F.avg("value").over(w).alias("c"))
    else:
        ranks = grouped_ranks(c, ["prey"], "value", ["other", "replicate"], hot_rows=hot_rows).drop("replicate").join(totals, "prey")
    return cut_lineage(ranks)


def middle_ranks(n: Column) -> tuple[Column, Column]:
    """Places of the two middle ones of n ordered values (the same one twice for an odd n)."""
    return F.floor((n + 1) / 2).cast("bigint"), F.ceil((n + 1) / 2).cast("bigint")


def removed_values(ranks: DataFrame, members: DataFrame | None, median: bool) -> DataFrame:
    """Per (prey, set_id) the count and sums about the prey mean of the values of the set's baits, and how far they shift
    the two middle ranks of what is left.

    The i-th removed value, at rank r, has r - i kept ones before it, so the k-th kept value stands at rank k plus the number
    of removed ones with r - i < k: a running number and a count, whatever the size of the set.  Without ``members`` every
    bait is the set of itself.
    """
    x = ranks.withColumn("set_id", F.col("other")) if members is None else ranks.join(members.select("set_id", "other"), "other")
    x = x.select("prey", "set_id", *(["rank", "all_n"] if median else []), (F.col("value") - F.col("c")).alias("d"))
    sums = [F.count("*").alias("n"), F.sum("d").alias("s"), F.sum(F.col("d") * F.col("d")).alias("ss")]
    if not median:
        return x.groupBy("prey", "set_id").agg(*sums)
    w = W.partitionBy("prey", "set_id")
    before = F.col("rank") - F.row_number().over(w.orderBy("rank"))
    x = x.withColumn("_before", before).withColumn("_left", F.col("all_n") - F.count("*").over(w))
    k1, k2 = middle_ranks(F.col("_left"))
    return x.groupBy("prey", "set_id").agg(*sums, F.count_if(F.col("_before") < k1).alias("shift1"), F.count_if(F.col("_before") < k2).alias("shift2"))


def leave_out_scores(values: DataFrame, control: DataFrame, exclusion: DataFrame | None, ddof: int = 1, mean: bool = False, scale: bool = True,
                     sets: DataFrame | None = None, samples: DataFrame | None = None) -> DataFrame:
    """(prey, bait, t, df, pvals, enrichment) of every sampled pair against its control.

    ``exclusion`` holds distinct (bait, other) pairs; None excludes the bait itself only.  ``samples`` may carry the ``sample_stats`` of the values.  Where baits share what they exclude, ``sets``
    assigns each bait a set_id and ``exclusion`` lists the members (set_id, other) of each set once;
    no pairs of baits are formed then.  ``mean`` compares means instead of medians and
    ``scale=False`` leaves the difference undivided by the control's deviation.

    The shuffled volume is the two input tables, one narrow row per pair and one per value of an excluded bait; no row
    holds a list, and a median is fetched by its (prey, rank).
    """
    if mean:
        ranks = control.filter("value is not null").select("prey", F.col("bait").alias("other"), F.col("value").cast("double").alias("value"))
        ranks = ranks.join(ranks.groupBy("prey").agg(F.count("*").alias("all_n"), F.avg("value").alias("c")), "prey")
    else:
        ranks = ranked_control(control)
    totals = ranks.groupBy("prey").agg(F.max("all_n").alias("all_n"), F.max("c").alias("c"), F.sum((F.col("value") - F.col("c")) * (F.col("value") - F.col("c"))).alias("all_ss"))
    members = exclusion if sets is not None or exclusion is None else exclusion.withColumnRenamed("bait", "set_id")
    gone = removed_values(ranks, members, not mean)
    if samples is None:
        samples = sample_stats(ranks.select("prey", F.col("other").alias("bait"), "value") if control is values else values.repartition("prey"))
    samples = samples.join(sets, "bait", "left") if sets is not None else samples.withColumn("set_id", F.col("bait"))
    j = samples.join(totals, "prey").join(gone, ["prey", "set_id"], "left").na.fill(0, ["n", "s", "ss", *([] if mean else ["shift1", "shift2"])])

    n2 = F.col("all_n") - F.col("n")
    shift = F.when(n2 > 0, -F.col("s") / F.when(n2 > 0, n2))
    j = j.withColumns({"n2": n2, "m2": F.col("c") + shift,
                       "q2": F.greatest(F.col("all_ss") - F.col("ss") - n2 * shift * shift, F.lit(0.0))}).filter("n2 > 0")
    n2, q2 = F.col("n2"), F.col("q2")
    t, df = t_statistic(F.col("n1"), F.col("m1"), F.col("q1"), n2, F.col("m2"), q2)
    sd = F.sqrt(q2 / F.when(n2 > ddof, n2 - ddof))
    own = [*PAIR, "n1", "n2", t.alias("t"), df.alias("df"), sd.alias("sd")]
    if mean:
        j = j.select(*own, (F.col("m1") - F.col("m2")).alias("diff"))
    else:
        k1, k2 = middle_ranks(n2)
        j = j.select(*own, "med1", (k1 + F.col("shift1")).alias("r1"), (k2 + F.col("shift2")).alias("r2"))
        for k in ("1", "2"):
            j = j.join(ranks.select("prey", F.col("rank").alias(f"r{k}"), F.col("value").alias(f"v{k}")), ["prey", f"r{k}"])
        j = j.withColumn("diff", F.col("med1") - (F.col("v1") + F.col("v2")) / 2)
    e = F.when(F.col("sd") > 0, F.col("diff") / F.when(F.col("sd") > 0, F.col("sd"))) if scale else F.col("diff")
    return j.select(*PAIR, "n1", "n2", "t", "df", e.alias("enrichment")).withColumn("pvals", neglog10p(F.col("t"), F.col("df")))


# --- controls ------------------------------------------------------------------------------------

def control_exclusion(baits: DataFrame, complexes: DataFrame) -> DataFrame:
    """(bait, other): itself, baits of the same gene root or complex, and MED with POLR.

    ``baits``: (bait, gene); ``complexes``: (complex_id, gene).  The result has one row per pair of
    related baits, a dimension table.
    """
    b = baits.select("bait", "gene", C.root_gene("gene").alias("root"))
    # The two families that share subunits.
    partner = F.when(F.col("root") == "MED", "POLR").when(F.col("root") == "POLR", "MED")
    keys = b.select("bait", "gene", F.explode(F.array_compact(F.array("root", partner))).alias("root"))
    other = b.select(F.col("bait").alias("other"), F.col("root"))
    by_root = keys.select("bait", "root").join(other, "root").select("bait", "other")
    member = complexes.join(b, "gene").select("complex_id", "bait")
    by_complex = member.join(member.withColumnRenamed("bait", "other"), "complex_id").select("bait", "other")
    itself = b.select("bait", F.col("bait").alias("other"))
    return by_root.unionByName(by_complex).unionByName(itself).distinct()


def cluster_sets(values: DataFrame, clusters: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sets, members) for leave_out_scores: a bait's control has the baits of other clusters only.

    A bait without a cluster is a set of its own.  ``clusters``: (bait, cluster).
    """
    c = values.select("bait").distinct().join(clusters.select("bait", F.col("cluster").cast("string").alias("_c")), "bait", "left")
    sets = c.select("bait", F.coalesce(F.concat(F.lit("cluster "), "_c"), F.concat(F.lit("bait "), "bait")).alias("set_id"))
    return sets, sets.select("set_id", F.col("bait").alias("other"))


def bait_correlation(values: DataFrame) -> DataFrame:
    """Pearson r of every two baits over preys seen in all baits, both orders and the diagonal."""
    med = median_replicates(all_valids(values))
    s = med.groupBy("bait").agg(F.avg("value").alias("_m"), F.sqrt(F.var_pop("value") * F.count("*")).alias("_l"))
    z = med.join(s, "bait").select("prey", "bait", ((F.col("value") - F.col("_m")) / F.when(F.col("_l") > 0, F.col("_l"))).alias("z"))
    g = gram(z, row="prey", column="bait", value="z")
    # rounded so that both orders of a pair, summed in different order, compare as equal
    return g.select(F.col("a").alias("bait"), F.col("b").alias("other"), F.round("dot", 12).alias("r"))


def correlated_baits(corr: DataFrame, percentile: float = 0.95) -> DataFrame:
    """(bait, other) above the percentile of off-diagonal correlations; the bait itself included."""
    corr = cut_lineage(corr)  # one row per two baits, used three times below
    cut = grouped_quantiles(corr.filter("bait <> other"), [], "r", {"cut": percentile})
    return corr.join(F.broadcast(cut), (F.col("r") > F.col("cut")) | (F.col("bait") == F.col("other"))).select("bait", "other")


# --- thresholds ----------------------------------------------------------------------------------

def fdr_curve(e: Column, curvature, offset, two_sided: bool = False) -> Column:
    """curvature / (|e| - offset); infinite left of the offset and exactly at it."""
    c, x0 = (v if isinstance(v, Column) else F.lit(float(v)) for v in (curvature, offset))
    base = F.abs(e) if two_sided else e
    gap = F.abs(e) - x0
    return F.when((base < x0) | (gap == 0), float("inf")).otherwise(c / F.when(gap != 0, gap))


def two_level_hits(scores: DataFrame, fdr1, fdr5, overrides: DataFrame | None = None) -> DataFrame:
    """hits above the first curve; minor_hits strictly between the two.

    ``fdr1`` / ``fdr5`` are (curvature, offset) numbers or Columns; ``overrides`` may carry
    (plate, target, c1, x1, c5, x5) for single pulldowns.
    """
    (c1, x1), (c5, x5) = [[v if isinstance(v, Column) else F.lit(float(v)) for v in pair] for pair in (fdr1, fdr5)]
    drop = []
    if overrides is not None:
        o = overrides.select("plate", "target", *[F.col(n).alias(f"_{n}") for n in ("c1", "x1", "c5", "x5")])
        scores = scores.join(o, ["plate", "target"], "left")
        c1, x1, c5, x5 = [F.coalesce(f"_{n}", v) for n, v in (("c1", c1), ("x1", x1), ("c5", c5), ("x5", x5))]
        drop = ["_c1", "_x1", "_c5", "_x5"]
    p = F.col("pvals")
    first, second = fdr_curve(F.col("enrichment"), c1, x1), fdr_curve(F.col("enrichment"), c5, x5)
    return scores.withColumns({"hits": F.coalesce(p > first, F.lit(False)),
                               "minor_hits": F.coalesce((p < first) & (p > second), F.lit(False))}).drop(*drop)


CURVATURE = 3.0


def _hit_tenth() -> Column:
    """Largest offset, in tenths, at which a row is still a hit at curvature 3."""
    return (F.ceil(F.round(10 * (F.abs("enrichment") - CURVATURE / F.col("pvals")), 6)) - 1).cast("bigint")


def fdr1_seed(scores: DataFrame, keys=("target",)) -> DataFrame:
    """Smallest offset of the search grid without a hit on the negative side.

    The grid has tenths up to 4.2, then fifths, and ends at the first value of at least 10; below
    2.5 it continues downward in tenths.  NULL for targets without negative rows.
    """
    m = scores.filter("enrichment < 0 and pvals > 0").groupBy(*keys).agg((F.max(_hit_tenth()) + 1).alias("_m"))
    odd = 43 + 2 * F.ceil((F.col("_m") - 43) / 2)
    up = F.when(F.col("_m") <= 43, F.col("_m")).otherwise(F.least(odd, F.lit(101)))
    return scores.select(*keys).distinct().join(m, list(keys), "left").select(*keys, (up / 10).alias("fdr1"))


def fdr5_seed(scores: DataFrame, seeds: DataFrame, perc: float = 10.0, keys=("target",)) -> DataFrame:
    """Lower the offset by tenths until two negative hits and the wanted negative/positive percentage.

    Hits are counted per tenth first, so the search walks over a short table per target, not over rows.
    """
    ks = list(keys)
    s = scores.filter("enrichment <> 0 and pvals > 0").withColumn("_t", _hit_tenth())
    per = s.groupBy(*ks, F.col("_t")).agg(F.count_if(F.col("enrichment") < 0).alias("neg"), F.count_if(F.col("enrichment") > 0).alias("pos"))
    start = seeds.filter("fdr1 is not null").select(*ks, F.round(F.col("fdr1") * 10).cast("bigint").alias("_s"))
    grid = start.withColumn("_g", F.explode(F.sequence(F.least(F.lit(1), F.col("_s")), F.col("_s"))))
    # hits at offset g are the rows whose own tenth is at least g; tenths above the start count everywhere
    binned = per.join(start, ks).select(*ks, F.least("_t", "_s").alias("_g"), "neg", "pos").filter("_g >= least(1, _s)") \
        .groupBy(*ks, "_g").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    w = W.partitionBy(*ks).orderBy(F.desc("_g")).rowsBetween(W.unboundedPreceding, 0)
    cum = grid.join(binned, [*ks, "_g"], "left").na.fill(0, ["neg", "pos"]).withColumns(
        {"n": F.sum("neg").over(w), "p": F.sum("pos").over(w)})
    share = F.when(F.col("p") > 0, 100 * F.col("n") / F.when(F.col("p") > 0, F.col("p"))).when(F.col("n") > 0, float("inf"))
    cum = cum.withColumn("share", share)
    more = (F.col("n") < 2) | F.coalesce(F.col("share") < perc, F.lit(False))
    # the walk stops where no more is needed, at the latest at the lowest tenth (1, or the start itself below it)
    stop = F.coalesce(F.max(F.when(~more, F.col("_g"))), F.min("_g"))
    got = cum.groupBy(*ks).agg(stop.alias("_stop"))
    at = cum.join(got, ks).filter("_g = _stop")
    back = F.when(F.coalesce(F.col("share") > perc, F.lit(False)), 1).otherwise(0)
    return seeds.join(at.select(*ks, ((F.col("_stop") + back) / 10).alias("fdr5")), ks, "left").select(*ks, "fdr1", "fdr5")


def dynamic_fdr(scores: DataFrame, perc: float = 10.0) -> DataFrame:
    """Both seeds per target, then two-level hits."""
    seeds = fdr5_seed(scores, fdr1_seed(scores), perc)
    return two_level_hits(scores.join(seeds, "target"), (CURVATURE, F.col("fdr1")), (CURVATURE, F.col("fdr5")))


def fdr_curve_points(fdrs: DataFrame, keys: list[str], width: float = 10.0, steps: int = 100) -> DataFrame:
    """x, y samples of both curves, right of their offset, for charts."""
    curves = fdrs.select(*keys, F.explode(F.array(F.struct(F.lit("fdr1").alias("curve"), F.col("fdr1").alias("x0")),
                                                  F.struct(F.lit("fdr5").alias("curve"), F.col("fdr5").alias("x0")))).alias("c"))
    x = F.col("c.x0") + F.col("i") * (width / steps)
    return curves.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(steps)))).select(
        *keys, "c.curve", x.alias("x"), (F.lit(CURVATURE) / (F.col("i") * (width / steps))).alias("y")).filter("x is not null")


def melt_scores(blocks: dict[str, DataFrame], just_hits: bool = False) -> DataFrame:
    """Blocks of scores named by pulldown ('P012_GENE') to one long table with plate and target."""
    rows = reduce(DataFrame.unionByName, [df.withColumn("bait", F.lit(name)) for name, df in blocks.items()])
    return split_bait(rows, just_hits)


def split_bait(rows: DataFrame, just_hits: bool = False) -> DataFrame:
    parts = F.split("bait", "_", 2)
    out = rows.withColumns({"plate": parts[0], "target": F.upper(parts[1])}).drop("bait")
    return out.filter(F.col("hits") | F.col("minor_hits")) if just_hits else out


# --- rounds --------------------------------------------------------------------------------------

def mask_hits(values: DataFrame, scores: DataFrame, p_cut: float) -> DataFrame:
    """Control table of the next round: values of enriched, significant pairs are taken out."""
    hits = scores.filter((F.col("enrichment") > 0) & (F.col("pvals") > p_cut)).select(*PAIR)
    return values.join(hits, PAIR, "left_anti")


def score_two_rounds(values: DataFrame, exclusion: DataFrame, p_cut: float, curvature: float, offset: float) -> DataFrame:
    values, exclusion = cut_lineage(values), cut_lineage(exclusion)
    samples = cut_lineage(sample_stats(values.repartition("prey")))
    first = leave_out_scores(values, values, exclusion, samples=samples)
    second = leave_out_scores(values, mask_hits(values, first, p_cut), exclusion, samples=samples)
    return second.withColumn("hits", F.coalesce(F.col("pvals") > fdr_curve(F.col("enrichment"), curvature, offset), F.lit(False)))


def score_bootstrap(values: DataFrame, exclusion: DataFrame, fewest: int = 9, seed: str = "boot") -> DataFrame:
    """Scores against controls resampled with replacement to the prey's full number of samples.

    A prey has one value per sample, so its control array is as long as one row of the sample
    matrix.  Draws are keyed by pair and position.  Pairs with fewer than ``fewest`` control values
    get small random scores.  Missing sample values count as the control mean.
    """
    cells = F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct("value", "bait", "replicate"))))
    rows = values.groupBy("prey").agg(F.count("*").alias("len"), cells.alias("cells"))
    mine = values.groupBy(*PAIR).agg(F.count("*").alias("n1"), F.sort_array(F.collect_list("value")).alias("xs"))
    drop = exclusion.groupBy("bait").agg(F.collect_set("other").alias("drop"))
    j = mine.join(drop, "bait").join(rows, "prey").withColumn(
        "con", F.transform(F.filter("cells", lambda c: ~F.array_contains("drop", c["bait"])), lambda c: c["value"]))
    m = F.size("con")
    pick = lambda i: F.element_at("con", (F.floor(keyed.uniform("prey", "bait", i, F.lit(seed)) * m) + 1).cast("int"))
    j = j.withColumn("enough", m >= fewest)
    j = j.withColumn("draw", F.when(F.col("enough"), F.array_sort(F.transform(F.sequence(F.lit(1), F.col("len").cast("int")), pick))))
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)
    j = j.withColumn("m2", total("draw") / F.size("draw"))
    j = j.withColumn("full", F.array_sort(F.concat("xs", F.array_repeat(F.col("m2"), (F.col("n1") - F.size("xs")).cast("int")))))
    j = j.withColumn("m1", total("full") / F.col("n1"))
    squares = lambda arr, mu: F.aggregate(arr, F.lit(0.0), lambda a, x: a + (x - mu) * (x - mu))
    j = j.withColumns({"q1": squares("full", F.col("m1")), "q2": squares("draw", F.col("m2")), "n2": F.size("draw")})
    mid = lambda arr: (F.element_at(arr, F.floor((F.size(arr) + 1) / 2).cast("int")) + F.element_at(arr, F.ceil((F.size(arr) + 1) / 2).cast("int"))) / 2
    t, df = t_statistic(F.col("n1"), F.col("m1"), F.col("q1"), F.col("n2"), F.col("m2"), F.col("q2"))
    sd = F.sqrt(F.col("q2") / F.col("n2"))
    e = F.when(sd > 0, (mid("full") - mid("draw")) / F.when(sd > 0, sd))
    few = ~F.col("enough")
    s = j.select(*PAIR, "enough", t.alias("t"), df.alias("df"), F.when(few, -0.1 + 0.2 * keyed.uniform("prey", "bait", F.lit("e"), F.lit(seed))).otherwise(e).alias("enrichment"))
    return s.withColumn("pvals", F.when(F.col("enough"), neglog10p(F.col("t"), F.col("df")))
                        .otherwise(0.2 * keyed.uniform("prey", "bait", F.lit("p"), F.lit(seed)))).drop("enough")


def score_iterative(values: DataFrame, names: DataFrame, curvature: float, offset: float, max_iter: int = 5, many: int = 35) -> DataFrame:
    """Rescore while hits name further baits to leave out; all baits advance together.

    ``names``: (prey, gene).  A bait with more than ``many`` new hits drops only its best ones and
    gets one more round.
    """
    excluded = cut_lineage(self_exclusion(values))
    baits = values.select("bait").distinct()
    state = cut_lineage(baits.withColumn("left", F.lit(max_iter)))
    seen, done = None, []
    while not state.isEmpty():
        live = values.join(state.select("bait"), "bait", "left_semi")
        sc = leave_out_scores(live, values, excluded)
        sc = cut_lineage(sc.withColumn("hits", F.coalesce(F.col("pvals") > fdr_curve(F.col("enrichment"), curvature, offset), F.lit(False))))
        fresh = sc.filter("hits").join(names, "prey").select("bait", "gene", "pvals").groupBy("bait", "gene").agg(F.max("pvals").alias("pvals"))
        if seen is not None:
            fresh = fresh.join(seen, ["bait", "gene"], "left_anti")
        counts = fresh.groupBy("bait").agg((F.count("*") > many).alias("crowded"))
        big = top_n(fresh.join(counts.filter("crowded"), "bait", "left_semi"), ["bait"], [F.desc("pvals"), F.asc("gene")], many).drop("rank")
        small = fresh.join(counts.filter("not crowded"), "bait", "left_semi")
        genes = small.unionByName(big).select("bait", F.explode(F.split("gene", ";")).alias("gene")).distinct()
        others = contains_join(baits.withColumnRenamed("bait", "other"), "other", genes, "gene").select("other", "gene").distinct()
        drops = cut_lineage(genes.join(others, "gene").select("bait", "other").distinct().join(excluded, ["bait", "other"], "left_anti"))
        nxt = (state.join(counts, "bait", "left").withColumn("left", F.when(F.coalesce("crowded", F.lit(False)), 1).otherwise(F.col("left") - 1))
               .filter("left > 0").join(drops.select("bait").distinct(), "bait", "left_semi").select("bait", "left"))
        nxt = cut_lineage(nxt)
        done.append(sc.join(nxt.select("bait"), "bait", "left_anti"))
        seen_now = sc.filter("hits").join(names, "prey").select("bait", "gene").distinct()
        seen = cut_lineage(seen_now if seen is None else seen.unionByName(seen_now).distinct())
        excluded = cut_lineage(excluded.unionByName(drops))
        state = nxt
    return reduce(DataFrame.unionByName, done)


def score_curve_rounds(values: DataFrame, fdr_first: tuple[float, float], fdr_second: tuple[float, float]) -> DataFrame:
    """Round one leaves only the bait itself out and masks hits by a threshold curve; round two uses
    the whole masked table as control."""
    values = cut_lineage(values)
    samples = cut_lineage(sample_stats(values.repartition("prey")))
    first = leave_out_scores(values, values, None, samples=samples)
    hits = first.filter(F.col("pvals") > fdr_curve(F.col("enrichment"), *fdr_first)).select(*PAIR)
    nobody = values.select("bait", F.col("bait").alias("other")).filter(F.lit(False))
    second = leave_out_scores(values, values.join(hits, PAIR, "left_anti"), nobody, samples=samples)
    return second.withColumn("hits", F.coalesce(F.col("pvals") > fdr_curve(F.col("enrichment"), *fdr_second), F.lit(False)))
