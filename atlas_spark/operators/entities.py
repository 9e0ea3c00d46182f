"""Plates, designs, lines, pulldowns and fields of view: choice of the best, roll-ups, records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import cols as C
from ..session import cut_lineage
from .hits import displayed, significant_hits
from .ranking import best_row, global_row_number
from .relational import top_n

STRINGS = "array<string>"


def categories(c: str = "categories") -> Column:
    return F.from_json(c, STRINGS)


def best_pulldown(pulldowns: DataFrame) -> DataFrame:
    """Per line the flagged pulldown, else the first."""
    order = [F.when(F.col("display_flag"), 0).otherwise(1), F.col("pulldown_id")]
    return best_row(pulldowns, ["line_id"], order, ["pulldown_id"])


def best_cell_line(lines: DataFrame, pulldowns: DataFrame, fovs: DataFrame) -> DataFrame:
    """Per design: a resorted line, else one with a pulldown, else one with images, else the first."""
    has_p = pulldowns.select("line_id", F.lit(True).alias("_p")).distinct()
    has_f = fovs.select("line_id", F.lit(True).alias("_f")).distinct()
    r = lines.join(has_p, "line_id", "left").join(has_f, "line_id", "left")
    rank = F.when(F.col("sort_count") > 1, 0).when(F.col("_p"), 1).when(F.col("_f"), 2).otherwise(3)
    return best_row(r, ["design_id"], [rank, F.col("line_id")], ["line_id"])


def best_fov(fovs: DataFrame, annotated: DataFrame) -> DataFrame:
    """First and last annotated field of each line."""
    a = fovs.join(annotated, "fov_id", "left_semi")
    return a.groupBy("line_id").agg(F.min("fov_id").alias("first_fov_id"), F.max("fov_id").alias("last_fov_id"))


def fov_scores(results: DataFrame, kind: str) -> DataFrame:
    """One score per field for a kind of result: that of the latest result."""
    return results.filter(F.col("kind") == kind).groupBy("fov_id").agg(F.max_by("score", "result_id").alias("score"))


def top_scoring_fovs(fovs: DataFrame, scores: DataFrame, ntop: int) -> DataFrame:
    s = fovs.join(scores.filter("score is not null"), "fov_id")
    return top_n(s, ["line_id"], [F.desc("score"), F.asc("fov_id")], ntop)


def bait_hits(pulldowns: DataFrame, lines: DataFrame, hits: DataFrame, group_designs: DataFrame) -> DataFrame:
    """Significant hits of a pulldown whose protein group belongs to the pulldown's own design."""
    own = pulldowns.join(lines.select("line_id", "design_id"), "line_id").select("pulldown_id", "design_id")
    sig = significant_hits(hits).join(own, "pulldown_id")
    return sig.join(group_designs, ["group_id", "design_id"])


def bait_hit_best(bait: DataFrame) -> DataFrame:
    return best_row(bait, ["pulldown_id"], [F.col("enrichment"), -F.col("hit_id")], ["hit_id", "group_id", "enrichment"], largest=True)


def reference_uniprot(meta: DataFrame) -> DataFrame:
    """Per ensg id the entry with the longest annotation, or the most gene names when none is annotated."""
    ann = F.nullif(F.col("annotation"), F.lit("NaN"))
    m = meta.filter("ensg_id is not null").withColumns({
        "annotation": ann, "_len": F.coalesce(F.length(ann), F.lit(0)),
        "_names": F.coalesce(F.size(F.split("gene_names", " ")), F.lit(0))})
    # both candidates in one aggregate; which one counts is decided by the group's longest annotation
    row = ["uniprot_id", "protein_names", "gene_names", "annotation"]
    pick = lambda k: F.min(F.struct((-F.col(k)).alias("k"), *row))
    g = m.groupBy("ensg_id").agg(F.max(F.col("annotation").isNotNull()).alias("_any"), pick("_len").alias("_l"), pick("_names").alias("_n"))
    best = F.when(F.col("_any"), F.col("_l")).otherwise(F.col("_n"))
    return g.select("ensg_id", *[best[c].alias(c) for c in row])


def group_designs(groups: DataFrame, designs: DataFrame) -> DataFrame:
    """(group_id, design_id) through the isoform-free uniprot ids."""
    ids = groups.select("group_id", F.explode(F.split("uniprot_ids", ";")).alias("u")) \
                .select("group_id", C.strip_isoform("u").alias("uniprot_id")).distinct()
    return ids.join(designs.select("design_id", "uniprot_id"), "uniprot_id").select("group_id", "design_id").distinct()


def fov_counts(lines: DataFrame, fovs: DataFrame, annotated: DataFrame, low: str, high: str) -> DataFrame:
    """Fields and annotated fields per line, in all and inside a range of datasets; counted before the join."""
    f = fovs.join(annotated.select("fov_id", F.lit(1).alias("_a")), "fov_id", "left")
    inside = F.col("pml_id").between(low, high)
    c = f.groupBy("line_id").agg(
        F.count("*").alias("num_fovs"), F.count("_a").alias("num_annotated_fovs"),
        F.count_if(inside).alias("num_fovs_in_range"), F.count(F.when(inside, F.col("_a"))).alias("num_annotated_fovs_in_range"))
    names = c.columns[1:]
    return lines.select("line_id").join(c, "line_id", "left").select("line_id", *[F.coalesce(n, F.lit(0)).alias(n) for n in names])


def category_rows(annotations: DataFrame) -> DataFrame:
    """(entity, category, root, grade); 'none' where there is no grade."""
    e = annotations.select("entity_id", F.explode(F.array_distinct(categories())).alias("category"))
    return e.withColumns({"root": C.root_category("category"), "grade": F.coalesce(C.grade("category"), F.lit("none"))})


def category_cooccurrence(annotations: DataFrame) -> DataFrame:
    """Lines with both categories over lines with the first; pairs arise within one line's own list."""
    a = annotations.select("entity_id", F.array_distinct(categories()).alias("cs"))
    pairs = a.select(F.explode("cs").alias("c1"), "cs").select("c1", F.explode("cs").alias("c2")).groupBy("c1", "c2").agg(F.count("*").alias("n"))
    freq = pairs.filter("c1 = c2").select("c1", F.col("n").alias("n1"))
    return pairs.join(freq, "c1").select("c1", "c2", "n", (F.col("n") / F.col("n1")).alias("share"))


def select_by_categories(annotations: DataFrame, qc: list[str], localizations: list[str], mode: str = "any") -> DataFrame:
    """Entities with all QC categories and any or all of the localization categories, grades ignored."""
    roots = F.array_distinct(F.transform(categories(), C.root_category))
    lit = lambda xs: F.array(*[F.lit(x) for x in xs]).cast(STRINGS)
    none_missing = lambda xs: F.size(F.array_except(lit(xs), F.col("cs"))) == 0
    wanted = F.arrays_overlap("cs", lit(localizations)) if mode == "any" else none_missing(localizations)
    return annotations.select("entity_id", roots.alias("cs")).filter(none_missing(qc) & wanted).select("entity_id")


def categorical_filters(df: DataFrame, columns: list[str]) -> DataFrame:
    """(filter, value) with 'all' in front of each filter's distinct values."""
    pairs = F.array(*[F.struct(F.lit(c).alias("filter"), F.col(c).cast("string").alias("value")) for c in columns],
                    *[F.struct(F.lit(c).alias("filter"), F.lit("all").alias("value")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).select("p.filter", "p.value").filter("value is not null").distinct()


def apply_filters(df: DataFrame, chosen: dict[str, str]) -> DataFrame:
    for c, v in chosen.items():
        if v != "all":
            df = df.filter(F.col(c) == v)
    return df


def resolve_line(wanted: DataFrame, designs: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Line id per wanted key, with the number of matches; the smallest id where several match."""
    known = designs.join(lines.filter("line_type = 'POLYCLONAL'"), "design_id")
    found = known.join(wanted, keys, "left_semi").groupBy(*keys).agg(F.count("*").alias("n_matches"), F.min("line_id").alias("line_id"))
    return wanted.join(found, keys, "left").withColumn("n_matches", F.coalesce("n_matches", F.lit(0)))


def resolve_pulldown(wanted: DataFrame, pulldowns: DataFrame, lines: DataFrame, designs: DataFrame) -> DataFrame:
    """'P012_GENE' to the pulldown of that plate whose design has the target."""
    parts = F.split("key", "_", 2)
    w = wanted.select("key", C.ms_plate(parts[0]).alias("plate_id"), parts[1].alias("target_name"))
    known = (pulldowns.select("pulldown_id", "line_id", C.ms_plate("plate").alias("plate_id"))
             .join(lines.select("line_id", "design_id"), "line_id").join(designs.select("design_id", "target_name"), "design_id"))
    got = known.groupBy("plate_id", "target_name").agg(F.min("pulldown_id").alias("pulldown_id"), F.count("*").alias("n_matches"))
    return w.join(got, ["plate_id", "target_name"], "left").select("key", "plate_id", "pulldown_id", F.coalesce("n_matches", F.lit(0)).alias("n_matches"))


def load_plate_designs(designs: DataFrame, expected: int = 96) -> DataFrame:
    """Designs without empty controls and with NaN texts as NULL, and whether their plate is complete."""
    clean = designs.select(*[F.nullif(F.col(c), F.lit("NaN")).alias(c) if t == "string" else F.col(c) for c, t in designs.dtypes])
    clean = clean.filter(F.coalesce(F.col("target_name") != "empty_control", F.lit(True)))
    n = clean.groupBy("plate_id").agg(F.count("*").alias("_n"))
    return clean.join(n, "plate_id").withColumn("complete_plate", F.col("_n") == expected).drop("_n")


def fov_flags(fovs: DataFrame, scores: DataFrame, fov_annotations: DataFrame, line_annotations: DataFrame) -> DataFrame:
    lines = line_annotations.select("line_id", F.array_contains(categories(), "no_gfp").alias("is_gfp_negative"),
                                    F.array_contains(categories(), "publication_ready").alias("is_pub_ready"))
    f = (fovs.join(scores, "fov_id", "left").join(fov_annotations.select("fov_id", F.lit(True).alias("_a")), "fov_id", "left")
         .join(lines, "line_id", "left"))
    has = F.col("score").isNotNull()
    return f.select("fov_id", "line_id", has.alias("has_score"), F.coalesce("_a", F.lit(False)).alias("is_annotated"),
                    "is_gfp_negative", "is_pub_ready", F.coalesce(has & F.col("is_pub_ready"), F.lit(False)).alias("final_flag"))


def lines_newer_than(fovs: DataFrame, scores: DataFrame, cutoff: int, ntop: int = 2) -> DataFrame:
    """Lines whose best fields include an id above the cutoff."""
    top = top_scoring_fovs(fovs, scores, ntop)
    return top.groupBy("line_id").agg(F.max("fov_id").alias("max_fov_id")).filter(F.col("max_fov_id") > cutoff)


def score_bands(results: DataFrame, keys: list[str], good: float, bad: float) -> DataFrame:
    s = F.col("score")
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    return results.groupBy(*keys).agg(share(s > good).alias("good"), share(s < bad).alias("bad"), share(s.isNull()).alias("missing"),
                                      F.max(s).alias("max_score"), F.count("*").alias("n"))


def sequencing_fractions(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts over their row total; rows with a missing count or a zero total are left out."""
    total = sum((F.col(c) for c in columns[1:]), F.col(columns[0]))
    ok = df.withColumn("_t", total).filter("_t is not null and _t <> 0")
    return ok.select(*[F.col(c) for c in df.columns if c not in columns], *[(F.col(c) / F.col("_t")).alias(c) for c in columns])


def step_properties(df: DataFrame, keys: list[str], index: str, constant: str) -> DataFrame:
    """Whether the sorted index rises by exactly 1 and the other column never changes.

    Both follow from extremes and counts, so no ordered pass over a group is needed.
    """
    i, c = F.col(index), F.col(constant)
    return df.groupBy(*keys).agg(
        F.count(index).alias("n"), ((F.max(i) - F.min(i) + 1 == F.count(i)) & (F.count_distinct(i) == F.count(i))).alias("contiguous"),
        (F.max(c) - F.min(c) == 0).alias("constant"))


def second_difference_max(df: DataFrame, keys: list[str], index: str, value: str) -> DataFrame:
    """Largest |y[i-1] - 2 y[i] + y[i+1]|: each point adds its share to its own and both neighbouring positions."""
    spread = df.select(*keys, F.explode(F.array(*[F.struct((F.col(index) + d).alias("i"), (F.col(value) * w).alias("v"))
                                                  for d, w in ((-1, 1.0), (0, -2.0), (1, 1.0))])).alias("s"))
    d2 = spread.groupBy(*keys, "s.i").agg(F.sum("s.v").alias("d2"), F.count("*").alias("n")).filter("n = 3")
    return d2.groupBy(*keys).agg(F.max(F.abs("d2")).alias("max_d2"))


def tile_positions(items: DataFrame, id_col: str, columns: int = 36) -> DataFrame:
    """Row-major (row, column) of each item, in id order."""
    i = F.col("_i") - 1
    return global_row_number(items.select(id_col), id_col, "_i").select(
        id_col, F.floor(i / columns).cast("bigint").alias("tile_row"), (i % columns).cast("bigint").alias("tile_column"))


def merge_positions(tiles: DataFrame, targets: DataFrame, gridded: DataFrame, raw: DataFrame, key: str = "line_id") -> DataFrame:
    return tiles.join(targets, key, "left").join(gridded, key, "left").join(raw, key, "left")


# --- nested records ----------------------------------------------------------------------------

def line_records(designs, lines, uniprot, annotations, pulldowns, counts) -> DataFrame:
    """One nested record per line."""
    ann = annotations.select("line_id", F.array_sort(categories()).alias("categories"))
    graded = F.coalesce(F.exists("categories", lambda c: c.rlike("_[1,2,3]$")), F.lit(False))
    j = (lines.join(designs, "design_id").join(uniprot.select("uniprot_id", "protein_names", "gene_names"), "uniprot_id", "left")
         .join(ann, "line_id", "left").join(best_pulldown(pulldowns), "line_id", "left").join(counts, "line_id", "left"))
    return j.select("line_id", F.struct("design_id", "plate_id", "well_id", "target_name", "family", "sort_count").alias("metadata"),
                    F.struct("uniprot_id", C.protein_name("protein_names").alias("protein_name"), "gene_names").alias("uniprot"),
                    F.struct("categories", graded.alias("has_graded")).alias("annotation"),
                    F.struct("pulldown_id").alias("best_pulldown"), F.struct("num_fovs", "num_annotated_fovs").alias("fov_counts"))


def plate_targets(designs: DataFrame) -> DataFrame:
    """Targets of each plate; a plate has 96 wells, so the list is short."""
    return designs.groupBy("plate_id").agg(F.array_sort(F.collect_set("target_name")).alias("targets"), F.count("*").alias("n_wells"))


def fov_records(fovs: DataFrame, results: DataFrame, rois: DataFrame) -> DataFrame:
    """Per field the newest value of several kinds of result side by side, and its first ROI."""
    def newest(kind, value):
        return F.max_by(value, F.when(F.col("kind") == kind, F.col("result_id")))
    k = F.get_json_object("data", "$.k").cast("int")
    r = results.groupBy("fov_id").agg(
        newest("view", F.when(F.col("kind") == "view", F.col("score"))).alias("score"),
        newest("click", F.when(F.col("kind") == "click", k)).alias("laser_power"),
        newest("purchase", F.when(F.col("kind") == "purchase", k)).alias("cell_layer_center"))
    first = rois.groupBy("fov_id").agg(F.min("roi_id").alias("roi_id"))
    return (fovs.join(r, "fov_id", "left").join(first, "fov_id", "left")
            .select("fov_id", "line_id", "pml_id", "site_num", "score", "laser_power",
                    (F.col("cell_layer_center") * C.z_step("pml_id")).alias("cell_layer_um"), "roi_id"))


def hit_records(hits: DataFrame, pulldowns: DataFrame, lines: DataFrame, groups: DataFrame, designs: DataFrame, bridge: DataFrame) -> DataFrame:
    """Significant hits with gene and target names and whether the hit is the pulldown's own bait."""
    names = bridge.join(designs.select("design_id", "target_name"), "design_id") \
        .groupBy("group_id").agg(F.array_sort(F.collect_set("target_name")).alias("target_names"))
    mine = bridge.withColumn("_own", F.lit(True))
    own = pulldowns.join(lines.select("line_id", "design_id"), "line_id").select("pulldown_id", "design_id")
    j = (significant_hits(hits).join(own, "pulldown_id").join(groups.select("group_id", "gene_names"), "group_id")
         .join(names, "group_id", "left").join(mine, ["group_id", "design_id"], "left"))
    return j.select("pulldown_id", "hit_id", "group_id", "pval", "enrichment", F.split("gene_names", ";").alias("gene_names"), "target_names",
                    F.coalesce("_own", F.lit(False)).alias("is_bait"))


def interactor_records(primary: DataFrame, meta: DataFrame, hits: DataFrame, pulldowns: DataFrame) -> DataFrame:
    """Per ensg id: primary group, its metadata, and the displayed lines where it is a hit."""
    shown = pulldowns.filter(displayed("display_flag")).select("pulldown_id", "line_id")
    seen = significant_hits(hits).join(shown, "pulldown_id").select("group_id", "line_id").distinct().groupBy("group_id").agg(F.count("*").alias("n_lines"))
    return (primary.join(meta, "ensg_id", "left").join(seen, "group_id", "left")
            .select("ensg_id", "group_id", C.protein_name("protein_names").alias("protein_name"), F.coalesce("n_lines", F.lit(0)).alias("n_lines")))


#: Pulldowns of a cluster that meet its tiles in one task, about.
PORTION = 4096


def pulldown_cluster_tiles(heatmap: DataFrame, hits: DataFrame, measures: list[Column] = ()) -> DataFrame:
    """All tiles of the lowest-numbered cluster in which a pulldown has a tile.

    With ``measures``, aggregates over these rows instead, one row per pulldown.  Every tile of the cluster meets every pulldown either
    way: the pulldowns are dealt to portions, each of which gets the cluster's tiles once, and a portion's rows are added up where they
    arise, before any shuffle.  The rows grow with pulldowns times tiles of a cluster, and so does the time.
    """
    own = heatmap.join(hits.select("hit_id", "pulldown_id"), "hit_id").groupBy("pulldown_id").agg(F.min("cluster_id").alias("cluster_id"))
    own = cut_lineage(own.filter("cluster_id is not null"))
    portions = cut_lineage(own.groupBy("cluster_id").agg(F.ceil(F.count("*") / PORTION).cast("int").alias("_portions")))
    n = max(portions.agg(F.sum("_portions")).first()[0] or 0, 1)
    key = ["cluster_id", "_portion"]
    one = own.join(portions, "cluster_id").withColumn("_portion", F.pmod(F.xxhash64("pulldown_id"), F.col("_portions").cast("bigint")).cast("int")).drop("_portions")
    tiles = heatmap.join(portions, "cluster_id").withColumn("_portion", F.explode(F.sequence(F.lit(0), F.col("_portions") - 1))).drop("_portions")
    met = one.repartition(n, *key).join(tiles.repartition(n, *key), key)
    return (met.groupBy(*key, "pulldown_id").agg(*measures) if measures else met).drop("_portion")
