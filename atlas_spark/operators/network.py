"""Interaction networks as edge tables (target, prey, ...).

Hubs hold a large share of all edges.  Questions of the form "which x are in both lists" therefore
expand the shorter list of each pair and look the result up in the longer one, and pair searches
use the rarest shared members only; no step lists all pairs of a hub's partners.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import keyed
from ..session import cut_lineage
from .ranking import HOT_ROWS, grouped_ranks
from .relational import top_n


#: Rows that one task sorts for a join of narrow rows, about.
TASK_ROWS = 200_000


def both_ways(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Each pair in both orders (a, b), other columns kept."""
    other = [c for c in pairs.columns if c not in (a, b)]
    flip = pairs.select(F.col(b).alias(a), F.col(a).alias(b), *other)
    return pairs.select(a, b, *other).unionByName(flip)


def dealt(rows: DataFrame, n: int, *keys: str) -> DataFrame:
    """The ``n`` rows by their keys, about TASK_ROWS to a task where there are many: they are narrow, and adaptive execution deals by
    size.  A group of few rows more or less does not matter, so ``n`` may be a bound."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = -(-n // TASK_ROWS)
    return rows.repartition(max(parts, least), *keys) if 4 * parts > least else rows


def intersect_lists(pairs: DataFrame, left: DataFrame, l: str, right: DataFrame, r: str, x: str, task_rows: int | None = None) -> DataFrame:
    """For every (l, r) of ``pairs`` the x that left lists for l and right lists for r.

    ``left`` and ``right`` are distinct on (l, x) and (r, x); their further columns are carried along.  With ``task_rows`` the
    expanded rows are counted first and dealt so that a task sorts about that many: narrow rows are small once compressed, and
    adaptive execution alone would put millions of them into one task.
    """
    nl = left.groupBy(l).agg(F.count("*").alias("_nl"))
    nr = right.groupBy(r).agg(F.count("*").alias("_nr"))
    sized = pairs.join(nl, l).join(nr, r)
    parts = 0
    if task_rows is not None:
        sized = cut_lineage(sized)
        parts = -(-(sized.agg(F.sum(F.least("_nl", "_nr"))).first()[0] or 0) // task_rows)

    def join(a, b, *keys):
        return (a.repartition(parts, *keys).join(b.repartition(parts, *keys), [*keys]) if parts > 1 else a.join(b, [*keys]))
    by_left = join(join(sized.filter("_nl <= _nr").drop("_nl", "_nr"), left, l), right, r, x)
    by_right = join(join(sized.filter("_nl > _nr").drop("_nl", "_nr"), right, r), left, l, x)
    return by_left.unionByName(by_right)


def unique_interactions(edges: DataFrame, keep_self: bool = False, weight: str | None = None, n: int = 0) -> DataFrame:
    """Undirected pairs (prot_1, prot_2), optionally with the largest weight of both directions; ``n`` edges, if known, are ``dealt``."""
    e = edges if keep_self else edges.filter("target <> prey")
    keys = [F.least("target", "prey").alias("prot_1"), F.greatest("target", "prey").alias("prot_2")]
    if weight is None:
        return e.select(*keys).distinct()
    return dealt(e.select(*keys, weight), n, "prot_1", "prot_2").groupBy("prot_1", "prot_2").agg(F.max(weight).alias(weight))


def null_network(edges: DataFrame) -> DataFrame:
    """Targets keep their number of edges; preys are dealt out again in a keyed random order."""
    e = edges.select("target", "prey").withColumns({"_a": keyed.uniform("target", "prey", F.lit("a")),
                                                    "_b": keyed.uniform("target", "prey", F.lit("b"))})
    a = grouped_ranks(e, [], "_a", ["target", "prey"], out="_r").select("_r", "target")
    b = grouped_ranks(e, [], "_b", ["target", "prey"], out="_r").select("_r", "prey")
    return a.join(b, "_r").select("target", "prey")


#: Members of a block of a hub's list.
HUB_BLOCK = 512


def member_pairs(rows: DataFrame, group: str, member: str, block: int = HUB_BLOCK) -> DataFrame:
    """(first, second), first < second: the pairs of members of each group, without repeats.

    A group of many members is cut into blocks, and every two blocks are a key of their own, so that a hub's pairs are spread over
    many tasks.  ``rows`` are distinct.
    """
    size = rows.groupBy(group).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    d = rows.select(group, member).join(size, group).withColumn("_own", F.pmod(F.xxhash64(member), "_blocks").cast("int"))
    d = d.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    d = d.select(group, F.least("_own", "_other").alias("_lo"), F.greatest("_own", "_other").alias("_hi"), "_own", F.col(member).alias("first"))
    key = [group, "_lo", "_hi"]
    second = d.select(*key, F.col("_own").alias("_own2"), F.col("first").alias("second"))
    return d.join(second, key).filter("first < second and (_lo = _hi or _own <> _own2)").select("first", "second").distinct()


def second_neighbors(edges: DataFrame, threshold: int = 3, listed: bool = True) -> DataFrame:
    """Prey pairs sharing at least ``threshold`` targets and no direct edge, with the shared targets if ``listed``.

    With targets ordered from rare to common, two preys can only share that many if they share one
    outside the last threshold-1 of their lists, so the common targets never generate pairs.  What a candidate pair shares is
    found by expanding the shorter list and looking it up in the longer one.
    """
    e = cut_lineage(edges.select("target", "prey").distinct())
    freq = e.groupBy("target").agg(F.count("*").alias("_f"))
    degree = e.groupBy("prey").agg(F.count("*").alias("_d")).filter(F.col("_d") >= threshold)
    sized = e.join(freq, "target").join(degree, "prey")
    if degree.filter(F.col("_d") > HOT_ROWS).isEmpty():
        ranked = sized.withColumn("_i", F.row_number().over(W.partitionBy("prey").orderBy("_f", "target")))
    else:
        ranked = grouped_ranks(sized, ["prey"], "_f", ["target"], out="_i")
    rare = ranked.filter(F.col("_i") <= F.col("_d") - (threshold - 1)).select("target", "prey")
    pairs = member_pairs(rare, "target", "prey").withColumnsRenamed({"first": "prot_1", "second": "prot_2"})
    pairs = pairs.join(unique_interactions(e), ["prot_1", "prot_2"], "left_anti")
    d1, d2 = (degree.select(F.col("prey").alias(f"prot_{k}"), F.col("_d").alias(f"_d{k}")) for k in "12")
    first = F.col("_d1") <= F.col("_d2")
    pairs = pairs.join(d1, "prot_1").join(d2, "prot_2").select("prot_1", "prot_2", F.when(first, F.col("prot_1")).otherwise(F.col("prot_2")).alias("_short"),
                                                              F.when(first, F.col("prot_2")).otherwise(F.col("prot_1")).alias("_long"))
    short, long_ = (e.select(F.col("prey").alias(p), "target") for p in ("_short", "_long"))
    shared = pairs.join(short, "_short").join(long_, ["_long", "target"], "left_semi").groupBy("prot_1", "prot_2")
    if not listed:
        return shared.agg(F.count("*").alias("_n")).filter(F.col("_n") >= threshold).select("prot_1", "prot_2")
    shared = shared.agg(F.array_sort(F.collect_list("target")).alias("shared_targets"))
    return shared.filter(F.size("shared_targets") >= threshold)


def ego_network(edges: DataFrame, egos: DataFrame, second: DataFrame) -> DataFrame:
    """(ego, a, b, direct): edges among each ego and its partners, and second neighbours among them."""
    u, second = cut_lineage(unique_interactions(edges)), cut_lineage(second)
    partner = both_ways(u, "prot_1", "prot_2").select(F.col("prot_1").alias("ego"), F.col("prot_2").alias("a")).join(egos, "ego", "left_semi")
    members = cut_lineage(partner.unionByName(egos.select("ego", F.col("ego").alias("a")).join(partner.select("ego").distinct(), "ego", "left_semi")))
    right = members.select("ego", F.col("a").alias("b"))

    def inside(pairs, direct):
        lists = pairs.select(F.col("prot_1").alias("a"), F.col("prot_2").alias("b"))
        return intersect_lists(members, lists, "a", right, "ego", "b").select("ego", "a", "b", F.lit(direct).alias("direct"))
    return inside(u, True).unionByName(inside(second, False))


def induced_subgraph(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """(cluster_id, target, prey, ...) edges with both ends in a cluster, without self edges."""
    m = membership.select("cluster_id", "gene").distinct()
    e = edges.filter("target <> prey").join(m.withColumnRenamed("gene", "target"), "target")
    return e.join(m.withColumnRenamed("gene", "prey"), ["cluster_id", "prey"], "left_semi")


def prune_single_edges(edges: DataFrame, max_rounds: int = 1000) -> DataFrame:
    """Drop targets and preys with fewer than two rows, counted together, until none is left."""
    cur = cut_lineage(edges.filter("target <> prey"))
    n = cur.count()
    for _ in range(max_rounds):
        t = cur.groupBy("target").agg(F.count("*").alias("n")).filter("n >= 2").select("target")
        p = cur.groupBy("prey").agg(F.count("*").alias("n")).filter("n >= 2").select("prey")
        cur = cut_lineage(cur.join(t, "target", "left_semi").join(p, "prey", "left_semi"))
        left = cur.count()
        if left == n:
            return cur
        n = left
    raise RuntimeError(f"not settled after {max_rounds} rounds")


def haircut(membership: DataFrame, edges: DataFrame, weight: str | None = None, above: float = 0.0) -> DataFrame:
    """One trim of all clusters: members touching at least two others (or with an edge above a weight) stay."""
    inner = induced_subgraph(edges, membership)
    ends = both_ways(inner.select("cluster_id", "target", "prey", *([weight] if weight else [])), "target", "prey")
    keep = F.count_distinct("prey") >= 2
    if weight:
        keep = keep | F.coalesce(F.max(weight) > above, F.lit(False))
    ok = ends.groupBy("cluster_id", F.col("target").alias("gene")).agg(keep.alias("_k")).filter("_k").select("cluster_id", "gene")
    return membership.join(ok, ["cluster_id", "gene"], "left_semi")


def recursive_haircut(membership: DataFrame, edges: DataFrame, weight: str | None = None, above: float = 0.0, max_rounds: int = 1000) -> DataFrame:
    cur = cut_lineage(membership)
    n = cur.count()
    for _ in range(max_rounds):
        cur = cut_lineage(haircut(cur, edges, weight, above))
        left = cur.count()
        if left == n:
            return cur
        n = left
    raise RuntimeError(f"not settled after {max_rounds} rounds")


# --- clustering ----------------------------------------------------------------------------------

def mcl_clusters(membership: DataFrame, edges: DataFrame, first_thresh: int, mcl_thresh: int, inflation: float = 2.0,
                 weight: str | None = None, prune: float = 0.001, max_rounds: int = 100, select: int = 1000) -> DataFrame:
    """(super_cluster, second_clustering, cluster, gene): Markov clustering inside large clusters.

    All clusters advance together.  Between two rounds, and before the first, a column keeps its ``select`` largest entries (ties:
    its own loop, then the smallest name), so a round starts from nodes x ``select`` rows.  Entries above 1 / ``select`` are never
    cut, so with the default only ties of a column's maximum can be.  The row of a hub is multiplied in blocks with keys of their own.
    """
    size = membership.groupBy("cluster_id").agg(F.count("*").alias("_n"))
    sized = membership.join(size, "cluster_id")
    small = sized.filter(F.col("_n") < first_thresh)
    inner = induced_subgraph(edges, sized.filter(F.col("_n") >= first_thresh))
    w = F.max(weight) if weight else F.lit(1.0)
    one = inner.groupBy("cluster_id", F.least("target", "prey").alias("i"), F.greatest("target", "prey").alias("j")).agg(w.cast("double").alias("v"))
    m = both_ways(one, "i", "j")
    loops = m.select("cluster_id", F.col("i"), F.col("i").alias("j"), F.lit(1.0).alias("v")).distinct()
    m = cut_lineage(_columns_to_one(m.unionByName(loops), 1.0, 0.0, select))
    for _ in range(max_rounds):
        nxt = cut_lineage(_columns_to_one(_squared(m), inflation, prune, select))
        diff = nxt.withColumnRenamed("v", "_w").join(m, ["cluster_id", "i", "j"], "full").na.fill(0.0, ["v", "_w"])
        moved = not diff.filter(F.abs(F.col("v") - F.col("_w")) > 1e-8 + 1e-5 * F.abs("_w")).isEmpty()
        m = nxt
        if not moved:
            break
    else:
        raise RuntimeError(f"clustering not settled after {max_rounds} rounds")
    centre = m.filter("i = j").select("cluster_id", "i")
    label = m.join(centre, ["cluster_id", "i"]).groupBy("cluster_id", F.col("j").alias("gene")).agg(F.min("i").alias("cluster"))
    enough = label.groupBy("cluster_id", "cluster").agg(F.count("*").alias("n")).filter(F.col("n") >= mcl_thresh).select("cluster_id", "cluster")
    split = label.join(enough, ["cluster_id", "cluster"])
    cols = [F.col("cluster_id").alias("super_cluster"), "second_clustering", "cluster", "gene"]
    return split.withColumn("second_clustering", F.lit(True)).select(*cols).unionByName(
        small.withColumns({"second_clustering": F.lit(False), "cluster": F.lit(None).cast("string")}).select(*cols))


def _squared(m: DataFrame, block: int = HUB_BLOCK) -> DataFrame:
    """The matrix times itself: the row of k, cut into blocks, meets the column of k in every block."""
    parts = m.groupBy("cluster_id", F.col("i").alias("k")).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    key = ["cluster_id", "k"]
    left = m.select("cluster_id", "i", F.col("j").alias("k"), F.col("v").alias("a")).join(parts, key) \
            .withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))).drop("_blocks")
    right = m.select("cluster_id", F.col("i").alias("k"), "j", F.col("v").alias("b")).join(parts, key) \
             .withColumn("_b", F.pmod(F.xxhash64("j"), "_blocks").cast("int")).drop("_blocks")
    return left.join(right, [*key, "_b"]).groupBy("cluster_id", "i", "j").agg(F.sum(F.col("a") * F.col("b")).alias("v"))


def _columns_to_one(m: DataFrame, power: float, prune: float, select: int) -> DataFrame:
    """Raise entries to a power, scale columns to sum 1, keep entries above ``prune`` and column maxima, at most ``select`` a column."""
    p = m.withColumn("v", F.pow("v", F.lit(power)))
    s = p.groupBy("cluster_id", "j").agg(F.sum("v").alias("_s"), F.max("v").alias("_m"))
    kept = p.join(s, ["cluster_id", "j"]).withColumn("_x", F.col("v") / F.col("_s")).filter((F.col("_x") >= prune) | (F.col("v") == F.col("_m")))
    # rounded, as equal entries may be summed in different orders
    order = [F.desc(F.round("_x", 12)), F.desc(F.col("i") == F.col("j")), F.asc("i")]
    return top_n(kept, ["cluster_id", "j"], order, select).select("cluster_id", "i", "j", F.col("_x").alias("v"))


# --- membership ----------------------------------------------------------------------------------

def explode_members(clusters: DataFrame, members: str = "members", sep: str = " ") -> DataFrame:
    """(cluster_id, gene) from a text of member names."""
    return clusters.select("cluster_id", F.explode(F.split(F.trim(members), sep)).alias("gene"))


def members_text(membership: DataFrame, sep: str = " ") -> DataFrame:
    """The inverse, one row per cluster as cluster files have it."""
    return membership.groupBy("cluster_id").agg(F.array_join(F.array_sort(F.collect_set("gene")), sep).alias("members"))


def annotate_first_cluster(points: DataFrame, membership: DataFrame) -> DataFrame:
    return points.join(membership.groupBy("gene").agg(F.min("cluster_id").alias("cluster_id")), "gene", "left")


def find_gene_clusters(membership: DataFrame, genes: DataFrame) -> DataFrame:
    """Clusters holding each gene, with their size."""
    size = membership.groupBy("cluster_id").agg(F.count_distinct("gene").alias("n_members"))
    return genes.join(membership, "gene").select("gene", "cluster_id").distinct().join(size, "cluster_id")


def cluster_heatmap_rows(edges: DataFrame, membership: DataFrame, weight: str, carry: list[str]) -> DataFrame:
    """One tile per (cluster, target, prey): indices by falling total weight, ids both ends share, best edge."""
    best = edges.filter("target <> prey").groupBy("target", "prey").agg(F.max(F.struct(weight, *carry)).alias("_b"))
    tiles = induced_subgraph(best, membership).select("cluster_id", "target", "prey", *[F.col(f"_b.{c}").alias(c) for c in [weight, *carry]])

    def order(end, out):
        d = tiles.groupBy("cluster_id", end).agg((-F.round(F.sum(weight), 9)).alias("_w"))  # rounded, so that equal totals tie in any order of summation
        return grouped_ranks(d, ["cluster_id"], "_w", [end], out="_i").select("cluster_id", end, (F.col("_i") - 1).alias(out))
    ids = membership.groupBy("cluster_id", "gene").agg(F.min("subcluster_id").alias("s"), F.min("core_id").alias("c"))
    t = ids.select("cluster_id", F.col("gene").alias("target"), F.col("s").alias("ts"), F.col("c").alias("tc"))
    p = ids.select("cluster_id", F.col("gene").alias("prey"), F.col("s").alias("ps"), F.col("c").alias("pc"))
    return (tiles.join(order("target", "col_index"), ["cluster_id", "target"]).join(order("prey", "row_index"), ["cluster_id", "prey"])
            .join(t, ["cluster_id", "target"]).join(p, ["cluster_id", "prey"])
            .select("cluster_id", "target", "prey", "col_index", "row_index", F.when(F.col("ts") == F.col("ps"), F.col("ts")).alias("subcluster_id"),
                    F.when(F.col("tc") == F.col("pc"), F.col("tc")).alias("core_complex_id"), weight, *carry))


def attach_hit_ids(rows: DataFrame, hits: DataFrame, keys: list[str]) -> DataFrame:
    """Id of the significant hit with the same keys and the highest p value (smallest id on ties)."""
    best = hits.filter("is_significant").groupBy(*keys).agg(F.max(F.struct("pval", (-F.col("hit_id")).alias("_i"), "hit_id")).alias("_b"))
    return rows.join(best.select(*keys, F.col("_b.hit_id").alias("hit_id")), keys, "left")


# --- agreement with reference sets ---------------------------------------------------------------

def _oriented(pairs: DataFrame) -> DataFrame:
    """Reference pairs as (pair, a, b), in both orders; the pair id is the pair itself."""
    p = pairs.select("prot_1", "prot_2").distinct().withColumn("pair", F.struct("prot_1", "prot_2"))
    return both_ways(p, "prot_1", "prot_2").withColumnsRenamed({"prot_1": "a", "prot_2": "b"})


def covered_pairs(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(target, prey, pair) for every edge that is a reference pair in either orientation."""
    e = edges.select("target", "prey").distinct()
    return _oriented(pairs).withColumnsRenamed({"a": "target", "b": "prey"}).join(e, ["target", "prey"], "left_semi")


def coverage_pairs(edges: DataFrame, pairs: DataFrame, directional: bool = False, all_nodes: bool = False) -> DataFrame:
    """(covered, possible): reference pairs seen, of those that touch a target."""
    nodes = edges.select(F.col("target").alias("a"))
    if all_nodes:
        nodes = nodes.unionByName(edges.select(F.col("prey").alias("a")))
    touch = _oriented(pairs).join(nodes.distinct(), "a", "left_semi")
    count = F.count("*") if directional else F.count_distinct("pair")
    return covered_pairs(edges, pairs).agg(count.alias("covered")).join(F.broadcast(touch.agg(count.alias("possible"))), F.lit(True))


def coverage_marginals(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    c = covered_pairs(edges, pairs).groupBy("target").agg(F.count("*").alias("covered"))
    return edges.select("target").distinct().join(c, "target", "left").na.fill(0, ["covered"])


def expanded_coverage(edges: DataFrame, pairs: DataFrame, level: str | None = None, n: int = 0) -> DataFrame:
    """(pair, a, b, possible, covered) per oriented reference pair whose a is a target.

    A pair is covered by an edge a-b, or by a covered prey of a that is itself a target and has b as
    prey.  With ``level`` (a score column) the two results are the largest thresholds below which the
    pair is possible and covered; without it they are 1 or NULL.  ``n`` edges, if known, are ``dealt``.
    """
    e = edges.select("target", "prey", (F.col(level) if level else F.lit(1.0)).alias("lv"))
    tgt = e.groupBy(F.col("target").alias("a")).agg(F.max("lv").alias("possible"))
    e = dealt(e, n, "target", "prey").groupBy("target", "prey").agg(F.max("lv").alias("lv"))
    p = pairs.select("prot_1", "prot_2").distinct()
    o = p.select(F.col("prot_1").alias("a"), F.col("prot_2").alias("b"), F.lit(False).alias("flip"))
    o = o.unionByName(p.select(F.col("prot_2").alias("a"), F.col("prot_1").alias("b"), F.lit(True).alias("flip")))
    ref = o.join(tgt, "a").join(e.select(F.col("target").alias("a"), F.col("prey").alias("b"), F.col("lv").alias("direct")), ["a", "b"], "left")
    ref = cut_lineage(ref)  # read by the lists, the pairs and the result
    # only a prey that is a target itself leads on, and only to more than the pair's own edge gives
    left = ref.filter("direct is not null").groupBy("a", F.col("b").alias("c")).agg(F.max("direct").alias("l1"))
    left = left.join(tgt.select(F.col("a").alias("c")), "c", "left_semi")
    right = e.select(F.col("prey").alias("b"), F.col("target").alias("c"), F.col("lv").alias("l2"))
    short = ref.filter("direct is null or direct < possible").select("a", "b", "flip", "direct")
    hop = intersect_lists(short, left, "a", right, "b", "c").filter("direct is null or l1 > direct").filter("direct is null or l2 > direct")
    rows = ref.select("a", "b", "flip", "possible", F.col("direct").alias("covered"))
    rows = rows.unionByName(hop.select("a", "b", "flip", F.least("l1", "l2").alias("covered")), allowMissingColumns=True)
    one, two = F.when(F.col("flip"), F.col("b")).otherwise(F.col("a")), F.when(F.col("flip"), F.col("a")).otherwise(F.col("b"))
    rows = rows.select(one.alias("prot_1"), two.alias("prot_2"), "flip", "possible", "covered")
    rows = dealt(rows.repartition("prot_1", "prot_2"), ref.count() if n else 0, "prot_1", "prot_2")
    rows = rows.groupBy("prot_1", "prot_2", "flip").agg(F.max("possible").alias("possible"), F.max("covered").alias("covered"))
    one, two = (F.when(F.col("flip"), F.col(x)).otherwise(F.col(y)) for x, y in (("prot_2", "prot_1"), ("prot_1", "prot_2")))
    return rows.select(F.struct("prot_1", "prot_2").alias("pair"), one.alias("a"), two.alias("b"), "possible", "covered")


def coverage_expanded(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    x = expanded_coverage(edges, pairs).groupBy("pair").agg(F.max("covered").alias("c"))
    return x.agg(F.count("c").alias("covered"), F.count("*").alias("possible"))


def uncovered_partners(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """(target, partner) of reference pairs a target misses."""
    return expanded_coverage(edges, pairs).filter("covered is null").select(F.col("a").alias("target"), F.col("b").alias("partner"))


def pair_precision(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Edges with both ends in the reference set, flagged when they are a reference pair."""
    o = _oriented(pairs)
    genes = o.select(F.col("a").alias("g")).distinct()
    known = edges.select("target", "prey").distinct() \
        .join(genes.withColumnRenamed("g", "target"), "target", "left_semi").join(genes.withColumnRenamed("g", "prey"), "prey", "left_semi")
    ref = o.select(F.col("a").alias("target"), F.col("b").alias("prey"), F.lit(True).alias("_r")).distinct()
    return known.join(ref, ["target", "prey"], "left").select("target", "prey", F.coalesce("_r", F.lit(False)).alias("precision"))


def coessential_coverage(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges whose ends share a gene set, and their percentage.  ``sets``: (set_id, gene)."""
    e = edges.filter("target <> prey").select("target", "prey")
    inside = shared_set_edges(e.distinct(), sets)
    return inside.agg(F.count("*").alias("n_shared")).join(F.broadcast(e.agg(F.count("*").alias("_n"))), F.lit(True)).select(
        "n_shared", (100 * F.col("n_shared") / F.col("_n")).alias("percent"))


def shared_set_edges(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """Distinct edges whose two ends are members of one set."""
    m = sets.select("set_id", "gene").distinct()
    return intersect_lists(edges, m.select(F.col("gene").alias("target"), "set_id"), "target",
                           m.select(F.col("gene").alias("prey"), "set_id"), "prey", "set_id", task_rows=TASK_ROWS).select("target", "prey").distinct()


def cluster_coverage(edges: DataFrame, membership: DataFrame) -> DataFrame:
    """Percentage of edge rows inside any cluster."""
    inside = shared_set_edges(edges.select("target", "prey").distinct(), membership.withColumnRenamed("cluster_id", "set_id")).withColumn("_in", F.lit(1))
    return edges.select("target", "prey").join(inside, ["target", "prey"], "left").agg((100 * F.count("_in") / F.count("*")).alias("percent"))


def colocalization(edges: DataFrame, localization: DataFrame, extra: list[str] = ()) -> DataFrame:
    """Edges with both ends localised, flagged when labels overlap or either end is everywhere ('B')."""
    loc = localization.select("gene", "label")
    j = (edges.filter("target <> prey").select("target", "prey", *extra)
         .join(loc.withColumnsRenamed({"gene": "target", "label": "_t"}), "target")
         .join(loc.withColumnsRenamed({"gene": "prey", "label": "_p"}), "prey"))
    t, p = F.split("_t", "/"), F.split("_p", "/")  # cut after the joins, which carry the plain labels
    same = F.arrays_overlap(t, p) | F.array_contains(t, "B") | F.array_contains(p, "B")
    return j.select("target", "prey", *extra, same.alias("colocalized"))


def spatial_distance(edges: DataFrame, coordinates: DataFrame) -> DataFrame:
    """Distance between the mean positions of both ends.  ``coordinates``: (gene, x, y)."""
    c = coordinates.groupBy("gene").agg(F.avg("x").alias("x"), F.avg("y").alias("y"))
    t = c.withColumnsRenamed({"gene": "target", "x": "tx", "y": "ty"})
    p = c.withColumnsRenamed({"gene": "prey", "x": "px", "y": "py"})
    d = F.sqrt(F.pow(F.col("tx") - F.col("px"), 2) + F.pow(F.col("ty") - F.col("py"), 2))
    return edges.select("target", "prey").join(t, "target").join(p, "prey").select("target", "prey", d.alias("distance"))


def at_thresholds(levels: DataFrame, level: str, thresholds: list[float], counts: dict[str, Column]) -> DataFrame:
    """Aggregates over the rows above each threshold, from one pass.

    Rows are summed by the number of thresholds they pass; only those few sums are then spread over
    the thresholds below.
    """
    cuts = F.array(*[F.lit(float(x)) for x in sorted(thresholds)])
    passed = F.size(F.filter(cuts, lambda x: x < F.col(level)))
    per = levels.groupBy(passed.alias("_k")).agg(*[c.alias(n) for n, c in counts.items()]).filter("_k > 0")
    spread = per.withColumn("threshold", F.explode(F.slice(cuts, F.lit(1), F.col("_k"))))
    return spread.groupBy("threshold").agg(*[F.sum(n).alias(n) for n in counts])


def precision_recall(scores: DataFrame, level: Column, pairs: DataFrame, localization: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, num_interactions, recall, precision): hits are the rows whose level exceeds the threshold."""
    cuts = sorted(float(x) for x in thresholds)
    # a level counts by the number of thresholds it passes; rows that pass none are in no result
    passed = F.size(F.filter(F.array(*[F.lit(x) for x in cuts]), lambda x: x < F.col("lv"))).alias("lv")
    s = scores.select("target", "prey", level.alias("lv")).filter("lv is not null").select("target", "prey", passed).filter("lv > 0")
    at = list(range(len(cuts)))
    n = at_thresholds(s, "lv", at, {"num_interactions": F.count("*")})
    rows = s.count()
    x = expanded_coverage(s, pairs, "lv", rows).groupBy("pair.prot_1", "pair.prot_2").agg(F.max("possible").alias("possible"), F.max("covered").alias("covered"))
    x = cut_lineage(x.groupBy("possible", "covered").agg(F.count("*").alias("n")))  # counted twice below
    possible = at_thresholds(x, "possible", at, {"possible": F.sum("n")})
    covered = at_thresholds(x.filter("covered is not null"), "covered", at, {"covered": F.sum("n")})
    u = unique_interactions(s, weight="lv", n=rows).withColumnsRenamed({"prot_1": "target", "prot_2": "prey"})
    loc = at_thresholds(colocalization(u, localization, ["lv"]), "lv", at, {"known": F.count("*"), "same": F.count_if("colocalized")})
    j = scores.sparkSession.createDataFrame([(float(i), x) for i, x in enumerate(cuts)], "threshold double, _x double")
    for part in (n, possible, covered, loc):
        j = j.join(part, "threshold", "left")
    return j.select(F.col("_x").alias("threshold"), F.coalesce("num_interactions", F.lit(0)).alias("num_interactions"),
                    F.try_divide(F.coalesce("covered", F.lit(0)), "possible").alias("recall"), F.try_divide("same", "known").alias("precision"))


def poor_annotation(edges: DataFrame, annotated: DataFrame, membership: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Poorly annotated genes of the network with first cluster and interactor count, and their interactors as rows."""
    partners = both_ways(edges.select("target", "prey"), "target", "prey").withColumnsRenamed({"target": "gene", "prey": "interactor"})
    mine = partners.join(annotated.select("gene"), "gene", "left_semi")
    count = mine.groupBy("gene").agg(F.count("*").alias("interactor_count"))
    return annotate_first_cluster(annotated.join(count, "gene"), membership), mine


# --- networks around pulldowns -------------------------------------------------------------------

def interacting_pulldowns(pulldowns: DataFrame, lines: DataFrame, hits: DataFrame, group_designs: DataFrame) -> DataFrame:
    """(pulldown_id, other): displayed pulldowns in which a group of the pulldown's target is a hit."""
    from .hits import displayed, significant_hits
    own = pulldowns.join(lines.select("line_id", "design_id"), "line_id").join(group_designs, "design_id").select("pulldown_id", "group_id").distinct()
    shown = pulldowns.filter(displayed("display_flag")).select(F.col("pulldown_id").alias("other"))
    seen = significant_hits(hits).select(F.col("pulldown_id").alias("other"), "group_id").join(shown, "other", "left_semi")
    return own.join(seen, "group_id").filter("pulldown_id <> other").select("pulldown_id", "other").distinct()


def network_nodes(hits: DataFrame, bait: DataFrame, interacting: DataFrame) -> DataFrame:
    """(pulldown_id, node_group, type, source_pulldown, pval, enrichment): origin, its hits, its interacting pulldowns.

    ``bait``: best bait hit per pulldown; source_pulldown is the pulldown a node itself stands for.
    """
    from .hits import significant_hits
    sig = significant_hits(hits)
    scored = bait.select("pulldown_id", "hit_id").join(hits.select("hit_id", "pval", "enrichment"), "hit_id")
    origin = bait.select("pulldown_id", F.col("group_id").alias("origin"))
    none = F.lit(None).cast("bigint")
    cols = ["pulldown_id", "node_group", "type", "source_pulldown", "pval", "enrichment"]
    a = origin.join(scored, "pulldown_id").select("pulldown_id", F.col("origin").alias("node_group"), F.lit("bait").alias("type"),
                                                  F.col("pulldown_id").alias("source_pulldown"), "pval", "enrichment")
    b = sig.join(origin, "pulldown_id").filter("group_id <> origin").select("pulldown_id", F.col("group_id").alias("node_group"), F.lit("hit").alias("type"),
                                                                           none.alias("source_pulldown"), "pval", "enrichment")
    seen = sig.groupBy(F.col("pulldown_id").alias("other"), F.col("group_id").alias("origin")).agg(F.min(F.struct("hit_id", "pval", "enrichment")).alias("h"))
    c = (interacting.join(origin, "pulldown_id").join(bait.select(F.col("pulldown_id").alias("other"), F.col("group_id").alias("node_group")), "other")
         .join(seen, ["other", "origin"])
         .select("pulldown_id", "node_group", F.lit("pulldown").alias("type"), F.col("other").alias("source_pulldown"), F.col("h.pval").alias("pval"), F.col("h.enrichment").alias("enrichment")))
    return a.select(*cols).unionByName(b.select(*cols)).unionByName(c.select(*cols))


def network_edges(nodes: DataFrame, hits: DataFrame, group_designs: DataFrame, designs: DataFrame, best_lines: DataFrame, best_pulldowns: DataFrame) -> DataFrame:
    """(pulldown_id, source, target): a node's own hits that are nodes of the same network.

    Hit nodes stand for a pulldown only when their group maps to one distinct uniprot id.
    """
    from .hits import significant_hits
    single = group_designs.join(designs.select("design_id", "uniprot_id"), "design_id").groupBy("group_id").agg(F.count_distinct("uniprot_id").alias("n")).filter("n = 1")
    stand = (group_designs.join(single, "group_id", "left_semi").join(best_lines.select("design_id", "line_id"), "design_id")
             .join(best_pulldowns.withColumnRenamed("pulldown_id", "_p"), "line_id").groupBy("group_id").agg(F.min_by("_p", "design_id").alias("_p")))
    n = nodes.join(stand.withColumnRenamed("group_id", "node_group"), "node_group", "left").withColumn(
        "source_pulldown", F.when(F.col("type") == "hit", F.col("_p")).otherwise(F.col("source_pulldown")))
    pairs = n.filter("source_pulldown is not null").select("pulldown_id", F.col("node_group").alias("source"), "source_pulldown").distinct()
    left = significant_hits(hits).select(F.col("pulldown_id").alias("source_pulldown"), F.col("group_id").alias("target")).distinct()
    right = nodes.select("pulldown_id", F.col("node_group").alias("target")).distinct()
    return (intersect_lists(pairs, left, "source_pulldown", right, "pulldown_id", "target").filter("source <> target")
            .select("pulldown_id", "source", "target").distinct())


def compound_nodes(nodes: DataFrame, clusters: DataFrame) -> DataFrame:
    """Nodes with the parent they are drawn in: the subcluster, else the cluster, of clusters with several nodes.

    ``clusters``: (node_group, cluster_id, subcluster_id), first row per group; id 0 counts as none.
    """
    first = clusters.groupBy("node_group").agg(F.min(F.struct("cluster_id", "subcluster_id")).alias("c")).select("node_group", "c.*")
    ids = nodes.select("pulldown_id", "node_group").distinct().join(first, "node_group")
    many = ids.groupBy("pulldown_id", "cluster_id").agg(F.count("*").alias("n")).filter("n > 1").select("pulldown_id", "cluster_id")
    kept = ids.join(many, ["pulldown_id", "cluster_id"])
    parent = F.when(F.col("subcluster_id") != 0, F.concat_ws("-", F.coalesce(F.col("cluster_id").cast("string"), F.lit("None")), "subcluster_id")) \
        .when(F.col("cluster_id") != 0, F.col("cluster_id").cast("string"))
    return nodes.join(kept, ["pulldown_id", "node_group"], "left").withColumn("parent", parent)


def parent_nodes(compound: DataFrame) -> DataFrame:
    """(pulldown_id, id, parent) of the cluster and subcluster boxes."""
    c = compound.filter("cluster_id is not null")
    top = c.select("pulldown_id", F.col("cluster_id").cast("string").alias("id"), F.lit(None).cast("string").alias("parent"))
    sub = c.filter("subcluster_id is not null and parent <> cast(cluster_id as string)").select("pulldown_id", F.col("parent").alias("id"), F.col("cluster_id").cast("string").alias("parent"))
    return top.unionByName(sub).distinct()


def group_associations(groups: DataFrame, uniprot: DataFrame, reference: DataFrame, designs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt bridges: group to the reference entry of its ensg ids, and group to designs of the same ensg id."""
    from ..functions import cols as C
    ids = groups.select("group_id", F.explode(F.split("uniprot_ids", ";")).alias("u")).select("group_id", C.strip_isoform("u").alias("uniprot_id")).distinct()
    ensg = ids.join(uniprot.select("uniprot_id", "ensg_id"), "uniprot_id").filter("ensg_id is not null").select("group_id", "ensg_id").distinct()
    to_uniprot = ensg.join(reference.select("ensg_id", "uniprot_id"), "ensg_id").select("group_id", "uniprot_id").distinct()
    d = designs.join(uniprot.select("uniprot_id", "ensg_id"), "uniprot_id").select("design_id", "ensg_id")
    return to_uniprot, ensg.join(d, "ensg_id").select("group_id", "design_id").distinct()


def target_group_audit(groups: DataFrame, uniprot: DataFrame, designs: DataFrame, bridge: DataFrame) -> DataFrame:
    """(problem, entity): targets in no group, groups with no or several ensg ids, groups of several targets."""
    from ..functions import cols as C
    ids = groups.select("group_id", F.explode(F.split("uniprot_ids", ";")).alias("u")).select("group_id", C.strip_isoform("u").alias("uniprot_id"))
    n = groups.select("group_id").join(ids.join(uniprot.select("uniprot_id", "ensg_id"), "uniprot_id").filter("ensg_id is not null")
                                       .groupBy("group_id").agg(F.count_distinct("ensg_id").alias("n")), "group_id", "left").na.fill(0, ["n"])
    def row(df, text, c):
        return df.select(F.lit(text).alias("problem"), F.col(c).cast("string").alias("entity"))
    several = bridge.groupBy("group_id").agg(F.count_distinct("design_id").alias("n")).filter("n > 1")
    return (row(designs.join(bridge, "design_id", "left_anti"), "target in no group", "target_name")
            .unionByName(row(n.filter("n = 0"), "group without ensg", "group_id")).unionByName(row(n.filter("n > 1"), "group with several ensg", "group_id"))
            .unionByName(row(several, "group of several targets", "group_id")))
