"""Queries for interaction networks."""

from pyspark.sql import functions as F

from ..operators import entities as E, network as N
from ..operators.communities import modularity_split
from ..operators.embeddings import node_embeddings as embed
from ..registry import query
from .relational import BRIDGE, REF_UNIPROT, SIG, rounded

UNI = "(select distinct least(target, prey) as a, greatest(target, prey) as b from {edges} where target <> prey)"


@query("unique_interactions", "select least(target, prey) as prot_1, greatest(target, prey) as prot_2, max(weight) as weight from {edges} where target <> prey group by 1, 2")
def unique_interactions(t):
    return N.unique_interactions(t.edges, weight="weight")


def u32(tag):
    return f"cast('0x' || substr(md5(concat_ws('|', target, prey, '{tag}')), 1, 8) as bigint)"


@query("null_network", f"""with a as (select target, row_number() over (order by {u32('a')}, target, prey) as r from {{edges}}), b as (select prey, row_number() over (order by {u32('b')}, target, prey) as r from {{edges}})
    select target, prey from a join b using (r)""")
def null_network(t):
    return N.null_network(t.edges)


SECOND = f"""(select a.prey as prot_1, b.prey as prot_2, string_agg(a.target, ',' order by a.target) as shared_targets from {{edges}} a join {{edges}} b on a.target = b.target and a.prey < b.prey
    where not exists (select 1 from {UNI} u where u.a = a.prey and u.b = b.prey) group by 1, 2 having count(*) >= 3)"""


@query("second_neighbors", SECOND[1:-1])
def second_neighbors(t):
    return N.second_neighbors(t.edges).withColumn("shared_targets", F.array_join("shared_targets", ","))


EGOS = "select concat('G', s_suppkey) as ego from {supplier}"


@query("ego_network", f"""with u as materialized {UNI}, s as materialized {SECOND}, p as (select a as ego, b as m from u union select b, a from u), m as (select ego, m from p where ego in ({EGOS}) union select distinct ego, ego from p where ego in ({EGOS}))
    select x.ego, u.a, u.b, true as direct from u join m x on x.m = u.a join m y on y.m = u.b and y.ego = x.ego union all
    select x.ego, s.prot_1, s.prot_2, false from s join m x on x.m = s.prot_1 join m y on y.m = s.prot_2 and y.ego = x.ego""")
def ego_network(t):
    return N.ego_network(t.edges, t.sql(EGOS), N.second_neighbors(t.edges, listed=False))


INDUCED = "(select a.cluster_id, e.* from {edges} e join {clusters} a on a.gene = e.target join {clusters} b on b.gene = e.prey and b.cluster_id = a.cluster_id where target <> prey)"


@query("induced_subgraph", INDUCED[1:-1])
def induced_subgraph(t):
    return N.induced_subgraph(t.edges, t.clusters)


# more rounds than either table needs: further rounds change nothing once the fixed point is reached
PRUNE = "with r0 as materialized (select target, prey, weight from {edges} where target <> prey)" + "".join(
    f", r{i} as materialized (select * from r{i - 1} where target in (select target from r{i - 1} group by 1 having count(*) >= 2) and prey in (select prey from r{i - 1} group by 1 having count(*) >= 2))"
    for i in range(1, 13)) + " select * from r12"


@query("prune_single_edges", PRUNE)
def prune_single_edges(t):
    return N.prune_single_edges(t.edges).select("target", "prey", "weight")


BIG = "select concat('C', p_size % 5) as cluster_id, concat('G', p_partkey) as gene from {part}"
BIG_IN = f"(select a.cluster_id, target, prey, weight from {{edges}} e join ({BIG}) a on a.gene = e.target join ({BIG}) b on b.gene = e.prey and b.cluster_id = a.cluster_id where target <> prey)"


@query("haircut", f"""with i as {BIG_IN}, e as (select cluster_id, target as g, prey as o from i union select cluster_id, prey, target from i), k as (select cluster_id, g from e group by 1, 2 having count(distinct o) >= 2)
    select m.cluster_id, m.gene from ({BIG}) m join k on k.cluster_id = m.cluster_id and k.g = m.gene""")
def haircut(t):
    return N.haircut(t.sql(BIG), t.edges)


HAIRCUT = f"with m0 as materialized ({BIG})" + "".join(
    f""", i{i} as (select a.cluster_id, target, prey from {{edges}} e join m{i - 1} a on a.gene = e.target join m{i - 1} b on b.gene = e.prey and b.cluster_id = a.cluster_id where target <> prey),
    m{i} as materialized (select * from m{i - 1} m where (cluster_id, gene) in (select (cluster_id, g) from (select cluster_id, target as g, prey as o from i{i} union select cluster_id, prey, target from i{i}) u group by cluster_id, g having count(distinct o) >= 2))"""
    for i in range(1, 9)) + " select cluster_id, gene from m8"


@query("recursive_haircut", HAIRCUT)
def recursive_haircut(t):
    return N.recursive_haircut(t.sql(BIG), t.edges)


@query("mcl_clusters")
def mcl_clusters(t):
    return N.mcl_clusters(t.clusters, t.edges, first_thresh=30, mcl_thresh=2)


@query("newman_clusters")
def newman_clusters(t):
    return modularity_split(t.clusters, t.edges, first_thresh=30)


@query("explode_membership", """select c.gene, c.cluster_id, length(m.members) as n_chars, f.first_id from {clusters} c join (select cluster_id, string_agg(gene, ' ' order by gene) as members from {clusters} group by 1) m on m.cluster_id = c.cluster_id
    join (select gene, min(cluster_id) as first_id from {clusters} group by 1) f on f.gene = c.gene""")
def explode_membership(t):
    text = N.members_text(t.clusters)
    rows = N.explode_members(text).join(text.select("cluster_id", F.length("members").cast("bigint").alias("n_chars")), "cluster_id")
    first = N.annotate_first_cluster(t.clusters.select("gene").distinct(), t.clusters).withColumnRenamed("cluster_id", "first_id")
    return rows.join(first, "gene").select("gene", "cluster_id", "n_chars", "first_id")


@query("find_gene_clusters", "select concat('G', s_suppkey) as gene, cluster_id, (select count(distinct gene) from {clusters} x where x.cluster_id = c.cluster_id) as n_members from supplier join {clusters} c on c.gene = concat('G', s_suppkey)")
def find_gene_clusters(t):
    return N.find_gene_clusters(t.clusters, t.sql("select concat('G', s_suppkey) as gene from {supplier}"))


@query("cluster_heatmap_rows", """with b as (select target, prey, pvals, plate, row_key from (select *, row_number() over (partition by target, prey order by pvals desc, plate desc, row_key desc) as r from {scores} where target <> prey) q where r = 1),
    i as (select c.cluster_id, b.*, c.subcluster_id as ts, d.subcluster_id as ps, c.core_id as tc, d.core_id as pc from b join {clusters} c on c.gene = b.target join {clusters} d on d.gene = b.prey and d.cluster_id = c.cluster_id),
    t as (select cluster_id, target, row_number() over (partition by cluster_id order by -round(sum(pvals), 9), target) - 1 as col_index from i group by 1, 2), p as (select cluster_id, prey, row_number() over (partition by cluster_id order by -round(sum(pvals), 9), prey) - 1 as row_index from i group by 1, 2)
    select i.cluster_id, i.target, i.prey, col_index, row_index, case when ts = ps then ts end as subcluster_id, case when tc = pc then tc end as core_complex_id, pvals, plate, row_key from i
    join t on t.cluster_id = i.cluster_id and t.target = i.target join p on p.cluster_id = i.cluster_id and p.prey = i.prey""")
def cluster_heatmap_rows(t):
    return N.cluster_heatmap_rows(t.scores, t.clusters, "pvals", ["plate", "row_key"])


HEAT = "select distinct line_id, plate, group_id from (select p.line_id, p.plate, l_partkey as group_id from {lineitem} join {pulldown} p on p.pulldown_id = l_orderkey) q"


@query("attach_hit_ids", f"""with h as ({HEAT}), k as (select p.line_id, p.plate, h.group_id, h.hit_id, row_number() over (partition by p.line_id, p.plate, h.group_id order by pval desc, hit_id) as r from {{hit}} h join {{pulldown}} p on p.pulldown_id = h.pulldown_id where is_significant)
    select h.line_id, h.plate, h.group_id, k.hit_id from h left join k on k.line_id = h.line_id and k.plate = h.plate and k.group_id = h.group_id and r = 1""")
def attach_hit_ids(t):
    hits = t.hit.join(t.pulldown.select("pulldown_id", "line_id", "plate"), "pulldown_id")
    return N.attach_hit_ids(t.sql(HEAT), hits, ["line_id", "plate", "group_id"])


O = "(select prot_1 || '|' || prot_2 as id, prot_1 as a, prot_2 as b from {corum} union all select prot_1 || '|' || prot_2, prot_2, prot_1 from {corum})"
EE = "(select distinct target, prey from {edges})"


@query("coverage_pairs", f"""select (select count(distinct id) from {O} o join {EE} e on e.target = o.a and e.prey = o.b) as covered, (select count(distinct id) from {O} o where a in (select target from {{edges}})) as possible""")
def coverage_pairs(t):
    return N.coverage_pairs(t.edges, t.corum)


@query("coverage_pairs_directional", f"""select (select count(*) from {O} o join {EE} e on e.target = o.a and e.prey = o.b) as covered, (select count(*) from {O} o where a in (select target from {{edges}} union select prey from {{edges}})) as possible""")
def coverage_pairs_directional(t):
    return N.coverage_pairs(t.edges, t.corum, directional=True, all_nodes=True)


@query("coverage_marginals", f"select e.target, count(o.id) as covered from {EE} e left join {O} o on e.target = o.a and e.prey = o.b group by 1")
def coverage_marginals(t):
    return N.coverage_marginals(t.edges, t.corum)


COVERED = f"""c as materialized (select o.id, o.a, o.b from {O} o join {EE} e on e.target = o.a and e.prey = o.b), x as materialized (select id, a, b from c union select o.id, o.a, o.b from {O} o join c on c.a = o.a join {EE} e on e.target = c.b and e.prey = o.b)"""


@query("coverage_expanded", f"with {COVERED} select (select count(distinct id) from x) as covered, (select count(distinct id) from {O} o where a in (select target from {{edges}})) as possible")
def coverage_expanded(t):
    return N.coverage_expanded(t.edges, t.corum)


@query("coverage_uncovered", f"with {COVERED} select a as target, b as partner from {O} o where a in (select target from {{edges}}) and not exists (select 1 from x where x.a = o.a and x.b = o.b)")
def coverage_uncovered(t):
    return N.uncovered_partners(t.edges, t.corum)


@query("pair_precision", f"with o as materialized {O} select target, prey, exists (select 1 from o where o.a = target and o.b = prey) as precision from {EE} e where target in (select a from o) and prey in (select a from o)")
def pair_precision(t):
    return N.pair_precision(t.edges, t.corum)


SETS = "select concat('K', p_size % 7) as set_id, concat('G', p_partkey) as gene from {part} union all select concat('T', p_partkey % 13), concat('G', p_partkey) from {part}"


@query("coessential_coverage", f"""with s as ({SETS}), e as (select distinct target, prey from {{edges}} where target <> prey), k as (select distinct target, prey from e join s a on a.gene = target join s b on b.gene = prey and a.set_id = b.set_id)
    select count(*) as n_shared, round(100.0 * count(*) / (select count(*) from {{edges}} where target <> prey), 8) as percent from k""")
def coessential_coverage(t):
    return rounded(N.coessential_coverage(t.edges, t.sql(SETS)), "percent", digits=8)


@query("cluster_coverage", "select round(100.0 * count(*) filter (exists (select 1 from {clusters} a join {clusters} b on a.cluster_id = b.cluster_id where a.gene = e.target and b.gene = e.prey)) / count(*), 8) as percent from {edges} e")
def cluster_coverage(t):
    return rounded(N.cluster_coverage(t.edges, t.clusters), "percent", digits=8)


@query("colocalization", """select target, prey, list_has_any(string_split(p.label, '/'), string_split(q.label, '/')) or list_contains(string_split(p.label, '/'), 'B') or list_contains(string_split(q.label, '/'), 'B') as colocalized
    from {edges} join {localization} p on p.gene = target join {localization} q on q.gene = prey where target <> prey""")
def colocalization(t):
    return N.colocalization(t.edges, t.localization)


COORD = "select concat('G', p_partkey) as gene, cast(p_size as double) as x, p_retailprice as y from {part} where p_size > 5"


@query("spatial_distance", f"with c as (select gene, avg(x) as x, avg(y) as y from ({COORD}) q group by 1) select target, prey, round(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), 6) as distance from {{edges}} join c a on a.gene = target join c b on b.gene = prey")
def spatial_distance(t):
    return rounded(N.spatial_distance(t.edges, t.sql(COORD)), "distance")


@query("node_embeddings")
def node_embeddings(t):
    return embed(t.edges)


POOR = "select distinct concat('G', p_partkey) as gene, p_size as score from {part} where p_size >= 40"


@query("poor_annotation", f"""with p as ({POOR}), u as (select target as gene, prey as interactor from {{edges}} union all select prey, target from {{edges}})
    select p.gene, p.score, count(*) as interactor_count, min(c.cluster_id) as cluster_id from p join u on u.gene = p.gene left join {{clusters}} c on c.gene = p.gene group by 1, 2""")
def poor_annotation(t):
    return N.poor_annotation(t.edges, t.sql(POOR), t.clusters)[0].select("gene", "score", "interactor_count", "cluster_id")


@query("poor_annotation_interactors", f"with p as ({POOR}) select p.gene, interactor from p join (select target as gene, prey as interactor from {{edges}} union all select prey, target from {{edges}}) u on u.gene = p.gene")
def poor_annotation_interactors(t):
    return N.poor_annotation(t.edges, t.sql(POOR), t.clusters)[1]


# --- networks around pulldowns -------------------------------------------------------------------

def bridge(t):
    return E.group_designs(t.protein_group, t.design)


INTERACTING = f"""(select distinct o.pulldown_id, h.pulldown_id as other from (select p.pulldown_id, b.group_id from {{pulldown}} p join {{line}} l on l.line_id = p.line_id join {BRIDGE} b on b.design_id = l.design_id) o
    join {{hit}} h on h.group_id = o.group_id and {SIG} join {{pulldown}} q on q.pulldown_id = h.pulldown_id and coalesce(q.display_flag, true) where o.pulldown_id <> h.pulldown_id)"""


@query("interacting_pulldowns", INTERACTING[1:-1])
def interacting_pulldowns(t):
    return N.interacting_pulldowns(t.pulldown, t.line, t.hit, bridge(t))


# fewer, larger pulldowns so that baits find themselves and networks have inner edges
NET = {"pulldown": "select s_suppkey as pulldown_id, s_suppkey as line_id, case when s_nationkey % 5 = 0 then false end as display_flag from {supplier}",
       "line": "select s_suppkey as line_id, s_suppkey as design_id, 1 as sort_count from {supplier}",
       "design": "select s_suppkey as design_id, concat('Q', s_suppkey) as uniprot_id from {supplier}",
       "bridge": "select p_partkey % 400 as group_id, p_partkey % 100 as design_id from {part} where p_size < 25 group by 1, 2",
       "hit": "select l_suppkey * 100000 + l_partkey % 400 as hit_id, l_suppkey as pulldown_id, l_partkey % 400 as group_id, max(l_quantity) / 2.5 as pval, max(l_discount) * 100 - 4 as enrichment, max(l_quantity) > 45 as is_significant, max(l_quantity) > 48 as is_minor from {lineitem} group by 1, 2, 3"}
NET_BAIT = f"(select pulldown_id, hit_id, group_id, enrichment from (select h.*, row_number() over (partition by h.pulldown_id order by enrichment desc, hit_id) as r from nhit h join npd p on p.pulldown_id = h.pulldown_id join nln l on l.line_id = p.line_id join nbr b on b.group_id = h.group_id and b.design_id = l.design_id where {SIG}) q where r = 1)"
NET_CTE = f"""npd as materialized ({NET['pulldown']}), nln as ({NET['line']}), nds as ({NET['design']}), nbr as materialized ({NET['bridge']}), nhit as materialized ({NET['hit']}), sig as materialized (select * from nhit where {SIG}), bait as materialized {NET_BAIT},
    inter as materialized (select distinct o.pulldown_id, h.pulldown_id as other from (select p.pulldown_id, b.group_id from npd p join nln l on l.line_id = p.line_id join nbr b on b.design_id = l.design_id) o join sig h on h.group_id = o.group_id
      join npd q on q.pulldown_id = h.pulldown_id and coalesce(q.display_flag, true) where o.pulldown_id <> h.pulldown_id),
    nodes as materialized (select b.pulldown_id, b.group_id as node_group, 'bait' as type, b.pulldown_id as source_pulldown, h.pval, h.enrichment from bait b join nhit h on h.hit_id = b.hit_id union all
      select s.pulldown_id, s.group_id, 'hit', null, s.pval, s.enrichment from sig s join bait b on b.pulldown_id = s.pulldown_id where s.group_id <> b.group_id union all
      select i.pulldown_id, o.group_id, 'pulldown', i.other, s.pval, s.enrichment from inter i join bait b on b.pulldown_id = i.pulldown_id join bait o on o.pulldown_id = i.other join sig s on s.pulldown_id = i.other and s.group_id = b.group_id)"""


def net(t):
    v = {k: t.sql(q) for k, q in NET.items()}
    bait = E.bait_hit_best(E.bait_hits(v["pulldown"], v["line"], v["hit"], v["bridge"]))
    inter = N.interacting_pulldowns(v["pulldown"], v["line"], v["hit"], v["bridge"])
    return v, N.network_nodes(v["hit"], bait, inter)


@query("network_nodes", f"with {NET_CTE} select pulldown_id, node_group, type, source_pulldown, pval, round(enrichment, 6) as enrichment from nodes")
def network_nodes(t):
    return rounded(net(t)[1], "enrichment")


@query("network_edges", f"""with {NET_CTE}, single as (select group_id from nbr b join nds d on d.design_id = b.design_id group by 1 having count(distinct uniprot_id) = 1),
    stand as (select b.group_id, arg_min(p.pulldown_id, b.design_id) as pd from nbr b join single using (group_id) join nln l on l.design_id = b.design_id join npd p on p.line_id = l.line_id group by 1),
    n as (select pulldown_id, node_group, case when type = 'hit' then s.pd else source_pulldown end as sp from nodes left join stand s on s.group_id = node_group)
    select distinct n.pulldown_id, n.node_group as source, sig.group_id as target from n join sig on sig.pulldown_id = n.sp join nodes m on m.pulldown_id = n.pulldown_id and m.node_group = sig.group_id where n.node_group <> sig.group_id""")
def network_edges(t):
    v, nodes = net(t)
    best = v["line"].select("design_id", "line_id")
    pulls = E.best_pulldown(v["pulldown"])
    return N.network_edges(nodes, v["hit"], v["bridge"], v["design"], best, pulls)


GROUP_CLUSTERS = "select p_partkey % 400 as node_group, cast(min(p_size) % 4 as bigint) as cluster_id, cast(min(p_size) % 3 as bigint) as subcluster_id from {part} group by 1"
COMPOUND = f"""gc as ({GROUP_CLUSTERS}), ids as (select distinct pulldown_id, n.node_group, cluster_id, subcluster_id from nodes n join gc on gc.node_group = n.node_group), many as (select pulldown_id, cluster_id from ids group by 1, 2 having count(*) > 1),
    comp as (select n.pulldown_id, n.node_group, n.type, i.cluster_id, i.subcluster_id, case when i.subcluster_id <> 0 then i.cluster_id || '-' || i.subcluster_id when i.cluster_id <> 0 then cast(i.cluster_id as varchar) end as parent
      from nodes n left join (select ids.* from ids join many using (pulldown_id, cluster_id)) i on i.pulldown_id = n.pulldown_id and i.node_group = n.node_group)"""


@query("compound_nodes", f"with {NET_CTE}, {COMPOUND} select * from comp")
def compound_nodes(t):
    return N.compound_nodes(net(t)[1], t.sql(GROUP_CLUSTERS)).select("pulldown_id", "node_group", "type", "cluster_id", "subcluster_id", "parent")


@query("compound_parents", f"with {NET_CTE}, {COMPOUND} select distinct pulldown_id, cast(cluster_id as varchar) as id, null::varchar as parent from comp where cluster_id is not null union select distinct pulldown_id, parent, cast(cluster_id as varchar) from comp where subcluster_id is not null and parent <> cast(cluster_id as varchar)")
def compound_parents(t):
    return N.parent_nodes(N.compound_nodes(net(t)[1], t.sql(GROUP_CLUSTERS)))


GROUP_IDS = "(select distinct group_id, string_split(unnest(string_split(uniprot_ids, ';')), '-')[1] as uniprot_id from {protein_group})"


@query("group_associations", f"select distinct g.group_id, d.design_id from {GROUP_IDS} g join {{uniprot}} u on u.uniprot_id = g.uniprot_id join {{uniprot}} v on v.ensg_id = u.ensg_id join {{design}} d on d.uniprot_id = v.uniprot_id")
def group_associations(t):
    return N.group_associations(t.protein_group, t.uniprot, E.reference_uniprot(t.uniprot), t.design)[1]


@query("group_reference_uniprot", f"select distinct g.group_id, r.uniprot_id from {GROUP_IDS} g join {{uniprot}} u on u.uniprot_id = g.uniprot_id join {REF_UNIPROT} r on r.ensg_id = u.ensg_id")
def group_reference_uniprot(t):
    return N.group_associations(t.protein_group, t.uniprot, E.reference_uniprot(t.uniprot), t.design)[0]


@query("target_group_audit", f"""with b as {BRIDGE}, e as (select g.group_id, count(distinct ensg_id) as n from {GROUP_IDS} g left join {{uniprot}} u on u.uniprot_id = g.uniprot_id group by 1)
    select 'target in no group' as problem, target_name as entity from {{design}} where design_id not in (select design_id from b) union all select 'group without ensg', cast(group_id as varchar) from e where n = 0
    union all select 'group with several ensg', cast(group_id as varchar) from e where n > 1 union all select 'group of several targets', cast(group_id as varchar) from b group by group_id having count(distinct design_id) > 1""")
def target_group_audit(t):
    return N.target_group_audit(t.protein_group, t.uniprot, t.design, bridge(t))
