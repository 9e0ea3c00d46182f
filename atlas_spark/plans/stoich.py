"""Queries for stoichiometry and fractionation."""

from pyspark.sql import functions as F

from ..operators import stoich as S
from ..operators.quant import median_replicates
from ..registry import query
from .network import GROUP_IDS
from .relational import rounded

MED = "select l_partkey as group_id, concat('B', l_suppkey % 12) as bait, max(l_quantity) / 5 as value from {lineitem} group by 1, 2"
PEP = "select group_id, cast(group_id % 7 as double) as n_peptides from {protein_group}"
OWN = "select distinct concat('B', s_suppkey % 12) as bait, s_suppkey as group_id from {supplier} where s_suppkey % 12 <> 5"
ABS = f"(select m.group_id, bait, value, pow(2, value) / nullif(n_peptides, 0) as absolute from ({MED}) m left join ({PEP}) p on p.group_id = m.group_id)"


@query("group_gene_map", f"select group_id, ensg_id, min(g.uniprot_id) as uniprot_id from {GROUP_IDS} g join {{uniprot}} u on u.uniprot_id = g.uniprot_id where ensg_id is not null group by 1, 2")
def group_gene_map(t):
    return S.group_gene_map(t.protein_group, t.uniprot)


@query("group_theoretical_peptides", """with s as (select concat('Q', doc_id) as protein_id, len(list_filter(string_split(text, 'e'), lambda p: len(p) between 7 and 30)) as n from documents)
    select group_id, median(n) as n_peptides from (select group_id, unnest(string_split(gene_names, ';')) as g from {protein_group}) q join s on s.protein_id = replace(q.g, 'G', 'Q') group by 1""")
def group_theoretical_peptides(t):
    groups = t.protein_group.select("group_id", F.regexp_replace("gene_names", "G", "Q").alias("uniprot_ids"))
    seqs = t.documents.select(F.concat(F.lit("Q"), "doc_id").alias("protein_id"), F.col("text").alias("sequence"))
    return S.theoretical_peptides(groups, seqs, cut="e")


def absolute(t):
    return S.absolute_intensity(t.sql(MED), t.sql(PEP))


@query("absolute_intensity", f"select group_id, bait, round(absolute, 6) as absolute from {ABS} q")
def absolute_intensity(t):
    return rounded(absolute(t).select("group_id", "bait", "absolute"), "absolute")


INTER = f"(with a as {ABS}, o as ({OWN}), w as (select a.bait, max(absolute) as own from a join o on o.bait = a.bait and o.group_id = a.group_id group by 1) select a.bait, a.group_id, absolute / own as interaction_stoi from a join w on w.bait = a.bait where own is not null)"


@query("interaction_stoichiometry", f"select bait, group_id, round(interaction_stoi, 6) as interaction_stoi from {INTER} q")
def interaction_stoichiometry(t):
    return rounded(S.interaction_stoichiometry(absolute(t), t.sql(OWN)).select("bait", "group_id", "interaction_stoi"), "interaction_stoi")


ABU = "select ensg_id, cast(length(protein_names) as double) as abundance from {uniprot} where ensg_id is not null"
GABU = f"(select group_id, sum(abundance) as abundance from (select distinct group_id, ensg_id from {GROUP_IDS} g join {{uniprot}} u on u.uniprot_id = g.uniprot_id where ensg_id is not null) m left join (select ensg_id, sum(abundance) as abundance from ({ABU}) q group by 1) a on a.ensg_id = m.ensg_id group by 1)"


@query("abundance_by_gene", GABU[1:-1])
def abundance_by_gene(t):
    return S.abundance_by_gene(t.sql(ABU), S.group_gene_map(t.protein_group, t.uniprot))


NABU = "select concat('G', s_suppkey) as gene, s_acctbal as abundance from {supplier}"


@query("abundance_by_name", f"select group_id, round(sum(abundance), 4) as abundance from (select distinct group_id, unnest(string_split(gene_names, ';')) as gene from {{protein_group}}) n join ({NABU}) a on a.gene = n.gene group by 1")
def abundance_by_name(t):
    return rounded(S.abundance_by_name(t.sql(NABU), t.protein_group), "abundance", digits=4)


@query("stoichiometry_table", f"""with s as (select bait, group_id, value from ({MED}) q), ga as materialized {GABU}, o as ({OWN}), w as (select bait, max(abundance) as own from o join ga on ga.group_id = o.group_id group by 1)
    select s.bait, s.group_id, value, round(interaction_stoi, 6) as interaction_stoi, round(abundance / nullif(own, 0), 6) as abundance_stoi from s left join {INTER} i on i.bait = s.bait and i.group_id = s.group_id
    left join ga on ga.group_id = s.group_id left join w on w.bait = s.bait""")
def stoichiometry_table(t):
    ga = S.abundance_by_gene(t.sql(ABU), S.group_gene_map(t.protein_group, t.uniprot))
    return rounded(S.stoichiometry_table(t.sql(MED), absolute(t), t.sql(OWN), ga), "interaction_stoi", "abundance_stoi")


REL = "select target, case when row_key % 9 = 0 then target else prey end as prey, row_key, abundance_stoi as abundance from {scores}"


@query("relative_abundance", f"with r as ({REL}), o as (select target, max(abundance) as own from r where target = prey group by 1) select row_key, round(abundance / own, 6) as relative_abundance from r join o on o.target = r.target")
def relative_abundance(t):
    return rounded(S.relative_abundance(t.sql(REL)).select("row_key", "relative_abundance"), "relative_abundance")


FRAC = "select concat('P', l_partkey) as prey, cast(l_orderkey % 6 + 1 as int) as replicate, case l_linenumber when 1 then '01K' when 2 then '03K' when 3 then 'Cyt' when 4 then '05K' when 5 then '12K' when 6 then '24K' else '80K' end as fraction, sum(case when l_linenumber = 1 then l_quantity * 40 when l_linenumber = 3 and l_partkey % 3 = 0 then l_quantity * 30 else l_quantity end) as value from {lineitem} group by 1, 2, 3"
NOC = f"(select prey, replicate, case fraction when '01K' then 'nuclear' when 'Cyt' then 'cyto' else 'organellar' end as compartment, sum(value) as value from ({FRAC}) f group by 1, 2, 3)"
PROP = f"(select prey, replicate, compartment, coalesce(value / nullif(sum(value) over (partition by prey, replicate), 0), 0) as value from {NOC} n)"
CONS = f"""(with v as materialized (select prey, replicate, coalesce(max(value) filter (compartment = 'nuclear'), 0) as nuclear, coalesce(max(value) filter (compartment = 'organellar'), 0) as organellar, coalesce(max(value) filter (compartment = 'cyto'), 0) as cyto from {PROP} p group by 1, 2),
    l as materialized (select prey, replicate, unnest([1, 2, 3]) as k, unnest([nuclear, organellar, cyto]) as x from v), c as (select a.prey, a.replicate, b.replicate as other, corr(a.x, b.x) as r from l a join l b on a.prey = b.prey and a.k = b.k group by 1, 2, 3),
    k as (select prey, replicate from c group by 1, 2 having count(*) filter (round(r, 12) > 0.9) - 1 >= 3), m as (select v.prey, count(*) as q, median(nuclear) as n, median(organellar) as o, median(cyto) as cy from v join k on k.prey = v.prey and k.replicate = v.replicate group by 1)
    select p.prey, cast(coalesce(q, 0) as int) as quality, coalesce(n, 0) as nuclear, coalesce(o, 0) as organellar, coalesce(cy, 0) as cyto from (select distinct prey from v) p left join m on m.prey = p.prey)"""
PARTS = ["nuclear", "organellar", "cyto"]


@query("to_noc", NOC[1:-1])
def to_noc(t):
    return S.to_noc(t.sql(FRAC))


@query("fraction_proportion", f"select prey, replicate, compartment, round(value, 8) as value from {PROP} q")
def fraction_proportion(t):
    return rounded(S.fraction_proportion(S.to_noc(t.sql(FRAC))), "value", digits=8)


def consistent(t):
    return S.consistent_median(S.fraction_proportion(S.to_noc(t.sql(FRAC))), PARTS)


@query("consistent_median", f"select prey, quality, round(nuclear, 8) as nuclear, round(organellar, 8) as organellar, round(cyto, 8) as cyto from {CONS} q")
def consistent_median(t):
    return rounded(consistent(t), *PARTS, digits=8)


@query("classify_noc", f"""select prey, case when nuclear >= 0.85 then 'N' when cyto >= 0.85 then 'C' when organellar > 0.3 and cyto < 0.15 then 'O' when nuclear < 0.4 and organellar > 0.15 and cyto > 0.15 then 'O/C'
    when nuclear > 0.15 and organellar < 0.1 and cyto >= 0.15 then 'N/C' when nuclear + organellar + cyto = 0 then 'I' else 'B' end as localization from {CONS} q""")
def classify_noc(t):
    return S.classify_noc(consistent(t)).select("prey", "localization")


ATLAS = "select p_partkey, case p_size % 5 when 0 then 'Nucleoplasm' when 1 then 'Cytosol' when 2 then 'Golgi' when 3 then '' else 'Nucleoli;Cytosol' end as label from {part}"


@query("compartment_label", f"select p_partkey, lower(label) like '%nuc%' as is_nuc, lower(label) like '%cyt%' as is_cyt, not (lower(label) like '%nuc%' or lower(label) like '%cyt%' or label = '') as is_org from ({ATLAS}) q")
def compartment_label(t):
    return t.sql(ATLAS).withColumns(S.compartment_label("label")).select("p_partkey", "is_nuc", "is_cyt", "is_org")
