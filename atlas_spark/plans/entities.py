"""Queries for search and nested entity records (flattened for comparison)."""

from pyspark.sql import functions as F

from ..operators import entities as E, search as S
from ..registry import query
from ..session import shared_folder
from .network import BRIDGE
from .relational import BAIT_HITS, CATS, REF_UNIPROT, SIG, rounded

ASK = "select distinct case when p_partkey % 2 = 0 then concat('g', p_partkey) else upper(p_type) end as query from {part}"
READY = f"select distinct l.design_id from {{annotation}} a join {{line}} l on l.line_id = a.entity_id"


@query("gene_search", f"""with q as ({ASK}), n as (select distinct ensg_id, unnest(string_split(upper(gene_names), ' ')) as g from {{uniprot}} where ensg_id is not null)
    select query, 'target' as kind, cast(design_id as varchar) as id from q join {{design}} d on upper(d.target_name) = upper(query) where design_id in ({READY}) union all select query, 'ensg', ensg_id from q join n on n.g = upper(query)""")
def gene_search(t):
    return S.gene_search(t.sql(ASK), t.design, t.uniprot, t.sql(READY))


HGNC = "select concat('G', p_partkey) as symbol, concat('OLD', p_partkey % 700, '|PREV', p_partkey) as prev_symbol, case when p_size > 20 then concat('AL', p_partkey % 900) end as alias_symbol from {part}"
ALIASES = "select distinct case p_partkey % 4 when 0 then concat('G', p_partkey) when 1 then concat('OLD', p_partkey) when 2 then concat('AL', p_partkey) else concat('PREV', p_partkey) end as query from {part}"


@query("resolve_alias", f"""with h as ({HGNC}), a as (select symbol, unnest(list_concat(string_split(prev_symbol, '|'), coalesce(string_split(alias_symbol, '|'), []))) as query from h), q as ({ALIASES})
    select query, coalesce((select min(symbol) from h where h.symbol = q.query), (select min(symbol) from a where a.query = q.query)) as symbol from q""")
def resolve_alias(t):
    return S.resolve_alias(t.sql(ALIASES), t.sql(HGNC))


PREFIX = "select distinct concat('g', s_suppkey) as query from {supplier} union all select 'econ'"
PREFIX_SQL = f"(select distinct query, ensg_id, 1.0::double as relevance from ({PREFIX}) q join (select ensg_id, unnest(string_split(upper(gene_names), ' ')) as g from {{uniprot}} where ensg_id is not null) n on starts_with(n.g, upper(query)))"


@query("prefix_search", PREFIX_SQL[1:-1])
def prefix_search(t):
    return S.prefix_search(t.sql(PREFIX), t.uniprot)


TEXTQ = "select distinct concat(split_part(lower(regexp_replace(text, '[^\\\\pL\\\\pN]+', ' ')), ' ', 1), ' ', split_part(lower(regexp_replace(text, '[^\\\\pL\\\\pN]+', ' ')), ' ', 3)) as query from {benchmark}"
TEXTQ_DUCK = TEXTQ.replace("'[^\\\\pL\\\\pN]+', ' ')", "'[^\\pL\\pN]+', ' ', 'g')")


@query("fulltext_search", f"""with w as (select doc_id as id, list_filter(string_split_regex(lower(text), '[^\\pL\\pN]+'), lambda x: x <> '') as ws from documents), k as materialized (select id, len(ws) as n, unnest(ws) as token from w), f as materialized (select id, n, token, count(*) as tf from k group by all),
    q as (select query, list_distinct(list_filter(string_split_regex(lower(query), '[^\\pL\\pN]+'), lambda x: x <> '')) as ws from ({TEXTQ_DUCK}) b), a as (select query, len(ws) as n_asked, unnest(ws) as token from q),
    h as (select query, n_asked, id, n, count(*) as m, sum(tf) as tf from a join f using (token) group by all), r as (select query, id, tf / n as relevance, row_number() over (partition by query order by tf / n desc, id) as rank from h where m = n_asked)
    select query, id, round(relevance, 8) as relevance from r where rank <= 100""")
def fulltext_search(t):
    index = S.build_text_index(t.documents, "doc_id", "text", shared_folder(t.spark, "text-index"))
    return rounded(S.fulltext_search(t.sql(TEXTQ), index), "relevance", digits=8)


@query("search_combine", f"""with a as {PREFIX_SQL}, n as (select query, concat('ENSG', lpad(cast(s_suppkey as varchar), 11, '0')) as ensg_id, 0.5::double as relevance from ({PREFIX}) p join supplier on query = concat('g', s_suppkey)), u as (select * from a union all select * from n),
    b as (select query, ensg_id, max(relevance) as relevance from u group by 1, 2), tg as (select distinct ensg_id from {{design}} d join {{uniprot}} x on x.uniprot_id = d.uniprot_id)
    select b.query, b.ensg_id, relevance, case when tg.ensg_id is not null then 'Target' else 'Interactor' end as status from b left join tg on tg.ensg_id = b.ensg_id""")
def search_combine(t):
    extra = t.sql("select concat('g', s_suppkey) as query, concat('ENSG', lpad(cast(s_suppkey as string), 11, '0')) as ensg_id, 0.5D as relevance from {supplier}")
    targets = t.design.join(t.uniprot, "uniprot_id").select("ensg_id")
    out = S.search_combine([S.prefix_search(t.sql(PREFIX), t.uniprot), extra], targets)
    return out.orderBy("query", F.desc("status"), F.desc("relevance"), "ensg_id").select("query", "ensg_id", "relevance", "status")


@query("target_names", "select target_name, p_name as protein_name from (select target_name, min(design_id) as d from {design} group by 1) q join part on p_partkey = d")
def target_names(t):
    return S.target_names(t.design, t.uniprot)


@query("name_prefix", "select distinct target_name from {design} where lower(target_name) like 'g1%'")
def name_prefix(t):
    return S.name_prefix(t.design.select("target_name").distinct(), "target_name", "G1")


COUNTS = "(select line_id, count(*) as num_fovs, count(doc_id) as num_annotated_fovs from {fov} left join labels on doc_id = fov_id group by 1)"
BEST_P = "(select line_id, pulldown_id from (select *, row_number() over (partition by line_id order by case when display_flag then 0 else 1 end, pulldown_id) as r from {pulldown}) q where r = 1)"


@query("entity_lines", f"""select l.line_id, d.plate_id, d.target_name, p_name as protein_name, array_to_string(list_sort({CATS}), ',') as categories, coalesce(len(list_filter({CATS}, lambda c: regexp_matches(c, '_[1,2,3]$'))) > 0, false) as has_graded,
    b.pulldown_id, coalesce(c.num_fovs, 0) as num_fovs, coalesce(c.num_annotated_fovs, 0) as num_annotated_fovs from {{line}} l join {{design}} d on d.design_id = l.design_id left join part on p_partkey = d.design_id left join {{annotation}} a on a.entity_id = l.line_id
    left join {BEST_P} b on b.line_id = l.line_id left join {COUNTS} c on c.line_id = l.line_id""")
def entity_lines(t):
    counts = E.fov_counts(t.line, t.fov, t.labels.select(F.col("doc_id").alias("fov_id")), "PML0000", "PML9999")
    r = E.line_records(t.design, t.line, t.uniprot, t.annotation.withColumnRenamed("entity_id", "line_id"), t.pulldown, counts)
    return r.select("line_id", "metadata.plate_id", "metadata.target_name", "uniprot.protein_name", F.array_join("annotation.categories", ",").alias("categories"),
                    "annotation.has_graded", "best_pulldown.pulldown_id", "fov_counts.num_fovs", "fov_counts.num_annotated_fovs")


@query("entity_plate", "select plate_id, string_agg(target_name, ',' order by target_name) as targets, count(*) as n_wells from {design} group by 1")
def entity_plate(t):
    return E.plate_targets(t.design).withColumn("targets", F.array_join("targets", ","))


ROIS = "select doc_id as fov_id, doc_id * 10 + quality as roi_id from {labels} union all select doc_id, doc_id * 10 + 5 from {labels}"


@query("entity_fovs", f"""with k as (select fov_id, kind, score, cast(json_extract(data, '$.k') as int) as k, row_number() over (partition by fov_id, kind order by result_id desc) as r from {{fov_result}}),
    p as (select fov_id, max(score) filter (kind = 'view') as score, max(k) filter (kind = 'click') as laser_power, max(k) filter (kind = 'purchase') as c from k where r = 1 group by 1), ro as (select fov_id, min(roi_id) as roi_id from ({ROIS}) x group by 1)
    select f.fov_id, f.line_id, f.pml_id, f.site_num, score, laser_power, c * case when cast(substr(pml_id, 4) as int) < 123 then 0.5::double else 0.2::double end as cell_layer_um, roi_id from {{fov}} f left join p on p.fov_id = f.fov_id left join ro on ro.fov_id = f.fov_id""")
def entity_fovs(t):
    return E.fov_records(t.fov, t.fov_result, t.sql(ROIS))


@query("entity_hits", f"""select h.pulldown_id, h.hit_id, h.group_id, h.pval, h.enrichment, replace(g.gene_names, ';', ',') as gene_names, n.target_names, exists (select 1 from {BRIDGE} x where x.group_id = h.group_id and x.design_id = l.design_id) as is_bait
    from {{hit}} h join {{pulldown}} p on p.pulldown_id = h.pulldown_id join {{line}} l on l.line_id = p.line_id join {{protein_group}} g on g.group_id = h.group_id left join (select group_id, string_agg(distinct target_name, ',' order by target_name) as target_names from {BRIDGE} b join {{design}} d on d.design_id = b.design_id group by 1) n on n.group_id = h.group_id where {SIG}""")
def entity_hits(t):
    r = E.hit_records(t.hit, t.pulldown, t.line, t.protein_group, t.design, E.group_designs(t.protein_group, t.design))
    return r.withColumns({"gene_names": F.array_join("gene_names", ","), "target_names": F.array_join("target_names", ",")})


PRIMARY = "select ensg_id, min(group_id) as group_id from {protein_group} g join {uniprot} u on u.uniprot_id = split_part(split_part(g.uniprot_ids, ';', 1), '-', 1) where ensg_id is not null group by 1"


@query("entity_interactor", f"""with p as ({PRIMARY}), r as {REF_UNIPROT}, s as (select group_id, count(distinct line_id) as n from {{hit}} h join {{pulldown}} q on q.pulldown_id = h.pulldown_id where {SIG} and coalesce(display_flag, true) group by 1)
    select p.ensg_id, p.group_id, string_split(r.protein_names, ' (')[1] as protein_name, coalesce(s.n, 0) as n_lines from p left join r on r.ensg_id = p.ensg_id left join s on s.group_id = p.group_id""")
def entity_interactor(t):
    return E.interactor_records(t.sql(PRIMARY), E.reference_uniprot(t.uniprot), t.hit, t.pulldown)


TILES = "select hit_id, cast(group_id % 40 as bigint) as cluster_id, group_id % 9 as row_index, pulldown_id % 5 as col_index from {hit} where is_significant and group_id % 3 = 0"


@query("entity_clusters", f"with k as ({TILES}), o as (select pulldown_id, min(cluster_id) as cluster_id from k join {{hit}} h on h.hit_id = k.hit_id group by 1) select o.pulldown_id, o.cluster_id, count(*) as n_tiles, count(distinct row_index) as n_rows, count(distinct col_index) as n_cols from o join k on k.cluster_id = o.cluster_id group by 1, 2")
def entity_clusters(t):
    measures = [F.count("*").alias("n_tiles"), F.count_distinct("row_index").alias("n_rows"), F.count_distinct("col_index").alias("n_cols")]
    return E.pulldown_cluster_tiles(t.sql(TILES), t.hit, measures).select("pulldown_id", "cluster_id", "n_tiles", "n_rows", "n_cols")
