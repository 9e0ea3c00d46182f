"""Queries for predicates, joins, aggregations, ranked choices and set operations."""

from pyspark.sql import functions as F

from ..functions import cols as C
from ..operators import entities as E, hits as H, ranking, relational as R
from ..operators.validation import entity_problems
from ..registry import query

CATS = "cast(categories as json)::varchar[]"
SIG = "(is_significant or is_minor)"


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


# --- predicates ----------------------------------------------------------------------------------

@query("significant_hits", f"select hit_id, pulldown_id, pval from {{hit}} where {SIG} and group_id in (select p_partkey from part where p_size < 20)")
def significant_hits(t):
    ids = t.part.filter("p_size < 20").select(F.col("p_partkey").alias("group_id"))
    return H.significant_hits(t.hit, ids).select("hit_id", "pulldown_id", "pval")


@query("display_flag_filter", "select pulldown_id from {pulldown} where display_flag is null or display_flag")
def display_flag_filter(t):
    return t.pulldown.filter(H.displayed("display_flag")).select("pulldown_id")


@query("hit_class", "select hit_id, case when is_significant then 'significant' when is_minor then 'minor' else 'none' end as hit_class from {hit}")
def hit_class(t):
    return t.hit.select("hit_id", H.hit_class(F.col("is_significant"), F.col("is_minor")).alias("hit_class"))


@query("nonsignificant_compact", f"select pulldown_id, round(pval, 3) as pval, round(enrichment, 3) as enrichment from {{hit}} where not {SIG}")
def nonsignificant_compact(t):
    return H.nonsignificant_compact(t.hit)


@query("nonsig_downsample", """select hit_id, pval from {hit} where pval > 3 or
    cast('0x' || substr(md5(cast(hit_id as varchar)), 1, 8) as bigint) / 4294967296.0 < 0.5""")
def nonsig_downsample(t):
    return H.nonsig_downsample(t.hit, ["hit_id"]).select("hit_id", "pval")


@query("lines_by_annotation", f"select entity_id from {{annotation}} where list_contains({CATS}, 'publication_ready')")
def lines_by_annotation(t):
    return t.annotation.filter(F.array_contains(E.categories(), "publication_ready")).select("entity_id")


ROOTS = f"list_transform({CATS}, lambda x: regexp_replace(x, '_[1,2,3]$', ''))"


@query("category_any_all", f"""select entity_id, 'any' as mode from {{annotation}} where list_has_all({ROOTS}, ['publication_ready']) and list_has_any({ROOTS}, ['fr', 'de', 'src1'])
    union all select entity_id, 'all' from {{annotation}} where list_has_all({ROOTS}, ['publication_ready', 'en', 'src4'])""")
def category_any_all(t):
    some = E.select_by_categories(t.annotation, ["publication_ready"], ["fr", "de", "src1"], "any").withColumn("mode", F.lit("any"))
    return some.unionByName(E.select_by_categories(t.annotation, ["publication_ready"], ["en", "src4"], "all").withColumn("mode", F.lit("all")))


@query("categorical_filters", """select distinct 'family' as filter, family as value from {design} where family is not null union select distinct 'plate_id', plate_id from {design}
    union select 'family', 'all' union select 'plate_id', 'all'""")
def categorical_filters(t):
    return E.categorical_filters(t.design, ["family", "plate_id"])


@query("categorical_selection", "select design_id from {design} where family = 'kinase' and plate_id = 'P0004'")
def categorical_selection(t):
    return E.apply_filters(t.design, {"family": "kinase", "plate_id": "P0004", "well_id": "all"}).select("design_id")


CHOSEN = "select distinct concat('G', s_suppkey) as target, concat('P00', s_suppkey % 3 + 1) as pick from {supplier} where s_nationkey < 15"


@query("drop_unchosen", f"""with c as ({CHOSEN}) select row_key, target, plate from {{scores}} s where not exists (select 1 from c where c.target = s.target)
    or exists (select 1 from c where c.target = s.target and c.pick = s.plate)""")
def drop_unchosen(t):
    return H.drop_unchosen(t.scores, t.sql(CHOSEN)).select("row_key", "target", "plate")


@query("set_circle", """select row_key, case when abundance_stoi > 0.1 and abundance_stoi < 10 and interaction_stoi > 0.2 then 10.0::double
    when abundance_stoi > 0.1 and abundance_stoi < 10 and interaction_stoi > 0.05 and interaction_stoi < 0.2 then 4.0::double else 0.2::double end as circle_stoi from {scores}""")
def set_circle(t):
    return t.scores.select("row_key", H.circle_weight(F.col("abundance_stoi"), F.col("interaction_stoi")).alias("circle_stoi"))


@query("hit_bool_weight", "select row_key, case when interaction_stoi < 0.01 then 0.2::double when interaction_stoi > 0 then 2.2::double end as weight from {scores}")
def hit_bool_weight(t):
    return t.scores.select("row_key", H.hit_weight(F.col("interaction_stoi")).alias("weight"))


@query("prep_cluster_edges", """select target, prey, max(case when interaction_stoi < 0.01 then 0.2::double else 2.2::double end) as interaction_stoi from {scores} group by 1, 2""")
def prep_cluster_edges(t):
    s = t.scores.withColumn("target", F.concat_ws("_", "plate", "target"))
    return H.prep_cluster_edges(s, "interaction_stoi")


@query("validate_entities", """with d as (select c_custkey as id, concat('PML', lpad(cast(c_custkey % 20000 as varchar), case when c_custkey % 50 = 0 then 3 else 4 end, '0')) as pml_id,
      c_mktsegment as terminus, concat('P', c_nationkey) as plate_id, concat('A', c_custkey % 300) as well_id, upper(substr(c_name, 1, 1)) as seq from customer)
    select 'pml_id' as problem, cast(id as varchar) as entity, 1::bigint as n from d where not regexp_matches(pml_id, '^PML[0-9]{4}$')
    union all select 'terminus', cast(id as varchar), 1 from d where terminus not in ('BUILDING', 'MACHINERY')
    union all select 'sequence', cast(id as varchar), 1 from d where not regexp_matches(seq, '^[acgtACGT]*$')
    union all select 'duplicate plate_id,well_id', plate_id || ',' || well_id, count(*) from d group by plate_id, well_id having count(*) > 1""")
def validate_entities(t):
    d = t.sql("""select c_custkey as id, concat('PML', lpad(cast(c_custkey % 20000 as string), case when c_custkey % 50 = 0 then 3 else 4 end, '0')) as pml_id,
        c_mktsegment as terminus, concat('P', c_nationkey) as plate_id, concat('A', c_custkey % 300) as well_id, upper(substr(c_name, 1, 1)) as seq from {customer}""")
    return entity_problems(d, "id", patterns={"pml_id": ("pml_id", "^PML[0-9]{4}$"), "sequence": ("seq", "^[acgtACGT]*$")},
                           allowed={"terminus": ("terminus", ["BUILDING", "MACHINERY"])}, unique=[["plate_id", "well_id"]])


@query("annotated_only", """select fov_id, fov_id in (select doc_id from labels where toxic = 1) as has_roi from {fov} where fov_id in (select doc_id from labels)""")
def annotated_only(t):
    ann = t.labels.select(F.col("doc_id").alias("fov_id"))
    roi = t.labels.filter("toxic = 1").select(F.col("doc_id").alias("fov_id"))
    f = t.fov.join(ann, "fov_id", "left_semi")
    with_roi = f.join(roi, "fov_id", "left_semi").select("fov_id", F.lit(True).alias("has_roi"))
    return with_roi.unionByName(f.join(roi, "fov_id", "left_anti").select("fov_id", F.lit(False).alias("has_roi")))


# --- joins ---------------------------------------------------------------------------------------

@query("join_inner_usingkey", "select d.design_id, d.target_name, u.ensg_id from {design} d join {uniprot} u using (uniprot_id)")
def join_inner_usingkey(t):
    return t.design.join(t.uniprot, "uniprot_id").select("design_id", "target_name", "ensg_id")


@query("join_left_rollup", """select l.line_id, count(f.fov_id) as num_fovs, count(a.doc_id) as num_annotated_fovs from {line} l left join {fov} f on f.line_id = l.line_id
    left join labels a on a.doc_id = f.fov_id group by 1""")
def join_left_rollup(t):
    c = E.fov_counts(t.line, t.fov, t.labels.select(F.col("doc_id").alias("fov_id")), "PML0000", "PML9999")
    return c.select("line_id", "num_fovs", "num_annotated_fovs")


@query("join_semi_in", "select line_id from {line} where line_id in (select line_id from {pulldown} where display_flag)")
def join_semi_in(t):
    return t.line.join(t.pulldown.filter("display_flag"), "line_id", "left_semi").select("line_id")


@query("join_anti_missing", "select fov_id from {fov} where fov_id not in (select fov_id from {fov_result} where kind = 'view')")
def join_anti_missing(t):
    return t.fov.join(t.fov_result.filter("kind = 'view'"), "fov_id", "left_anti").select("fov_id")


@query("join_gene_membership", "select h.hit_id, d.design_id from {hit} h join (select group_id, unnest(string_split(gene_names, ';')) as g from {protein_group}) p on p.group_id = h.group_id join {design} d on d.target_name = p.g")
def join_gene_membership(t):
    m = R.member_join(t.protein_group, "gene_names", t.design.select(F.col("target_name").alias("gene"), "design_id"), "gene")
    return t.hit.join(m, "group_id").select("hit_id", "design_id")


BAITS_SQL = "select distinct concat('B_', p_name, '_', p_size) as bait from {part}"
NEEDLES_SQL = "select distinct concat(substr(p_brand, 6, 3), '') as gene from {part} union select distinct substr(p_type, 1, 3) from {part} union select distinct lower(substr(p_name, 2, 4)) from {part}"


@query("join_substring_theta", f"with b as ({BAITS_SQL}), n as ({NEEDLES_SQL}) select distinct gene, bait from n join b on contains(b.bait, n.gene)")
def join_substring_theta(t):
    return H.hits_within_bait_names(t.sql(NEEDLES_SQL), t.sql(BAITS_SQL))


FB = {"baits": "select distinct concat('P00', l_suppkey % 3) as plate, concat('G', l_partkey) as target from {lineitem}",
      "exact": "select concat('P00', p_size % 3) as plate, concat('G', p_partkey) as target, p_partkey as group_id from {part} where p_size < 20",
      "names": "select group_id, gene_names from {protein_group} where group_id % 5 = 0",
      "preys": "select group_id + 1000000 as group_id, gene_names from {protein_group} where group_id % 3 = 0"}


@query("join_fallback_chain", f"""with b as ({FB['baits']}), e as ({FB['exact']}), n as (select group_id, unnest(string_split(gene_names, ';')) as target from ({FB['names']}) q),
    p as (select group_id, unnest(string_split(gene_names, ';')) as target from ({FB['preys']}) q)
    select b.plate, b.target, coalesce((select min(group_id) from e where e.plate = b.plate and e.target = b.target), (select min(group_id) from n where n.target = b.target),
      (select min(group_id) from p where p.target = b.target)) as group_id from b""")
def join_fallback_chain(t):
    return H.bait_group_lookup(*[t.sql(FB[k]) for k in ("baits", "exact", "names", "preys")])


@query("join_array_overlap", """select distinct g.group_id, d.family_id from (select group_id, unnest(string_split(gene_names, ';')) as x from {protein_group}) g
    join (select p_size as family_id, concat('G', p_partkey) as x from part where p_size < 10) d on d.x = g.x""")
def join_array_overlap(t):
    groups = t.protein_group.select("group_id", F.split("gene_names", ";").alias("genes"))
    wanted = t.part.filter("p_size < 10").select(F.col("p_size").alias("family_id"), F.array(F.concat(F.lit("G"), "p_partkey")).alias("members"))
    return R.overlap_pairs(groups, "group_id", "genes", wanted, "family_id", "members")


BRIDGE = "(select distinct group_id, design_id from (select group_id, string_split(unnest(string_split(uniprot_ids, ';')), '-')[1] as u from {protein_group}) g join {design} d on d.uniprot_id = g.u)"


@query("join_mn_bridge", BRIDGE[1:-1])
def join_mn_bridge(t):
    return E.group_designs(t.protein_group, t.design)


@query("join_star_dims", """select f.pml_id, d.plate_id, d.family, count(*) as n_fovs, count(distinct d.design_id) as n_targets from {fov} f left join {line} l on l.line_id = f.line_id
    left join {design} d on d.design_id = l.design_id group by 1, 2, 3""")
def join_star_dims(t):
    star = t.fov.join(t.line, "line_id", "left").join(t.design, "design_id", "left")
    return star.groupBy("pml_id", "plate_id", "family").agg(F.count("*").alias("n_fovs"), F.count_distinct("design_id").alias("n_targets"))


@query("lineage_root", """with recursive r as (select line_id, line_id as root from {line} where parent_id is null union all
    select l.line_id, r.root from {line} l join r on l.parent_id = r.line_id) select line_id, root from r""")
def lineage_root(t):
    return R.lineage_root(t.line)


POS = {"tiles": "select c_custkey as line_id, c_custkey % 36 as tile_column from {customer}", "grid": "select s_suppkey as line_id, s_nationkey as grid_x from {supplier}",
       "raw": "select o_custkey as line_id, min(o_totalprice) as raw_x from {orders} group by 1"}


@query("merge_positions", f"""select t.line_id, tile_column, target_name, grid_x, raw_x from ({POS['tiles']}) t left join (select line_id, target_name from {{line}} l join {{design}} d on d.design_id = l.design_id) n
    on n.line_id = t.line_id left join ({POS['grid']}) g on g.line_id = t.line_id left join ({POS['raw']}) r on r.line_id = t.line_id""")
def merge_positions(t):
    targets = t.line.join(t.design, "design_id").select("line_id", "target_name")
    return E.merge_positions(t.sql(POS["tiles"]), targets, t.sql(POS["grid"]), t.sql(POS["raw"]))


@query("update_left", "select c_custkey as k, coalesce(x.v, c_acctbal) as v from customer left join (select s_suppkey as k, case when s_nationkey > 5 then s_acctbal end as v from supplier) x on x.k = c_custkey")
def update_left(t):
    from ..sources.upserts import update_from
    return update_from(t.sql("select c_custkey as k, c_acctbal as v from {customer}"),
                       t.sql("select s_suppkey as k, case when s_nationkey > 5 then s_acctbal end as v from {supplier}"), ["k"], ["v"])


FACS_A = "select event_type as plate_id, user_id as well_id, avg(value) / 100 as area from {events} group by 1, 2"
FACS_B = "select event_type as plate_id, user_id as well_id, median(value) / 60 as other_area from {events} group by 1, 2"


@query("facs_compare_join", f"select plate_id, well_id, round(area, 8) as area, round(other_area, 8) as other_area from ({FACS_A}) a join ({FACS_B}) b using (plate_id, well_id) where area > 0.01 and abs(other_area / area) < 0.7")
def facs_compare_join(t):
    from ..operators.cyto import compare_results
    return rounded(compare_results(t.sql(FACS_A), t.sql(FACS_B)), "area", "other_area", digits=8)


WANT = "select distinct concat('P', lpad(cast(n_nationkey as string), 4, '0')) as plate_id, concat('A', lpad(cast(s_suppkey % 12 + 1 as string), 2, '0')) as well_id, cast(s_suppkey % 3 + 1 as int) as sort_count from {supplier} join {nation} on n_nationkey = s_nationkey"


@query("resolve_line", f"""with w as ({WANT}), k as (select plate_id, well_id, sort_count, count(*) as n, min(line_id) as line_id from {{line}} l join {{design}} d on d.design_id = l.design_id where line_type = 'POLYCLONAL' group by 1, 2, 3)
    select w.plate_id, w.well_id, w.sort_count, coalesce(n, 0) as n_matches, line_id from w left join k on k.plate_id = w.plate_id and k.well_id = w.well_id and k.sort_count = w.sort_count""")
def resolve_line(t):
    return E.resolve_line(t.sql(WANT), t.design, t.line, ["plate_id", "well_id", "sort_count"])


KEYS = "select distinct concat(plate, '_G', line_id % 600) as key from {pulldown}"


@query("resolve_pulldown", f"""with k as ({KEYS}), p as (select 'CZBMPI_0' || substr(plate, 2) as plate_id, target_name, min(pulldown_id) as pulldown_id, count(*) as n from {{pulldown}} p join {{line}} l on l.line_id = p.line_id
    join {{design}} d on d.design_id = l.design_id group by 1, 2)
    select key, 'CZBMPI_0' || substr(key, 2, 3) as plate_id, pulldown_id, coalesce(n, 0) as n_matches from k left join p on p.plate_id = 'CZBMPI_0' || substr(key, 2, 3) and p.target_name = string_split(key, '_')[2]""")
def resolve_pulldown(t):
    return E.resolve_pulldown(t.sql(KEYS), t.pulldown, t.line, t.design)


DESIGN_IN = "select c_custkey as design_id, concat('P', c_nationkey) as plate_id, case when c_custkey % 9 = 0 then 'empty_control' else c_name end as target_name, case when c_custkey % 4 = 0 then 'NaN' else c_mktsegment end as notes from {customer}"


@query("load_plate_designs", f"""with d as (select design_id, plate_id, target_name, nullif(notes, 'NaN') as notes from ({DESIGN_IN}) q where target_name <> 'empty_control')
    select d.*, (select count(*) from d e where e.plate_id = d.plate_id) = 50 as complete_plate from d""")
def load_plate_designs(t):
    return E.load_plate_designs(t.sql(DESIGN_IN), expected=50)


SCORE_VIEW = "(select fov_id, arg_max_null(score, result_id) as score from {fov_result} where kind = 'view' group by 1)"


@query("fov_flags", f"""select f.fov_id, f.line_id, s.score is not null as has_score, a.doc_id is not null as is_annotated, list_contains({CATS}, 'no_gfp') as is_gfp_negative,
    list_contains({CATS}, 'publication_ready') as is_pub_ready, coalesce(s.score is not null and list_contains({CATS}, 'publication_ready'), false) as final_flag
    from {{fov}} f left join {SCORE_VIEW} s on s.fov_id = f.fov_id left join labels a on a.doc_id = f.fov_id left join {{annotation}} n on n.entity_id = f.line_id""")
def fov_flags(t):
    ann = t.labels.select(F.col("doc_id").alias("fov_id"))
    return E.fov_flags(t.fov, E.fov_scores(t.fov_result, "view"), ann, t.annotation.withColumnRenamed("entity_id", "line_id"))


# --- aggregations --------------------------------------------------------------------------------

HITS2 = "select target, concat(prey, case when row_key % 4 = 0 then concat(';', target) else '' end) as prey from {scores} where pvals > 12"


@query("interaction_summary", f"""with h as ({HITS2}), p as (select target, count(*) as hit_count, cast(max(case when list_contains(string_split(prey, ';'), target) then 1 else 0 end) as int) as target_match from h group by 1),
    x as (select g, count(*) as n from (select unnest(list_distinct(string_split(prey, ';'))) as g from h) q group by 1)
    select target, hit_count, coalesce(n, 0) as preys, target_match, hit_count - target_match as subtracted_hits, coalesce(n, 0) - target_match as subtracted_preys from p left join x on x.g = p.target""")
def interaction_summary(t):
    return H.interaction_summary(t.sql(HITS2))


@query("fov_counts", """select l.line_id, count(f.fov_id) as num_fovs, count(a.doc_id) as num_annotated_fovs, count(*) filter (f.pml_id between 'PML0010' and 'PML0030') as num_fovs_in_range,
    count(a.doc_id) filter (f.pml_id between 'PML0010' and 'PML0030') as num_annotated_fovs_in_range from {line} l left join {fov} f on f.line_id = l.line_id left join labels a on a.doc_id = f.fov_id group by 1""")
def fov_counts(t):
    return E.fov_counts(t.line, t.fov, t.labels.select(F.col("doc_id").alias("fov_id")), "PML0010", "PML0030")


CAT_ROWS = f"(select entity_id, unnest(list_distinct({CATS})) as category from {{annotation}})"


@query("category_counts", f"select regexp_replace(category, '_[1,2,3]$', '') as root, coalesce(nullif(regexp_extract(category, '_([1,2,3])$', 1), ''), 'none') as grade, count(*) as n from {CAT_ROWS} q group by 1, 2")
def category_counts(t):
    return E.category_rows(t.annotation).groupBy("root", "grade").agg(F.count("*").alias("n"))


@query("category_cooccurrence", f"""with c as {CAT_ROWS}, p as (select a.category as c1, b.category as c2, count(*) as n from c a join c b on a.entity_id = b.entity_id group by 1, 2),
    f as (select category, count(*) as n from c group by 1) select c1, c2, p.n, round(p.n / f.n, 8) as share from p join f on f.category = c1""")
def category_cooccurrence(t):
    return rounded(E.category_cooccurrence(t.annotation), "share", digits=8)


@query("flag_counts_by_plate", f"select plate_id, count(*) filter (list_contains({CATS}, 'no_gfp')) as n_flagged, count(*) as n from {{annotation}} a join {{line}} l on l.line_id = a.entity_id join {{design}} d on d.design_id = l.design_id group by 1")
def flag_counts_by_plate(t):
    a = t.annotation.withColumnRenamed("entity_id", "line_id").join(t.line, "line_id").join(t.design, "design_id")
    return a.groupBy("plate_id").agg(F.count_if(F.array_contains(E.categories(), "no_gfp")).alias("n_flagged"), F.count("*").alias("n"))


@query("group_count_order", "select p_type as family, count(*) as n from part group by 1 order by n desc, family limit 20")
def group_count_order(t):
    return t.part.groupBy(F.col("p_type").alias("family")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "family").limit(20)


@query("count_distinct", "select ensg_id, count(distinct uniprot_id) as n_ids, count(distinct gene_names) as n_names from {uniprot} group by 1 having count(distinct uniprot_id) > 1")
def count_distinct(t):
    return t.uniprot.groupBy("ensg_id").agg(F.count_distinct("uniprot_id").alias("n_ids"), F.count_distinct("gene_names").alias("n_names")).filter("n_ids > 1")


@query("max_by_group_sql", "select target_name, max(protein_names) as protein_names from {design} d join {uniprot} u using (uniprot_id) group by 1")
def max_by_group_sql(t):
    return t.sql("select target_name, max(protein_names) as protein_names from {design} d join {uniprot} u using (uniprot_id) group by 1")


MESSAGES = "select user_id as plate_id, concat('[{\"message\":\"', event_type, '\",\"id\":', event_id, '},{\"message\":\"seen\",\"id\":', event_id, '}]') as events from {events}"


@query("event_message_rollup", "select plate_id, message, count(*) as n, min(id) as first_id from (select user_id as plate_id, event_type as message, event_id as id from events union all select user_id, 'seen', event_id from events) q group by 1, 2")
def event_message_rollup(t):
    e = t.events.select(F.col("user_id").alias("plate_id"), F.concat(
        F.lit('[{"message":"'), "event_type", F.lit('","id":'), "event_id", F.lit('},{"message":"seen","id":'), "event_id", F.lit("}]")).alias("events"))
    rows = e.select("plate_id", F.inline(F.from_json("events", "array<struct<message:string,id:bigint>>")))
    return rows.groupBy("plate_id", "message").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("result_json_flatten", "select result_id, fov_id, kind, cast(json_extract(data, '$.k') as int) as k, json_extract_string(data, '$.error') is not null as is_error from {fov_result}")
def result_json_flatten(t):
    r = t.fov_result.withColumn("d", F.from_json("data", "k int, error string"))
    return r.select("result_id", "fov_id", "kind", "d.k", F.col("d.error").isNotNull().alias("is_error"))


@query("score_bands", """select kind, fov_id % 50 as well, round(avg(case when score > 0.7 then 1.0 else 0 end), 8) as good, round(avg(case when score < 0.3 then 1.0 else 0 end), 8) as bad,
    round(avg(case when score is null then 1.0 else 0 end), 8) as missing, max(score) as max_score, count(*) as n from {fov_result} group by 1, 2""")
def score_bands(t):
    return rounded(E.score_bands(t.fov_result.withColumn("well", F.col("fov_id") % 50), ["kind", "well"], 0.7, 0.3), "good", "bad", "missing", digits=8)


SEQ = "select user_id as well, sum(case when event_type = 'view' then 1 else 0 end) as hdr, sum(case when event_type = 'click' then 1 else 0 end) as nhej, case when user_id % 7 = 0 then null else sum(case when event_type = 'error' then 1 else 0 end) end as mixed from {events} group by 1"


@query("sequencing_fractions", f"select well, round(hdr / (hdr + nhej + mixed), 8) as hdr, round(nhej / (hdr + nhej + mixed), 8) as nhej, round(mixed / (hdr + nhej + mixed), 8) as mixed from ({SEQ}) q where hdr + nhej + mixed <> 0")
def sequencing_fractions(t):
    return rounded(E.sequencing_fractions(t.sql(SEQ), ["hdr", "nhej", "mixed"]), "hdr", "nhej", "mixed", digits=8)


@query("histogram", """with v as (select event_type as plate, value from events), b as (select plate, quantile_cont(value, 0.002) as lo, quantile_cont(value, 0.998) as hi, 2 * pow(count(*), 1 / 3.0) as nb from v group by 1),
    w as (select *, (hi - lo) / nb as width, cast(ceil(nb) as bigint) - 1 as n_bins from b),
    c as (select v.plate, least(cast(floor((value - lo) / width) as bigint), n_bins - 1) as bin, count(*) as n from v join w on w.plate = v.plate where value >= lo and value <= lo + width * n_bins group by 1, 2),
    t as (select plate, sum(n) as total from c group by 1)
    select c.plate, bin, c.n, round(lo + (bin + 0.5) * width, 6) as center, round(c.n / (total * width), 8) as density from c join w on w.plate = c.plate join t on t.plate = c.plate""")
def histogram(t):
    from ..operators.cyto import histogram as hist
    h = hist(t.events.select(F.col("event_type").alias("plate"), "value"), ["plate"], "value", percentile=0.2)
    return rounded(h.drop("lo", "width").withColumn("center", F.round("center", 6)), "density", digits=8)


@query("file_size_rollup", "select n_nationkey as plate, round(sum(n_chars) / pow(1000, 3), 9) as gb, count(*) as n_files, count(distinct d.source) as n_targets from documents d join nation on n_nationkey = doc_id % 25 group by 1")
def file_size_rollup(t):
    d = t.documents.join(t.nation, F.col("n_nationkey") == F.col("doc_id") % 25)
    return d.groupBy(F.col("n_nationkey").alias("plate")).agg(F.round(F.sum("n_chars") / 1e9, 9).alias("gb"), F.count("*").alias("n_files"), F.count_distinct("source").alias("n_targets"))


LOCS = ["fr_1", "en_1", "en_2", "src1", "src2", "src3", "publication_ready", "no_gfp"]


@query("labels_to_columns", f"select fov_id, ls[1] as label_0, ls[2] as label_1, ls[3] as label_2, ls[4] as label_3, ls[5] as label_4, ls[6] as label_5 from (select f.fov_id, list_sort(list_filter({CATS}, lambda x: list_contains({LOCS}, x))) as ls from {{fov}} f join {{annotation}} a on a.entity_id = f.line_id) q")
def labels_to_columns(t):
    a = t.annotation.select(F.col("entity_id").alias("line_id"), F.array_intersect(E.categories(), F.array(*[F.lit(x) for x in LOCS])).alias("ls"))
    return R.numbered_labels(t.fov.join(a, "line_id"), "fov_id", "ls", 6)


@query("cluster_extent", """with h as (select cluster_id, gene, row_number() over (partition by cluster_id order by gene) as i from {clusters}), m as (select cluster_id, max(i) as max_row from h group by 1)
    select d.cluster_id, d.subcluster_id, min(d.gene) as first_target, max_row from {clusters} d join m on m.cluster_id = d.cluster_id group by 1, 2, 4""")
def cluster_extent(t):
    size = t.clusters.groupBy("cluster_id").agg(F.count("*").alias("max_row"))
    return t.clusters.groupBy("cluster_id", "subcluster_id").agg(F.min("gene").alias("first_target")).join(size, "cluster_id")


RANKED = f"(select f.line_id, f.fov_id, s.score, row_number() over (partition by f.line_id order by s.score desc, f.fov_id) as rank from {{fov}} f join {SCORE_VIEW} s on s.fov_id = f.fov_id where s.score is not null)"


@query("newer_than_cutoff", f"select line_id, max(fov_id) as max_fov_id from {RANKED} q where rank <= 2 group by 1 having max(fov_id) > 1000")
def newer_than_cutoff(t):
    return E.lines_newer_than(t.fov, E.fov_scores(t.fov_result, "view"), 1000)


@query("sliced_edge_counts", "with r as (select target, cast(floor((row_number() over (order by target) - 1) / 30) as bigint) as block from (select distinct target from {edges}) q) select block, count(*) as n_edges, round(avg(count(*)) over (), 6) as mean_edges from {edges} e join r on r.target = e.target group by 1")
def sliced_edge_counts(t):
    counts = t.edges.join(R.block_numbers(t.edges, "target", 30), "target").groupBy("block").agg(F.count("*").alias("n_edges"))
    return counts.join(F.broadcast(counts.agg(F.round(F.avg("n_edges"), 6).alias("mean_edges"))), F.lit(True))


# --- ranked choices ------------------------------------------------------------------------------

@query("best_pulldown", "select line_id, pulldown_id from (select *, row_number() over (partition by line_id order by case when display_flag then 0 else 1 end, pulldown_id) as r from {pulldown}) q where r = 1")
def best_pulldown(t):
    return E.best_pulldown(t.pulldown)


@query("best_cell_line", """select design_id, line_id from (select design_id, l.line_id, row_number() over (partition by design_id order by case when sort_count > 2 then 0 when l.line_id in (select line_id from {pulldown} where display_flag) then 1
    when l.line_id in (select line_id from {fov}) then 2 else 3 end, l.line_id) as r from {line} l) q where r = 1""")
def best_cell_line(t):
    lines = t.line.withColumn("sort_count", F.col("sort_count") - 1)
    return E.best_cell_line(lines, t.pulldown.filter("display_flag"), t.fov)


@query("best_fov", "select line_id, min(fov_id) as first_fov_id, max(fov_id) as last_fov_id from {fov} where fov_id in (select doc_id from labels) group by 1")
def best_fov(t):
    return E.best_fov(t.fov, t.labels.select(F.col("doc_id").alias("fov_id")))


@query("top_scoring_fovs", f"select line_id, fov_id, score, cast(rank as int) as rank from {RANKED} q where rank <= 3")
def top_scoring_fovs(t):
    return E.top_scoring_fovs(t.fov, E.fov_scores(t.fov_result, "view"), 3).select("line_id", "fov_id", "score", "rank")


BAIT_HITS = f"(select h.* from {{hit}} h join {{pulldown}} p on p.pulldown_id = h.pulldown_id join {{line}} l on l.line_id = p.line_id join {BRIDGE} b on b.group_id = h.group_id and b.design_id = l.design_id where {SIG})"


@query("bait_hit_best", f"select pulldown_id, hit_id, group_id, enrichment from (select *, row_number() over (partition by pulldown_id order by enrichment desc, hit_id) as r from {BAIT_HITS} q) w where r = 1")
def bait_hit_best(t):
    return E.bait_hit_best(E.bait_hits(t.pulldown, t.line, t.hit, E.group_designs(t.protein_group, t.design)))


REF_UNIPROT = """(select ensg_id, uniprot_id, protein_names, gene_names, annotation from (select *, row_number() over (partition by ensg_id order by case when has then len(annotation) else 0 end desc nulls last,
    case when has then 0 else len(string_split(gene_names, ' ')) end desc, uniprot_id) as r from (select * replace (nullif(annotation, 'NaN') as annotation), bool_or(nullif(annotation, 'NaN') is not null) over (partition by ensg_id) as has
    from {uniprot} where ensg_id is not null) q) w where r = 1)"""


@query("reference_uniprot", REF_UNIPROT[1:-1])
def reference_uniprot(t):
    return E.reference_uniprot(t.uniprot)


@query("max_edge_dedupe", "select target, prey, plate, pvals, row_key from (select *, row_number() over (partition by target, prey order by pvals desc, row_key desc) as r from {scores}) q where r = 1")
def max_edge_dedupe(t):
    return ranking.best_row(t.scores, ["target", "prey"], [F.col("pvals"), F.col("row_key")], ["plate", "pvals", "row_key"], largest=True)


@query("duplicate_max_ties", "select distinct target, prey, plate, pvals from {scores} s where pvals = (select max(pvals) from {scores} x where x.target = s.target and x.prey = s.prey)")
def duplicate_max_ties(t):
    return R.duplicate_max_ties(t.scores.select("target", "prey", "plate", "pvals"), ["target", "prey"], "pvals")


@query("first_per_group", "select plate_id, min(design_id) as design_id, arg_min(target_name, design_id) as target_name from {design} group by 1")
def first_per_group(t):
    return ranking.best_row(t.design, ["plate_id"], [F.col("design_id")], ["design_id", "target_name"])


@query("rolling_7d", "with d as (select cast(o_orderdate as date) as day, count(*) as n from orders group by 1) select cast(day as varchar) as day, n, cast(sum(n) over (order by day range between interval 6 days preceding and current row) as bigint) as n_7d from d")
def rolling_7d(t):
    return R.rolling_sum(t.orders, "o_orderdate").withColumn("day", F.col("day").cast("string"))


@query("cumulative_quantile", """with h as (select event_type as plate, cast(floor(value / 5) as bigint) as bin, count(*) as y from events group by 1, 2), c as (select plate, bin, sum(y) over (partition by plate order by bin) / sum(y) over (partition by plate) as yc from h),
    l as (select *, lag(yc) over (partition by plate order by bin) as py, lag(bin) over (partition by plate order by bin) as pb from c)
    select plate, round(max(case when yc >= 0.5 and py < 0.5 then pb * 5 + (bin - pb) * 5 * (0.5 - py) / (yc - py) end), 6) as q50, round(max(case when yc >= 0.99 and py < 0.99 then pb * 5 + (bin - pb) * 5 * (0.99 - py) / (yc - py) end), 6) as q99 from l group by 1""")
def cumulative_quantile(t):
    from ..operators.cyto import cumulative_quantiles
    h = t.events.groupBy(F.col("event_type").alias("plate"), (F.floor(F.col("value") / 5) * 5).alias("x")).agg(F.count("*").alias("y"))
    return rounded(cumulative_quantiles(h, ["plate"], "x", "y", {"q50": 0.5, "q99": 0.99}), "q50", "q99")


@query("step_diffs", "select fov_id, channel, count(*) as n, max(slice_ind) - min(slice_ind) + 1 = count(*) as contiguous, max(exposure_time) = min(exposure_time) as constant from {page} group by 1, 2")
def step_diffs(t):
    return E.step_properties(t.page, ["fov_id", "channel"], "slice_ind", "exposure_time")


@query("second_difference_max", "select fov_id, cast(max(abs(d2)) as double) as max_d2 from (select fov_id, n_chars - 2 * lag(n_chars) over w + lag(n_chars, 2) over w as d2 from {page} window w as (partition by fov_id order by slice_ind)) q where d2 is not null group by 1")
def second_difference_max(t):
    return E.second_difference_max(t.page, ["fov_id"], "slice_ind", "n_chars")


@query("tile_positions", "select line_id, cast(floor((row_number() over (order by line_id) - 1) / 36) as bigint) as tile_row, (row_number() over (order by line_id) - 1) % 36 as tile_column from {line}")
def tile_positions(t):
    return E.tile_positions(t.line, "line_id")


@query("score_sort", "select fov_id, coalesce(nullif(score, 0), -2) as sort_score from {fov_result} where kind = 'view' order by sort_score desc nulls last, fov_id")
def score_sort(t):
    s = t.fov_result.filter("kind = 'view'").select("fov_id", F.coalesce(F.nullif(F.col("score"), F.lit(0.0)), F.lit(-2.0)).alias("sort_score"))
    return s.orderBy(F.desc_nulls_last("sort_score"), "fov_id")


@query("relevance_topk", "select doc_id, n_chars from documents order by n_chars desc, doc_id limit 100")
def relevance_topk(t):
    return t.documents.select("doc_id", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(100)


@query("plate_layout", """with f as (select substr('ABCDEFGH', cast(r as int) + 1, 1) as row, lpad(cast(c + 1 as varchar), 2, '0') as col from (select unnest(range(8)) as r) a, (select unnest(range(12)) as c) b),
    d as (select plate_id, well_id, min_by(target_name, design_id) as target_name from {design} group by 1, 2)
    select p.plate_id, f.row, f.col as "column", d.target_name from (select distinct plate_id from {design}) p cross join f left join d on d.plate_id = p.plate_id and d.well_id = f.row || f.col""")
def plate_layout(t):
    return R.plate_layout(t.design, t.spark)


# --- set operations ------------------------------------------------------------------------------

@query("set_union_rows", "select target, prey, pvals, null::varchar as source from {scores} where pvals > 19 union all select prot_1, prot_2, null, 'reference' from {corum}")
def set_union_rows(t):
    a = t.scores.filter("pvals > 19").select("target", "prey", "pvals")
    b = t.corum.select(F.col("prot_1").alias("target"), F.col("prot_2").alias("prey"), F.lit("reference").alias("source"))
    return a.unionByName(b, allowMissingColumns=True)


@query("set_difference", "select prey as gene from {scores} where pvals > 18 except select gene from {localization}")
def set_difference(t):
    return t.scores.filter("pvals > 18").select(F.col("prey").alias("gene")).subtract(t.localization.select("gene"))


@query("set_intersect", "select prey as gene from {scores} where pvals > 18 intersect select target from {scores}")
def set_intersect(t):
    return t.scores.filter("pvals > 18").select(F.col("prey").alias("gene")).intersect(t.scores.select("target"))


@query("array_set_concat", "select p_partkey, unnest(list_concat(string_split(p_name, ' '), string_split(p_type || '|' || p_brand, '|'))) as alias from part")
def array_set_concat(t):
    return t.part.select("p_partkey", F.explode(F.concat(F.split("p_name", " "), F.split(F.concat_ws("|", "p_type", "p_brand"), "[|]"))).alias("alias"))


@query("distinct_rows", "select distinct target, plate from {scores}")
def distinct_rows(t):
    return t.scores.select("target", "plate").distinct()
