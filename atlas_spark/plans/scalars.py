"""Queries for the scalar functions."""

from pyspark.sql import functions as F

from ..functions import cols as C
from ..operators import imaging_paths
from ..registry import query


@query("fn_group_id", """select group_id, sha256('[''' || array_to_string(list_sort(string_split(uniprot_ids, ';')), ''', ''') || ''']') as hashed_id
       from {protein_group}""")
def fn_group_id(t):
    return t.protein_group.select("group_id", C.group_id("uniprot_ids").alias("hashed_id"))


MS_PLATE_TEXT = """case c_custkey % 6 when 0 then cast(c_custkey as string) when 1 then concat('Plate ', c_custkey, '.2')
    when 2 then concat('plate_', c_custkey, '.0') when 3 then concat('CZBMPI_', lpad(cast(c_custkey % 10000 as string), 4, '0'))
    when 4 then 'none' else concat('CZBMPI_', c_custkey, '.1') end"""


@query("fn_ms_plate", f"""select c_custkey, case when regexp_matches(s, '^CZBMPI_[0-9]{{{{4}}}}(.[0-9])?$') then s
         when regexp_extract(s, '([0-9]+)', 1) = '' then null
         else 'CZBMPI_' || printf('%04d', cast(regexp_extract(s, '([0-9]+)', 1) as bigint)) ||
              case when regexp_extract(s, '(\\.[0-9]+)$', 1) = '.0' then '' else regexp_extract(s, '(\\.[0-9]+)$', 1) end end as ms_plate
       from (select c_custkey, {MS_PLATE_TEXT} as s from customer) q""".replace("{{4}}", "{4}"))
def fn_ms_plate(t):
    return t.customer.select("c_custkey", C.ms_plate(F.expr(MS_PLATE_TEXT)).alias("ms_plate"))


WELL_TEXT = "concat(substr('ABCDEFGHZ', cast(c_custkey % 9 as int) + 1, 1), c_custkey % 14)"


@query("fn_well_id", f"""select c_custkey, case when regexp_matches(w, '^[A-H][1-9]$') then w[1] || '0' || w[2] else w end as well_id
       from (select c_custkey, {WELL_TEXT} as w from customer) q""")
def fn_well_id(t):
    return t.customer.select("c_custkey", C.well_id(F.expr(WELL_TEXT)).alias("well_id"))


PLATE_TEXT = """case c_custkey % 6 when 0 then cast(c_custkey as string) when 1 then concat('plate', c_custkey)
    when 2 then concat('Plate ', c_custkey) when 3 then concat('P0', c_custkey) when 4 then concat('Plate  ', c_custkey) else 'a' end"""


@query("fn_plate_id", f"""select c_custkey, case when n = '' then null else 'P' || printf('%04d', cast(n as bigint)) end as plate_id
       from (select c_custkey, regexp_extract(lower({PLATE_TEXT}), '^p?(late)? ?([0-9]+)$', 2) as n from customer) q""")
def fn_plate_id(t):
    return t.customer.select("c_custkey", C.plate_id(F.expr(PLATE_TEXT)).alias("plate_id"))


@query("fn_is_sequence", """select doc_id, translate(lower(substr(text, 1, 1 + doc_id % 3)), 'acgt', '') = '' as is_sequence from documents""")
def fn_is_sequence(t):
    return t.documents.select("doc_id", C.is_sequence(F.expr("substr(text, 1, cast(1 + doc_id % 3 as int))")).alias("is_sequence"))


@query("fn_terminus", """select c_custkey, case when c_mktsegment[1] = 'B' then 'INTERNAL'
       when c_mktsegment[1] = 'A' then 'C_TERMINUS' when c_mktsegment[1] = 'H' then 'N_TERMINUS' else lower(c_mktsegment) end as terminus from customer""")
def fn_terminus(t):
    text = F.expr("""case substr(c_mktsegment, 1, 1) when 'B' then 'Internal' when 'A' then 'C-term'
                     when 'H' then 'n' else c_mktsegment end""")
    return t.customer.select("c_custkey", C.terminus(text).alias("terminus"))


@query("fn_parse_float", """select o_orderkey, case when o_orderkey % 5 = 0 then null else round(o_totalprice, 2) end as amount from orders""")
def fn_parse_float(t):
    text = F.when(F.col("o_orderkey") % 5 == 0, F.lit("n/a")).otherwise(F.format_number("o_totalprice", 2))
    return t.orders.select("o_orderkey", C.parse_float(text).alias("amount"))


@query("fn_protein_name", "select p_partkey, p_name as protein_name from part")
def fn_protein_name(t):
    return t.uniprot.select(F.expr("cast(substr(uniprot_id, 2) as bigint)").alias("p_partkey"),
                            C.protein_name("protein_names").alias("protein_name"))


@query("fn_annotation", """select uniprot_id, regexp_replace(regexp_replace(replace(replace(a, '; FUNCTION: ', ' '), 'FUNCTION: ', ''),
       ' \\((PubMed:[0-9]+(, )?)+\\)', '', 'g'), ' [{].*[}].', '', 'g') as annotation
       from (select uniprot_id, annotation || case when uniprot_id like '%3' then ' {ECO:1|PubMed:2, ECO:3}.' else '' end as a from {uniprot}) q""")
def fn_annotation(t):
    text = F.concat("annotation", F.when(F.col("uniprot_id").endswith("3"), " {ECO:1|PubMed:2, ECO:3}.").otherwise(""))
    return t.uniprot.select("uniprot_id", C.annotation(text).alias("annotation"))


@query("fn_primary_gene", """select uniprot_id, case when annotation = 'NaN' then uniprot_id else string_split(gene_names, ' ')[1] end as primary_gene from {uniprot}""")
def fn_primary_gene(t):
    names = F.when(F.col("annotation") == "NaN", "NaN").otherwise(F.col("gene_names"))
    return t.uniprot.select("uniprot_id", C.primary_gene(names, "uniprot_id").alias("primary_gene"))


@query("fn_strip_isoform", """select group_id, string_split(unnest(string_split(uniprot_ids, ';')), '-')[1] as uniprot_id from {protein_group}""")
def fn_strip_isoform(t):
    ids = t.protein_group.select("group_id", F.explode(F.split("uniprot_ids", ";")).alias("u"))
    return ids.select("group_id", C.strip_isoform("u").alias("uniprot_id"))


@query("fn_public_ids", "select c_custkey, printf('OPCT%011d', c_custkey) as target_public_id, printf('OCPD%011d', c_custkey) as group_public_id from customer")
def fn_public_ids(t):
    return t.customer.select("c_custkey", C.public_id("c_custkey").alias("target_public_id"),
                             C.public_id("c_custkey", C.GROUP_ID_PREFIX).alias("group_public_id"))


@query("fn_clean_name", "select page_id, replace(replace(replace(url, '-', ''), '_', ''), '/', '') as clean_name from pages")
def fn_clean_name(t):
    return t.pages.select("page_id", C.clean_name("url").alias("clean_name"))


@query("fn_dst_path", """select line_id, site_num, fov_id, 'roi/czML0383-' || plate || '/czML0383-' || plate || '-' || well || '-' || pml_id || '-S' ||
       lpad(cast(site_num as varchar), 2, '0') || '_ROI-0000-' || lpad(cast(site_num * 100 as varchar), 4, '0') || '-0600-0600-PROJ-CH405.tif' as path
       from (select *, 'P' || lpad(cast(line_id % 25 as varchar), 4, '0') as plate, 'A' || lpad(cast(line_id % 12 + 1 as varchar), 2, '0') as well from {fov}) q""")
def fn_dst_path(t):
    f = t.fov.withColumn("plate", F.concat(F.lit("P"), C.zero_pad(F.col("line_id") % 25, 4))) \
             .withColumn("well", F.concat(F.lit("A"), C.zero_pad(F.col("line_id") % 12 + 1, 2)))
    coords = [F.lit("0000"), C.zero_pad(F.col("site_num") * 100, 4), F.lit("0600"), F.lit("0600"), F.lit("PROJ"), F.lit("CH405")]
    return f.select("line_id", "site_num", "fov_id",
                    C.dst_path(F.lit("roi"), F.lit("czML0383"), "plate", "well", "pml_id",
                               F.concat(F.lit("S"), C.zero_pad("site_num", 2)), coords, F.lit("tif")).alias("path"))


RAW_FILES = """select concat('mNG96wp', n_chars % 24 + 1, case doc_id % 5 when 0 then '_Thawed' when 1 then '_Thawed2' else '' end,
    '/ML', lpad(cast(doc_id % 90 as string), 4, '0'), '_20190101/', substr('ABCDEFGH', cast(doc_id % 8 as int) + 1, 1), n_chars % 12 + 1, '_', doc_id % 30,
    case when doc_id % 6 = 0 then '_Jin_A1_' else '_' end, 'GENE', doc_id % 17, case doc_id % 4 when 0 then '-N' when 1 then '_Int' when 2 then '' else '+' end,
    '.ome.tif') as path from {documents}"""


@query("fn_parse_tiff_name", """with f as (select path, string_split(path, '/')[1] as plate_dir, string_split(path, '/')[2] as exp_dir, string_split(path, '/')[3] as name
         from (""" + RAW_FILES + """) q),
       p as (select *, regexp_extract(name, '^([A-H][1-9][0-2]?)_([1-9][0-9]?)_(Jin_[A-H][1-9][0-2]?_)?([a-zA-Z0-9]+)([|_-][a-zA-Z]+)?.ome.tif$', 1) as w,
         regexp_extract(name, '^([A-H][1-9][0-2]?)_([1-9][0-9]?)_(Jin_[A-H][1-9][0-2]?_)?([a-zA-Z0-9]+)([|_-][a-zA-Z]+)?.ome.tif$', 2) as s,
         regexp_extract(name, '^([A-H][1-9][0-2]?)_([1-9][0-9]?)_(Jin_[A-H][1-9][0-2]?_)?([a-zA-Z0-9]+)([|_-][a-zA-Z]+)?.ome.tif$', 4) as g from f),
       r as (select string_split(exp_dir, '_')[1] || '-' || case when len(w) = 2 then w[1] || '0' || w[2] else w end || '-S' || lpad(s, 2, '0') as fov_id,
         'P' || string_split(exp_dir, '_')[1] as pml_id, cast(s as int) as site_num, g as target_name,
         'P' || lpad(regexp_extract(plate_dir, '([0-9]+)(_Thawed2?)?$', 1), 4, '0') as plate_id,
         case when plate_dir like '%Thawed2%' then 3 when plate_dir like '%Thawed%' then 2 else 1 end as imaging_round_num
         from p where w <> '')
       select * from r where fov_id in (select fov_id from r group by fov_id having count(*) = 1)""")
def fn_parse_tiff_name(t):
    return imaging_paths.raw_metadata(t.sql(RAW_FILES))


@query("fn_z_step", "select fov_id, case when cast(substr(pml, 4) as int) < 123 then 0.5::double else 0.2::double end as z_step from (select fov_id, 'PML' || lpad(cast(fov_id % 300 as varchar), 4, '0') as pml from {fov}) q")
def fn_z_step(t):
    pml = F.concat(F.lit("PML"), C.zero_pad(F.col("fov_id") % 300, 4))
    return t.fov.select("fov_id", C.z_step(pml).alias("z_step"))


@query("fn_grade", """select entity_id, c as category, nullif(regexp_extract(c, '_([1,2,3])$', 1), '') as grade, regexp_replace(c, '_[1,2,3]$', '') as root
       from (select entity_id, unnest(cast(categories as json)::varchar[]) as c from {annotation}) q""")
def fn_grade(t):
    a = t.annotation.select("entity_id", F.explode(F.from_json("categories", "array<string>")).alias("category"))
    return a.withColumn("grade", C.grade("category")).withColumn("root", C.root_category("category"))


GENE_TEXT = "concat(upper(split_part(p_name, ' ', 1)), p_size, case when p_partkey % 3 = 0 then 'AB' when p_partkey % 3 = 1 then 'x' else '' end)"


@query("fn_root_gene", f"""select p_partkey, case when regexp_extract(g, '^(.+?)[0-9]+[A-Z]+$', 1) <> '' then regexp_extract(g, '^(.+?)[0-9]+[A-Z]+$', 1)
       else regexp_extract(g, '^(.+?)[0-9]*$', 1) end as root from (select p_partkey, {GENE_TEXT} as g from part) q""")
def fn_root_gene(t):
    return t.part.select("p_partkey", C.root_gene(F.expr(GENE_TEXT)).alias("root"))


HLOG_SQL = """(case when v < 0 then -1 else 1 end) * pow(10, (case when v < 0 then -1 else 1 end) * v * log10(262144) / 10000)
    + 350 * v * log10(262144) / 10000 - (case when v < 0 then -1 else 1 end)"""


@query("fn_hlog_inverse", f"select event_id, round({HLOG_SQL}, 6) as linear from (select event_id, value * 20 - 400 as v from events) q")
def fn_hlog_inverse(t):
    return t.events.select("event_id", F.round(C.hlog_inverse(F.col("value") * 20 - 400), 6).alias("linear"))


@query("fn_simplify_histogram", """select vec_id, array_to_string(list_transform(list_filter(range(1, len(embedding) + 1), lambda i: i % 2 = 1),
       lambda i: cast(trunc(cast(embedding[i] as double) * 1000000) as bigint)), ',') as ys from embeddings""")
def fn_simplify_histogram(t):
    doubles = F.transform("embedding", lambda x: x.cast("double"))
    return t.embeddings.select("vec_id", F.array_join(C.simplify_histogram(doubles, C.HISTOGRAM_SCALE), ",").alias("ys"))


@query("fn_json_extract", "select event_id, cast(json_extract(props, '$.k') as int) as k from events")
def fn_json_extract(t):
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("fn_safe_log10", "select row_key, case when interaction_stoi > 0 then round(log10(interaction_stoi), 6) end as log_stoi from {scores}")
def fn_safe_log10(t):
    return t.scores.select("row_key", F.round(C.log10_or_null("interaction_stoi"), 6).alias("log_stoi"))


@query("fn_to_json", """select row_key, case when pvals > 19 then '{"enrichment":null}' else '{"enrichment":' || cast(cast(enrichment as double) as varchar) || '}' end as js from {scores}""")
def fn_to_json(t):
    bad = F.when(F.col("pvals") > 19, F.lit(float("nan"))).otherwise(F.col("enrichment"))
    return t.scores.withColumn("enrichment", bad).select("row_key", C.json_row("enrichment").alias("js"))


@query("fn_theoretical_peptides", """select doc_id, len(list_filter(string_split(text, 'e'), lambda p: len(p) between 7 and 30)) as peptides from documents""")
def fn_theoretical_peptides(t):
    return t.documents.select("doc_id", C.peptide_count("text", cut="e").cast("bigint").alias("peptides"))


@query("fn_exp2", "select event_id, round(pow(2, value / 50), 6) as v from events")
def fn_exp2(t):
    return t.events.select("event_id", F.round(C.exp2(F.col("value") / 50), 6).alias("v"))
