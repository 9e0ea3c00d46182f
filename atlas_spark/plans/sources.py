"""Queries for readers, writers and keyed updates.  Reader queries write the given tables in the
reader's file format first, so they run over whole tables and can be checked by SQL."""

from pyspark.sql import functions as F

from ..functions import cols as C
from ..registry import query
from ..sources import readers as R, upserts as U, writers as W

SAMPLES = [(b, r) for b in range(12) for r in range(3)]
GROUP_FILE = """select l_partkey as pk, {sums} from (select l_partkey, concat('B', l_suppkey % 12, '_', l_linenumber % 3) as s,
    max(l_extendedprice) as v from {{lineitem}} group by 1, 2) q group by 1"""


def group_file(t, prefix, suffix=""):
    sums = ", ".join(f"max(case when s = 'B{b}_{r}' then v end) as `{prefix} B{b}_0{r + 1}{suffix}`" for b, r in SAMPLES)
    wide = t.sql(GROUP_FILE.format(sums=sums))
    pk = F.col("pk")
    flag = lambda n: F.when(pk % n == 0, "+")
    wide = wide.select(F.concat(F.lit("Q"), pk).alias("Protein IDs"), F.concat(F.lit("Q"), pk).alias("Majority protein IDs"),
                       F.lit("name").alias("Protein names"), F.concat(F.lit("G"), pk).alias("Gene names"),
                       F.lit("h").alias("Fasta headers"), flag(11).alias("Potential contaminant"),
                       flag(13).alias("Only identified by site"), flag(17).alias("Reverse"),
                       F.lit(1.0).alias("Intensity"), *[R.quoted(c) for c in wide.columns if c != "pk"])
    path = W.scratch_path(t.spark)
    wide.write.csv(path, sep="\t", header=True)
    return path


LONG_SQL = """select concat('Q', l_partkey) as protein_ids, concat('B', l_suppkey % 12) as bait, cast(l_linenumber % 3 + 1 as int) as replicate,
    max(l_extendedprice) as value from lineitem where l_partkey % 11 <> 0 and l_partkey % 13 <> 0 and l_partkey % 17 <> 0 group by 1, 2, 3"""


@query("read_protein_groups", LONG_SQL)
def read_protein_groups(t):
    df = R.read_protein_groups(t.spark, group_file(t, "LFQ intensity"), prefixes=("LFQ intensity",))
    long = R.melt_samples(df, ["Protein IDs"], R.select_by_prefix(df.columns, "lfq intensity"), "^LFQ intensity (.*)_0[0-9]", "_0([0-9])$")
    return long.filter("value is not null").withColumnRenamed("Protein IDs", "protein_ids")


@query("read_spatial_groups", LONG_SQL)
def read_spatial_groups(t):
    df = R.read_spatial_groups(t.spark, group_file(t, "Intensity"))
    long = R.melt_samples(df, ["Protein IDs"], R.select_by_prefix(df.columns, "intensity"), "^Intensity (.*)_0[0-9]", "_0([0-9])$")
    return long.filter("value is not null").withColumnRenamed("Protein IDs", "protein_ids")


@query("select_by_prefix", """select l_partkey as pk, max(case when l_suppkey % 12 = 1 then l_extendedprice end) as lfq_1,
    max(case when l_suppkey % 12 = 2 then l_extendedprice end) as LFQ_2 from lineitem group by 1""")
def select_by_prefix(t):
    wide = t.sql("""select l_partkey as pk, max(case when l_suppkey % 12 = 1 then l_extendedprice end) as lfq_1,
        max(case when l_suppkey % 12 = 2 then l_extendedprice end) as LFQ_2, max(l_tax) as other from {lineitem} group by 1""")
    return wide.select("pk", *R.select_by_prefix(wide.columns, "LFQ"))


@query("melt_samples", """select prey, concat('B', b) as bait, cast(r as int) as replicate, value from (
    select prey, bait, replicate, value from {intensity}) i join (select unnest(range(12)) as b) bb on i.bait = concat('B', b)
    join (select unnest(range(3)) as r) rr on r = replicate where value is not null""")
def melt_samples(t):
    wide = t.intensity.withColumn("s", F.concat_ws("_0", "bait", "replicate")) \
        .groupBy("prey").pivot("s", [f"B{b}_0{r}" for b, r in SAMPLES]).agg(F.max("value"))
    return R.melt_samples(wide, ["prey"], wide.columns[1:], "^(.*)_0[0-9]$", "_0([0-9])$").filter("value is not null")


@query("pivot_sparse_matrix", "select prey, " + ", ".join(
    f"coalesce(max(case when bait = 'B{b}' then value end), 0) as B{b}" for b in range(12)) + " from {intensity} group by prey")
def pivot_sparse_matrix(t):
    from ..operators.quant import sparse_matrix
    return sparse_matrix(t.intensity, "prey", "bait", "value", [f"B{b}" for b in range(12)])


@query("read_fasta", """select concat('sp|Q', doc_id, '|', upper(lang)) as reference, concat('Q', doc_id) as protein_id,
    regexp_replace(upper(replace(text, 'ß', '')), '[^A-Z]', '', 'g') as sequence from documents""")
def read_fasta(t):
    path = W.scratch_path(t.spark)
    seq = F.regexp_replace(F.upper(F.replace(F.col("text"), F.lit("ß"), F.lit(""))), "[^A-Z]", "")
    rec = F.concat(F.lit(">sp|Q"), F.col("doc_id"), F.lit("|"), F.upper("lang"), F.lit(" some name\n"),
                   F.regexp_replace(seq, "(.{60})", "$1\n"))
    t.documents.select(rec.alias("value")).write.text(path)
    return R.read_fasta(t.spark, path)


@query("read_library_snapshot", """select printf('P%04d', c_nationkey) as plate_id, concat('A', c_custkey % 12 + 1) as well_id, c_name as target_name,
    c_mktsegment as target_family, concat('ENST', c_custkey) as transcript_id, round(c_acctbal, 2) as hek_tpm from customer""")
def read_library_snapshot(t):
    path = W.scratch_path(t.spark)
    c = t.customer.select(
        F.concat(F.lit("Plate "), "c_nationkey").alias("plate_id"), F.concat(F.lit("A"), F.col("c_custkey") % 12 + 1).alias("well_id"),
        F.col("c_name").alias("gene_name"), F.col("c_mktsegment").alias("family"), F.concat(F.lit("ENST"), "c_custkey").alias("enst_id"),
        F.format_number("c_acctbal", 2).alias("hek_tpm"),
        *[F.lit("x").alias(n) for n in R.LIBRARY_COLUMNS if n not in ("plate_id", "well_id", "gene_name", "family", "enst_id", "hek_tpm")])
    c.write.csv(path, header=True)
    return R.read_library_snapshot(t.spark, path).select("plate_id", "well_id", "target_name", "target_family", "transcript_id", "hek_tpm")


@query("read_electroporations", "select printf('P%04d', c_nationkey) as plate_id, concat('2019-01-', c_custkey % 28 + 1) as date, c_name as notes from customer")
def read_electroporations(t):
    path = W.scratch_path(t.spark)
    t.customer.select(F.concat(F.lit("plate"), "c_nationkey").alias("plate_id"),
                      F.concat(F.lit("2019-01-"), F.col("c_custkey") % 28 + 1).alias("electroporation_date"),
                      F.col("c_name").alias("comment"), F.lit(1).alias("extra")).write.csv(path, header=True)
    return R.read_electroporations(t.spark, path)


@query("read_microscopy_key", """select printf('PML%04d', o_orderkey % 10000) as pml_id, cast(cast(o_orderdate as date) as varchar) as date,
    o_orderstatus as automation, o_orderpriority as imager, cast(o_custkey as varchar) as description, 'n' as notes from orders""")
def read_microscopy_key(t):
    path = W.scratch_path(t.spark)
    t.orders.select(F.concat(F.lit("ML"), C.zero_pad(F.col("o_orderkey") % 10000, 4), F.lit("_"), F.date_format("o_orderdate", "yyyyMMdd")).alias("ID"),
                    F.col("o_orderstatus").alias("Automated acquisition?"), F.col("o_orderpriority").alias("Primary imager"),
                    F.col("o_custkey").alias("Description"), F.lit("n").alias("Acquisition notes"), F.lit("z").alias("Unnamed: 5")
                    ).write.csv(path, header=True)
    return R.read_microscopy_key(t.spark, path).withColumn("date", F.col("date").cast("string"))


@query("read_platemap", """with p as (select distinct concat(substr('ABCDEFGHZ', cast(c_custkey % 9 as int) + 1, 1), c_custkey % 11 + 1) as well_id,
       case when c_custkey % 97 = 0 then null else 'g' end as target_name from customer),
     w as (select substr('ABCDEFGH', cast(r as int) + 1, 1) || cast(c + 1 as varchar) as well_id from (select unnest(range(8)) as r) a, (select unnest(range(12)) as c) b)
     select 'missing well' as problem, well_id from w where well_id not in (select well_id from p)
     union all select distinct 'unexpected well', well_id from p where well_id not in (select well_id from w)
     union all select 'no target', well_id from p where target_name is null""")
def read_platemap(t):
    path = W.scratch_path(t.spark)
    t.sql("""select distinct concat(substr('ABCDEFGHZ', cast(c_custkey % 9 as int) + 1, 1), c_custkey % 11 + 1) as well_id,
        case when c_custkey % 97 = 0 then null else 'g' end as target_name from {customer}""").write.csv(path)
    return R.platemap_problems(R.read_platemap(t.spark, path))


@query("read_hgnc", """select p_name as symbol, p_type as alias_symbol, p_brand as prev_symbol, 'n' as name, 'a' as alias_name, 'p' as prev_name,
    concat('ENSG', p_partkey) as ensg_id, concat('HGNC:', p_partkey) as hgnc_id from part""")
def read_hgnc(t):
    path = W.scratch_path(t.spark)
    t.sql("""select concat('HGNC:', p_partkey) as hgnc_id, p_name as symbol, p_type as alias_symbol, p_brand as prev_symbol, 'n' as name,
        'a' as alias_name, 'p' as prev_name, 'x' as locus, concat('ENSG', p_partkey) as ensembl_gene_id from {part}""").write.csv(path, sep="\t", header=True)
    return R.read_hgnc(t.spark, path)


@query("read_facs_results", """select event_type as plate_id, case when user_id < 10 then concat('A0', user_id) else concat('A', user_id) end as well_id,
    cast(count(*) as varchar) as n, cast(count(*) as double) as x0 from events where user_id > 0 group by event_type, user_id""")
def read_facs_results(t):
    a, b = W.scratch_path(t.spark), W.scratch_path(t.spark)
    g = t.sql("select event_type as plate_id, concat('A', user_id) as well_id, count(*) as n from {events} where user_id > 0 group by 1, 2")
    g.write.csv(a, header=True)
    one = F.array(F.col("n").cast("double"))
    g.select("plate_id", "well_id", one.alias("x"), one.alias("y_sample"), one.alias("y_ref_fitted")).write.json(b)
    r = R.read_facs_results(t.spark, a, b)
    return r.select("plate_id", "well_id", F.get_json_object("scalars", "$.n").alias("n"), F.col("x")[0].alias("x0"))


@query("read_fov_metadata", """select cast(event_id as varchar) as site_num, concat(event_type, '/', 'f', event_id, '.tif') as raw_filepath,
    cast(case when user_id % 3 = 0 then 1 else user_id % 3 end as int) as sort_count from events where value <= 200""")
def read_fov_metadata(t):
    path = W.scratch_path(t.spark)
    t.sql("""select event_id as site_num, event_type as src_dirpath, concat('f', event_id, '.tif') as src_filename,
        case when user_id % 3 = 0 then null else user_id % 3 end as sort_count, value > 200 as manually_flagged from {events}""").write.csv(path, header=True)
    return R.read_fov_metadata(t.spark, path).select("site_num", "raw_filepath", "sort_count")


@query("list_files", """select concat('mNG96wp', n_regionkey + 1) as plate_dir, count(*) as n_files, sum(length(n_name) + 1)::bigint as n_bytes, true as dated
    from nation group by 1""")
def list_files(t):
    from ..operators.imaging_paths import path_levels
    root = W.scratch_path(t.spark)
    # one image-named file per nation row, in plate folders of its region
    (t.nation.select(F.col("n_name").alias("value"), F.concat(F.lit("mNG96wp"), F.col("n_regionkey") + 1).alias("plate"),
                     F.concat(F.lit("f"), "n_nationkey", F.lit(".tif")).alias("file"))
     .write.partitionBy("plate", "file").text(root))
    # partition folders are named plate=...; the pattern argument covers such trees as well
    files = R.list_files(t.spark, root, pattern="^plate=mNG96wp[1-9]")
    files = files.withColumn("path", F.regexp_replace("path", "plate=", ""))
    rows = path_levels(files.select("path")).join(files, "path")
    recent = F.col("modificationTime").between(F.current_timestamp() - F.expr("interval 1 day"), F.current_timestamp() + F.expr("interval 1 day"))
    return rows.groupBy("plate_dir").agg(F.count("*").alias("n_files"), F.sum("length").alias("n_bytes"), F.bool_and(recent).alias("dated"))


@query("read_edge_networks", "select target, prey, weight as score from {edges} where weight > 18")
def read_edge_networks(t):
    path = W.scratch_path(t.spark)
    t.edges.select(F.col("target").alias("Gene A"), F.col("prey").alias("Gene B"), F.col("weight").alias("combined score"),
                   F.lit("x").alias("other")).write.csv(path, sep="\t", header=True)
    return R.read_edge_network(t.spark, path, "Gene A", "Gene B", "combined score", above=18, sep="\t")


@query("write_edg", "select 'EDGE' as edge, target, prey from {edges}")
def write_edg(t):
    path = W.scratch_path(t.spark)
    W.write_edg(t.edges, path)
    return t.spark.read.schema("edge string, target string, prey string").csv(path, sep="\t")


@query("write_results", """select target, prey, pvals, 'fdr1' as fdr_level, 'v1' as version from {scores} where pvals > 16 union all
    select target, prey, pvals, 'fdr5', 'v1' from {scores} where pvals > 12""")
def write_results(t):
    path = W.scratch_path(t.spark)
    s = t.scores.select("target", "prey", "pvals")
    W.write_results(s.filter("pvals > 19"), path, "fdr1", "v1")
    W.write_results(s.filter("pvals > 16"), path, "fdr1", "v1")
    W.write_results(s.filter("pvals > 12"), path, "fdr5", "v1")
    return t.spark.read.schema("target string, prey string, pvals double, version string, fdr_level string").parquet(path)


NODES = """select pulldown_id, case group_id % 3 when 0 then 'hit' when 1 then 'pulldown' else 'bait' end as type,
    concat('G', group_id) as gene_name, concat('B', pulldown_id) as bait_name, pval, enrichment, interaction_stoich, abundance_stoich,
    case when group_id % 2 = 0 then group_id % 50 end as cluster_id, case when group_id % 4 = 0 then group_id % 7 end as subcluster_id from {hit}"""


@query("export_interaction_table", f"""select pulldown_id, case when type in ('hit', 'bait') then bait_name else gene_name end as bait_gene_name,
    case when type = 'hit' then gene_name else bait_name end as prey_gene_name, round(pval, 2) as pval_minus_log10, round(enrichment, 2) as relative_enrichment,
    round(case when abundance_stoich > 0 then log10(abundance_stoich) end, 2) as abundance_stoich_log10,
    round(case when interaction_stoich > 0 then log10(interaction_stoich) end, 2) as interaction_stoich_log10,
    coalesce(cast(cluster_id as varchar), 'None') as cluster_id, coalesce(cast(subcluster_id as varchar), 'None') as core_complex_id from ({NODES}) n""")
def export_interaction_table(t):
    return W.interaction_table(t.sql(NODES))


@query("insert_if_absent", """select s_suppkey as key, s_name as name from supplier union all
    select c_custkey, c_name from customer where c_custkey not in (select s_suppkey from supplier)""")
def insert_if_absent(t):
    return U.insert_if_absent(t.sql("select s_suppkey as key, s_name as name from {supplier}"),
                              t.sql("select c_custkey as key, c_name as name from {customer} union all select c_custkey, concat(c_name, 'x') from {customer}"), ["key"])


@query("replace_by_key", """select pulldown_id, group_id, pval from {hit} where pulldown_id not in (select o_orderkey from orders where o_orderstatus = 'P')
    union all select o_orderkey, o_custkey, o_totalprice from orders where o_orderstatus = 'P'""")
def replace_by_key(t):
    new = t.sql("select o_orderkey as pulldown_id, o_custkey as group_id, o_totalprice as pval from {orders} where o_orderstatus = 'P'")
    return U.replace_by_key(t.hit.select("pulldown_id", "group_id", "pval"), new, ["pulldown_id"])


@query("update_from", """select c_custkey as line_id, coalesce(s.s_name, c_name) as name, coalesce(s.s_acctbal, c_acctbal) as score from customer
    left join supplier s on s_suppkey = c_custkey""")
def update_from(t):
    return U.update_from(t.sql("select c_custkey as line_id, c_name as name, c_acctbal as score from {customer}"),
                         t.sql("select s_suppkey as line_id, s_name as name, s_acctbal as score from {supplier}"), ["line_id"], ["name", "score"])


@query("flag_pulldown", """select p.pulldown_id, p.line_id, case when k.picked is not null then p.pulldown_id = k.picked else display_flag end as display_flag
    from {pulldown} p left join (select line_id, min(pulldown_id) as picked from {pulldown} where display_flag group by 1) k on k.line_id = p.line_id""")
def flag_pulldown(t):
    return U.flag_one(t.pulldown, t.pulldown.filter("display_flag")).select("pulldown_id", "line_id", "display_flag")


@query("append_results", """select fov_id, kind, data from {fov_result} union all
    select fov_id, 'thumbnail', concat('{{"site_num":', site_num, ',"line_id":', line_id, '}}') from {fov}""".replace("{{", "{").replace("}}", "}"))
def append_results(t):
    return U.append_results(t.fov_result.select("fov_id", "kind", "data"), t.fov.withColumns(
        {"site_num": F.col("site_num"), "line_id": F.col("line_id")}), "thumbnail", "fov_id", ["site_num", "line_id"])


@query("clusters_to_rows", """select p_partkey, case when p_size % 4 <> 0 then cast(p_size as bigint) end as cluster_id,
    case when p_size % 3 <> 0 then cast(p_size * 2 as bigint) end as subcluster_id, 'primary' as analysis_type from part""")
def clusters_to_rows(t):
    nan = "cast('NaN' as double)"
    return U.clusters_to_rows(t.sql(f"""select p_partkey, case when p_size % 4 = 0 then {nan} else cast(p_size as double) end as cluster_id,
        case when p_size % 3 = 0 then {nan} else cast(p_size * 2 as double) end as subcluster_id from {{part}}"""), ["cluster_id", "subcluster_id"], "primary")


@query("category_migration", """select entity_id, array_to_string(case when list_has_any(c, ['src1', 'src2', 'src3']) and not list_contains(c, 'low_source')
    then list_append(c, 'low_source') else c end, ',') as categories from (select entity_id, list_transform(cast(categories as json)::varchar[],
    lambda x: regexp_replace(x, '^fr(_[1,2,3])?$', 'french\\1')) as c from {annotation}) q""")
def category_migration(t):
    a = t.annotation.select("entity_id", F.from_json("categories", "array<string>").alias("c"))
    a = a.withColumn("c", U.rename_category("c", "fr", "french"))
    return a.select("entity_id", F.array_join(U.flag_if_any("c", ["src1", "src2", "src3"], "low_source"), ",").alias("categories"))
