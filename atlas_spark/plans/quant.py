"""Queries for intensity tables: filters, replicates, imputation, normalisation, quality control."""

from pyspark.sql import functions as F

from ..functions import cols as C
from ..operators import quant as Q, ranking
from ..registry import query
from ..sources import readers as R


def rounded(df, *names, digits=6):
    return df.withColumns({n: F.round(n, digits) for n in names})


def deviate(parts, u):
    """SQL for the keyed normal deviate over the given text parts."""
    def uni(tag):
        return f"(cast('0x' || substr(md5(concat_ws('|', {parts}, '{tag}')), 1, 8) as bigint) / 4294967296.0)"
    return f"sqrt(-2.0 * ln(greatest({uni('a')}, pow(2, -33)))) * cos(2 * pi() * {uni('b')})"


LOG = "(select prey, bait, replicate, log2(value) as value from {intensity})"


@query("qc_flag_filter", "select p_partkey from part where p_partkey % 11 <> 0 and p_partkey % 13 <> 0 and p_partkey % 17 <> 0")
def qc_flag_filter(t):
    flagged = t.part.select("p_partkey", *[F.when(F.col("p_partkey") % n == 0, "+").alias(c) for n, c in zip((11, 13, 17), R.QC_FLAGS)])
    return R.qc_flag_filter(flagged).select("p_partkey")


@query("rename_by_regex", """select distinct concat('20190101_', 'B', l_suppkey % 12, '_0', l_linenumber % 3 + 1) as sample from lineitem""")
def rename_by_regex(t):
    raw = t.lineitem.select(F.concat(F.lit("LFQ Intensity 20190101_B"), F.col("l_suppkey") % 12, F.lit("_0"), F.col("l_linenumber") % 3 + 1,
                                     F.lit("_20190101")).alias("sample")).distinct()
    named = R.rename_samples(raw, [("^lfq intensity ", "")])
    return named.select(R.trim_after_replicate("sample").alias("sample"))


@query("dedupe_sample_max", "select concat('P', l_partkey) as prey, concat('B', l_suppkey % 12) as sample, max(l_extendedprice) as value from lineitem group by 1, 2")
def dedupe_sample_max(t):
    return Q.dedupe_sample_max(t.lineitem.select(F.concat(F.lit("P"), "l_partkey").alias("prey"),
                                                 F.concat(F.lit("B"), F.col("l_suppkey") % 12).alias("sample"),
                                                 F.col("l_extendedprice").alias("value")), ["prey", "sample"])


@query("log2_transform", f"select prey, bait, replicate, round(value, 6) as value from {LOG} q")
def log2_transform(t):
    return rounded(Q.transform_intensities(t.intensity), "value")


@query("filter_valids", """select * from {intensity} where prey in (select prey from (select prey, bait from {intensity} group by 1, 2
    having bool_and(value is not null)) q)""")
def filter_valids(t):
    return Q.filter_valids(t.intensity)


@query("all_valids", """select * from {intensity} where prey in (select prey from {intensity} where value is not null group by prey
    having count(distinct bait) = (select count(distinct bait) from {intensity}))""")
def all_valids(t):
    return Q.all_valids(t.intensity)


@query("median_replicates", "select prey, bait, median(value) as value from {intensity} group by 1, 2")
def median_replicates(t):
    return Q.median_replicates(t.intensity)


@query("mean_replicates", "select prey, bait, round(avg(value), 4) as value from {intensity} group by 1, 2")
def mean_replicates(t):
    return rounded(Q.median_replicates(t.intensity, mean=True), "value", digits=4)


PG = "select concat('Q', l_partkey) as protein_id, concat('S', l_suppkey % 5) as sample, case when l_partkey % 2 = 0 then concat('info', l_partkey) end as info, sum(l_quantity) as value from {lineitem} group by 1, 2, 3"
PG_MAP = "select concat('Q', p_partkey) as protein_id, concat('Q', cast(floor(p_partkey / 10) * 10 as bigint)) as primary_id from {part} where p_size < 40 union all select concat('Q', p_partkey), 'Q0' from {part} where p_size = 7"


@query("consolidate_groups", f"""with pg as ({PG}), m as ({PG_MAP}), c as (select protein_id, min(primary_id) as primary_id from m group by 1 having count(*) = 1),
    j as (select coalesce(c.primary_id, pg.protein_id) as primary_id, pg.* from pg left join c on pg.protein_id = c.protein_id)
    select primary_id, sample, min_by(info, protein_id) filter (info is not null) as info, nullif(sum(value), 0) as value from j group by 1, 2""")
def consolidate_groups(t):
    return Q.consolidate_groups(t.sql(PG), t.sql(PG_MAP))


@query("join_outer_combine", """select coalesce(a.id, b.id) as protein_id, coalesce(a.info, b.info) as info, a.v as v1, b.v as v2 from
    (select l_partkey as id, concat('a', l_partkey) as info, sum(l_quantity) as v from lineitem where l_returnflag = 'A' group by 1) a full join
    (select l_partkey as id, concat('b', l_partkey) as info, sum(l_quantity) as v from lineitem where l_linestatus = 'F' and l_returnflag = 'R' group by 1) b on a.id = b.id""")
def join_outer_combine(t):
    def part(where, tag, v):
        return t.sql(f"select l_partkey as protein_id, concat('{tag}', l_partkey) as info, sum(l_quantity) as {v} from {{lineitem}} where {where} group by 1")
    return Q.combine_transformed(part("l_returnflag = 'A'", "a", "v1"), part("l_linestatus = 'F' and l_returnflag = 'R'", "b", "v2"), "protein_id", "info")


@query("sum_intensity_qc", """with tot as (select bait, replicate, sum(value) as total from {intensity} group by 1, 2),
    cv as (select bait, stddev_samp(total) / avg(total) as cv from tot group by 1),
    c as (select a.bait, a.replicate, b.replicate as other, corr(a.value, b.value) as r from {intensity} a join {intensity} b
      on a.prey = b.prey and a.bait = b.bait and a.replicate < b.replicate group by 1, 2, 3),
    m as (select bait, min(r) as min_corr from c group by 1)
    select cv.bait, round(cv, 8) as cv, round(min_corr, 8) as min_corr, cv > 0.05 as high_cv, min_corr < 0.65 as low_corr from cv full join m on cv.bait = m.bait""")
def sum_intensity_qc(t):
    return rounded(Q.sum_intensity_qc(t.intensity), "cv", "min_corr", digits=8)


CURATED = [f"P{i}" for i in range(14)] + ["ABSENT"]


@query("target_fraction", f"""with tot as (select bait, replicate, sum(value) as total from {{intensity}} group by 1, 2),
    g as (select *, unnest({CURATED}) as prey from tot), v as (select bait, replicate, prey, sum(value) as v from {{intensity}} group by 1, 2, 3)
    select g.bait, g.replicate, g.prey, round(case when coalesce(v, 0) = 0 then 0.001 else 100 * v / total end, 8) as percent,
    round(case when coalesce(v, 0) = 0 then 10.0 else log2(v) end, 8) as log2_intensity
    from g left join v on g.bait = v.bait and g.replicate = v.replicate and g.prey = v.prey""")
def target_fraction(t):
    return rounded(Q.target_fraction(t.intensity, CURATED), "percent", "log2_intensity", digits=8)


SAMPLE = "select concat('G', l_suppkey) as bait_gene, l_linenumber % 3 as replicate, concat('P', l_partkey) as prey, max(l_extendedprice) as value from {lineitem} group by 1, 2, 3"
NAMES = "select concat('P', group_id) as prey, gene_names from {protein_group} where group_id % 5 in (0, 1, 2)"
BAIT_MATCH_SQL = f"""with s as ({SAMPLE}), n as ({NAMES}), g as (select distinct bait_gene from s), e as (select g.bait_gene, n.prey from n join g on n.gene_names = g.bait_gene),
    l as (select g.bait_gene, min_by(n.prey, n.gene_names) as prey from n join g on contains(n.gene_names, g.bait_gene) where n.gene_names like '%;%'
      and g.bait_gene not in (select bait_gene from e) group by 1),
    c as (select *, true as exact from e union all select *, false from l)
    select s.bait_gene, s.replicate, max(value) as intensity, bool_and(exact) as exact from s join c on s.bait_gene = c.bait_gene and s.prey = c.prey group by 1, 2"""


@query("bait_match", BAIT_MATCH_SQL)
def bait_match(t):
    return Q.bait_match(t.sql(SAMPLE), t.sql(NAMES))


@query("bait_unmatched", f"select distinct bait_gene from ({SAMPLE}) q where bait_gene not in (select bait_gene from ({BAIT_MATCH_SQL}) m)")
def bait_unmatched(t):
    s = t.sql(SAMPLE)
    return Q.unmatched_baits(s, Q.bait_match(s, t.sql(NAMES)).select("bait_gene"))


@query("identification_summary", """select coalesce(a.sample, b.sample) as sample, coalesce(n_peptides, 0) as n_peptides, coalesce(n_proteins, 0) as n_proteins from
    (select concat(bait, '_', replicate) as sample, count(value) as n_peptides from {intensity} group by 1) a full join
    (select concat('B', l_suppkey % 12, '_', l_linenumber % 3) as sample, count(*) filter (l_tax <> 0) as n_proteins from lineitem group by 1) b on a.sample = b.sample""")
def identification_summary(t):
    pep = t.intensity.select(F.concat_ws("_", "bait", "replicate").alias("sample"), "value")
    pro = t.sql("select concat('B', l_suppkey % 12, '_', l_linenumber % 3) as sample, l_tax as value from {lineitem}")
    return Q.identification_summary(pep, pro)


@query("pulldown_summary", f"""with m as ({BAIT_MATCH_SQL}), s2 as ({SAMPLE}), t as (select bait_gene, replicate, log2(sum(value)) as log2_total from s2 group by 1, 2)
    select t.bait_gene, t.replicate, substr(t.bait_gene, 1, 4) as experiment, round(log2_total, 8) as log2_total, intensity as bait_intensity
    from t left join m on t.bait_gene = m.bait_gene and t.replicate = m.replicate""")
def pulldown_summary(t):
    s = t.sql(SAMPLE)
    return rounded(Q.pulldown_summary(s, Q.bait_match(s, t.sql(NAMES))), "log2_total", digits=8)


N01 = deviate("prey, bait, replicate", "u")
LOG_I = "select prey, bait, replicate, log2(value) as value from {intensity}"


@query("impute_bait", f"""with l as ({LOG_I}), s as (select bait, avg(value) as m, stddev_samp(value) as sd from l group by 1)
    select prey, l.bait, replicate, round(case when value is null then m - 1.8 * sd + 0.3 * sd * {N01.replace('bait,', 'l.bait,')} else round(value, 4) end, 6) as value,
    value is null as is_imputed from l join s on l.bait = s.bait""")
def impute_bait(t):
    return rounded(Q.impute_bait(t.sql(LOG_I)), "value")


IMPUTE_PREY = f"""with l as ({LOG_I}), s as (select prey, avg(value) as m, stddev_samp(value) as sd, count(value) as n from l group by 1)
    select l.prey, bait, replicate, round(case when n > 20 then value when value is null then m + 0.3 * sd * {N01.replace('prey,', 'l.prey,')} else round(value, 4) end, 6) as value,
    value is null and n <= 20 as is_imputed from l join s on l.prey = s.prey"""


@query("impute_prey", IMPUTE_PREY)
def impute_prey(t):
    return rounded(Q.impute_prey(t.sql(LOG_I), threshold=20), "value")


@query("imputed_flags", f"select prey, bait, bool_and(is_imputed) as all_imputed from ({IMPUTE_PREY}) q group by 1, 2")
def imputed_flags(t):
    return Q.imputed_flags(Q.impute_prey(t.sql(LOG_I), threshold=20))


@query("median_normalize", f"""with l as ({LOG_I}), s as (select bait, replicate, median(value) as m from l group by 1, 2)
    select prey, l.bait, l.replicate, round(value - m, 8) as value from l join s on l.bait = s.bait and l.replicate = s.replicate""")
def median_normalize(t):
    return rounded(Q.median_normalize(t.sql(LOG_I), ["bait", "replicate"]), "value", digits=8)


@query("subtract_prey_median", f"""with l as ({LOG_I}), s as (select prey, median(value) as m from l group by 1), c as (select l.prey, bait, replicate, value - m as value from l join s on l.prey = s.prey),
    a as (select prey, avg(value) as m from c group by 1), d as (select c.prey, avg(abs(value - m)) as mad from c join a on c.prey = a.prey group by 1)
    select c.prey, bait, replicate, round(case when value > mad then value else 0 end, 8) as value from c join d on c.prey = d.prey""")
def subtract_prey_median(t):
    return rounded(Q.subtract_prey_median(t.sql(LOG_I)), "value", digits=8)


@query("standard_scale", f"""with l as ({LOG_I}), s as (select prey, avg(value) as m, stddev_pop(value) as sd from l group by 1)
    select l.prey, bait, replicate, round((value - m) / case when sd > 0 then sd else 1 end, 6) as value from l join s on l.prey = s.prey""")
def standard_scale(t):
    return rounded(Q.standard_scale(t.sql(LOG_I), ["prey"]), "value")


SPATIAL = "select concat('P', l_partkey) as prey, concat(case l_suppkey % 7 when 0 then '01K' when 1 then '03K' when 2 then '05K' when 3 then '12K' when 4 then '24K' when 5 then '80K' else 'Cyt' end, 'Rep', l_linenumber % 6 + 1) as sample, sum(l_quantity) as value from {lineitem} group by 1, 2"


@query("total_intensity_norm", f"""with s as ({SPATIAL}), t as (select sample, sum(value) as total from s group by 1), f as (select sample, total / (select min(total) from t) as f from t)
    select prey, s.sample, round(value * f, 6) as value from s join f on s.sample = f.sample""")
def total_intensity_norm(t):
    return rounded(Q.total_intensity_norm(t.sql(SPATIAL)), "value")


@query("yield_norm", f"""with s as ({SPATIAL}), y as (select sample, count(*) / 100.0 as yield from s group by 1)
    select prey, s.sample, round(value * yield, 4) as value from s join y on s.sample = y.sample""")
def yield_norm(t):
    s = t.sql(SPATIAL)
    return rounded(Q.yield_norm(s, s.groupBy("sample").agg((F.count("*") / 100.0).alias("yield"))), "value", digits=4)


@query("penalty_factor", """with l as (select * from {complete}), neg as (select prey, median(value) as neg from l group by 1),
    m as (select prey, bait, median(value) as value from l group by 1, 2), r as (select bait, corr(value, neg) as r from m join neg on m.prey = neg.prey group by 1),
    p as (select bait, pow(r / (select median(r) from r), 2) as penalty from r)
    select m.bait, m.prey, round(penalty, 6) as penalty, round(value * penalty, 6) as enrichment from m join p on m.bait = p.bait""")
def penalty_factor(t):
    med = Q.median_replicates(t.complete)
    scores = med.withColumnRenamed("value", "enrichment")
    return rounded(Q.penalty_factor(med, t.complete, scores), "penalty", "enrichment")


@query("percentile_threshold", "select round(quantile_cont(value, 0.95), 8) as q95, round(quantile_cont(value, 0.002), 8) as q002 from {complete}")
def percentile_threshold(t):
    q = ranking.grouped_quantiles(t.complete, [], "value", {"q95": 0.95, "q002": 0.002}, hot_rows=5000)
    return rounded(q, "q95", "q002", digits=8)
