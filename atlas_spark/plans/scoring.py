"""Queries for scoring, thresholds and their validation."""

from pyspark.sql import functions as F

from ..operators import network as N, stats as S
from ..operators.quant import impute_prey
from ..registry import query
from ..session import cut_lineage
from .quant import IMPUTE_PREY, LOG_I, rounded


def series(a, b, x):
    """log of x^a (1-x)^b / (a B(a,b)) times the hypergeometric sum."""
    terms = (f"list_sum(list_transform(range(0, 500), lambda n: exp(lgamma({a} + {b} + n) - lgamma({a} + {b}) - lgamma({a} + 1 + n) + lgamma({a} + 1) + n * ln({x}))))")
    return f"({a} * ln({x}) + {b} * ln(1 - ({x})) - ln({a}) - (lgamma({a}) + lgamma({b}) - lgamma({a} + {b})) + ln({terms}))"


def p_sql(t, df):
    x, y = f"({df} / ({df} + {t} * {t}))", f"({t} * {t} / ({df} + {t} * {t}))"
    a = f"({df} / 2.0)"
    return (f"case when {t} is null or {df} is null then null when {t} = 0 then 0.0 when {x} < ({a} + 1) / ({a} + 2.5) then -({series(a, '0.5', x)}) / ln(10) "
            f"else -log10(1 - exp({series('0.5', a, y)})) end")


def leave_out(values, control, exclusion, ddof=1, mean=False, scale=True):
    """SQL: every pair against the control rows of non-excluded baits."""
    sd = "stddev_samp(c.value)" if ddof == 1 else "stddev_pop(c.value)"
    mid = "avg" if mean else "median"
    div = " / nullif(s2, 0)" if scale else ""
    return f"""(select prey, bait, n1, n2, t, df, enrichment, {p_sql('t', 'df')} as pvals from (
      select prey, bait, n1, n2, case when n1 + n2 > 2 and (q1 + q2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2) > 0 then
        (m1 - m2) / sqrt((q1 + q2) / (n1 + n2 - 2) * (1.0 / n1 + 1.0 / n2)) end as t, cast(n1 + n2 - 2 as double) as df, (d1 - d2){div} as enrichment from
        (select s.*, count(c.value) as n2, avg(c.value) as m2, var_pop(c.value) * count(c.value) as q2, {mid}(c.value) as d2, {sd} as s2 from
          (select prey, bait, count(value) as n1, avg(value) as m1, var_pop(value) * count(value) as q1, {mid}(value) as d1 from {values} where value is not null group by 1, 2) s
          join {control} c on c.prey = s.prey and c.value is not null and not exists (select 1 from {exclusion} x where x.bait = s.bait and x.other = c.bait) group by all) w) z)"""


SELF = "(select distinct bait, bait as other from {complete})"
EXCLUSION = """(with b as (select bait, gene, case when regexp_matches(gene, '^(.+?)[0-9]+[A-Z]+$') then regexp_extract(gene, '^(.+?)[0-9]+[A-Z]+$', 1) else regexp_extract(gene, '^(.+?)[0-9]*$', 1) end as root from {bait_gene})
    select distinct a.bait, o.bait as other from b a join b o on a.bait = o.bait or a.root = o.root or (a.root = 'MED' and o.root = 'POLR') or (a.root = 'POLR' and o.root = 'MED')
      or exists (select 1 from {bait_complex} x join {bait_complex} y on x.complex_id = y.complex_id where x.gene = a.gene and y.gene = o.gene))"""
NUMS = "round(t, 5) as t, df, round(enrichment, 5) as enrichment, round(pvals, 5) as pvals"


def exclusion(t):
    return S.control_exclusion(t.bait_gene, t.bait_complex)


def nums(df, *more):
    return df.select("prey", "bait", F.round("t", 5).alias("t"), F.col("df").cast("double").alias("df"), F.round("enrichment", 5).alias("enrichment"),
                     F.round("pvals", 5).alias("pvals"), *more)


def curve(c, x0):
    return f"case when enrichment < {x0} or abs(enrichment) - {x0} = 0 then cast('inf' as double) else {c} / nullif(abs(enrichment) - {x0}, 0) end"


@query("ttest_neglog10p", f"select prey, bait, {NUMS} from {leave_out('{complete}', '{complete}', SELF)} q")
def ttest_neglog10p(t):
    v = t.complete
    return nums(S.leave_out_scores(v, v, None))


@query("enrichment", f"select prey, bait, round(enrichment, 5) as enrichment from {leave_out('{complete}', '{complete}', SELF, ddof=0, mean=True)} q")
def enrichment(t):
    v = t.complete
    s = S.leave_out_scores(v, v, None, ddof=0, mean=True)
    return s.select("prey", "bait", F.round("enrichment", 5).alias("enrichment"))


FILTERED = "(select * from {complete} where prey in (select prey from (select prey, bait from {intensity} group by 1, 2 having bool_and(value is not null)) q))"


@query("bait_interactions", f"""select prey, bait, {NUMS}, coalesce(pvals > {curve(3, 0.5)}, false) as hits,
    coalesce(pvals < {curve(3, 0.5)} and pvals > {curve(1, 0)}, false) as minor_hits from {leave_out(FILTERED, FILTERED, SELF)} q""")
def bait_interactions(t):
    from ..functions.cols import log2_or_null
    from ..operators.quant import filter_valids, transform_intensities
    v = transform_intensities(filter_valids(t.intensity), log2_or_null).filter("value is not null")
    s = S.leave_out_scores(v, v, None)
    return nums(S.two_level_hits(s, (3, 0.5), (1, 0)), "hits", "minor_hits")


@query("control_exclusion", EXCLUSION[1:-1])
def control_exclusion(t):
    return exclusion(t)


ROUND1 = leave_out("{complete}", "{complete}", EXCLUSION)


@query("score_round_one", f"with s as {ROUND1}, h as (select prey, bait from s where enrichment > 0 and pvals > 1.3) select c.prey, c.bait, c.replicate, round(c.value, 6) as value from {{complete}} c where not exists (select 1 from h where h.prey = c.prey and h.bait = c.bait)")
def score_round_one(t):
    v = cut_lineage(t.complete)
    first = S.leave_out_scores(v, v, exclusion(t))
    return rounded(S.mask_hits(v, first, 1.3), "value")


@query("score_round_two", f"""with v as materialized (select * from {{complete}}), x as materialized {EXCLUSION}, s as materialized {leave_out('v', 'v', 'x')}, m as materialized (select * from v where not exists (select 1 from s where s.prey = v.prey and s.bait = v.bait and enrichment > 0 and pvals > 1.3))
    select prey, bait, {NUMS}, coalesce(pvals > {curve(1, 0.3)}, false) as hits from {leave_out('v', 'm', 'x')} q""")
def score_round_two(t):
    return nums(S.score_two_rounds(t.complete, exclusion(t), 1.3, 1, 0.3), "hits")


@query("score_leave_self_two_rounds", f"""with v as materialized (select * from {{complete}}), x as materialized {SELF}, s as materialized {leave_out('v', 'v', 'x')}, m as materialized (select * from v where not exists (select 1 from s where s.prey = v.prey and s.bait = v.bait and pvals > {curve(1, 0.3)})),
    none as (select 'none' as bait, 'none' as other) select prey, bait, {NUMS}, coalesce(pvals > {curve(1, 0.3)}, false) as hits from {leave_out('v', 'm', 'none')} q""")
def score_leave_self_two_rounds(t):
    return nums(S.score_curve_rounds(t.complete, (1, 0.3), (1, 0.3)), "hits")


MANUAL = "(select distinct concat('B', s_suppkey % 12) as bait, concat('B', s_suppkey % 4) as other from {supplier})"


@query("score_manual_exclusion", f"select prey, bait, round(t, 5) as t, df, round(enrichment, 5) as enrichment, round(pvals, 5) as pvals from {leave_out('{complete}', '{complete}', MANUAL, ddof=0, mean=True, scale=False)} q")
def score_manual_exclusion(t):
    return nums(S.leave_out_scores(t.complete, t.complete, t.sql(MANUAL[1:-1]), ddof=0, mean=True, scale=False))


IMP = f"(select prey, bait, replicate, case when is_imputed and prey like '%3' then null else value end as value from ({IMPUTE_PREY.replace('round(case', '(case').replace(', 6) as value', ') as value')}) q)"


def uni(*parts):
    return f"(cast('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 8) as bigint) / 4294967296.0)"


BOOT = f"""with v as materialized {IMP}, x as materialized {EXCLUSION}, p as (select prey, bait, count(*) as n1, list(value order by value) filter (value is not null) as xs from v group by 1, 2), n as (select prey, count(*) as len from v group by 1),
    r as (select p.prey, p.bait, n1, coalesce(xs, []) as xs, len, coalesce(list(c.value order by c.value, c.bait, c.replicate) filter (c.value is not null), []) as con from p join n on n.prey = p.prey
      left join v c on c.prey = p.prey and not exists (select 1 from x where x.bait = p.bait and x.other = c.bait) group by 1, 2, 3, 4, 5),
    d as (select *, case when len(con) >= 9 then list_transform(range(1, len + 1), lambda i: con[cast(floor({uni('prey', 'bait', 'i', "'boot'")} * len(con)) as bigint) + 1]) end as draw from r),
    m as (select *, list_avg(draw) as m2 from d), f as (select *, list_concat(xs, list_transform(range(0, n1 - len(xs)), lambda i: m2)) as samples from m),
    q as (select *, list_avg(samples) as m1, list_var_pop(samples) * n1 as q1, list_var_pop(draw) * len as q2 from f),
    z as (select prey, bait, case when draw is not null then (m1 - m2) / nullif(sqrt((q1 + q2) / (n1 + len - 2) * (1.0 / n1 + 1.0 / len)), 0) end as t, case when draw is not null then cast(n1 + len - 2 as double) end as df,
      case when draw is null then -0.1 + 0.2 * {uni('prey', 'bait', "'e'", "'boot'")} else (list_median(samples) - list_median(draw)) / nullif(sqrt(q2 / len), 0) end as enrichment, draw from q)
    select prey, bait, round(t, 5) as t, df, round(enrichment, 5) as enrichment, round(case when draw is null then 0.2 * {uni('prey', 'bait', "'p'", "'boot'")} else {p_sql('t', 'df')} end, 5) as pvals from z"""


@query("score_bootstrap", BOOT)
def score_bootstrap(t):
    imputed = impute_prey(t.sql(LOG_I), threshold=20)
    v = imputed.withColumn("value", F.when(~(F.col("is_imputed") & F.col("prey").like("%3")), F.col("value")))
    return nums(S.score_bootstrap(v, exclusion(t)))


@query("score_iterative")
def score_iterative(t):
    v = t.complete.withColumn("bait", F.concat("bait", F.lit("_P"), F.expr("cast(substr(bait, 2) as int)")))
    names = v.select("prey", F.col("prey").alias("gene")).distinct()
    return nums(S.score_iterative(v, names, 1.0, 0.3), "hits")


CLUST = "(select distinct concat('B', s_suppkey % 12) as bait, s_suppkey % 12 % 3 as cluster from {supplier})"


@query("score_by_cluster", f"with c as {CLUST}, x as materialized (select a.bait, b.bait as other from c a join c b on a.cluster = b.cluster) select prey, bait, {NUMS} from {leave_out('{complete}', '{complete}', 'x')} q")
def score_by_cluster(t):
    v = t.complete
    sets, members = S.cluster_sets(v, t.sql(CLUST[1:-1]))
    return nums(S.leave_out_scores(v, v, members, sets=sets))


CORR = """(with k as (select prey from {complete} group by 1 having count(distinct bait) = (select count(distinct bait) from {complete})), m as (select prey, bait, median(value) as v from {complete} where prey in (select prey from k) group by 1, 2)
    select a.bait, b.bait as other, round(corr(a.v, b.v), 12) as r from m a join m b on a.prey = b.prey group by 1, 2)"""


@query("bait_correlation", f"select bait, other, round(r, 6) as r from {CORR} q")
def bait_correlation(t):
    return rounded(S.bait_correlation(t.complete), "r")


CORR_X = f"(with c as materialized {CORR} select bait, other from c where bait = other or r > (select quantile_cont(r, 0.95) from c where bait <> other))"


@query("correlated_baits", CORR_X[1:-1])
def correlated_baits(t):
    return S.correlated_baits(S.bait_correlation(t.complete))


@query("score_correlation_controls", f"with v as materialized (select * from {{complete}}), x as materialized {CORR_X} select prey, bait, {NUMS} from {leave_out('v', 'v', 'x')} q")
def score_correlation_controls(t):
    v = cut_lineage(t.complete)
    return nums(S.leave_out_scores(v, v, S.correlated_baits(S.bait_correlation(v))))


@query("fdr_curve", f"select row_key, round(case when isinf({curve(3, 2)}) then 1e9 else {curve(3, 2)} end, 6) as thresh, round(case when abs(enrichment) < 2 or abs(enrichment) = 2 then 1e9 else 3 / nullif(abs(enrichment) - 2, 0) end, 6) as thresh_both from {{scores}}")
def fdr_curve(t):
    def finite(c):
        return F.round(F.when(c == float("inf"), 1e9).otherwise(c), 6)
    e = F.col("enrichment")
    return t.scores.select("row_key", finite(S.fdr_curve(e, 3, 2)).alias("thresh"), finite(S.fdr_curve(e, 3, 2, two_sided=True)).alias("thresh_both"))


OVERRIDES = "select distinct concat('P00', s_suppkey % 3 + 1) as plate, concat('G', s_suppkey) as target, 2.0D as c1, cast(s_nationkey % 5 as double) as x1, 1.0D as c5, 0.5D as x5 from {supplier} where s_nationkey < 8"


@query("two_level_hits", f"""with o as ({OVERRIDES.replace('2.0D', '2.0::double').replace('1.0D', '1.0::double').replace('0.5D', '0.5::double')}), j as (select s.*, coalesce(o.c1, 3) as c1, coalesce(o.x1, 4) as x1, coalesce(o.c5, 3) as c5, coalesce(o.x5, 2) as x5 from {{scores}} s left join o on o.plate = s.plate and o.target = s.target)
    select row_key, pvals > {curve('c1', 'x1')} as hits, pvals < {curve('c1', 'x1')} and pvals > {curve('c5', 'x5')} as minor_hits from j""")
def two_level_hits(t):
    return S.two_level_hits(t.scores, (3, 4), (3, 2), t.sql(OVERRIDES)).select("row_key", "hits", "minor_hits")


FDR1 = """(select target, case when m <= 43 then m else least(43 + 2 * ceil((m - 43) / 2.0), 101) end / 10 as fdr1 from (select target, max(cast(ceil(round(10 * (abs(enrichment) - 3.0 / pvals), 6)) as bigint)) filter (enrichment < 0) as m from {scores} group by 1) q)"""
FDR5 = f"""(with recursive f as (select target, cast(round(fdr1 * 10) as bigint) as s, fdr1 from {FDR1} q), r as (select target, cast(ceil(round(10 * (abs(enrichment) - 3.0 / pvals), 6)) as bigint) - 1 as tt, enrichment from {{scores}} where enrichment <> 0),
    g as (select f.target, gg as g, count(*) filter (r.enrichment < 0 and r.tt >= gg) as n, count(*) filter (r.enrichment > 0 and r.tt >= gg) as p from (select target, s, unnest(range(least(1, s), s + 1)) as gg from f) f join r on r.target = f.target group by 1, 2),
    k as (select *, case when p > 0 then 100.0 * n / p when n > 0 then cast('inf' as double) end as share from g),
    st as (select target, coalesce(max(g) filter (not (n < 2 or coalesce(share < 10, false))), min(g)) as stop from k group by 1)
    select f.target, fdr1, (stop + case when coalesce(share > 10, false) then 1 else 0 end) / 10.0 as fdr5 from f left join st on st.target = f.target left join k on k.target = f.target and k.g = st.stop)"""


@query("fdr1_seed", f"select target, cast(fdr1 as double) as fdr1 from {FDR1} q")
def fdr1_seed(t):
    return S.fdr1_seed(t.scores)


@query("fdr5_seed", f"select target, cast(fdr1 as double) as fdr1, cast(fdr5 as double) as fdr5 from {FDR5} q")
def fdr5_seed(t):
    return S.fdr5_seed(t.scores, S.fdr1_seed(t.scores))


@query("dynamic_fdr", f"""with s as (select sc.*, cast(fdr1 as double) as fdr1, cast(fdr5 as double) as fdr5 from {{scores}} sc join {FDR5} f on f.target = sc.target) select row_key, fdr1, fdr5,
    pvals > {curve('3', 'fdr1')} as hits, pvals < {curve('3', 'fdr1')} and pvals > {curve('3', 'fdr5')} as minor_hits from s""")
def dynamic_fdr(t):
    return S.dynamic_fdr(t.scores).select("row_key", "fdr1", "fdr5", "hits", "minor_hits")


@query("fdr_curve_points", f"""with f as {FDR5}, c as (select target, 'fdr1' as curve, fdr1 as x0 from f union all select target, 'fdr5', fdr5 from f)
    select target, curve, round(x0 + i * 0.1, 6) as x, round(3.0 / (i * 0.1), 6) as y from (select *, unnest(range(1, 101)) as i from c) q""")
def fdr_curve_points(t):
    return rounded(S.fdr_curve_points(S.fdr5_seed(t.scores, S.fdr1_seed(t.scores)), ["target"]), "x", "y")


@query("melt_scores", f"select row_key, plate, target, prey, pvals from {{scores}} where pvals > 12")
def melt_scores(t):
    s = t.scores.withColumn("bait", F.concat_ws("_", "plate", F.lower("target"))).drop("plate", "target")
    s = s.withColumns({"hits": F.col("pvals") > 16, "minor_hits": (F.col("pvals") > 12) & (F.col("pvals") <= 16)})
    return S.split_bait(s, just_hits=True).select("row_key", "plate", "target", "prey", "pvals")


TH = [0, 1, 2, 3, 4, 5, 6]


def pr_oracle(level, thresholds):
    """SQL restating every threshold on its own: hits, coverage of reference pairs, co-localised share."""
    return f"""with th as (select unnest({thresholds}) as x), s as (select target, prey, {level} as lv from {{scores}} where {level} is not null),
    h as materialized (select distinct x, target, prey from s join th on lv > x), n as (select x, count(*) as num_interactions from s join th on lv > x group by 1),
    tg as materialized (select distinct x, target from h), c as materialized (select prot_1, prot_2, row_number() over (order by prot_1, prot_2) as id from {{corum}}),
    o as materialized (select id, prot_1 as a, prot_2 as b from c union all select id, prot_2, prot_1 from c),
    cov as materialized (select h.x, o.id, o.a, o.b from o join h on h.target = o.a and h.prey = o.b),
    hop as (select cov.x, o.id from cov join tg on tg.x = cov.x and tg.target = cov.b join h on h.x = cov.x and h.target = cov.b join o on o.a = cov.a and o.b = h.prey),
    covered as (select x, count(distinct id) as cov from (select x, id from cov union select x, id from hop) q group by 1),
    possible as (select x, count(distinct id) as pos from tg join o on o.a = tg.target group by 1),
    u as (select distinct x, least(target, prey) as a, greatest(target, prey) as b from h where target <> prey),
    l as (select x, count(*) as known, count(*) filter (list_has_any(string_split(p.label, '/'), string_split(q.label, '/')) or list_contains(string_split(p.label, '/'), 'B') or list_contains(string_split(q.label, '/'), 'B')) as same
      from u join {{localization}} p on p.gene = u.a join {{localization}} q on q.gene = u.b group by 1)
    select cast(th.x as double) as threshold, coalesce(num_interactions, 0) as num_interactions, round(coalesce(cov, 0) / pos, 8) as recall, round(same / known, 8) as precision
    from th left join n on n.x = th.x left join covered on covered.x = th.x left join possible on possible.x = th.x left join l on l.x = th.x"""


@query("precision_recall", pr_oracle("case when enrichment > 0 and pvals > 0 then enrichment - 3 / pvals end", TH))
def precision_recall(t):
    level = F.when((F.col("enrichment") > 0) & (F.col("pvals") > 0), F.col("enrichment") - 3 / F.col("pvals"))
    return rounded(N.precision_recall(t.scores, level, t.corum, t.localization, TH), "recall", "precision", digits=8)


PTH = [1, 2, 3, 4.5, 6, 9, 12, 15, 20, 25, 30]


@query("precision_recall_pvals", pr_oracle("pvals", PTH))
def precision_recall_pvals(t):
    return rounded(N.precision_recall(t.scores, F.col("pvals"), t.corum, t.localization, PTH), "recall", "precision", digits=8)
