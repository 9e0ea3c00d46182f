"""Queries for flow cytometry."""

from pyspark.sql import functions as F

from ..functions import cols as C
from ..operators import cyto as Y
from ..registry import query
from .relational import rounded
from .scalars import HLOG_SQL

EDGES = list(zip(Y.SINGLET_POLYGON, Y.SINGLET_POLYGON[1:] + Y.SINGLET_POLYGON[:1]))
RAY = " + ".join(f"case when ({y1} > fsc_w) <> ({y2} > fsc_w) and fsc_a < {x1} + (fsc_w - {y1}) * ({x2 - x1}) / ({y2 - y1}) then 1 else 0 end" for (x1, y1), (x2, y2) in EDGES if y1 != y2)
WELLS = "select plate, well % 12 as well, cell_id, fitc from {cells}"
CONTROL = "select plate, well % 4 as well, fitc / 3 as fitc from {cells} where fitc < 150"


@query("gate_cells", f"select cell_id, plate, well from {{cells}} where fsc_a > 8650 and ssc_a > 8500 and ({RAY}) % 2 = 1")
def gate_cells(t):
    return Y.gate_cells(t.cells).select("cell_id", "plate", "well")


#: Transformed values off the limits of the gates, by a quarter.
MEASURED = "select plate, well, cell_id, fitc, fsc_a + 0.25D as fsc_a, ssc_a + 0.25D as ssc_a, fsc_w from {cells}"


def raw_cells(t, sql):
    """Cells as an instrument measures them: the inverse of the transform of the given values."""
    return t.sql(sql).withColumns({c: C.hlog_inverse(c) for c in ("fitc", "fsc_a", "ssc_a")})


@query("transform_and_gate", f"select plate, well, cell_id, round(fitc, 6) as fitc, fsc_a, ssc_a from (select plate, well, cell_id, fitc, fsc_a + cast(0.25 as double) as fsc_a, ssc_a + cast(0.25 as double) as ssc_a, fsc_w from {{cells}}) q where fsc_a > 8650 and ssc_a > 8500 and ({RAY}) % 2 = 1")
def transform_and_gate(t):
    return rounded(Y.transform_and_gate(raw_cells(t, MEASURED)).select("plate", "well", "cell_id", "fitc", "fsc_a", "ssc_a"), "fitc", "fsc_a", "ssc_a")


@query("hlog_transform", "select event_id, round(value * 15 - 300, 4) as v from events")
def hlog_transform(t):
    linear = C.hlog_inverse(F.col("value") * 15 - 300)
    return t.events.select("event_id", linear.alias("y")).select("event_id", F.round(C.hlog("y"), 4).alias("v"))


POOL = f"(with c as ({CONTROL}), m as (select plate, well, avg(fitc) as m, count(*) as n from c group by 1, 2) select c.plate, (select sum(m * n) / sum(n) from m where m.plate = c.plate) as ref_mean, stddev_pop(fitc - m.m) as ref_std from c join m on m.plate = c.plate and m.well = c.well group by 1)"


@query("pool_controls", f"select plate, round(ref_mean, 6) as ref_mean, round(ref_std, 6) as ref_std from {POOL} q")
def pool_controls(t):
    return rounded(Y.pool_controls(t.sql(CONTROL))[1], "ref_mean", "ref_std")


AUDIT = "select distinct plate, concat(substr('ABCDEFGHJ', cast(well % 9 as int) + 1, 1), lpad(cast(well % 12 + 1 as string), 2, '0')) as well_id from {cells}"


@query("control_audit", f"""with a as ({AUDIT}), c as (select plate, count(distinct well_id) as n from a where well_id like '%01' group by 1)
    select a.plate, 96 - count(*) filter (well_id not like 'J%') as n_missing, count(*) filter (well_id like 'J%') as n_unexpected, coalesce(max(n), 0) as n_controls, coalesce(max(n), 0) <> 12 as wrong_controls from a left join c on c.plate = a.plate group by 1""")
def control_audit(t):
    a = t.sql(AUDIT)
    return Y.control_audit(a, a.filter("well_id like '%01'"))


def parts(t):
    return Y.fit_inputs(t.sql(WELLS), t.sql(CONTROL), xrange=(0, 500))


@query("unmix_fit")
def unmix_fit(t):
    return rounded(Y.unmix_fit(*parts(t), ["plate", "well"]), "offset", "scale")


@query("unmixed_stats")
def unmixed_stats(t):
    samples, ref, pool = parts(t)
    return Y.unmixed_stats(samples, ref, pool, Y.unmix_fit(samples, ref, pool, ["plate", "well"]), ["plate", "well"])


@query("facs_all_plates")
def facs_all_plates(t):
    return Y.all_plates(t.sql(WELLS), t.sql(CONTROL), xrange=(0, 500)).select("plate", "well", "area", "fitted_offset", "raw_mean", "raw_median", "rel_median_log")
