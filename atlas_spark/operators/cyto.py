"""Flow cytometry: gates, control pools, histograms, unmixing of the negative population."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import cols as C
from ..session import cut_lineage
from ..sources.readers import wells
from .ranking import grouped_quantiles

# Gate limits, singlet polygon on (FSC-A, FSC-W), number of controls, sample range.
VIABLE_FSC_A, VIABLE_SSC_A = 8650, 8500
SINGLET_POLYGON = ((8750, 250), (9350, 240), (10000, 290), (10200, 390), (9500, 400), (9250, 390), (9000, 360), (8800, 300))
NUM_CONTROLS = 12
SAMPLE_RANGE = (0.0, 10000.0)


def inside_polygon(x: Column, y: Column, points=SINGLET_POLYGON) -> Column:
    """Even-odd test: the number of edges crossed by a ray to the right is odd."""
    crossings = F.lit(0)
    for (x1, y1), (x2, y2) in zip(points, points[1:] + points[:1]):
        if y1 == y2:
            continue
        spans = (F.lit(float(y1)) > y) != (F.lit(float(y2)) > y)
        at = x1 + (y - y1) * ((x2 - x1) / (y2 - y1))
        crossings = crossings + F.when(spans & (x < at), 1).otherwise(0)
    return crossings % 2 == 1


def gate_cells(cells: DataFrame) -> DataFrame:
    viable = (F.col("fsc_a") > VIABLE_FSC_A) & (F.col("ssc_a") > VIABLE_SSC_A)
    return cells.filter(viable & inside_polygon(F.col("fsc_a"), F.col("fsc_w")))


def transform_and_gate(cells: DataFrame) -> DataFrame:
    """Viable single cells of raw measurements: fluorescence and the two areas as hyperlogs, the width as it is.

    A cell with a missing area or width is in no gate; a missing fluorescence stays missing.
    """
    names = ("fitc", "fsc_a", "ssc_a")
    # a generated row, as a filter moved below plain columns would solve for them in every term of the gate
    once = F.inline(F.array(F.struct(*[C.hlog(c).alias(c) for c in names])))
    return gate_cells(cells.select(*[c for c in cells.columns if c not in names], once))


def pool_controls(cells: DataFrame, value: str = "fitc") -> tuple[DataFrame, DataFrame]:
    """Mean-centred control values, and (plate, ref_mean, ref_std) of the pool."""
    means = cells.groupBy("plate", "well").agg(F.avg(value).alias("_m"), F.count(value).alias("_n"))
    centred = cells.join(means, ["plate", "well"]).select("plate", "well", (F.col(value) - F.col("_m")).alias(value))
    mean = means.groupBy("plate").agg((F.sum(F.col("_m") * F.col("_n")) / F.sum("_n")).alias("ref_mean"))
    std = centred.groupBy("plate").agg(F.stddev_pop(value).alias("ref_std"))
    return centred, mean.join(std, "plate")


def control_audit(samples: DataFrame, controls: DataFrame) -> DataFrame:
    """Per plate: wells missing, wells unexpected, and whether it has the right number of controls."""
    known = wells(samples.sparkSession).select(C.well_id("well_id").alias("well_id"))
    w = samples.select("plate", "well_id").distinct().join(F.broadcast(known.withColumn("_k", F.lit(1))), "well_id", "left")
    per = w.groupBy("plate").agg((F.lit(C.PLATE_COLUMNS * len(C.PLATE_ROWS)) - F.count("_k")).alias("n_missing"),
                                 F.count_if(F.col("_k").isNull()).alias("n_unexpected"))
    n = controls.groupBy("plate").agg(F.count_distinct("well_id").alias("n_controls"))
    return per.join(n, "plate", "left").select("plate", "n_missing", "n_unexpected", F.coalesce("n_controls", F.lit(0)).alias("n_controls"),
                                               (F.coalesce("n_controls", F.lit(0)) != NUM_CONTROLS).alias("wrong_controls"))


def histogram(df: DataFrame, keys: list[str], value: str, xrange: tuple[float, float] | None = None,
              nbins: float | None = None, percentile: float = 0.0) -> DataFrame:
    """(keys, bin, n, center, density); range given or from percentiles, bins given or 2 n^(1/3)."""
    n = df.groupBy(*keys).agg(F.count(value).alias("_n"))
    if xrange is None:
        q = grouped_quantiles(df, keys, value, {"_lo": percentile / 100, "_hi": 1 - percentile / 100})
        spec = n.join(q, keys)
    else:
        spec = n.withColumns({"_lo": F.lit(float(xrange[0])), "_hi": F.lit(float(xrange[1]))})
    nb = F.lit(float(nbins)) if nbins else 2 * F.pow(F.col("_n"), F.lit(1 / 3))
    spec = spec.withColumn("_w", F.try_divide(F.col("_hi") - F.col("_lo"), nb)).withColumn("_bins", F.ceil(nb) - 1).filter("_w > 0")
    v = F.col(value)
    inside = (v >= F.col("_lo")) & (v <= F.col("_lo") + F.col("_w") * F.col("_bins"))
    b = F.least(F.floor((v - F.col("_lo")) / F.col("_w")), F.col("_bins") - 1)
    counts = df.join(spec, keys).filter(inside).groupBy(*keys, b.alias("bin"), "_lo", "_w").agg(F.count("*").alias("n"))
    total = counts.groupBy(*keys).agg(F.sum("n").alias("_t"))
    return counts.join(total, keys).select(*keys, "bin", "n", F.col("_lo").alias("lo"), F.col("_w").alias("width"), (F.col("_lo") + (F.col("bin") + 0.5) * F.col("_w")).alias("center"),
                                           (F.col("n") / (F.col("_t") * F.col("_w"))).alias("density"))


def cumulative_quantiles(hist: DataFrame, keys: list[str], x: str, y: str, probs: dict[str, float]) -> DataFrame:
    """Position where the normalised running sum of a histogram crosses each level, linear between bins.

    The windows run over bins, whose number does not grow with the cells behind them.
    """
    w = W.partitionBy(*keys).orderBy(x)
    c = hist.withColumn("_c", F.sum(y).over(w) / F.sum(y).over(W.partitionBy(*keys)))
    c = c.withColumns({"_pc": F.lag("_c").over(w), "_px": F.lag(x).over(w)})
    def at(q):
        hit = (F.col("_c") >= q) & (F.col("_pc") < q)
        pos = F.col("_px") + (F.col(x) - F.col("_px")) * F.try_divide(q - F.col("_pc"), F.col("_c") - F.col("_pc"))
        return F.min_by(F.when(hit, pos), F.when(hit, F.col(x)))
    return c.groupBy(*keys).agg(*[at(q).alias(n) for n, q in probs.items()])


def compare_results(a: DataFrame, b: DataFrame, floor: float = 0.01, ratio: float = 0.7) -> DataFrame:
    """Wells whose area in two result sets disagrees."""
    j = a.join(b, ["plate_id", "well_id"])
    return j.filter((F.col("area") > floor) & (F.abs(F.try_divide("other_area", "area")) < ratio))


def histogram_arrays(hist: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key with the first centre x0, the bin width and the densities of all bins, empty ones as 0.

    The number of bins follows the cube root of the cells, so the array stays short.
    """
    g = hist.groupBy(*keys).agg(F.max("lo").alias("_lo"), F.max("width").alias("width"), F.max("bin").alias("_last"),
                                F.map_from_entries(F.collect_list(F.struct("bin", "density"))).alias("_m"))
    ys = F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("_last")), lambda b: F.coalesce(F.element_at("_m", b), F.lit(0.0)))
    return g.select(*keys, (F.col("_lo") + F.col("width") / 2).alias("x0"), "width", ys.alias("ys"))


def _shifted(ref_x0: Column, ref_w: Column, ref_ys: Column, x: Column, offset: Column) -> Column:
    """Reference density at x after moving the reference by ``offset``; linear between bins, 0 outside."""
    pos = (x - offset - ref_x0) / ref_w
    i = F.floor(pos)
    frac = pos - i
    a = F.get(ref_ys, i.cast("int"))
    b = F.coalesce(F.get(ref_ys, (i + 1).cast("int")), a)
    return F.when((pos >= 0) & (pos <= F.size(ref_ys) - 1), a + (b - a) * frac).otherwise(0.0)


def _best_offset(samples: DataFrame, keys: list[str], grid: Column) -> DataFrame:
    """Offset of the grid with the smallest squared error; for each offset the scale is a closed form in [0, 1]."""
    rows = samples.withColumn("offset", F.explode(grid)).withColumn("_i", F.explode(F.sequence(F.lit(0), F.size("ys") - 1)))
    x, y = F.col("x0") + F.col("_i") * F.col("width"), F.get("ys", F.col("_i"))
    inside = (x > 0) & (x < F.col("ref_mean") + F.col("ref_std"))
    r = _shifted(F.col("ref_x0"), F.col("ref_width"), F.col("ref_ys"), x, F.col("offset"))
    g = rows.select(*keys, "offset", y.alias("y"), r.alias("r"), inside.alias("_in")).filter("_in").groupBy(*keys, "offset").agg(
        F.sum(F.col("r") * F.col("r")).alias("rr"), F.sum(F.col("r") * F.col("y")).alias("ry"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    scale = F.when(F.col("rr") > 0, F.least(F.greatest(F.col("ry") / F.when(F.col("rr") > 0, F.col("rr")), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    cost = F.col("yy") - 2 * F.col("scale") * F.col("ry") + F.col("scale") * F.col("scale") * F.col("rr")
    return g.withColumn("scale", scale).withColumn("cost", cost).groupBy(*keys).agg(
        F.min(F.struct(F.round(F.col("cost") / F.col("yy"), 9).alias("c"), "offset", "scale")).alias("b")).select(*keys, "b.offset", "b.scale", F.col("b.c").alias("cost"))


def unmix_fit(samples: DataFrame, reference: DataFrame, pool: DataFrame, keys: list[str], points: int = 40) -> DataFrame:
    """Offset and scale of the control histogram that best explain the left side of each sample.

    ``samples``: histogram arrays by (plate, well); ``reference``: by plate; ``pool``: (plate, ref_mean, ref_std).
    The offset is searched on a coarse and then a fine grid between 0 and ref_mean + 2 ref_std.
    """
    ref = reference.select("plate", F.col("x0").alias("ref_x0"), F.col("width").alias("ref_width"), F.col("ys").alias("ref_ys"))
    s = samples.join(ref, "plate").join(pool, "plate")
    top = F.col("ref_mean") + 2 * F.col("ref_std")
    steps = F.sequence(F.lit(0), F.lit(points))
    coarse = _best_offset(s, keys, F.transform(steps, lambda i: top * i / points))
    near = s.join(coarse.select(*keys, F.col("offset").alias("_at")), keys)
    fine = F.transform(steps, lambda i: F.least(F.greatest(F.col("_at") + top / points * (2 * i / points - 1), F.lit(0.0)), top))
    return _best_offset(near, keys, fine)


def unmixed_stats(samples: DataFrame, reference: DataFrame, pool: DataFrame, fit: DataFrame, keys: list[str]) -> DataFrame:
    """Area, mean, deviation, median and 99th percentile right of the boundary after removing the fitted controls.

    A negative area is reported as 0 without further numbers.
    """
    ref = reference.select("plate", F.col("x0").alias("ref_x0"), F.col("width").alias("ref_width"), F.col("ys").alias("ref_ys"))
    s = samples.join(ref, "plate").join(pool, "plate").join(fit.select(*keys, "offset", "scale"), keys)
    rows = s.withColumn("_i", F.explode(F.sequence(F.lit(0), F.size("ys") - 1)))
    x = F.col("x0") + F.col("_i") * F.col("width")
    y = F.get("ys", F.col("_i")) - F.col("scale") * _shifted(F.col("ref_x0"), F.col("ref_width"), F.col("ref_ys"), x, F.col("offset"))
    rows = rows.select(*keys, "offset", "scale", "width", (F.col("offset") + F.col("ref_std")).alias("boundary"), x.alias("x"), y.alias("y")).filter("x > boundary")
    g = rows.groupBy(*keys).agg(F.max("offset").alias("fitted_offset"), F.max("scale").alias("fitted_scale"), F.max("boundary").alias("boundary"),
                                (F.sum("y") * F.max("width")).alias("area"), F.try_divide(F.sum(F.col("x") * F.col("y")), F.sum("y")).alias("raw_mean"),
                                F.try_divide(F.sum(F.col("x") * F.col("x") * F.col("y")), F.sum("y")).alias("_m2"))
    q = cumulative_quantiles(rows, keys, "x", "y", {"raw_median": 0.5, "raw_percentile99": 0.99})
    j = g.join(q, keys).withColumn("raw_std", F.sqrt(F.greatest(F.col("_m2") - F.pow("raw_mean", 2), F.lit(0.0))))
    empty = F.col("area") < 0
    j = j.withColumns({c: F.when(~empty, F.col(c)) for c in ("raw_mean", "raw_std", "raw_median", "raw_percentile99")}).withColumn("area", F.greatest("area", F.lit(0.0)))
    base = C.hlog_inverse("fitted_offset")
    for c in ("mean", "median", "percentile99"):
        v = C.hlog_inverse(f"raw_{c}")
        j = j.withColumns({f"rel_{c}_linear": v - base, f"rel_{c}_log": C.log10_or_null(F.try_divide(v, base)), f"rel_{c}_hlog": F.col(f"raw_{c}") - F.col("fitted_offset")})
    return j.drop("_m2")


def fit_inputs(cells: DataFrame, controls: DataFrame, xrange=SAMPLE_RANGE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(samples, reference, pool): histograms per well and per plate.  They are short next to the cells
    and read many times, so they are written to the checkpoint folder once."""
    centred, pool = pool_controls(controls)
    reference = histogram_arrays(histogram(centred, ["plate"], "fitc", percentile=0.2), ["plate"])
    samples = histogram_arrays(histogram(cells, ["plate", "well"], "fitc", xrange=xrange), ["plate", "well"])
    return cut_lineage(samples), cut_lineage(reference), cut_lineage(pool)


def all_plates(cells: DataFrame, controls: DataFrame, xrange=SAMPLE_RANGE) -> DataFrame:
    """The analysis of transformed and gated cells for every well of every plate in one job."""
    keys = ["plate", "well"]
    samples, reference, pool = fit_inputs(cells, controls, xrange)
    return unmixed_stats(samples, reference, pool, cut_lineage(unmix_fit(samples, reference, pool, keys)), keys)


def analyse_plates(cells: DataFrame, controls: DataFrame, xrange=SAMPLE_RANGE) -> DataFrame:
    """The whole analysis from raw measurements (plate, well, fitc, fsc_a, fsc_w, ssc_a) of samples and controls, both transformed and
    gated, to one row per well of every plate."""
    return all_plates(transform_and_gate(cells), transform_and_gate(controls), xrange)
