"""Image-derived tables.  A slice row is (fov_id, channel, z, row, pixels): one line of an image as an array.

Per-pixel work stays inside the arrays; rows are exploded only where single values must be ranked.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .ranking import grouped_quantiles

IMAGE = ["fov_id", "channel"]
# Field and ROI size in pixels, slices of an ROI, chromatic offset, 8- and 16-bit ranges.
FOV_SIZE, ROI_SIZE, ROI_SLICES = 1024, 600, 27
CHROMATIC_UM = 1.0
MAX_VALUE = {"float": 1.0, "uint8": 255, "uint16": 65535}


def _sum(arr) -> Column:
    return F.aggregate(arr, F.lit(0.0), lambda a, x: a + x)


def page_metadata_qc(pages: DataFrame) -> DataFrame:
    """Per field: channel rules, equal slices, contiguity, constant exposure, how to split, and messages.

    ``pages``: (fov_id, page_ind, slice_ind, channel_ind, exposure_time, error).
    """
    bad = F.col("slice_ind").isNull() | F.col("channel_ind").isNull() | F.col("exposure_time").isNull()
    counts = pages.groupBy("fov_id").agg(F.count_if(bad).alias("dropped"), F.count_if("error").alias("errors"), F.count_if(~bad).alias("n_pages"))
    ch = pages.filter(~bad).groupBy("fov_id", "channel_ind").agg(
        F.count("*").alias("n"), ((F.max("slice_ind") - F.min("slice_ind") + 1 == F.count("*")) & (F.count_distinct("slice_ind") == F.count("*")) & (F.count("*") > 1)).alias("steps"),
        (F.max("exposure_time") == F.min("exposure_time")).alias("same"))
    g = ch.groupBy("fov_id").agg(F.count("*").alias("n_channels"), F.min("channel_ind").alias("lo"), F.max("channel_ind").alias("hi"),
                                 F.min_by("n", "channel_ind").alias("n_lo"), F.max_by("n", "channel_ind").alias("n_hi"),
                                 F.max(F.when(F.col("channel_ind") == 1, F.col("n"))).alias("n_1"),
                                 F.bool_or("steps").alias("valid_slices"), F.bool_and("steps").alias("_all"), F.bool_and("same").alias("_same"))
    c = counts.join(g, "fov_id", "left").withColumn("n_channels", F.coalesce("n_channels", F.lit(0)))
    three = (F.col("n_channels") == 3) & (F.col("lo") == 0) & (F.col("hi") == 2) & F.col("n_1").isNotNull()
    equal = F.when(F.col("n_channels") == 2, F.col("n_lo") == F.col("n_hi")).when(three, F.col("n_lo") == F.col("n_1"))
    valid, half = F.coalesce(equal, F.lit(False)), (F.col("n_channels") == 1) & (F.col("n_pages") % 2 == 0)
    msg = F.array_compact(F.array(
        F.when(F.col("dropped") != F.col("errors"), "dropped rows differ from error rows"), F.when(three, "three channel inds"),
        F.when((F.col("n_channels") == 1) & (F.col("n_pages") % 2 == 1), "one channel ind and an odd number of pages"),
        F.when(~F.col("n_channels").isin(1, 2) & ~F.coalesce(three, F.lit(False)), "unexpected number of channel inds"),
        F.when(~equal, "unequal number of slices"), F.when(~F.col("_all"), "slice inds not contiguous"), F.when(~F.col("_same"), "inconsistent exposure"),
        F.when(~valid & ~half, "unable to split pages by channel")))
    return c.select("fov_id", valid.alias("valid_channels"), F.coalesce("valid_slices", F.lit(False)).alias("valid_slices"), half.alias("split_in_half"), (valid | half).alias("did_split"), msg.alias("messages"))


def z_profiles(slices: DataFrame, percentile: float = 0.9999) -> DataFrame:
    """min, max, mean and a high percentile of every slice."""
    keys = [*IMAGE, "z"]
    m = slices.groupBy(*keys).agg(F.min(F.array_min("pixels")).alias("min"), F.max(F.array_max("pixels")).alias("max"),
                                  (F.sum(_sum("pixels")) / F.sum(F.size("pixels"))).alias("mean"))
    p = grouped_quantiles(slices.select(*keys, F.explode("pixels").alias("v")), keys, "v", {"p9999": percentile})
    return m.join(p, keys)


def z_projection(slices: DataFrame) -> DataFrame:
    """Largest value over z per pixel, one array per image row; an image row has as many slices as the stack."""
    stack = slices.groupBy(*IMAGE, "row").agg(F.collect_list("pixels").alias("s"))
    return stack.select(*IMAGE, "row", F.aggregate("s", F.get("s", F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: F.greatest(x, y))).alias("pixels"))


def mean_profile(slices: DataFrame) -> DataFrame:
    return slices.groupBy(*IMAGE, "z").agg((F.sum(_sum("pixels")) / F.sum(F.size("pixels"))).alias("m"))


def cell_layer_center(slices: DataFrame) -> DataFrame:
    """Centre of mass along z of the mean profile above its own average."""
    p = mean_profile(slices)
    avg = p.groupBy(*IMAGE).agg(F.avg("m").alias("_a"))
    w = F.greatest(F.col("m") - F.col("_a"), F.lit(0.0))
    return p.join(avg, IMAGE).groupBy(*IMAGE).agg(F.try_divide(F.sum(w * F.col("z")), F.sum(w)).alias("center"))


def exposure_qc(fovs: DataFrame) -> DataFrame:
    """Shares and counts over fields (com, max, power, time): low cell layers, overexposure, exposure."""
    return fovs.agg(F.avg(F.when(F.col("com") < 5, 1.0).otherwise(0.0)).alias("share_low"), F.count_if(F.col("max") > 65000).alias("n_overexposed"),
                    F.sum(F.col("power") * F.col("time")).alias("total_exposure"))


def exposure_histogram(fovs: DataFrame, time_width: float = 10, max_width: float = 1000) -> DataFrame:
    return fovs.filter("time is not null and max is not null").groupBy(F.floor(F.col("time") / time_width).alias("time_bin"), F.floor(F.col("max") / max_width).alias("max_bin")).agg(F.count("*").alias("n"))


def underexposed_groups(fovs: DataFrame, keys: list[str], time: float = 200, top: float = 5000, more_than: int = 2) -> DataFrame:
    dim = fovs.filter((F.col("time") < time) & (F.col("max") < top))
    return dim.groupBy(*keys).agg(F.count("*").alias("n")).filter(F.col("n") > more_than)


def align_crop(slices: DataFrame, bottom_um: float, top_um: float, step_um: float, wiggle_um: float = 0.0, nuclear: int = 0, signal: int = 1) -> tuple[DataFrame, DataFrame]:
    """Aligned, cropped and zero-padded stacks, and the plan (window, padding, error) of every field."""
    shift = int(CHROMATIC_UM / step_um)
    depth = slices.groupBy("fov_id").agg((F.max("z") + 1).alias("_n"))
    s = slices.join(depth, "fov_id")
    s = s.filter(F.when(F.col("channel") == nuclear, F.col("z") < F.col("_n") - shift).otherwise((F.col("channel") == signal) & (F.col("z") >= shift)))
    s = s.withColumn("z", F.when(F.col("channel") == signal, F.col("z") - shift).otherwise(F.col("z"))).drop("_n")
    c = cell_layer_center(s.filter(F.col("channel") == nuclear)).select("fov_id", F.rint("center").alias("c")).join(depth, "fov_id")
    n = F.col("_n") - shift
    bottom, top = F.floor(F.col("c") + bottom_um / step_um), F.ceil(F.col("c") + top_um / step_um)
    allowed = round(wiggle_um / step_um)
    plan = c.select("fov_id", F.greatest(bottom, F.lit(0)).alias("bottom"), top.alias("top"), F.greatest(-bottom, F.lit(0)).alias("pad"),
                    F.when((bottom < 0) & (-bottom > allowed), "too close to the bottom").when(top >= n, "too close to the top").alias("error"))
    k = s.join(plan.filter("error is null and bottom is not null"), "fov_id").filter("z >= bottom and z < top")
    kept = k.select(*IMAGE, (F.col("z") - F.col("bottom") + F.col("pad")).alias("z"), "row", "pixels")
    zeros = k.filter("z = bottom and pad > 0").select(*IMAGE, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("pad") - 1)).alias("z"), "row", F.transform("pixels", lambda x: F.lit(0)).alias("pixels"))
    return kept.unionByName(zeros), plan


def autoscale(slices: DataFrame, keys: list[str], percentile: float = 0.0, kind: str = "uint8", gamma: float | None = None) -> DataFrame:
    """Stretch each image between two percentiles to the range of its type; a constant image becomes 0."""
    q = grouped_quantiles(slices.select(*keys, F.explode("pixels").alias("v")), keys, "v", {"_lo": percentile / 100, "_hi": 1 - percentile / 100})
    lo, hi = F.col("_lo"), F.col("_hi")

    def scale(x):
        v = F.least(F.greatest((x - lo) / F.when(hi > lo, hi - lo), F.lit(0.0)), F.lit(1.0))
        v = F.pow(v, F.lit(gamma)) if gamma is not None else v
        out = v * MAX_VALUE[kind]
        return F.coalesce(out if kind == "float" else F.floor(out).cast("int"), F.lit(0))
    return slices.join(q, keys).withColumn("pixels", F.transform("pixels", scale)).drop("_lo", "_hi")


def block_downsample(images: DataFrame, size: int) -> DataFrame:
    """Mean over size x size blocks (edges padded with 0), without the last block row and column."""
    starts = F.sequence(F.lit(0), F.ceil(F.size("pixels") / size).cast("int") - 1)
    sums = F.transform(starts, lambda b: _sum(F.slice("pixels", b * size + 1, F.lit(size))))
    rows = images.select(*IMAGE, F.floor(F.col("row") / size).alias("row"), F.posexplode(sums).alias("col", "s"))
    last = images.groupBy(*IMAGE).agg(F.floor(F.max("row") / size).alias("_r"), F.max(F.ceil(F.size("pixels") / size) - 1).alias("_c"))
    out = rows.groupBy(*IMAGE, "row", "col").agg((F.sum("s") / (size * size)).alias("value"))
    return out.join(last, IMAGE).filter("row < _r and col < _c").drop("_r", "_c")


def rgb_compose(images: DataFrame, nuclear: int = 0, signal: int = 1) -> DataFrame:
    """(fov_id, row, red, green, blue) arrays: grey signal with the brighter of signal and nuclear stain in blue."""
    n = images.filter(F.col("channel") == nuclear)
    mean = n.groupBy("fov_id").agg((F.sum(_sum("pixels")) / F.sum(F.size("pixels"))).alias("_m"))
    n = n.join(mean, "fov_id").withColumn("pixels", F.transform("pixels", lambda x: F.greatest(x - F.col("_m"), F.lit(0.0)))).drop("_m")
    h = autoscale(n, IMAGE, percentile=1, gamma=0.7).select("fov_id", "row", F.col("pixels").alias("_h"))
    g = autoscale(images.filter(F.col("channel") == signal), IMAGE, percentile=1).select("fov_id", "row", F.col("pixels").alias("red"))
    return g.join(h, ["fov_id", "row"]).select("fov_id", "row", "red", F.col("red").alias("green"), F.zip_with("red", "_h", lambda a, b: F.greatest(a, b)).alias("blue"))


def corner_rois(fovs: DataFrame, fov_size: int = FOV_SIZE, roi_size: int = ROI_SIZE) -> DataFrame:
    """The four corner ROIs of every field."""
    hi = fov_size - roi_size
    corners = F.array(*[F.struct(F.lit(a).alias("top"), F.lit(b).alias("left")) for a in (0, hi) for b in (0, hi)])
    return fovs.select("fov_id", F.explode(corners).alias("c")).select("fov_id", "c.top", "c.left", F.lit(roi_size).alias("size"))


def annotated_rois(annotations: DataFrame, roi_size: int = ROI_SIZE) -> DataFrame:
    return annotations.filter("top is not null and left is not null").select("fov_id", "top", "left", F.lit(roi_size).alias("size"))


def roi_crop(slices: DataFrame, rois: DataFrame) -> DataFrame:
    """(fov_id, roi_id, channel, z, row, pixels) inside each ROI (roi_id, fov_id, top, left, size)."""
    j = slices.join(rois, "fov_id").filter((F.col("row") >= F.col("top")) & (F.col("row") < F.col("top") + F.col("size")))
    return j.select("fov_id", "roi_id", "channel", "z", (F.col("row") - F.col("top")).alias("row"), F.slice("pixels", F.col("left") + 1, F.col("size")).alias("pixels"))


def resample_z(slices: DataFrame, keys: list[str], step_um: float, target_um: float, slices_out: int = ROI_SLICES) -> DataFrame:
    """Linear resampling of each stack to another step, cut or zero-padded at the top to a fixed depth.

    Each output slice asks for its two neighbours by number, so a slice row is sent only where it is used.
    """
    scale = step_um / target_um
    depth = slices.groupBy(*keys).agg((F.max("z") + 1).alias("_n"))
    want = depth.withColumn("z", F.explode(F.sequence(F.lit(0), F.lit(slices_out - 1))))
    pos = F.least(F.greatest((F.col("z") + 0.5) / scale - 0.5, F.lit(0.0)), (F.col("_n") - 1).cast("double"))
    want = want.withColumn("_p", pos).withColumn("_out", F.col("z") >= F.round(F.col("_n") * scale))
    ask = want.select(*keys, "z", "_out", F.explode(F.array(F.struct(F.floor("_p").alias("s"), (1 - (F.col("_p") - F.floor("_p"))).alias("w")),
                                                           F.struct(F.ceil("_p").alias("s"), (F.col("_p") - F.floor("_p")).alias("w")))).alias("a"))
    src = slices.withColumnRenamed("z", "_s")
    j = ask.select(*keys, "z", "_out", F.col("a.s").alias("_s"), F.col("a.w").alias("w")).join(src, [*keys, "_s"])
    w = F.when(F.col("_out"), 0.0).otherwise(F.col("w"))
    part = j.select(*keys, "z", "row", F.transform("pixels", lambda x: x * w).alias("pixels"))
    return part.groupBy(*keys, "z", "row").agg(F.collect_list("pixels").alias("s")).select(
        *keys, "z", "row", F.aggregate("s", F.transform(F.get("s", F.lit(0)), lambda x: F.lit(0.0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y)).alias("pixels"))
