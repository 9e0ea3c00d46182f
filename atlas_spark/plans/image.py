"""Queries for image-derived tables."""

from pyspark.sql import functions as F

from ..operators import entities as E, image as M
from ..registry import query
from .relational import RANKED, rounded


def long(df, *keys, digits=6):
    """Arrays as one row per pixel, for comparison."""
    out = df.select(*keys, F.posexplode("pixels").alias("col", "pixel"))
    return out.withColumns({"col": F.col("col").cast("bigint"), "pixel": F.round(F.col("pixel").cast("double"), digits)})


PAGES = """select conv_id as fov_id, turn as page_ind, case when turn = 5 then null else cast(floor(turn / 2) as bigint) end as slice_ind, case when conv_id % 5 = 0 then 0 else turn % 2 end as channel_ind,
    cast(case when conv_id % 7 = 0 then length(text) else 50 end as double) as exposure_time, turn = 5 and conv_id % 3 <> 0 as error from {conversations}"""


@query("page_metadata_qc", f"""with p as ({PAGES}), ok as (select * from p where slice_ind is not null), c as (select fov_id, count(*) filter (slice_ind is null) as dropped, count(*) filter (error) as errors, count(*) filter (slice_ind is not null) as n_pages from p group by 1),
    ch as (select fov_id, channel_ind, count(*) as n, max(slice_ind) - min(slice_ind) + 1 = count(*) and count(distinct slice_ind) = count(*) and count(*) > 1 as steps, max(exposure_time) = min(exposure_time) as same from ok group by 1, 2),
    g as (select fov_id, count(*) as k, min(n) as a, max(n) as b, bool_or(steps) as vs, bool_and(steps) as va, bool_and(same) as sm from ch group by 1), j as (select c.*, coalesce(k, 0) as k, a, b, vs, va, sm from c left join g using (fov_id)),
    f as (select *, k = 2 and a = b as valid, k = 1 and n_pages % 2 = 0 as half from j)
    select fov_id, valid as valid_channels, coalesce(vs, false) as valid_slices, half as split_in_half, valid or half as did_split, concat_ws(';', case when dropped <> errors then 'dropped rows differ from error rows' end,
      case when k = 1 and n_pages % 2 = 1 then 'one channel ind and an odd number of pages' end, case when k not in (1, 2) then 'unexpected number of channel inds' end, case when k = 2 and a <> b then 'unequal number of slices' end,
      case when not va then 'slice inds not contiguous' end, case when not sm then 'inconsistent exposure' end, case when not valid and not half then 'unable to split pages by channel' end) as messages from f""")
def page_metadata_qc(t):
    return M.page_metadata_qc(t.sql(PAGES)).withColumn("messages", F.array_join("messages", ";"))


@query("z_profiles", "select fov_id, channel, z, min(pixel) as min, max(pixel) as max, round(avg(pixel), 6) as mean, round(quantile_cont(pixel, 0.9999), 6) as p9999 from {pixels} group by 1, 2, 3")
def z_profiles(t):
    return rounded(M.z_profiles(t.slices).withColumns({"channel": F.col("channel").cast("bigint"), "z": F.col("z").cast("bigint")}), "mean", "p9999")


@query("z_projection", "select fov_id, channel, row, col, cast(max(pixel) as double) as pixel from {pixels} group by 1, 2, 3, 4")
def z_projection(t):
    return long(M.z_projection(t.slices), "fov_id", F.col("channel").cast("bigint").alias("channel"), F.col("row").cast("bigint").alias("row"))


CENTER = "(with p as (select fov_id, channel, z, avg(pixel) as m from {pixels} group by 1, 2, 3), a as (select *, greatest(m - avg(m) over (partition by fov_id, channel), 0) as w from p) select fov_id, channel, sum(w * z) / sum(w) as center from a group by 1, 2)"


@query("cell_layer_center", f"select fov_id, channel, round(center, 6) as center from {CENTER} q")
def cell_layer_center(t):
    return rounded(M.cell_layer_center(t.slices).withColumn("channel", F.col("channel").cast("bigint")), "center")


EXPOSE = "select event_id as fov_id, event_type as plate_id, user_id as target, value / 20 as com, value * 300 as max, cast(event_id % 40 as double) as power, cast(user_id * 3 as double) as time from {events}"


@query("exposure_qc", f"select round(avg(case when com < 5 then 1.0 else 0 end), 8) as share_low, count(*) filter (max > 65000) as n_overexposed, round(sum(power * time), 2) as total_exposure from ({EXPOSE}) q")
def exposure_qc(t):
    return rounded(rounded(M.exposure_qc(t.sql(EXPOSE)), "share_low", digits=8), "total_exposure", digits=2)


@query("exposure_histogram", f"select cast(floor(time / 10) as bigint) as time_bin, cast(floor(max / 1000) as bigint) as max_bin, count(*) as n from ({EXPOSE}) q group by 1, 2")
def exposure_histogram(t):
    return M.exposure_histogram(t.sql(EXPOSE))


@query("underexposed_groups", f"select plate_id, target, count(*) as n from ({EXPOSE}) q where time < 200 and max < 5000 group by 1, 2 having count(*) > 2")
def underexposed_groups(t):
    return M.underexposed_groups(t.sql(EXPOSE), ["plate_id", "target"])


ALIGN = """p as (select fov_id, channel, case when channel = 1 then z - 1 else z end as z, row, col, pixel from {pixels} where (channel = 0 and z < 3) or (channel = 1 and z >= 1)),
    m as (select fov_id, z, avg(pixel) as m from p where channel = 0 group by 1, 2), w as (select *, greatest(m - avg(m) over (partition by fov_id), 0) as w from m), c as (select fov_id, round_even(sum(w * z) / sum(w), 0) as c from w group by 1),
    pl as (select fov_id, cast(greatest(floor(c - 1), 0) as bigint) as bottom, cast(ceil(c + 1) as bigint) as top, cast(greatest(-floor(c - 1), 0) as bigint) as pad, case when ceil(c + 1) >= 3 then 'too close to the top' end as error from c)"""


@query("align_crop", f"""with {ALIGN}, k as (select p.*, bottom, pad from p join pl using (fov_id) where error is null and z >= bottom and z < top)
    select fov_id, channel, z - bottom + pad as z, row, col, cast(pixel as double) as pixel from k union all select fov_id, channel, unnest(range(0, pad)), row, col, 0 from k where z = bottom and pad > 0""")
def align_crop(t):
    kept, _ = M.align_crop(t.slices, -1.0, 1.0, 1.0, wiggle_um=1.0)
    return long(kept, "fov_id", F.col("channel").cast("bigint").alias("channel"), "z", F.col("row").cast("bigint").alias("row"))


@query("align_plan", f"with {ALIGN} select * from pl")
def align_plan(t):
    return M.align_crop(t.slices, -1.0, 1.0, 1.0, wiggle_um=1.0)[1]


def scaled(src, p, gamma=1.0):
    q = f"(select fov_id, quantile_cont(pixel, {p}) as lo, quantile_cont(pixel, {1 - p}) as hi from {src} group by 1)"
    return f"(select s.fov_id, z, row, col, case when hi > lo then floor(255 * pow(least(greatest((pixel - lo) / (hi - lo), 0), 1), {gamma})) else 0 end as pixel from {src} s join {q} q on q.fov_id = s.fov_id)"


@query("autoscale", f"select fov_id, cast(z as bigint) as z, row, col, cast(pixel as double) as pixel from {scaled('(select * from {pixels} where channel = 1)', 0.0625)} q")
def autoscale(t):
    out = M.autoscale(t.slices.filter("channel = 1"), ["fov_id"], percentile=6.25)
    return long(out, "fov_id", F.col("z").cast("bigint").alias("z"), F.col("row").cast("bigint").alias("row"))


# one image of 8 rows and 4 columns per field, for block means
TALL = "select fov_id, channel, z * 2 + row as row, col, pixel from {pixels}"


@query("block_downsample", f"select fov_id, channel, cast(floor(row / 2) as bigint) as row, cast(floor(col / 2) as bigint) as col, round(avg(pixel), 6) as value from ({TALL}) q where row < 6 and col < 2 group by 1, 2, 3, 4")
def block_downsample(t):
    tall = t.slices.withColumn("row", F.col("z") * 2 + F.col("row")).drop("z")
    out = M.block_downsample(tall, 2)
    return rounded(out.withColumns({"channel": F.col("channel").cast("bigint"), "col": F.col("col").cast("bigint")}), "value")


@query("rgb_compose", f"""with n as (select fov_id, z, row, col, greatest(pixel - avg(pixel) over (partition by fov_id), 0) as pixel from {{pixels}} where channel = 0 and z = 0), h as {scaled('n', 0.01, 0.7)},
    g as {scaled('(select * from {pixels} where channel = 1 and z = 0)', 0.01)} select g.fov_id, g.row, g.col, cast(g.pixel as int) as red, cast(greatest(g.pixel, h.pixel) as int) as blue from g join h on h.fov_id = g.fov_id and h.row = g.row and h.col = g.col""")
def rgb_compose(t):
    rgb = M.rgb_compose(t.slices.filter("z = 0").drop("z"))
    return rgb.select("fov_id", F.col("row").cast("bigint").alias("row"), F.posexplode(F.arrays_zip("red", "blue")).alias("col", "p")).select("fov_id", "row", F.col("col").cast("bigint").alias("col"), "p.red", "p.blue")


@query("roi_plan", f"""with top as (select fov_id from {RANKED} q where rank <= 2) select fov_id, a.v as top, b.v as "left", 600 as size, 'corner' as kind from top, (select unnest([0, 424]) as v) a, (select unnest([0, 424]) as v) b
    union all select doc_id, quality * 100, toxic * 100, 600, 'annotated' from labels""")
def roi_plan(t):
    top = E.top_scoring_fovs(t.fov, E.fov_scores(t.fov_result, "view"), 2)
    ann = t.labels.select(F.col("doc_id").alias("fov_id"), (F.col("quality") * 100).alias("top"), (F.col("toxic") * 100).alias("left"))
    return M.corner_rois(top).withColumn("kind", F.lit("corner")).unionByName(M.annotated_rois(ann).withColumn("kind", F.lit("annotated")))


CROP = "select fov_id, roi_id, channel, z, row - top as row, col - lft as col, pixel from {pixels} join (select vec_id as fov_id, vec_id * 2 + k as roi_id, k as top, k * 2 as lft from {embeddings}, (select unnest([0, 1]) as k) x) r using (fov_id) where row >= top and row < top + 2 and col >= lft and col < lft + 2"


@query("roi_crop", f"""with c as ({CROP}), o as (select distinct fov_id, roi_id, channel, row, col, zz as z, least(greatest((zz + 0.5) / 1.5 - 0.5, 0), 3) as p, zz >= 6 as pad from c, (select unnest(range(0, 8)) as zz) x)
    select o.fov_id, o.roi_id, o.channel, o.z, o.row, o.col, round(case when pad then 0 else a.pixel + (b.pixel - a.pixel) * (p - floor(p)) end, 6) as pixel from o join c a on a.roi_id = o.roi_id and a.channel = o.channel and a.row = o.row and a.col = o.col and a.z = floor(p)
    join c b on b.roi_id = o.roi_id and b.channel = o.channel and b.row = o.row and b.col = o.col and b.z = ceil(p)""")
def roi_crop(t):
    rois = t.embeddings.select(F.col("vec_id").alias("fov_id"), F.explode(F.array(F.lit(0), F.lit(1))).alias("k")) \
        .select("fov_id", (F.col("fov_id") * 2 + F.col("k")).alias("roi_id"), F.col("k").alias("top"), (F.col("k") * 2).alias("left"), F.lit(2).alias("size"))
    out = M.resample_z(M.roi_crop(t.slices, rois), ["fov_id", "roi_id", "channel"], 0.3, 0.2, slices_out=8)
    return long(out, "fov_id", "roi_id", F.col("channel").cast("bigint").alias("channel"), F.col("z").cast("bigint").alias("z"), F.col("row").cast("bigint").alias("row"))
