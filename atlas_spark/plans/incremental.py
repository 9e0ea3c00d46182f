"""Queries for incremental work and streaming."""

from pyspark.sql import functions as F

from ..operators import incremental as I
from ..registry import query
from ..sources.writers import scratch_path
from ..streaming import results as R


@query("unprocessed_batch", "select fov_id, 'todo' as mode from {fov} where fov_id not in (select fov_id from {fov_result} where kind = 'view') union all select fov_id, 'all' from {fov}")
def unprocessed_batch(t):
    todo = I.unprocessed(t.fov, t.fov_result, "view").select("fov_id", F.lit("todo").alias("mode"))
    return todo.unionByName(I.unprocessed(t.fov, t.fov_result, "view", force=True).select("fov_id", F.lit("all").alias("mode")))


def ratio(row):
    return 100.0 / (row["site_num"] - 3)


@query("batch_with_error_log", "select fov_id, 'ratio' as method, case when site_num <> 3 then round(100.0 / (site_num - 3), 6) end as value, case when site_num = 3 then 'ZeroDivisionError' end as error_kind from {fov}")
def batch_with_error_log(t):
    ok, bad = I.run_with_error_log(t.fov.select("fov_id", "site_num"), "fov_id", "ratio", ratio)
    return ok.withColumn("value", F.round("value", 6)).unionByName(bad.drop("message"), allowMissingColumns=True)


@query("legacy_name_audit", "select c_custkey, concat('G', c_custkey % 50) as old_name, concat('G', c_nationkey) as new_name from customer where c_custkey % 50 <> c_nationkey")
def legacy_name_audit(t):
    old = t.customer.select("c_custkey", F.concat(F.lit("G"), F.col("c_custkey") % 50).alias("old_name"))
    new = t.customer.select("c_custkey", F.concat(F.lit("G"), "c_nationkey").alias("new_name"))
    return old.join(new, "c_custkey").filter("old_name <> new_name")


def stream(t):
    return R.result_stream(t.spark, t.sf_dir, glob="events.parquet")


@query("stream_new_results", "select fov_id, kind from {fov_result} group by 1, 2")
def stream_new_results(t):
    sink, chk = scratch_path(t.spark), scratch_path(t.spark)
    R.run_available(R.first_results(stream(t), "3650 days").select("fov_id", "kind"), sink, chk)
    return t.spark.read.schema("fov_id bigint, kind string").parquet(sink)


@query("stream_window_counts", """with d as (select event_type as kind, cast(floor(epoch(ts) / 86400) as bigint) as day, epoch(ts) as s from events), w as (select kind, (day - k) * 86400 as start_s, s from d, (select unnest(range(7)) as k) q where s < (day - k + 7) * 86400),
    m as (select max(epoch(ts)) - 86400 as mark from events) select kind, cast(start_s as bigint) as start_s, count(*) as n from w, m where start_s + 7 * 86400 <= mark group by 1, 2""")
def stream_window_counts(t):
    sink, chk = scratch_path(t.spark), scratch_path(t.spark)
    R.run_available(R.window_counts(stream(t)), sink, chk)
    out = t.spark.read.schema("start timestamp, end timestamp, kind string, n bigint").parquet(sink)
    return out.select("kind", F.unix_timestamp("start").alias("start_s"), "n")


@query("stream_upsert", "select fov_id, kind, max(value) as value from (select cast(floor(event_id / 5) as bigint) as fov_id, event_type as kind, value, ts, row_number() over (partition by floor(event_id / 5), event_type order by ts desc) as r from events) q where r = 1 group by 1, 2")
def stream_upsert(t):
    table, chk = scratch_path(t.spark), scratch_path(t.spark)
    R.upsert_batches(stream(t), table, chk, ["fov_id", "kind"])
    return R.read_table(t.spark, table, ["fov_id", "kind"]).select("fov_id", "kind", "value")
