"""Set-based forms of get-or-create, delete-and-insert and attribute updates on keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import cols as C


def insert_if_absent(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """existing plus one row per new key (the smallest row when a key comes more than once)."""
    rest = [c for c in incoming.columns if c not in keys]
    once = incoming.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("r")).select(*keys, "r.*") if rest \
        else incoming.select(*keys).distinct()
    return existing.unionByName(once.join(existing.select(*keys), keys, "left_anti"))


def replace_by_key(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of a parent key are replaced by the incoming batch of that key."""
    return existing.join(incoming.select(*keys).distinct(), keys, "left_anti").unionByName(incoming)


def update_from(existing: DataFrame, changes: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Non-null values of ``changes`` overwrite ``columns`` of matching rows; of a key that comes more than once the smallest
    value of each column counts, so no row is multiplied."""
    new = changes.groupBy(*keys).agg(*[F.min(c).alias(f"_new_{c}") for c in columns])
    out = existing.join(new, keys, "left")
    return out.select(*[F.coalesce(f"_new_{c}", c).alias(c) if c in columns else F.col(c) for c in existing.columns])


def flag_one(pulldowns: DataFrame, picked: DataFrame, key: str = "pulldown_id", parent: str = "line_id",
             flag: str = "display_flag") -> DataFrame:
    """Flag the picked row of each parent and unflag its siblings; parents without a pick are untouched."""
    choice = picked.groupBy(parent).agg(F.min(key).alias("_picked"))
    out = pulldowns.join(choice, parent, "left")
    return out.withColumn(flag, F.when(F.col("_picked").isNotNull(), F.col(key) == F.col("_picked"))
                          .otherwise(F.col(flag))).drop("_picked")


def append_results(results: DataFrame, batch: DataFrame, kind: str, id_col: str, value_cols: list[str]) -> DataFrame:
    """Add rows (id, kind, data) whose data is the JSON of the value columns."""
    tagged = batch.select(F.col(id_col), F.lit(kind).alias("kind"), C.json_row(*value_cols).alias("data"))
    return results.unionByName(tagged)


def clusters_to_rows(clusters: DataFrame, id_cols: list[str], analysis_type: str) -> DataFrame:
    """Ids arrive as doubles with NaN for none: NULL and whole numbers, tagged with the analysis."""
    return clusters.withColumns({c: F.when(~F.isnan(c), F.col(c)).cast("bigint") for c in id_cols}) \
                   .withColumn("analysis_type", F.lit(analysis_type))


def rename_category(categories: str, old: str, new: str):
    """Rename a category and its graded forms inside an array column."""
    return F.transform(categories, lambda c: F.regexp_replace(c, f"^{old}(_[1,2,3])?$", f"{new}$1"))


def flag_if_any(categories, triggers: list[str], flag: str):
    """Add ``flag`` to arrays holding any of the triggers."""
    arr = C.col(categories)
    hit = F.arrays_overlap(arr, F.array(*[F.lit(t) for t in triggers]))
    return F.when(hit, F.array_union(arr, F.array(F.lit(flag)))).otherwise(arr)
