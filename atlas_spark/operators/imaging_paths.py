"""Metadata parsed from raw image paths."""

from pyspark.sql import DataFrame, functions as F

from ..functions import cols as C


def path_levels(files: DataFrame, path: str = "path") -> DataFrame:
    parts = F.split(path, "/")
    n = F.size(parts)
    return files.select(
        F.col(path), parts[0].alias("plate_dir"), F.when(n > 2, parts[1]).alias("exp_dir"),
        F.when(n > 3, parts[2]).alias("exp_subdir"), F.element_at(parts, -1).alias("filename"))


def raw_metadata(files: DataFrame) -> DataFrame:
    """Parsed raw files; names of another form and every copy of a repeated field id are left out."""
    f = path_levels(files).filter(F.col("exp_dir").rlike("^ML[0-9]{4}_[0-9]{8}$"))
    name, plate = C.tiff_parts("filename"), C.plate_dir_parts("plate_dir")
    exp = F.split("exp_dir", "_")[0]
    parsed = f.select(
        F.concat_ws("-", exp, name["well_id"], F.concat(F.lit("S"), C.zero_pad(name["site_num"], 2))).alias("fov_id"),
        F.concat(F.lit("P"), exp).alias("pml_id"), name["site_num"].alias("site_num"),
        name["target_name"].alias("target_name"),
        F.concat(F.lit("P"), C.zero_pad(plate["plate_num"], 4)).alias("plate_id"),
        plate["imaging_round_num"].alias("imaging_round_num")).filter(F.col("target_name").isNotNull())
    # a plain aggregate combines before the shuffle, so a name repeated a billion times costs one row per task
    row = F.struct("pml_id", "site_num", "target_name", "plate_id", "imaging_round_num")
    once = parsed.groupBy("fov_id").agg(F.count("*").alias("n"), F.min(row).alias("r")).filter("n = 1")
    return once.select("fov_id", "r.*")
