"""Readers for the file formats of the atlas.  Text columns are read as strings and cast by name,
so no pass over the data is spent on schema inference."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import cols as C

# Info columns and QC flags of protein-group tables, column names of the library,
# electroporation, microscopy-key and gene-nomenclature files.
GROUP_INFO = ("Protein IDs", "Majority protein IDs", "Protein names", "Gene names", "Fasta headers")
QC_FLAGS = ("Potential contaminant", "Only identified by site", "Reverse")
LIBRARY_COLUMNS = {
    "plate_id": "plate_id", "well_id": "well_id", "gene_name": "target_name", "family": "target_family",
    "enst_id": "transcript_id", "enst_note": "transcript_notes", "hek_tpm": "hek_tpm",
    "terminus_to_tag": "target_terminus", "terminus_choice": "terminus_notes",
    "protospacer_name": "protospacer_name", "protospacer_note": "protospacer_notes",
    "protospacer_sequence": "protospacer_sequence", "ultramer_name": "template_name",
    "ultramer_note": "template_notes", "ultramer_sequence": "template_sequence"}
ELECTROPORATION_COLUMNS = {"plate_id": "plate_id", "electroporation_date": "date", "comment": "notes"}
MICROSCOPY_KEY_COLUMNS = {"id": "legacy_id", "automated_acquisition?": "automation",
                          "acquisition_notes": "notes", "primary_imager": "imager"}
HGNC_COLUMNS = ("symbol", "alias_symbol", "prev_symbol", "name", "alias_name", "prev_name",
                "ensembl_gene_id", "hgnc_id")
RAW_PLATE_PATH = "^mNG96wp[1-9]([0-9])?(_Thawed|/)"


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def read_delimited(spark: SparkSession, path: str, sep: str = ",", header: bool = True) -> DataFrame:
    return spark.read.csv(path, sep=sep, header=header, inferSchema=False, enforceSchema=False)


def select_by_prefix(names: list[str], prefix: str) -> list[str]:
    """Column names beginning with ``prefix`` in any case."""
    return [n for n in names if n.lower().startswith(prefix.lower())]


def qc_flag_filter(df: DataFrame, flags=QC_FLAGS) -> DataFrame:
    keep = F.lit(True)
    for f in flags:
        keep = keep & quoted(f).isNull()
    return df.filter(keep)


def read_protein_groups(spark: SparkSession, path: str, filter_rows: bool = True,
                        prefixes=("intensity", "LFQ intensity")) -> DataFrame:
    """Info columns and every sample column; samples are doubles."""
    df = read_delimited(spark, path, sep="\t")
    if filter_rows:
        df = qc_flag_filter(df)
    samples = [n for p in prefixes for n in select_by_prefix(df.columns, p)]
    return df.select(*[quoted(n) for n in GROUP_INFO],
                     *[quoted(n).cast("double").alias(n) for n in samples])


def read_spatial_groups(spark: SparkSession, path: str, identity: bool = False) -> DataFrame:
    """Fractionation groups: the total column goes, identification columns are optional."""
    df = qc_flag_filter(read_delimited(spark, path, sep="\t")).drop("Intensity")
    samples = select_by_prefix(df.columns, "intensity")
    extra = select_by_prefix(df.columns, "identification type") if identity else []
    return df.select(*[quoted(n) for n in GROUP_INFO],
                     *[quoted(n).cast("double").alias(n) for n in samples], *[quoted(n) for n in extra])


def melt(df: DataFrame, ids: list[str], samples: list[str], name: str = "sample", value: str = "value") -> DataFrame:
    return df.unpivot([quoted(i) for i in ids], [quoted(s) for s in samples], name, value)


def melt_samples(df: DataFrame, ids: list[str], samples: list[str], bait_pattern: str, replicate_pattern: str) -> DataFrame:
    """Wide samples to (ids, bait, replicate, value); names come from the patterns' first groups."""
    long = melt(df, ids, samples)
    return long.select(*[quoted(i) for i in ids], F.regexp_extract("sample", bait_pattern, 1).alias("bait"),
                       F.regexp_extract("sample", replicate_pattern, 1).cast("int").alias("replicate"), "value")


def rename_samples(df: DataFrame, rules: list[tuple[str, str]], column: str = "sample") -> DataFrame:
    """Ordered case-insensitive regex replacements on a sample-name column."""
    c = F.col(column)
    for pattern, replacement in rules:
        c = F.regexp_replace(c, f"(?i){pattern}", replacement)
    return df.withColumn(column, c)


def trim_after_replicate(c: Column | str, reps: int = 3) -> Column:
    """Cut whatever follows the first replicate id (_01_ ... _0<reps>_)."""
    c = C.col(c)
    return F.when(c.rlike(f"_0[1-{reps}]_"), F.regexp_extract(c, f"^(.*?_0[1-{reps}])_", 1)).otherwise(c)


def read_fasta(spark: SparkSession, path: str) -> DataFrame:
    """One row per record; the file is split at record starts, so a large file is read in parallel."""
    records = spark.read.text(path, lineSep="\n>").select(F.regexp_replace("value", "^>", "").alias("rec"))
    head = F.split("rec", "\n", 2)
    reference = F.split(head[0], "[ \t]")[0]
    return (records.filter(F.trim("rec") != "")
            .select(reference.alias("reference"), F.split(reference, "[|]")[1].alias("protein_id"),
                    F.regexp_replace(F.coalesce(F.get(head, F.lit(1)), F.lit("")), "\\s", "").alias("sequence")))


def _renamed(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    return df.select(*[quoted(a).alias(b) for a, b in mapping.items()])


def read_library_snapshot(spark: SparkSession, path: str) -> DataFrame:
    df = _renamed(read_delimited(spark, path), LIBRARY_COLUMNS)
    return df.withColumns({"plate_id": C.plate_id("plate_id"), "hek_tpm": C.parse_float("hek_tpm")})


def read_electroporations(spark: SparkSession, path: str) -> DataFrame:
    return _renamed(read_delimited(spark, path), ELECTROPORATION_COLUMNS).withColumn("plate_id", C.plate_id("plate_id"))


def read_microscopy_key(spark: SparkSession, path: str) -> DataFrame:
    df = read_delimited(spark, path)
    names = [re.sub(" ", "_", n).lower() for n in df.columns]
    df = df.toDF(*[MICROSCOPY_KEY_COLUMNS.get(n, n) for n in names])
    parts = F.split("legacy_id", "_")
    return df.select(F.concat(F.lit("P"), parts[0]).alias("pml_id"), F.to_date(parts[1], "yyyyMMdd").alias("date"),
                     "automation", "imager", "description", "notes")


def wells(spark: SparkSession) -> DataFrame:
    """The 96 unpadded wells of a plate."""
    return spark.range(len(C.PLATE_ROWS) * C.PLATE_COLUMNS).select(
        F.concat(F.substring(F.lit(C.PLATE_ROWS), (F.col("id") / C.PLATE_COLUMNS).cast("int") + 1, F.lit(1)),
                 (F.col("id") % C.PLATE_COLUMNS + 1).cast("string")).alias("well_id"))


def read_platemap(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("well_id string, target_name string").csv(path)


def platemap_problems(platemap: DataFrame) -> DataFrame:
    """Rows (problem, well_id) for missing wells, unexpected wells and wells without a target."""
    known = wells(platemap.sparkSession)
    used = platemap.select("well_id").distinct()
    def tagged(df, text):
        return df.select(F.lit(text).alias("problem"), "well_id")
    return (tagged(known.join(used, "well_id", "left_anti"), "missing well")
            .unionByName(tagged(used.join(known, "well_id", "left_anti"), "unexpected well"))
            .unionByName(tagged(platemap.filter(F.col("target_name").isNull()), "no target")))


def read_hgnc(spark: SparkSession, path: str) -> DataFrame:
    df = read_delimited(spark, path, sep="\t")
    return df.select(*HGNC_COLUMNS).withColumnRenamed("ensembl_gene_id", "ensg_id")


def read_facs_results(spark: SparkSession, scalars_path: str, histograms_path: str, multi_line: bool = False) -> DataFrame:
    """Scalars packed as JSON next to the histogram arrays of the same (plate, well).

    JSON lines is the default because one large multi-line array is read by a single task.
    """
    scalars = read_delimited(spark, scalars_path)
    rest = [c for c in scalars.columns if c not in ("plate_id", "well_id")]
    packed = scalars.select("plate_id", "well_id", F.to_json(F.struct(*rest)).alias("scalars"))
    hist = (spark.read.schema("plate_id string, well_id string, x array<double>, y_sample array<double>, y_ref_fitted array<double>")
            .json(histograms_path, multiLine=multi_line))
    return packed.join(hist, ["plate_id", "well_id"], "left").withColumn("well_id", C.well_id("well_id"))


def read_fov_metadata(spark: SparkSession, path: str) -> DataFrame:
    df = read_delimited(spark, path)
    sort = F.coalesce(F.col("sort_count").cast("int"), F.lit(1)) if "sort_count" in df.columns else F.lit(1)
    flagged = F.coalesce(F.lower("manually_flagged") == "true", F.lit(False))
    return df.filter(~flagged).withColumns(
        {"raw_filepath": F.concat_ws("/", "src_dirpath", "src_filename"), "sort_count": sort})


def list_files(spark: SparkSession, root: str, pattern: str = RAW_PLATE_PATH, suffix: str = ".tif") -> DataFrame:
    """Image files below ``root`` with path levels, size and time; file contents are not read."""
    files = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
             .select("path", "length", "modificationTime"))
    folder = spark._jvm.org.apache.hadoop.fs.Path(root)
    # the listed paths carry the scheme and host of the root's file system, whichever it is
    base = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString().rstrip("/") + "/"
    rel = F.regexp_replace("path", "^" + re.escape(base), "")
    return (files.withColumn("path", rel).filter(F.col("path").contains(suffix) & F.col("path").rlike(pattern)))


def read_edge_network(spark: SparkSession, path: str, source: str, target: str, score: str | None = None,
                      above: float | None = None, sep: str = ",") -> DataFrame:
    """Interaction set from a delimited file, optionally only rows scoring above a threshold."""
    df = read_delimited(spark, path, sep=sep)
    out = [quoted(source).alias("target"), quoted(target).alias("prey")]
    if score:
        out.append(quoted(score).cast("double").alias("score"))
    df = df.select(*out)
    return df.filter(F.col("score") > above) if score and above is not None else df
