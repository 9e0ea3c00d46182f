"""Scalar functions as plain Column expressions; everything here stays inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

# Id formats, histogram scaling, hyperlog parameters, z-step sizes, row letters.
PULLDOWN_PLATE_PREFIX = "CZBMPI_"
DESIGN_PLATE_PREFIX = "P"
TARGET_ID_PREFIX = "OPCT"
GROUP_ID_PREFIX = "OCPD"
HISTOGRAM_SCALE = 1e6
HLOG_B = 350.0
HLOG_SLOPE = math.log10(2 ** 18) / 10 ** 4
Z_STEP_CHANGE, Z_STEP_OLD, Z_STEP_NEW = 123, 0.5, 0.2
PLATE_ROWS = "ABCDEFGH"
PLATE_COLUMNS = 12


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def zero_pad(c, width: int) -> Column:
    """%0<width>d: pads short numbers, never cuts long ones."""
    s = col(c).cast("string")
    return F.when(F.length(s) >= width, s).otherwise(F.lpad(s, width, "0"))


def group_id(ids, sep: str = ";") -> Column:
    """sha256 of the printed, sorted id list."""
    quoted = F.array_join(F.array_sort(F.split(col(ids), sep)), "', '")
    return F.sha2(F.concat(F.lit("['"), quoted, F.lit("']")), 256)


def ms_plate(c) -> Column:
    s = col(c).cast("string")
    number = F.regexp_extract(s, "([0-9]+)", 1)
    sub = F.regexp_extract(s, r"(\.[0-9]+)$", 1)
    built = F.concat(F.lit(PULLDOWN_PLATE_PREFIX), zero_pad(number.try_cast("bigint"), 4),
                     F.when(sub == ".0", F.lit("")).otherwise(sub))
    formatted = s.rlike(f"^{PULLDOWN_PLATE_PREFIX}[0-9]{{4}}(.[0-9])?$")
    return F.when(formatted, s).when(number != "", built)


def well_id(c) -> Column:
    s = col(c)
    return F.when(s.rlike("^[A-H][1-9]$"), F.concat(F.substring(s, 1, 1), F.lit("0"), F.substring(s, 2, 1))).otherwise(s)


def plate_id(c) -> Column:
    """P%04d; NULL where the text is no plate number."""
    s = col(c).cast("string")
    number = F.regexp_extract(F.lower(s), "^p?(late)? ?([0-9]+)$", 2)
    return F.when(number != "", F.concat(F.lit(DESIGN_PLATE_PREFIX), zero_pad(number.try_cast("bigint"), 4)))


def is_sequence(c) -> Column:
    return col(c).rlike("^[acgtACGT]*$")


def terminus(c) -> Column:
    s = F.lower(col(c))
    return (F.when(s.startswith("int"), "INTERNAL").when(s.startswith("c"), "C_TERMINUS")
            .when(s.startswith("n"), "N_TERMINUS").otherwise(s))


def parse_float(c) -> Column:
    return F.replace(col(c), F.lit(","), F.lit("")).try_cast("double")


def protein_name(c) -> Column:
    """Text before the parenthesised synonyms and the bracketed comment; NULL when it has another shape."""
    pattern = r"^(.*?)( \([^\n]*?\))*( \[[^\n]*?\])?$"
    return F.when(col(c).rlike(pattern), F.regexp_extract(col(c), pattern, 1))


def annotation(c) -> Column:
    s = F.replace(F.replace(col(c), F.lit("; FUNCTION: "), F.lit(" ")), F.lit("FUNCTION: "), F.lit(""))
    s = F.regexp_replace(s, r" \((PubMed:[0-9]+(, )?)+\)", "")
    return F.regexp_replace(s, r" [{].*[}].", "")


def primary_gene(gene_names, uniprot_id) -> Column:
    g = col(gene_names)
    return F.when(g == "NaN", col(uniprot_id)).otherwise(F.split(g, " ")[0])


def strip_isoform(c) -> Column:
    return F.split(col(c), "-")[0]


def public_id(c, prefix: str = TARGET_ID_PREFIX) -> Column:
    return F.concat(F.lit(prefix), zero_pad(c, 11))


def clean_name(c) -> Column:
    return F.translate(col(c), "-_/", "")


def dst_path(kind, parental_line, plate, well, pml, site, appendix_parts, ext) -> Column:
    """kind/line-plate/line-plate-well-pml-site_KIND[-part...].ext"""
    plate_dir = F.concat_ws("-", col(parental_line), col(plate))
    name = F.concat_ws("-", plate_dir, col(well), col(pml), col(site))
    appendix = F.concat_ws("-", F.upper(col(kind)), *appendix_parts)
    return F.concat(col(kind), F.lit("/"), plate_dir, F.lit("/"), name, F.lit("_"), appendix, F.lit("."), col(ext))


def z_step(pml_id) -> Column:
    number = F.substring(col(pml_id), 4, 20).try_cast("int")
    return F.when(number < Z_STEP_CHANGE, Z_STEP_OLD).otherwise(Z_STEP_NEW)


def grade(c) -> Column:
    g = F.regexp_extract(col(c), "_([1,2,3])$", 1)
    return F.when(g != "", g)


def root_category(c) -> Column:
    return F.regexp_replace(col(c), "_[1,2,3]$", "")


def root_gene(c) -> Column:
    """CCT6A -> CCT, MED12 -> MED: a number with or without trailing capitals is no part of the root."""
    lettered = F.regexp_extract(col(c), "^(.+?)[0-9]+[A-Z]+$", 1)
    return F.when(lettered != "", lettered).otherwise(F.regexp_extract(col(c), "^(.+?)[0-9]*$", 1))


def hlog_inverse(v) -> Column:
    v = col(v).cast("double")
    s = F.when(v < 0, -1.0).otherwise(1.0)
    aux = v * HLOG_SLOPE
    return s * F.pow(F.lit(10.0), s * aux) + aux * HLOG_B - s


def hlog(y, rounds: int = 10) -> Column:
    """Forward hyperlog: Newton steps on the inverse formula, an odd function that is convex right of 0.

    They start at the smaller of two upper bounds, at most twice the root, and fall to it; ten rounds reach the last digits.
    """
    y = col(y).cast("double")
    size = F.abs(y)
    start = F.least(size / HLOG_B, F.log10(size + 1))

    def step(a, _):
        power = F.pow(F.lit(10.0), a)
        return a - (power + a * HLOG_B - 1 - size) / (power * math.log(10) + HLOG_B)

    root = F.aggregate(F.array_repeat(F.lit(0), rounds), start, step)
    return F.signum(y) * root / HLOG_SLOPE


def simplify_histogram(arr, scale: float = 1.0) -> Column:
    """Scale, truncate to whole numbers, keep every second element."""
    whole = F.transform(col(arr), lambda x: (x * scale).cast("bigint"))
    return F.filter(whole, lambda _, i: i % 2 == 0)


def log10_or_null(v) -> Column:
    return F.when(col(v) > 0, F.log10(col(v)))


def json_row(*names: str) -> Column:
    """JSON object with NaN and infinities written as null."""
    def clean(n):
        v = F.col(n)
        return F.when(F.isnan(v) | (F.abs(v) == float("inf")), None).otherwise(v)
    return F.to_json(F.struct(*[clean(n).alias(n) for n in names]), {"ignoreNullFields": "false"})


def peptide_count(seq, cut: str = "K", shortest: int = 7, longest: int = 30) -> Column:
    return F.size(F.filter(F.split(col(seq), cut), lambda p: F.length(p).between(shortest, longest)))


def exp2(v) -> Column:
    return F.pow(F.lit(2.0), col(v))


def log2_or_null(v) -> Column:
    return F.when(col(v) > 0, F.log2(col(v)))


# The formats of the parts of a raw image's file name (well, site, target, optional tag suffix), as documented.
_WELL = "[A-H][1-9][0-2]?"
_SITE = "[1-9][0-9]?"
_TARGET = "[a-zA-Z0-9]+"
_TAG = r"[\-|_][a-zA-Z]+"
TIFF_NAME = f"^({_WELL})_({_SITE})_({_TARGET})({_TAG})?.ome.tif$"
TIFF_NAME_TWO_WELLS = f"^({_WELL})_({_SITE})_Jin_({_WELL})_({_TARGET})({_TAG})?.ome.tif$"
PLATE_DIR = "^mNG96wp([0-9]{1,2})"


def tiff_parts(name) -> dict[str, Column]:
    c = col(name)
    one, two = c.rlike(TIFF_NAME), c.rlike(TIFF_NAME_TWO_WELLS)

    def pick(i, j):
        return (F.when(one, F.regexp_extract(c, TIFF_NAME, i))
                .when(two, F.regexp_extract(c, TIFF_NAME_TWO_WELLS, j)))
    return {"well_id": well_id(pick(1, 1)), "site_num": pick(2, 2).cast("int"), "target_name": pick(3, 4)}


def plate_dir_parts(d) -> dict[str, Column]:
    c = col(d)
    n = F.regexp_extract(c, PLATE_DIR, 1)
    return {"plate_num": F.when(n != "", n.cast("int")),
            "imaging_round_num": F.when(c.contains("Thawed2"), 3).when(c.contains("Thawed"), 2).otherwise(1)}
