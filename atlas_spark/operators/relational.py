"""Joins, set operations, ranked choices and roll-ups that several parts of the atlas share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import cols as C
from .ranking import best_row, text_ranks


#: Length of the substrings that stand for a longer needle.
FEW_KEYS = 100_000
TASK_ROWS = 200_000
GRAM = 3


def _grams(column: str, size: int) -> Column:
    """Distinct substrings of one length of a text."""
    n = F.length(column)
    at = F.when(n >= size, F.sequence(F.lit(1), n - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substr(F.col(column), i, F.lit(size))))


def contains_join(texts: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """Rows of ``texts`` joined with every needle their text contains; NULL and empty needles are in no text.

    A needle of GRAM characters or more is looked up by the one of its substrings of that length that the fewest texts have,
    and then compared in full; a shorter one is looked up by itself.  A text lists its distinct substrings of up to GRAM
    characters, so the rows stay linear in its length.
    """
    held = texts.select(F.col(text).alias("_t")).filter(F.length("_t") > 0).distinct()
    asked = needles.select(F.col(needle).alias("_needle")).filter(F.length("_needle") > 0).distinct()
    listed = held.select("_t", F.explode(F.concat(*[_grams("_t", k) for k in range(1, GRAM + 1)])).alias("_g"))
    freq = listed.filter(F.length("_g") == GRAM).groupBy("_g").agg(F.count("*").alias("_f"))
    parts = asked.filter(F.length("_needle") >= GRAM).select("_needle", F.explode(_grams("_needle", GRAM)).alias("_g"))
    # a substring that no text has rules its needle out
    rarest = parts.join(freq, "_g", "left").groupBy("_needle").agg(F.min(F.struct(F.coalesce("_f", F.lit(0)).alias("_f"), "_g")).alias("_r"))
    keyed = rarest.filter("_r._f > 0").select("_needle", F.col("_r._g").alias("_g"))
    keyed = keyed.unionByName(asked.filter(F.length("_needle") < GRAM).select("_needle", F.col("_needle").alias("_g")))
    # a text's substrings are many rows of few bytes: they stream past the needles and are not sorted
    found = listed.join(few_keys(keyed), "_g").filter(F.contains("_t", "_needle")).select(F.col("_t").alias(text), F.col("_needle").alias(needle))
    return texts.join(found, text)


def few_keys(keys: DataFrame) -> DataFrame:
    """The keys that choose rows of a large table: counted, and broadcast up to FEW_KEYS of them, so that the table is not shuffled
    for them; more are held in hash tables, so that it is not sorted."""
    from ..session import cut_lineage
    keys = cut_lineage(keys)
    return F.broadcast(keys) if keys.count() <= FEW_KEYS else keys.hint("shuffle_hash")


def distinct_rows(df: DataFrame, task_rows: int = TASK_ROWS) -> DataFrame:
    """The distinct rows of narrow columns, counted and dealt about ``task_rows`` to a task: they compress to little, so that adaptive
    execution would hold millions of them in one."""
    parts = -(-df.count() // task_rows)
    return df.repartition(max(parts, 1), *df.columns).distinct()


def member_join(rows: DataFrame, names: str, genes: DataFrame, gene: str, sep: str = ";") -> DataFrame:
    """Rows whose separated name list holds the gene; each (row, gene) once."""
    return rows.withColumn(gene, F.explode(F.array_distinct(F.split(names, sep)))).join(genes, gene)


def fallback_join(left: DataFrame, keys: list[str], candidates: list[DataFrame], value: str) -> DataFrame:
    """Try the candidate lookups in order; the first that knows the key supplies ``value`` (its smallest)."""
    out, names = left, []
    for i, c in enumerate(candidates):
        name = f"_v{i}"
        out = out.join(c.groupBy(*keys).agg(F.min(value).alias(name)), keys, "left")
        names.append(name)
    return out.withColumn(value, F.coalesce(*names)).drop(*names)


def overlap_pairs(sets: DataFrame, key: str, items: str, wanted: DataFrame, wanted_key: str, wanted_items: str) -> DataFrame:
    """(key, wanted_key) whose item arrays share a member."""
    a = sets.select(key, F.explode(items).alias("_i"))
    b = wanted.select(wanted_key, F.explode(wanted_items).alias("_i"))
    return a.join(b, "_i").select(key, wanted_key).distinct()


def lineage_root(lines: DataFrame, id_col: str = "line_id", parent: str = "parent_id", max_rounds: int = 40) -> DataFrame:
    """Root of every line by pointer doubling: a chain of length n is followed in log2(n) joins."""
    from ..session import cut_lineage
    cur = lines.select(id_col, F.coalesce(parent, id_col).alias("root"))
    for _ in range(max_rounds):
        up = cur.select(F.col(id_col).alias("root"), F.col("root").alias("_next"))
        nxt = cut_lineage(cur.join(up, "root", "left").select(id_col, F.coalesce("_next", "root").alias("_n"), F.col("root").alias("_r")))
        moved = not nxt.filter("_n <> _r").isEmpty()
        cur = nxt.select(id_col, F.col("_n").alias("root"))
        if not moved:
            return cur
    raise RuntimeError(f"roots not settled after {max_rounds} rounds: the parents form a cycle")


def numbered_labels(df: DataFrame, key: str, labels: str, count: int, prefix: str = "label_") -> DataFrame:
    """The i-th sorted label as its own column."""
    arr = F.array_sort(labels)
    return df.select(key, *[F.get(arr, F.lit(i)).alias(f"{prefix}{i}") for i in range(count)])


def unique_violations(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def duplicate_max_ties(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Every row that reaches its group's maximum, once."""
    top = df.groupBy(*keys).agg(F.max(value).alias(value))
    return df.join(top, [*keys, value], "left_semi").distinct()


def top_n(df: DataFrame, keys: list[str], order: list[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n rows per group; each task keeps n per group before the shuffle."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= n)


def rolling_sum(df: DataFrame, day: str, days: int = 7, amount: Column | None = None) -> DataFrame:
    """Trailing sum over calendar days.  Rows are summed per day first, and a day's total is sent to
    the days it counts for, so no window over the whole table is needed."""
    daily = df.groupBy(F.to_date(day).alias("day")).agg((F.sum(amount) if amount is not None else F.count("*")).alias("n"))
    spread = daily.select(F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("k"), "day", "n") \
                  .select(F.date_add("day", F.col("k")).alias("day"), "n")
    sums = spread.groupBy("day").agg(F.sum("n").alias(f"n_{days}d"))
    return daily.join(sums, "day")


def block_numbers(df: DataFrame, name: str, size: int) -> DataFrame:
    """Distinct names in order, cut into blocks of ``size``."""
    return text_ranks(df.select(name).distinct(), name, out="_r").select(name, F.floor((F.col("_r") - 1) / size).cast("bigint").alias("block"))


def plate_layout(wells_df: DataFrame, spark) -> DataFrame:
    """8 x 12 frame of every plate with the first record of each padded well."""
    frame = spark.range(96).select(
        F.substring(F.lit(C.PLATE_ROWS), (F.col("id") / 12).cast("int") + 1, F.lit(1)).alias("row"),
        C.zero_pad(F.col("id") % 12 + 1, 2).alias("column"))
    slots = frame.agg(F.collect_list(F.struct("row", "column")).alias("_s"))
    plates = wells_df.select("plate_id").distinct().join(F.broadcast(slots), F.lit(True)).select("plate_id", F.explode("_s").alias("_s")) \
        .select("plate_id", "_s.row", "_s.column").withColumn("well_id", F.concat("row", "column"))
    first = best_row(wells_df, ["plate_id", "well_id"], [F.col("design_id")], ["target_name"])
    return plates.join(first, ["plate_id", "well_id"], "left").select("plate_id", "row", "column", "target_name")
