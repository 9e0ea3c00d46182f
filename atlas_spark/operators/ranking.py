"""Exact ranks, running sums and quantiles inside groups of any size.

A window over a whole group sorts that group in one task.  Groups of up to ``hot_rows`` rows are
handled that way; larger ones are first cut into value ranges at their own approximate quantiles,
each range is sorted on its own and shifted by the size of the ranges before it.  The cut points
steer only the split of the work: ranks and quantiles are exact whatever they are.  Which groups
are large is found in the plan itself, and adaptive execution drops the second branch when none is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..session import cut_lineage

HOT_ROWS = 500_000
PIECES = 256
_GRID = "array(" + ", ".join(f"{i / PIECES}D" for i in range(1, PIECES)) + ")"
_ALL = "_all"


def split_hot(df: DataFrame, keys: list[str], hot_rows: int = HOT_ROWS) -> tuple[DataFrame, DataFrame]:
    """(rows of small groups, rows of large groups); there are at most rows / hot_rows large groups."""
    hot = df.groupBy(*keys).agg(F.count("*").alias("_n_rows")).filter(F.col("_n_rows") > hot_rows).select(*keys)
    match = [df[k].eqNullSafe(hot[k]) for k in keys]
    cond = match[0]
    for m in match[1:]:
        cond = cond & m
    return df.join(hot, cond, "left_anti"), df.join(hot, cond, "left_semi")


def _join_on(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join by keys of which NULLs are equal."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(r, cond).drop(*[f"_r_{k}" for k in keys])


def _pieces(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """df with ``_piece``: the number of the row's value range inside its group."""
    v = F.col(value).cast("double")
    cuts = df.groupBy(*keys).agg(F.array_distinct(F.percentile_approx(v, F.expr(_GRID), F.lit(2000))).alias("_cuts"))
    # the number of cuts below a value is found in two steps of 16, not by comparing with all of them
    cuts = cuts.withColumn("_coarse", F.filter("_cuts", lambda _, i: (i + 1) % 16 == 0))
    j = _join_on(df, cuts, keys).withColumn("_cut_at", 16 * F.size(F.filter("_coarse", lambda c: c < v)))
    fine = F.size(F.filter(F.slice("_cuts", F.col("_cut_at") + 1, F.lit(15)), lambda c: c < v))
    return j.withColumn("_piece", F.col("_cut_at") + fine).drop("_cuts", "_coarse", "_cut_at")


def _offsets(df: DataFrame, keys: list[str], amount: Column, out: str = "_before") -> DataFrame:
    """Sum of ``amount`` over the lower pieces of the group; at most PIECES rows per group."""
    per = df.groupBy(*keys, "_piece").agg(F.sum(amount).alias("_in_piece"))
    w = W.partitionBy(*keys).orderBy("_piece").rowsBetween(W.unboundedPreceding, -1)
    return per.withColumn(out, F.coalesce(F.sum("_in_piece").over(w), F.lit(0)))


def _with_keys(df: DataFrame, keys: list[str]) -> tuple[DataFrame, list[str]]:
    return (df, list(keys)) if keys else (df.withColumn(_ALL, F.lit(0)), [_ALL])


def grouped_ranks(df: DataFrame, keys: list[str], value: str, ties: list[str] = (), out: str = "rank",
                  hot_rows: int = HOT_ROWS) -> DataFrame:
    """row_number by (value, ties) inside each group, counted from 1; value must be numeric and not null."""
    d, ks = _with_keys(df, keys)
    cold, hot = split_hot(d, ks, hot_rows)
    small = cold.withColumn(out, F.row_number().over(W.partitionBy(*ks).orderBy(value, *ties)).cast("bigint"))
    p = _pieces(hot, ks, value)
    off = _offsets(p, ks, F.lit(1)).drop("_in_piece")
    rn = F.row_number().over(W.partitionBy(*ks, "_piece").orderBy(value, *ties))
    large = (p.withColumn("_rn", rn).transform(_join_on, off, [*ks, "_piece"])
             .withColumn(out, (F.col("_rn") + F.col("_before")).cast("bigint")))
    cols = [*df.columns, out]
    return small.select(*cols).unionByName(large.select(*cols))


def running_sum(df: DataFrame, keys: list[str], order: str, amount: str, out: str = "running",
                hot_rows: int = HOT_ROWS) -> DataFrame:
    """Sum of ``amount`` up to and including the row, by a numeric order that is unique in the group."""
    d, ks = _with_keys(df, keys)
    cold, hot = split_hot(d, ks, hot_rows)

    def upto(*part):
        return F.sum(amount).over(W.partitionBy(*part).orderBy(order).rowsBetween(W.unboundedPreceding, 0))
    small = cold.withColumn(out, upto(*ks))
    p = _pieces(hot, ks, order)
    off = _offsets(p, ks, F.col(amount)).drop("_in_piece")
    large = p.withColumn("_rs", upto(*ks, "_piece")).transform(_join_on, off, [*ks, "_piece"]).withColumn(out, F.col("_rs") + F.col("_before"))
    cols = [*df.columns, out]
    return small.select(*cols).unionByName(large.select(*cols))


def grouped_quantiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                      hot_rows: int = HOT_ROWS) -> DataFrame:
    """Exact linearly interpolated quantiles per group (NULLs skipped), one column per name in ``probs``.

    Equal values are counted before any group is formed, so a group's size here is its number of
    distinct values.  In a large group only the value ranges that hold a wanted rank are sorted.
    """
    d, ks = _with_keys(df, keys)
    v = d.filter(F.col(value).isNotNull()).groupBy(*ks, F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_c"))
    cold, hot = split_hot(v, ks, hot_rows)
    small = cold.groupBy(*ks).agg(*[F.percentile("_v", F.lit(q), F.col("_c")).alias(n) for n, q in probs.items()])

    p = _pieces(hot, ks, "_v")
    off = _offsets(p, ks, F.col("_c")).withColumn("_n", F.sum("_in_piece").over(W.partitionBy(*ks)))
    pos = {n: F.lit(q) * (F.col("_n") - 1) for n, q in probs.items()}
    needed = F.lit(False)
    for x in pos.values():
        for r in (F.floor(x), F.ceil(x)):
            needed = needed | ((F.col("_before") <= r) & (F.col("_before") + F.col("_in_piece") > r))
    rows = _join_on(p, off.filter(needed), [*ks, "_piece"])
    cum = F.sum("_c").over(W.partitionBy(*ks, "_piece").orderBy("_v").rowsBetween(W.unboundedPreceding, 0))
    rows = rows.withColumn("_cum", cum + F.col("_before"))
    aggs = [F.max("_n").alias("_n")]
    for n, x in pos.items():
        aggs += [F.min(F.when(F.col("_cum") > F.floor(x), F.col("_v"))).alias(f"_lo_{n}"),
                 F.min(F.when(F.col("_cum") > F.ceil(x), F.col("_v"))).alias(f"_hi_{n}")]
    outs = [(F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * (x - F.floor(x))).alias(n) for n, x in pos.items()]
    large = rows.groupBy(*ks).agg(*aggs).select(*ks, *outs)
    return small.unionByName(large).select(*keys, *probs)


def global_row_number(df: DataFrame, value: str, out: str = "rank", hot_rows: int = HOT_ROWS) -> DataFrame:
    """row_number over the whole table by a unique numeric column, without a single-task sort of large tables."""
    return grouped_ranks(df, [], value, out=out, hot_rows=hot_rows)


def text_ranks(df: DataFrame, column: str, out: str = "rank") -> DataFrame:
    """row_number over the whole table by a column of distinct, non-null texts.

    Spark cuts the table at whole texts that it samples, so names with a long common start fall into many pieces as well; each
    piece is sorted on its own and shifted by the rows before it.  The pieces are checkpointed, as a sample taken again could
    cut elsewhere.
    """
    pieces = cut_lineage(df.repartitionByRange(column).withColumn("_piece", F.spark_partition_id()))
    off = _offsets(pieces.withColumn(_ALL, F.lit(0)), [_ALL], F.lit(1)).select("_piece", "_before")  # one row per partition
    rn = F.row_number().over(W.partitionBy("_piece").orderBy(column))
    return pieces.join(F.broadcast(off), "_piece").withColumn(out, (rn + F.col("_before")).cast("bigint")).select(*df.columns, out)


def best_row(df: DataFrame, keys: list[str], order: list[Column], columns: list[str], largest: bool = False) -> DataFrame:
    """First (or last) row per group by ``order``, as an aggregate that combines before the shuffle."""
    pick = F.max if largest else F.min
    s = F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(order)], *[F.col(c) for c in columns])
    return df.groupBy(*keys).agg(pick(s).alias("_s")).select(*keys, *[F.col(f"_s.{c}").alias(c) for c in columns])
