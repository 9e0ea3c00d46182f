"""Constraint reports: what a relational store would refuse becomes rows of problems."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from .relational import unique_violations


def entity_problems(df: DataFrame, id_col: str, patterns: dict[str, tuple[str, str]] = {},
                    allowed: dict[str, tuple[str, list[str]]] = {}, unique: list[list[str]] = ()) -> DataFrame:
    """(problem, entity, n): values off their pattern or value list, and keys held by n rows."""
    rules = [(name, ~F.col(c).rlike(p)) for name, (c, p) in patterns.items()]
    rules += [(name, ~F.col(c).isin(values)) for name, (c, values) in allowed.items()]
    broken = F.filter(F.array(*[F.when(bad, F.lit(name)) for name, bad in rules]), lambda x: x.isNotNull())
    rows = df.select(F.explode(broken).alias("problem"), F.col(id_col).cast("string").alias("entity"), F.lit(1).cast("bigint").alias("n"))
    repeated = [unique_violations(df, keys).select(F.lit("duplicate " + ",".join(keys)).alias("problem"),
                                                   F.concat_ws(",", *keys).alias("entity"), "n") for keys in unique]
    return reduce(DataFrame.unionByName, repeated, rows)
