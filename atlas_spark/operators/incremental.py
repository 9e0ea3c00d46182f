"""Processing of what has no result yet."""

from __future__ import annotations

import traceback
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..session import cut_lineage


def unprocessed(items: DataFrame, results: DataFrame, kind: str, key: str = "fov_id", force: bool = False) -> DataFrame:
    """Items without a result of the kind; all of them when forced."""
    return items if force else items.join(results.filter(F.col("kind") == kind), key, "left_anti")


def run_with_error_log(items: DataFrame, key: str, method: str, task: Callable[[dict], float]) -> tuple[DataFrame, DataFrame]:
    """Run a per-item task in Arrow batches; failures become rows (id, method, kind, message).

    The attempts are written to the checkpoint folder, so the task runs once although both results are read.
    """
    kind = dict(items.dtypes)[key]

    def work(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                try:
                    out.append((row[key], float(task(row)), None, None))
                except Exception as error:  # every failure of a user task is logged, none stops the batch
                    out.append((row[key], None, type(error).__name__, traceback.format_exception_only(error)[-1].strip()))
            yield pd.DataFrame(out, columns=[key, "value", "error_kind", "message"])

    attempts = items.mapInPandas(work, f"{key} {kind}, value double, error_kind string, message string")
    attempts = cut_lineage(attempts.withColumn("method", F.lit(method)))
    return attempts.filter("error_kind is null").select(key, "method", "value"), attempts.filter("error_kind is not null").select(key, "method", "error_kind", "message")
