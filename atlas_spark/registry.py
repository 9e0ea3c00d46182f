"""Registry of named queries and the SQL each one is checked against."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from .fixtures import Tables, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

PLAN_MODULES = ("scalars", "sources", "quant", "relational", "scoring", "network", "stoich", "entities", "incremental", "cyto", "image", "ml",
                )


def query(key: str, oracle: str | None = None):
    """Register ``fn(tables) -> DataFrame`` under ``key``; ``oracle`` may use the fixture views."""
    def wrap(fn):
        QUERIES[key] = lambda spark, sf_dir: fn(Tables(spark, sf_dir))
        if oracle is not None:
            ORACLES[key] = with_views(oracle)
        return fn
    return wrap


def load() -> None:
    for name in PLAN_MODULES:
        import_module(f"{__package__}.plans.{name}")
