"""Every registered query with SQL equals that SQL; the slow, iterative ones are left to the property tests."""

import os
import re

import pytest

import __spark_entry__ as entry
from check import compare, connect
from conftest import SF_DIR

SQL = entry.oracle_sql()
KEYS = sorted(k for k in SQL if not re.match(r"op\d+_|pipeline", k))  # those of the corpus subpackage are tested beside it
EVERY = int(os.environ.get("TEST_EVERY", "1"))  # 4 takes every fourth


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("key", KEYS[::EVERY])
def test_query(spark, con, key):
    message, same = compare(spark, con, SF_DIR, entry.queries()[key], SQL[key])
    assert same, message


def test_entry(spark):
    df = entry.entry(spark)
    assert {"prey", "bait", "pvals", "enrichment", "hits"} <= set(df.columns) and df.count() > 0


def test_registry_is_consistent():
    assert set(SQL) <= set(entry.queries())
