import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import pytest

from atlas_spark.fixtures import Tables
from atlas_spark.session import build_session

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    return build_session("local[8]", 8)


@pytest.fixture(scope="session")
def tables(spark):
    return Tables(spark, SF_DIR)
