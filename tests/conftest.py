import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    from registry.check import session

    s = session("8")
    s.conf.set("spark.sql.shuffle.partitions", "4")
    yield s
    s.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def duck(sf_dir):
    from registry.check import connect

    return connect(sf_dir)


@pytest.fixture()
def small_limits(spark):
    """Limits so low that most sessions and buckets are split."""
    from sessionrank.settings import CELL_ITEMS_KEY, HOT_ROWS_KEY

    spark.conf.set(HOT_ROWS_KEY, "6")
    spark.conf.set(CELL_ITEMS_KEY, "2")
    yield
    spark.conf.unset(HOT_ROWS_KEY)
    spark.conf.unset(CELL_ITEMS_KEY)
