"""Every registered query against its SQL form."""

import pytest

from registry.catalogue import QUERIES
from registry.check import compare


@pytest.mark.parametrize("name", list(QUERIES))
def test_matches_sql(spark, duck, sf_dir, name):
    message, _, _ = compare(spark, duck, QUERIES[name], sf_dir)
    assert message is None, message


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    rows = e.entry(spark).collect()
    assert rows and max(r["rn"] for r in rows) <= 20
