"""Every image query against its SQL, on the smallest tables."""

import pytest
from conftest import compare

from tessella.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, sf_dir, name):
    compare(QUERIES[name](spark, sf_dir), ORACLES[name], sf_dir)


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
