"""Every registered query with SQL beside it agrees with DuckDB."""

import compare
import pytest

from gleanbox.plans import queries, stateful  # noqa: F401
from gleanbox.plans.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return compare.connection(SF)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, con, name):
    assert compare.differences(QUERIES[name](spark, SF), con, ORACLES[name]) == ""


def test_entry_has_every_query(spark):
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1
