"""Every query of the library's own operators against its SQL."""

import pytest

from ridgeline.plans import registry
from tests.compare import SMALL, assert_same, database


@pytest.fixture(scope="module")
def con():
    return database()


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query(spark, con, name):
    assert_same(registry.QUERIES[name](spark, SMALL), con, registry.SQL[name])


@pytest.mark.parametrize("name", sorted(registry.QUERIES.keys() - registry.SQL.keys()))
def test_rows_only(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() >= 0


def test_entry_point():
    import __spark_entry__ as entry

    assert registry.QUERIES.keys() <= entry.queries().keys()
    assert entry.oracle_sql().keys() <= entry.queries().keys()
