"""Every registered query against its SQL statement."""

import catalog
import oracle
import pytest
from conftest import SMALL

catalog.load()


@pytest.fixture(scope="module")
def connection():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_agrees_with_sql(spark, connection, name):
    frame = catalog.QUERIES[name](spark, SMALL)
    if name in catalog.ORACLES:
        assert oracle.differences(frame, catalog.ORACLES[name], connection) == []
    else:
        assert frame.count() >= 0


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 19
