"""Every registered query against its SQL on the smallest tables."""

import pytest

from corpusgauge.registry import all_queries
from tests.compare import compare, connect
from tests.conftest import SMALL

QUERIES = all_queries()


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    rows, problem = compare(spark, con, SMALL, QUERIES[name])
    assert problem is None, problem
    assert rows >= 0


def test_entry_contract():
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.FLAGSHIP in contract.queries()
