"""Every registered query against its SQL on the smallest tables."""

import check
import pytest

from pastward.plans.registry import all_queries

FOLDER = "/root/testdata/sf0.001"
QUERIES = all_queries()


@pytest.fixture(scope="module")
def con():
    return check.connect(FOLDER)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql is not None])
def test_same_rows_as_sql(spark, con, name):
    result = check.compare(QUERIES[name].run(spark, FOLDER), con, QUERIES[name].sql)
    assert result.startswith("ok"), result


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql is None])
def test_runs(spark, name):
    assert QUERIES[name].run(spark, FOLDER).count() > 0


def test_contract():
    import __spark_entry__ as contract

    assert set(contract.oracle_sql()) <= set(contract.queries())
    assert contract.FLAGSHIP in contract.queries()
