"""Every registered query against its SQL, on the smallest tables."""

import pytest

import __spark_entry__ as entry
from tests import oracle

QUERIES, CHECKS = entry.queries(), entry.oracle_sql()

# a report over the last day, which has no group of the needed size in the smallest tables
MAY_BE_EMPTY = {"a6_category_performance"}


@pytest.fixture(scope="module")
def con(sf):
    return oracle.connect(sf)


def test_every_check_has_its_query():
    assert set(CHECKS) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, sf, con):
    if name in CHECKS:
        problem = oracle.compare(spark, con, sf, QUERIES[name], CHECKS[name])
        assert problem is None or (problem == "EMPTY" and name in MAY_BE_EMPTY), problem
    else:
        assert QUERIES[name](spark, sf).count() > 0


def test_entry_runs(spark):
    assert entry.entry(spark).count() > 0
