"""Every query with SQL gives DuckDB's rows at the smallest scale; the others give rows of a stable schema."""

import pytest

import __spark_entry__ as entry
from codestrata.plans import catalogue
from tests.oracle import connect, difference

SF = "/root/testdata/sf0.001"
#: At this scale these have no row on either side; they are compared at the next one.
LARGER, MAY_BE_EMPTY = "/root/testdata/sf0.01", set()


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.fixture(scope="module")
def larger():
    return connect(LARGER)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_query(spark, con, larger, name):
    found = difference(catalogue.queries()[name](spark, SF), con, catalogue.oracle_sql()[name])
    if found == "no rows":
        found = difference(catalogue.queries()[name](spark, LARGER), larger, catalogue.oracle_sql()[name])
    assert not found or found == "no rows" and name in MAY_BE_EMPTY, found


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
