"""Every named query against its SQL in DuckDB on the same files."""

import pytest

from opslens.plans import CHECKS, QUERIES
from opslens.plans.check import compare, duck


@pytest.fixture(scope="module")
def con(sf_dir):
    return duck(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    ok, text = compare(spark, con, sf_dir, QUERIES[name], CHECKS.get(name))
    assert ok is not False, text


def test_checks_name_queries():
    assert set(CHECKS) <= set(QUERIES)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
