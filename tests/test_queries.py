"""Every registered query against its SQL on DuckDB, at the smallest scale."""

import pytest
from compare import TESTDATA, difference, duck

from __spark_entry__ import entry, oracle_sql, queries
from cashlens.plans.queries import REGISTRY

SF = f"{TESTDATA}/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


def test_every_query_has_sql():
    assert set(REGISTRY) <= set(oracle_sql()) & set(queries())


@pytest.mark.parametrize("name", sorted(REGISTRY))
def test_query_equals_sql(spark, con, name):
    assert difference(spark, con, SF, name) is None


def test_entry(spark):
    assert entry(spark).count() > 0
