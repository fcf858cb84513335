"""Every driver query beside its SQL at the smallest scale."""

import pytest

from __spark_entry__ import entry, oracle_sql, queries
from jobharbor.plans.queries import QUERIES
from tests.compare import connect, difference

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    return connect(SF)


def test_every_query_has_its_sql():
    assert set(QUERIES) <= set(oracle_sql()) <= set(queries())


@pytest.mark.parametrize("name", list(QUERIES))
def test_equal(spark, database, name):
    assert difference(spark, SF, database, queries()[name], oracle_sql()[name]) is None


def test_flagship(spark):
    assert entry(spark).count() > 0
