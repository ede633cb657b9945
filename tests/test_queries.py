"""Every query of the engine against its SQL."""

import pytest

from pagewright.plans.queries import ORACLES, QUERIES
from tests.compare import same_rows, tables

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    return tables(SF)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_sql(spark, db, name):
    assert same_rows(QUERIES[name](spark, SF), db, ORACLES[name]) > 0
