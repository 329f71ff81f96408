"""Every registered query against its SQL twin, over the smallest tables."""

import os

import pytest
from compare_sql import difference, duck

from skirmish.plans import catalog, oracle

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not there")


@pytest.fixture(scope="module")
def db():
    return duck(SF)


@pytest.mark.parametrize("name", list(catalog.queries()))
def test_query_matches_sql(spark, db, name):
    assert difference(spark, db, name, SF) is None


def test_every_query_has_a_twin():
    assert set(oracle.sql_twins()) == set(catalog.queries())
