"""Every query against its SQL twin on the stored tables."""

import pytest
from compare import database, difference

from pathloom.catalog import QUERIES
from pathloom.oracles import ORACLES

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def other():
    return database(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, other, name):
    assert difference(QUERIES[name](spark, FOLDER), other, ORACLES[name]) is None


def test_each_operator_has_a_query():
    assert set(ORACLES) == set(QUERIES)
