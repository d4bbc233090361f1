"""Every registered query against its SQL twin on the smallest tables."""

import pytest

from tests.oracle import compare, connect
from workload import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(DATA)


def test_every_query_has_a_twin():
    assert set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    assert compare(spark, con, QUERIES[name], ORACLES[name], DATA) is None
