"""Every registered query agrees with its SQL on the smallest tables."""

import pytest

from cuemill.plans import all_queries
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(all_queries()))
def test_query(spark, con, name):
    ok, note = compare(spark, con, all_queries()[name], SF)
    assert ok, note
