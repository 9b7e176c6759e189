"""Every registered query against its oracle statement on the smallest dataset."""

import os

import pytest

from rankwell.plans import ORACLES, QUERIES
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")
BRUTE_FORCE = {"experience_entries", "chunk_recursive", "years_near_alias"}


@pytest.fixture(scope="module")
def con():
    return connect(SF)


def test_every_query_has_an_oracle_or_a_brute_force_test():
    assert set(QUERIES) - set(ORACLES) == BRUTE_FORCE


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    result = compare(spark, con, SF, name, QUERIES[name], ORACLES.get(name))
    assert result.startswith(("ok", "ROWS")), result
