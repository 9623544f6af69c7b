"""Every registered query on the small tables, against its SQL twin where it has one."""

import pytest

from ledgerveil.catalog import ORACLES, QUERIES
from tools.compare import compare, duck


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, sf, name):
    ok, note = compare(spark, con, name, sf)
    assert ok, note


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(QUERIES)
