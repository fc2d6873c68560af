"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry_point
from recfuse.registry.load import QUERIES
from tests.oracle import compare, connect

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = connect(SF_DIR)
    yield c
    c.close()


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, con, name):
    ok, note, _ = compare(spark, con, SF_DIR, QUERIES[name])
    assert ok, note


def test_entry(spark):
    assert entry_point.entry(spark).count() == 200
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
