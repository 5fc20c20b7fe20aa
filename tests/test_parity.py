"""Every registered query against its SQL in DuckDB, on the smallest driver tables."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

import __spark_entry__ as entry
from tools.parity import connect, duck_rows, spark_rows
from workloads import oracle, queries

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="driver tables are absent")


@pytest.fixture(scope="module")
def duck():
    with connect(SF_DIR) as con:
        yield con


def test_every_query_has_sql():
    assert set(queries.REGISTRY) == set(oracle.statements())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    ours = spark_rows(entry.queries()[name](spark, SF_DIR))
    assert ours == duck_rows(duck, entry.oracle_sql()[name])
