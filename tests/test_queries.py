"""Every registered query against its SQL twin, and its plan against quadratic joins."""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import compare, connect

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF_DIR)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query_matches_its_twin(spark, con, name):
    verdict, rows, _ = compare(spark, con, SF_DIR, name)
    assert verdict in ("ok", "rows-only"), verdict


def test_twins_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_has_rows(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "crop_name" and df.count() > 0
