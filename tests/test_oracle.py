"""Every registered query against its comparison SQL, on the smallest tables."""

import oracle
import pytest

import __spark_entry__ as entry_point
from forecastops.catalog import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"
ROWS_ONLY = {"lr_coefficients"}


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF_DIR)


def test_every_query_has_sql_unless_sql_cannot_state_it():
    assert set(QUERIES) - set(ORACLES) == ROWS_ONLY
    assert set(ORACLES) <= set(QUERIES) <= set(entry_point.queries())


def test_flagship(spark):
    assert entry_point.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    assert oracle.differences(df, con, ORACLES[name]) == []


@pytest.mark.parametrize("name", sorted(ROWS_ONLY))
def test_rows_only(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0
