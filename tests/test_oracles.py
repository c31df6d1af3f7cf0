"""Every registered query of the library with SQL gives the rows of that SQL."""

from __future__ import annotations

import os

import pytest

from tests.oracle import connect, rows_of, rows_of_sql
from tickloom.plans import backtest, features, indicators, learning, market, records  # noqa: F401
from tickloom.plans.registry import ORACLES, QUERIES

ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(ROOT)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(spark, con, name):
    names, rows = rows_of(QUERIES[name](spark, ROOT))
    want_names, want = rows_of_sql(con, ORACLES[name])
    assert names == want_names
    assert rows == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, ROOT).count() >= 0
