"""Registered queries against their SQL."""

from __future__ import annotations

import os

import pytest

from tests.oracle import connect, rows_of, rows_of_sql
from tickloom.llm import queries as Q

ROOT = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(Q.oracle_sql()))
def test_same_rows(spark, name):
    names, rows = rows_of(Q.queries()[name](spark, ROOT))
    want_names, want = rows_of_sql(connect(ROOT), Q.oracle_sql()[name])
    assert names == want_names and rows == want
