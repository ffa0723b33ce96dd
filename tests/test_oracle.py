"""Every query with SQL gives the SQL's rows."""

from __future__ import annotations

import oracle
import pytest
from conftest import SMALL

import __spark_entry__ as entry_point


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SMALL)


@pytest.mark.parametrize("name", sorted(oracle.ORACLE))
def test_matches_sql(spark, con, name):
    assert oracle.compare(spark, con, name, SMALL) is None


def test_entry_point(spark):
    rows = entry_point.entry(spark).collect()
    assert len(rows) == 7
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
