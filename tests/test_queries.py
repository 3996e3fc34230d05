"""Every query with SQL against DuckDB on the smallest tables; the others run and keep a stable schema."""

from __future__ import annotations

from pathlib import Path

import pytest

from claimloom import catalog

from .compare import difference, duck

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="no input tables")


@pytest.fixture(scope="module")
def con():
    return duck(SMALL)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_agrees_with_sql(spark, con, name):
    assert difference(catalog.queries()[name](spark, SMALL), con, catalog.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(catalog.queries().keys() - catalog.oracle_sql().keys()))
def test_runs_without_sql(spark, name):
    frame = catalog.queries()[name](spark, SMALL)
    assert frame.columns and frame.count() >= 0


def test_every_oracle_has_a_query():
    assert catalog.oracle_sql().keys() <= catalog.queries().keys()
