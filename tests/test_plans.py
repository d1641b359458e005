"""Every analytics query against its SQL in DuckDB, or for its rows where it has none."""

import pytest

import __spark_entry__ as entry
from terralith.plans import audits, extras, grids, places, surfaces, tables

from .compare import differences, duck

PLANS = tables.PLANS | places.PLANS | grids.PLANS | audits.PLANS | extras.PLANS | surfaces.PLANS


@pytest.fixture(scope="module")
def con(sf):
    return duck(sf)


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in PLANS.items() if sql))
def test_equals_its_sql(spark, sf, con, name):
    assert differences(PLANS[name][0](spark, sf), con, PLANS[name][1]) == ""


@pytest.mark.parametrize("name", sorted(n for n, (_, sql) in PLANS.items() if not sql))
def test_gives_rows(spark, sf, name):
    assert PLANS[name][0](spark, sf).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert entry.oracle_sql().keys() <= entry.queries().keys()
