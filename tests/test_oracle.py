"""Every query that SQL can express against DuckDB on the smallest tables."""

from __future__ import annotations

import os

import pytest
from compare import duck, same_rows

from tidemark.plans import catalogue

SF = os.environ.get("TEST_DATA", "/root/testdata") + "/sf0.001"
SLOW = {"detect_scene"}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_matches_sql(spark, con, name):
    here, there, only_here, only_there = same_rows(catalogue.queries()[name](spark, SF), con, catalogue.oracle_sql()[name])
    assert here == there
    assert (only_here[:3], only_there[:3]) == ([], [])


@pytest.mark.parametrize("name", sorted(set(catalogue.queries()) - set(catalogue.oracle_sql()) - SLOW))
def test_runs_without_sql(spark, name):
    assert catalogue.queries()[name](spark, SF).count() > 0
