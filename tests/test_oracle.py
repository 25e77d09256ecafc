"""Every registered query with SQL against DuckDB, over the smallest tables (or $ORACLE_SF_DIR)."""

from __future__ import annotations

import os

import pytest
from compare import differences

from chronoweave import catalog

SF = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, name):
    assert differences(spark, SF, catalog.queries()[name], catalog.oracle_sql()[name]) == ""


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
