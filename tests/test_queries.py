"""Every registered query of the plans against its oracle."""

from __future__ import annotations

import pytest
from conftest import DATA, same_rows

from dealmill.plans import QUERIES, SQL


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_oracle(spark, duck, name):
    same_rows(QUERIES[name](spark, DATA), duck.execute(SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_runs(spark, name):
    assert QUERIES[name](spark, DATA).count() >= 0


def test_entry_is_complete(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0
