"""Every registered query that SQL can express, against DuckDB on the same tables."""

import pytest
from helpers import duck_rows, rows_of

import granary.plans.store_queries  # noqa: F401
import granary.plans.table_queries  # noqa: F401
from granary.plans.registry import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(name, spark, sf, duck):
    assert rows_of(QUERIES[name](spark, sf)) == duck_rows(duck, ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark, sf):
    assert QUERIES[name](spark, sf).count() > 0
