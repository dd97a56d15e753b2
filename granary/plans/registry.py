"""Registered queries: a Spark function of (spark, sf_dir) and, where SQL can say the same, its DuckDB statement."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .fixtures import FIXTURES, fixture, table, with_fixtures

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, *relations: str, oracle: str | None = None):
    """Registers ``f(*relations)``: each is a table or fixture of that name, read whole."""

    def register(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(*((fixture if r in FIXTURES else table)(spark, sf_dir, r) for r in relations))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = with_fixtures(oracle, *(r for r in relations if r in FIXTURES))
        return f

    return register
