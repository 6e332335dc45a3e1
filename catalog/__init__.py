"""Every operator as a query over the benchmark tables, with the SQL that states the expected result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from dqloom.plans.testbed import Tables
from dqloom.session import with_task_sizes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; the function gets the benchmark tables by name."""

    def register(build: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} exists")
        QUERIES[name] = lambda spark, folder: build(Tables(with_task_sizes(spark), folder))
        if sql is not None:
            ORACLES[name] = sql
        return build

    return register


def load() -> None:
    from catalog import checks, dispatching, experiments, ledgers, payloads, star, suites, violations  # noqa: F401
