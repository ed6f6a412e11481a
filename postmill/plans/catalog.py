"""Registry of named queries and their SQL twins."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from postmill.session import PLANNING

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, Callable[[], str]] = {}


def query(name: str, oracle: Callable[[], str] | None = None):
    """Register ``fn(spark, sf_dir)``; it plans with the settings of ``session`` in any session."""

    def wrap(fn):
        @functools.wraps(fn)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            for name, value in PLANNING.items():
                spark.conf.set(name, value)
            return fn(spark, sf_dir)

        QUERIES[name] = run
        if oracle:
            ORACLE[name] = oracle
        return run

    return wrap


def oracle_sql() -> dict[str, str]:
    return {name: build() for name, build in ORACLE.items()}
