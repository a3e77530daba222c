"""Registry of named queries and their DuckDB oracle SQL.

Each plan module registers `(name, spark_fn, oracle_sql)`; spark_fn takes
`(spark, sf_dir)` and returns a lazy DataFrame whose column names equal the
oracle's. Queries without an SQL equivalent register `sql=None`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # any session (not only ours) must see UTC and ship the package
            # to the executors before UDF-backed plans run
            from ..session import ship_package
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
            ship_package(spark)
            return fn(spark, sf_dir)

        run.__doc__ = fn.__doc__
        run.__name__ = getattr(fn, "__name__", name)
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every plan module so its queries register."""
    from . import (q_core, q_cleaning, q_signals, q_warning, q_alerts,  # noqa: F401
                   q_monitor, q_forecast, q_models, q_io, q_stream)
