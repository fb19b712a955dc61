"""One registry from which ``queries()`` and ``oracle_sql()`` are built."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from procspark.session import tune

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None, doubles: list[str] = ()) -> Callable[[Query], Query]:
    """Register ``fn(spark, sf_dir)`` under ``name``, with its DuckDB text if SQL can say it.

    ``doubles`` names columns whose literals DuckDB would type as decimals.
    """

    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(tune(spark), sf_dir)

        run.__name__ = name
        QUERIES[name] = run
        if sql is not None:
            casts = ", ".join(f'CAST("{c}" AS DOUBLE) AS "{c}"' for c in doubles)
            ORACLES[name] = f"SELECT * REPLACE ({casts}) FROM (\n{sql}\n)" if doubles else sql
        return fn

    return add
