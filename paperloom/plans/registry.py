"""Where queries register themselves, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, wide: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    """Register a query; the columns `wide` are whole numbers that the SQL gives as BIGINT."""

    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(spark, sf_dir).withColumns({c: F.col(c).cast("bigint") for c in wide})

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run if wide else f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add
