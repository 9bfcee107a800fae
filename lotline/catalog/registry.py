"""Registry of runnable queries with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lotline.catalog.views import with_views

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
_SQL: dict[str, tuple[tuple[str, ...], str]] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Doubles to six digits, all integers to bigint: the same form the SQL side returns."""
    columns = []
    for field in df.schema.fields:
        col = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            col = F.round(col.cast("double"), 6)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            col = col.cast("bigint")
        columns.append(col.alias(field.name))
    return df.select(*columns)


def query(name: str, sql: str | None = None, views: tuple[str, ...] = ()) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")

        def run(spark: SparkSession, root: str) -> DataFrame:
            return tidy(fn(spark, root))

        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            _SQL[name] = (views, sql)
        return fn

    return register


def oracles() -> dict[str, str]:
    """The SQL of every query that has one, with its views written out."""
    return {name: with_views(views, sql) for name, (views, sql) in _SQL.items()}
