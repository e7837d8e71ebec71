"""Registered checks: a Spark query and, where SQL can say it, a DuckDB one."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from checks import fixtures

CHECKS: dict[str, Check] = {}
SHARED_SQL: dict[str, str] = {}


@dataclasses.dataclass(frozen=True)
class Check:
    key: str
    build: Callable
    sql: str | None


def check(key: str, sql: str | None = None):
    """Register ``f(tables) -> DataFrame`` under a key."""

    def register(function):
        if key in CHECKS:
            raise ValueError(f"{key} is registered twice")
        CHECKS[key] = Check(key, function, sql)
        return function

    return register


def portable(df: DataFrame) -> DataFrame:
    """Types that print alike in both engines: dates and lists as text."""

    def plain(field: T.StructField):
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.ArrayType):
            column = F.array_join(F.transform(column, lambda x: x.cast("string")), ",")
        elif isinstance(field.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType, T.NullType)):
            column = column.cast("string")
        elif isinstance(field.dataType, (T.DecimalType, T.FloatType)):
            column = column.cast("double")
        return column.alias(field.name)

    return df.select(*[plain(f) for f in df.schema])


class Inputs:
    """What a check gets: ``t[name]`` for tables and views, plus the session."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._tables = fixtures.tables(spark, folder)

    def __getitem__(self, name: str) -> DataFrame:
        return self._tables[name]

    def rules(self, *names: str) -> dict[str, DataFrame]:
        """Views under the names the rules know them by."""
        return {n: self[f"fx_{n}"] for n in names}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def runner(entry: Check):
        return lambda spark, folder: portable(entry.build(Inputs(spark, folder)))

    return {key: runner(entry) for key, entry in CHECKS.items()}


def oracle_sql() -> dict[str, str]:
    return {
        key: fixtures.with_views(entry.sql, SHARED_SQL)
        for key, entry in CHECKS.items()
        if entry.sql is not None
    }
