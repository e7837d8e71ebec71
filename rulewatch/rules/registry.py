"""Rules as functions from tables and a date to findings."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession


@dataclasses.dataclass(frozen=True)
class Rule:
    name: str
    reads: tuple[str, ...]
    findings: Callable[..., DataFrame]


RULES: dict[str, Rule] = {}


def rule(name: str, reads: tuple[str, ...]):
    """Register ``f(tables, as_of, **params) -> DataFrame`` under a name."""

    def register(function):
        if name in RULES:
            raise ValueError(f"rule {name} is registered twice")
        RULES[name] = Rule(name, reads, function)
        return function

    return register


def build(name: str, tables: Mapping[str, DataFrame], as_of, **params) -> DataFrame:
    """The findings of a rule; an unknown name or a non-DataFrame result is an error."""
    if name not in RULES:
        raise KeyError(f"no rule named {name}")
    result = RULES[name].findings(tables, as_of, **params)
    if not isinstance(result, DataFrame):
        raise TypeError(f"rule {name} returned {type(result).__name__}, not a DataFrame")
    return result


def sql_rule(
    spark: SparkSession, text: str, tables: Mapping[str, DataFrame], args: dict | None = None
) -> DataFrame:
    """A rule written as one SELECT; ``{name}`` stands for a table, ``:name`` for a value."""
    return spark.sql(text, args=args or {}, **tables)
