"""Join helpers."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, functions as F

def without(df: DataFrame, other: DataFrame, on: str | list[str]) -> DataFrame:
    """Rows of ``df`` with no partner: what a left join plus IS NULL is used for.

    The two differ only where the tested right column itself can be NULL; filter
    such rows out of ``other`` first if they should not count as a match.  Repeated
    keys of ``other`` are combined before they are shuffled.
    """
    keys = [on] if isinstance(on, str) else on
    return df.join(other.select(*keys).distinct(), keys, "left_anti")


def lookup_join(df: DataFrame, lookup: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Equi-join that keeps the columns of ``df`` in their order.

    ``lookup`` should be unique by key.  Spark broadcasts it while it measures it
    small; else it sorts and merges, and splits the partitions of hot keys.
    """
    extra = [] if how in ("left_semi", "left_anti") else [c for c in lookup.columns if c not in on]
    return df.join(lookup, on, how).select(*df.columns, *extra)


def in_any_list(
    df: DataFrame, key: str, lists: Mapping[str, tuple[DataFrame, str]]
) -> DataFrame:
    """Rows whose key is in at least one list, one label column per list.

    ``lists`` maps the output column to ``(list, label column)``.  The lists are
    merged into one lookup with the smallest label per key and list, so there is a
    single join and rows are never multiplied.
    """
    merged = None
    for name, (frame, label) in lists.items():
        own = {n: F.col(label) if n == name else F.lit(None) for n in lists}
        part = frame.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(
            key, *[c.cast("string").alias(n) for n, c in own.items()]
        )
        merged = part if merged is None else merged.unionByName(part)
    lookup = merged.groupBy(key).agg(*[F.min(n).alias(n) for n in lists])
    return df.join(lookup, key)
