"""Grouping operators that hold up when one group has a large share of the rows.

Picks of one row per key are aggregates, which combine before the shuffle, not
windows over whole groups.  Values of a key are counted; the values themselves are
rows of a result of their own, however many there are.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame, Row, Window, functions as F


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key by ``order`` (which should be unique within a key)."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest])
        .select(*df.columns)
    )


def first_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row per key by ``order``."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
        .select(*keys, *[F.col(f"_row.`{c}`").alias(c) for c in rest])
        .select(*df.columns)
    )


def count_values(
    df: DataFrame, keys: list[str], value: str, name: str, having: Column | None = None
) -> DataFrame:
    """One row per key with the number of its distinct values; NULL is no value.

    ``having`` is an aggregate over a key's distinct values that must be true for
    the key to stay.
    """
    counts = df.select(*keys, value).distinct().groupBy(*keys)
    keep = F.lit(True) if having is None else having
    return counts.agg(F.count(value).alias(name), keep.alias("_keep")).where("_keep").drop("_keep")


def values_of(df: DataFrame, found: DataFrame, keys: list[str], value: str) -> DataFrame:
    """The distinct values of the keys of ``found``, one row each."""
    return df.select(*keys, value).where(F.col(value).isNotNull()).distinct().join(found.select(*keys).distinct(), keys, "left_semi")


def top_groups(
    df: DataFrame, key: str, measure: Column, n: int, name: str = "cnt"
) -> DataFrame:
    """The ``n`` groups with the largest measure; ties go to the smaller key."""
    return (
        df.groupBy(key)
        .agg(measure.alias(name))
        .orderBy(F.desc_nulls_last(name), F.asc_nulls_first(key))
        .limit(n)
    )


def recent_per_key(df: DataFrame, key: str, order: list[str], n: int) -> DataFrame:
    """The ``n`` last rows per key, numbered from the newest.

    ``n`` must stay under Spark's window-group-limit threshold (1,000): then each
    task keeps only ``n`` rows per key before the shuffle, however large the key.
    """
    newest_first = Window.partitionBy(key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("rn", F.row_number().over(newest_first)).where(F.col("rn") <= n)


def trend(df: DataFrame, key: str, order: list[str], fields: dict[str, Column], n: int = 14) -> DataFrame:
    """The ``n`` last runs per key as one array, oldest first."""
    recent = recent_per_key(df, key, order, n)
    point = F.struct((-F.col("rn")).alias("pos"), *[c.alias(f) for f, c in fields.items()])
    points = F.array_sort(F.collect_list(point))
    return recent.groupBy(key).agg(
        F.transform(points, lambda p: F.struct(*[p[f].alias(f) for f in fields])).alias("trend")
    )


def running_peak(df: DataFrame, key: str, order: str, value: str, name: str) -> DataFrame:
    """Largest value of the earlier rows of the key; NULL on its first row.

    Meant for rows already summed to one per key and period, which bounds a
    window group by the calendar.
    """
    before = (
        Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    )
    return df.withColumn(name, F.max(value).over(before))


def previous_values(
    df: DataFrame, keys: list[str], order: list[str], values: dict[str, Column], segments: int | None = None
) -> DataFrame:
    """Last non-NULL value of each expression among the earlier rows of a key.

    Like ``last(v, ignorenulls)`` over all preceding rows, but a scan in two passes.  Borders between about
    ``segments`` equal runs of (keys, order) come from a sample of fixed size; a window group is one key *and one
    segment*, so a key with very many rows is spread over tasks, whatever its rows have in common.  Only keys on a
    border go on in the next segment: the first pass finds their last values, two rows a segment at most, and
    the second lays them under the segments that follow.  ``order`` should be unique within a key.
    """
    count = segments or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    borders = _borders(df, [*keys, *order], count)
    raw = {name: f"_v_{name}" for name in values}
    rows = df.withColumns({raw[n]: v for n, v in values.items()}).withColumn("_segment", _segment_of(df.select(*keys, *order), borders))
    inside = Window.partitionBy("_segment", *keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    filled = rows.withColumns({f"_in_{n}": F.last(raw[n], ignorenulls=True).over(inside) for n in values})
    if not borders:
        return filled.select(*df.columns, *[F.col(f"_in_{n}").alias(n) for n in values])
    carried = F.broadcast(_carried(rows, keys, order, raw, borders))  # two rows a segment at most
    meet = [F.col(f"r.{c}").eqNullSafe(F.col(f"c.{c}")) for c in (*keys, "_segment")]
    joined = filled.alias("r").join(carried.alias("c"), functools.reduce(operator.and_, meet), "left")
    return joined.select(
        *[F.col(f"r.{c}") for c in df.columns],
        *[F.coalesce(F.col(f"r._in_{n}"), F.col(f"c._carry_{n}")).alias(n) for n in values],
    )


SAMPLED = 30  # rows of the sample for each segment


def _borders(df: DataFrame, columns: list[str], segments: int) -> list[Row]:
    """Rows that start a segment, sorted and apart: evenly spaced in the rows with the smallest hashes."""
    rows = df.select(*columns, F.xxhash64(*columns).alias("_hash"))
    sample = rows.orderBy("_hash").limit(SAMPLED * segments).drop("_hash").orderBy(*columns).collect()
    step = max(1, len(sample) // segments)
    picked = sample[step::step] if len(sample) > segments else sample[1:]
    return [b for a, b in zip([None, *picked], picked) if a != b]


def _segment_of(keyed: DataFrame, borders: list[Row]) -> Column:
    """How many borders lie at or before a row, found in blocks of borders first."""
    if not borders:
        return F.lit(0)
    types = [f.dataType for f in keyed.schema]
    here = F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(keyed.columns)])
    width = max(1, int(len(borders) ** 0.5))
    blocks = [borders[i : i + width] for i in range(0, len(borders), width)]

    def passed(rows: list[Row]) -> Column:
        starts = [F.struct(*[F.lit(v).cast(t).alias(f"c{i}") for i, (v, t) in enumerate(zip(r, types))]) for r in rows]
        return functools.reduce(operator.add, [(start <= here).cast("int") for start in starts])

    first = passed([b[0] for b in blocks])
    inside = F.lit(0)
    for i, block in enumerate(blocks):
        if block[1:]:
            inside = F.when(first == i + 1, passed(block[1:])).otherwise(inside)
    return F.when(first == 0, 0).otherwise((first - 1) * width + 1 + inside)


def _carried(rows: DataFrame, keys: list[str], order: list[str], raw: dict[str, str], borders: list[Row]) -> DataFrame:
    """For each key on a border and each segment it goes on in, the last non-NULL values before the segment."""
    spark = rows.sparkSession
    on_border = list(dict.fromkeys(tuple(b[: len(keys)]) for b in borders))
    crossing = F.broadcast(spark.createDataFrame(on_border, rows.select(*keys).schema))
    meet = [F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    mine = rows.alias("r").join(crossing.alias("b"), functools.reduce(operator.and_, meet), "left_semi")
    position = F.struct(*order)
    tails = mine.groupBy(*keys, "_segment").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), position)).alias(f"_carry_{n}") for n, c in raw.items()]
    )
    last: dict[tuple, list] = {}
    carried = []
    for row in sorted(tails.collect(), key=lambda r: r["_segment"]):
        key, found = tuple(row[: len(keys)]), list(row[len(keys) + 1 :])
        if key in last:
            carried.append((*key, row["_segment"], *last[key]))
        last[key] = [old if new is None else new for old, new in zip(last.get(key, found), found)]
    return spark.createDataFrame(carried, tails.schema)


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0, deepest: int = 10_000) -> DataFrame:
    """One page plus a look-ahead row, with ``has_more`` on every row kept.

    All rows up to the end of the page reach one task, so a page that ends beyond
    ``deepest`` is refused; :func:`page_after` costs the same at any depth.
    """
    if limit < 1 or offset < 0 or offset + limit > deepest:
        raise ValueError(f"a page lies within the first {deepest} rows; go on with page_after")
    return _with_look_ahead(df.orderBy(*order).offset(offset).limit(limit + 1), order, limit)


def page_after(df: DataFrame, order: str, tie: str, after: tuple | None, limit: int) -> DataFrame:
    """The page after the row ``after = (order value, tie value)``, newest first."""
    if limit < 1:
        raise ValueError("a page has one row at least")
    if after is not None:
        last, last_tie = (F.lit(v) for v in after)
        df = df.where((F.col(order) < last) | ((F.col(order) == last) & (F.col(tie) > last_tie)))
    keys = [F.desc(order), F.asc(tie)]
    return _with_look_ahead(df.orderBy(*keys).limit(limit + 1), keys, limit)


def _with_look_ahead(rows: DataFrame, order: list[Column], limit: int) -> DataFrame:
    # At most limit + 1 rows reach this window.
    numbered = rows.withColumns(
        {
            "rn": F.row_number().over(Window.orderBy(*order)),
            "_n": F.count(F.lit(1)).over(Window.partitionBy()),
        }
    )
    return (
        numbered.where(F.col("rn") <= limit)
        .withColumn("has_more", F.col("_n") > limit)
        .drop("_n")
    )
