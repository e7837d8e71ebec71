"""One generic chart over any finding archive."""

from __future__ import annotations

import dataclasses
import json

from pyspark.sql import Column, DataFrame, Window, functions as F

from rulewatch.functions.calendar import since_days
from rulewatch.functions.predicates import ARCHIVE_TS

# Allowed values of a chart specification (fixed values).
CHART_TYPES = ("line", "bar", "bar_h", "pie", "kpi")
WIDTHS = ("half", "full")
AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")
DATE_RANGES = {"7d": 7, "30d": 30, "90d": 90, "all": None}
UNSET = ("", "none", "null")
NO_LABEL = "—"


@dataclasses.dataclass(frozen=True)
class ChartSpec:
    """What to draw; column names are checked against the data when drawing."""

    chart_type: str
    x_axis: str = ARCHIVE_TS
    y_aggregation: str = "COUNT"
    y_column: str | None = None
    group_by: str | None = None
    top_n_series: int = 8
    date_range: str = "30d"
    max_points: int | None = None

    @classmethod
    def from_json(cls, chart_type: str, config: str | None) -> ChartSpec:
        given = json.loads(config or "{}")

        def value(name, default):
            found = given.get(name)
            return default if found is None or str(found) in UNSET else found

        return cls(
            chart_type,
            str(value("x_axis", ARCHIVE_TS)),
            str(value("y_aggregation", "COUNT")).upper(),
            value("y_column", None),
            value("group_by", None),
            int(value("top_n_series", 8)),
            str(value("date_range", "30d")),
        )


def measure(spec: ChartSpec) -> Column:
    """The y value of a group; without a column every aggregate counts rows."""
    if spec.y_aggregation == "COUNT" or not spec.y_column:
        return F.count(F.lit(1))
    column = F.col(spec.y_column)
    return {
        "SUM": F.coalesce(F.sum(column), F.lit(0)),
        "AVG": F.coalesce(F.avg(column.cast("double")), F.lit(0.0)),
        "MIN": F.min(column),
        "MAX": F.max(column),
    }.get(spec.y_aggregation, F.count(F.lit(1)))


def chart(findings: DataFrame, spec: ChartSpec, as_of) -> DataFrame:
    """The data of a chart: ``(kpi_value)``, ``(x, y)`` or ``(x, series, y)``."""
    for name in (spec.x_axis, spec.y_column, spec.group_by):
        if name and name not in findings.columns:
            raise ValueError(f"no column {name} to draw")
    rows = findings.where(since_days(ARCHIVE_TS, as_of, DATE_RANGES.get(spec.date_range, 30)))
    if spec.chart_type == "kpi":
        return rows.agg(F.round(F.coalesce(measure(spec), F.lit(0)).cast("double"), 4).alias("kpi_value"))
    by_day = spec.x_axis == ARCHIVE_TS
    x = (F.to_date(ARCHIVE_TS) if by_day else F.col(spec.x_axis)).cast("string")
    if spec.group_by:
        return _series(rows.withColumn("_x", x), spec)
    order = [F.asc_nulls_first("_x")] if by_day else [F.desc_nulls_last("y"), F.asc_nulls_first("_x")]
    points = rows.groupBy(x.alias("_x")).agg(measure(spec).alias("y")).orderBy(*order)
    if spec.max_points is not None:
        points = points.limit(spec.max_points)
    return points.select(F.coalesce("_x", F.lit(NO_LABEL)).alias("x"), F.coalesce("y", F.lit(0)).alias("y"))


def top_series(rows: DataFrame, spec: ChartSpec, keep_null: bool = False) -> DataFrame:
    """The series with the largest total, numbered.

    A NULL series is left out first; ``keep_null`` lets it take a place, although
    it is never drawn.
    """
    named = rows.withColumn("series", F.col(spec.group_by).cast("string"))
    if not keep_null:
        named = named.where(F.col("series").isNotNull())
    top = (
        named.groupBy("series")
        .agg(measure(spec).alias("total"))
        .orderBy(F.desc_nulls_last("total"), F.asc_nulls_first("series"))
        .limit(max(1, spec.top_n_series))
    )
    # As many rows as series asked for reach this window.
    place = Window.orderBy(F.desc_nulls_last("total"), F.asc_nulls_first("series"))
    return top.withColumn("place", F.row_number().over(place))


def _series(rows: DataFrame, spec: ChartSpec) -> DataFrame:
    """Every x of the top series by every top series; a cell without rows is 0."""
    top = top_series(rows, spec).select("series")
    drawn = rows.withColumn("series", F.col(spec.group_by).cast("string")).where(F.col("_x").isNotNull())
    cells = drawn.join(top, "series", "left_semi").groupBy(F.col("_x").alias("x"), "series").agg(measure(spec).alias("y"), F.lit(True).alias("_drawn"))
    # The list of series has the length asked for; each x of the chart gets it whole.
    every = top.agg(F.collect_list("series")).scalar()
    grid = cells.select("x").distinct().select("x", F.explode(every).alias("series"))
    y = F.when(F.col("_drawn"), F.col("y")).otherwise(F.lit(0))
    return grid.join(cells, ["x", "series"], "left").select("x", "series", y.alias("y"))
