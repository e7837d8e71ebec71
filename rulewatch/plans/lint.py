"""Checks of rule, chart and false-positive definitions, as columns of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rulewatch.functions.predicates import any_of, is_blank
from rulewatch.operators.findings import CRITERIA
from rulewatch.plans.charts import AGGREGATES, CHART_TYPES, DATE_RANGES, UNSET, WIDTHS
from rulewatch.sources.tables import FINDINGS_PREFIX

IDENTIFIER = "^[a-zA-Z_][a-zA-Z0-9_]*$"
TABLE_NAME = "^[a-z0-9_]+$"

# Text a Python rule may not contain (fixed values).
FORBIDDEN_PYTHON = (
    "os.system", "subprocess", "__import__", "open(", "eval(", "exec(", ".write.",
    "saveastable", "insertinto",
)


def messages(checks: dict[str, Column]) -> Column:
    """The names of the checks that are true, joined; NULL if none is."""
    found = F.array(*[F.when(bad, F.lit(name)) for name, bad in checks.items()])
    return F.nullif(F.array_join(found, " | "), F.lit(""))


def required_fields(configs: DataFrame, submit: bool = True) -> DataFrame:
    """Missing or malformed fields; more of them are required to submit than to save."""
    checks = {
        "test_name": is_blank("test_name"),
        "output_table": F.col("output_table").isNull() | ~F.col("output_table").startswith(FINDINGS_PREFIX),
    }
    if submit:
        checks |= {
            "responsible_area": is_blank("responsible_area"),
            "risco_id": is_blank("risco_id") | (F.col("risco_id") == "N/A"),
            "query_code": is_blank("query_code"),
            "query_type": ~F.coalesce(F.col("query_type").isin("SQL", "PYTHON"), F.lit(False)),
        }
    return configs.select("test_id", messages(checks).alias("errors")).where(F.col("errors").isNotNull())


def without_comments(code: Column) -> Column:
    """SQL text without block and line comments; both patterns are fixed values."""
    return F.regexp_replace(F.regexp_replace(code, r"(?s)/\*.*?\*/", " "), r"--[^\n]*", " ")


def rule_code(configs: DataFrame) -> DataFrame:
    """What is wrong with a rule's code; NULL errors are left out.

    SQL must be one SELECT or WITH; a ``;`` inside a literal trips the check too.
    """
    kind = F.upper(F.coalesce("query_type", F.lit("")))
    code = F.coalesce("query_code", F.lit(""))
    clean = F.regexp_replace(without_comments(code), r"^\s+|\s+$", "")
    body = F.regexp_replace(clean, r"[;]+$", "")
    text = F.lower(F.concat_ws("\n", F.coalesce("imports", F.lit("")), code))
    sql = (
        F.when(clean == "", "empty")
        .when(~clean.rlike(r"(?i)^(SELECT|WITH)\b"), "not a select")
        .when(body.contains(";"), "several statements")
    )
    python = F.when(any_of(text.contains(p) for p in FORBIDDEN_PYTHON), "forbidden text")
    error = F.when(kind == "SQL", sql).when(kind == "PYTHON", python).otherwise("unknown type")
    return configs.select("test_id", error.alias("error")).where(F.col("error").isNotNull())


def duplicate_names(configs: DataFrame) -> DataFrame:
    """Rules that share a name or a findings table, in any case of letters.

    Cancelled rules do not count.  One row per rule and shared field, however many
    share it.
    """
    live = configs.where(F.col("status") != "CANCELLED")
    out = None
    for field in ("test_name", "output_table"):
        named = live.select("test_id", F.lit(field).alias("field"), F.lower(field).alias("value"))
        shared = named.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
        part = named.join(shared, "value", "left_semi").select(
            "test_id", "field", "value"
        )
        out = part if out is None else out.unionByName(part)
    return out


CHART_CONFIG = (
    "x_axis string, y_aggregation string, y_column string, group_by string, date_range string"
)


def chart_specs(charts: DataFrame) -> DataFrame:
    """Chart specifications that cannot be drawn, with the reasons."""
    spec = F.from_json("config", CHART_CONFIG)
    rows = charts.withColumn("_c", spec)

    def bad_column(name):
        value = F.col(f"_c.{name}")
        return value.isNotNull() & ~value.isin("ArchiveDate", *UNSET) & ~value.rlike(IDENTIFIER)

    checks = {
        "chart_type": ~F.coalesce(F.col("chart_type").isin(*CHART_TYPES), F.lit(False)),
        "width": ~F.coalesce(F.col("width").isin(*WIDTHS), F.lit(False)),
        "date_range": ~F.coalesce("_c.date_range", F.lit("30d")).isin(*DATE_RANGES),
        "y_aggregation": ~F.upper(F.coalesce("_c.y_aggregation", F.lit("COUNT"))).isin(*AGGREGATES),
        **{name: bad_column(name) for name in ("x_axis", "y_column", "group_by")},
    }
    return rows.select("chart_id", messages(checks).alias("errors")).where(F.col("errors").isNotNull())


def fp_criteria(false_positives: DataFrame) -> DataFrame:
    """Criteria that may not be stored: none, over three, bad or repeated columns."""
    rows = false_positives.withColumn("_c", F.from_json("match_criteria", CRITERIA))
    names = F.transform("_c", lambda c: F.trim(F.coalesce(c["column"], F.lit(""))))
    size = F.coalesce(F.size("_c"), F.lit(-1))
    error = (
        F.when(size < 1, "no criteria")
        .when(~F.forall(names, lambda n: n.rlike(IDENTIFIER)), "bad column")
        .when(size > 3, "over three criteria")
        .when(F.size(F.array_distinct(names)) < size, "repeated column")
    )
    return rows.select("fp_id", error.alias("error")).where(F.col("error").isNotNull())


def table_names(configs: DataFrame) -> DataFrame:
    """Findings tables whose name could not be used as one."""
    return configs.where(~F.col("output_table").rlike(TABLE_NAME)).select("test_id", "output_table")
