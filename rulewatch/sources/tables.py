"""Named tables, their health and the shape of their columns."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Mapping

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from rulewatch.functions.predicates import business_columns
from rulewatch.sources.schemas import CONTROL_DDL, control_schema

FINDINGS_PREFIX = "tb_incidents_"


class Tables(Mapping):
    """Names to DataFrames, read when asked for and only once."""

    def __init__(self, load: Callable[[str], DataFrame], names: Iterable[str]):
        self._load, self._names, self._seen = load, list(names), {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._seen:
            self._seen[name] = self._load(name)
        return self._seen[name]

    def __iter__(self):
        return iter(self._names)

    def __len__(self):
        return len(self._names)


def parquet_tables(spark: SparkSession, folder: str, names: Iterable[str]) -> Tables:
    return Tables(lambda n: spark.read.parquet(f"{folder}/{n}.parquet"), names)


def catalog_tables(spark: SparkSession, paths: Mapping[str, str]) -> Tables:
    """Short names to catalog tables such as ``catalog.schema.table``."""
    return Tables(lambda n: spark.table(paths[n]), paths)


def load_configs(
    spark: SparkSession, path: str, created_by: str, as_of_ts, force_daily: bool = False
) -> DataFrame:
    """Rule configurations from a JSON list, with the defaults of a first load.

    Every rule starts at version 1; only active ones have an activation time.
    """
    stamped = ("created_by", "created_at", "updated_at", "activated_at", "version")
    full = control_schema("tb_test_configurations")
    given = T.StructType([T.StructField(f.name, f.dataType) for f in full if f.name not in stamped])
    now = F.lit(as_of_ts).cast("timestamp")
    rows = spark.read.schema(given).option("multiLine", True).json(path)
    rows = rows.withColumns(
        {
            "created_by": F.lit(created_by),
            "created_at": now,
            "updated_at": now,
            "activated_at": F.when(F.col("status") == "ACTIVE", now),
            "version": F.lit(1),
        }
    )
    if force_daily:
        rows = rows.withColumn("frequency", F.lit("DAILY"))
    return rows.select(*full.names)


def table_health(spark: SparkSession, tables: Mapping[str, DataFrame], names: Iterable[str]) -> DataFrame:
    """Row count per table, or the reason why it cannot be read."""
    counts = []
    for name in names:
        try:
            counts.append(
                tables[name].agg(
                    F.lit(name).alias("table_name"),
                    F.count(F.lit(1)).alias("row_count"),
                    F.lit(None).cast("string").alias("error"),
                )
            )
        except (PySparkException, KeyError) as problem:
            counts.append((name, str(problem)))
    frames = [c for c in counts if isinstance(c, DataFrame)]
    failed = [(n, None, e) for n, e in (c for c in counts if isinstance(c, tuple))]
    if failed:
        frames.append(
            spark.createDataFrame(failed, "table_name string, row_count bigint, error string")
        )
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def column_profile(df: DataFrame) -> dict[str, list[str]]:
    """Business columns as numeric and categorical, read from the schema."""
    names = business_columns(df)
    numeric = [c for c in names if isinstance(df.schema[c].dataType, T.NumericType)]
    return {"numeric_cols": numeric, "categorical_cols": [c for c in names if c not in numeric]}


def column_ranges(df: DataFrame) -> DataFrame:
    """One row per business column: kind, filled rows, smallest and largest value.

    All columns are measured in one scan and turned into rows afterwards.
    """
    profile = column_profile(df)
    names = profile["numeric_cols"] + profile["categorical_cols"]
    measured = df.agg(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.lit("numeric" if c in profile["numeric_cols"] else "categorical").alias("kind"),
                F.count(F.col(f"`{c}`")).alias("filled"),
                F.min(F.col(f"`{c}`")).cast("string").alias("smallest"),
                F.max(F.col(f"`{c}`")).cast("string").alias("largest"),
            ).alias(f"c{i}")
            for i, c in enumerate(names)
        ]
    )
    return measured.select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(names))])))


# Words that give away a risk-level column, in two languages (fixed values).
LEVEL_WORDS = re.compile(r"n[ií]vel|level|sever|critic|classif|grau", re.IGNORECASE)


def find_column(df: DataFrame, name: str, words: re.Pattern = LEVEL_WORDS, skip=()) -> str | None:
    """The column of that name, else the first whose name contains one of the words."""
    if name in df.columns:
        return name
    return next((c for c in df.columns if c not in skip and words.search(c)), None)


def cleanup_plan(spark: SparkSession, names: DataFrame, extra: Iterable[str] = ()) -> DataFrame:
    """Which tables of a schema belong to the audit and which stay.  Drops nothing.

    ``names`` has a ``table_name`` column, as made from ``spark.catalog.listTables()``.
    """
    listed = [*CONTROL_DDL, *extra]
    ours = F.col("table_name").isin(listed) | F.col("table_name").startswith(FINDINGS_PREFIX)
    return names.select("table_name").distinct().withColumn(
        "action", F.when(ours, "drop").otherwise("keep")
    )


def catalog_table_names(spark: SparkSession, schema: str | None = None) -> DataFrame:
    rows = [(t.name,) for t in spark.catalog.listTables(schema)]
    return spark.createDataFrame(rows, "table_name string")


def readiness(
    control: Mapping[str, DataFrame], archives: Mapping[str, DataFrame],
    configs: DataFrame, expected: Mapping[str, int],
) -> DataFrame:
    """Checks before going live: tables, columns, rules per status, archive stamps."""
    spark = configs.sparkSession
    rows = []
    for name in CONTROL_DDL:
        try:
            missing = set(control_schema(name).names) - set(control[name].columns)
            rows.append((f"table {name}", not missing, ", ".join(sorted(missing)) or None))
        except (PySparkException, KeyError):
            rows.append((f"table {name}", False, "not found"))
    for name, frame in archives.items():
        rows.append((f"archive {name}", "ArchiveDate" in frame.columns, None))
    static = spark.createDataFrame(rows, "check string, ok boolean, detail string")
    counts = [F.count_if(F.col("status") == s).alias(s) for s in expected]
    found = configs.agg(*counts).select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(f"rules {s}").alias("check"),
                        (F.col(s) == n).alias("ok"),
                        F.col(s).cast("string").alias("detail"),
                    )
                    for s, n in expected.items()
                ]
            )
        )
    )
    return static.unionByName(found)
