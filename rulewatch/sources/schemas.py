"""Schemas of the nine control tables and checks against them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

# Column names and types of the control tables (fixed values); "!" marks NOT NULL.
CONTROL_DDL = {
    "tb_test_configurations": """
        test_id string!, test_name string!, output_table string!, description string,
        responsible_area string, risco_id string, threshold int!, frequency string!,
        query_type string!, imports string, query_code string!, status string!,
        category string, created_by string!, reviewed_by string, rejection_reason string,
        created_at timestamp!, updated_at timestamp!, activated_at timestamp, version int!,
        should_activate_channel boolean""",
    "tb_test_configurations_history": """
        history_id string!, test_id string!, test_name string!, version int!,
        query_type string, imports string, query_code string, status_before string,
        status_after string, changed_by string!, changed_at timestamp!, change_type string!,
        comment string""",
    "tb_tests_executions": """
        TestName string, Description string, ResponsibleArea string, RiskId string,
        Frequency string, ExecutionDate timestamp, IncidentCount int, IncidentCountRaw int,
        ExecutionTimeSec float, Threshold int, TestResult string,
        ShouldActivateChannel boolean, ErrorMessage string, IsSupressed boolean,
        IsRecurrent boolean, IsContinued boolean""",
    "tb_incident_hashes": """
        test_name string, execution_date timestamp, incident_hash string, row_count int,
        is_suppressed boolean, is_recurrent boolean""",
    "tb_test_suppressions": """
        suppression_id string!, test_id string!, test_name string, linked_entry_id string,
        linked_entry_title string, note string, created_by string, created_at timestamp,
        active boolean""",
    "tb_false_positives": """
        fp_id string!, test_name string, row_hash string, match_criteria string,
        marked_by string, marked_at timestamp, note string, active boolean""",
    "tb_false_positives_history": """
        fp_history_id string!, fp_id string, event_type string, test_name string,
        row_hash string, row_data string, note string, actor string, event_at timestamp""",
    "tb_dashboard_views": """
        view_id string!, title string, position int, created_by string,
        created_at timestamp, updated_at timestamp""",
    "tb_dashboard_charts": """
        chart_id string!, view_id string!, title string, chart_type string, test_id string,
        config string, position int, width string, created_at timestamp,
        updated_at timestamp""",
}

# Proposed values of a live rule, kept beside the running ones.
STAGED_FIELDS = (
    "query_type", "imports", "query_code", "threshold", "frequency", "description",
    "responsible_area", "risco_id", "category", "should_activate_channel",
)
STAGED_DDL = """
    pending_query_type string, pending_imports string, pending_query_code string,
    pending_threshold int, pending_frequency string, pending_description string,
    pending_responsible_area string, pending_risco_id string, pending_category string,
    pending_should_activate_channel boolean, pending_submitted_by string,
    pending_submitted_at timestamp, has_pending_review boolean"""


def to_schema(ddl: str) -> T.StructType:
    return T.StructType.fromDDL(ddl.replace("!", " NOT NULL"))


def control_schema(table: str, staged: bool = False) -> T.StructType:
    ddl = CONTROL_DDL[table]
    return to_schema(f"{ddl}, {STAGED_DDL}" if staged else ddl)


def empty(spark: SparkSession, table: str) -> DataFrame:
    """No rows, full schema."""
    return spark.createDataFrame([], control_schema(table))


def widen(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Add the columns of ``schema`` that ``df`` lacks, as NULL; may be repeated."""
    have = {c.lower() for c in df.columns}
    missing = {f.name: F.lit(None).cast(f.dataType) for f in schema if f.name.lower() not in have}
    return df.withColumns(missing) if missing else df


def append_rows(old: DataFrame, new: DataFrame) -> DataFrame:
    """Union by name; a column only one side has is NULL on the other."""
    return old.unionByName(new, allowMissingColumns=True)


def schema_gaps(df: DataFrame, schema: T.StructType) -> list[str]:
    """What keeps ``df`` from fitting ``schema``: missing columns and other types."""
    have = {f.name: f.dataType for f in df.schema}
    gaps = [f"missing {f.name}" for f in schema if f.name not in have]
    gaps += [
        f"{f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}"
        for f in schema
        if f.name in have and have[f.name] != f.dataType
    ]
    return gaps


INTEGERS = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
DIGITS = (3, 5, 10, 19)  # of the integer types


def common_type(a: T.DataType, b: T.DataType) -> T.DataType:
    """The least type that takes the values of both.

    Integers rise to the wider one, then decimals, doubles and text; dates to timestamps; lists, and
    structs of the same fields, by their parts.  A decimal that would need over 38 digits is a double, which keeps 15 of them; what else
    has no common type is text, as Spark's cast writes it.
    """
    if a == b or isinstance(b, T.NullType):
        return a
    if isinstance(a, T.NullType):
        return b
    if isinstance(a, INTEGERS) and isinstance(b, INTEGERS):
        return max(a, b, key=lambda t: INTEGERS.index(type(t)))
    exact = (*INTEGERS, T.DecimalType)
    if isinstance(a, exact) and isinstance(b, exact):
        whole, scale = (max(x) for x in zip(*[(t.precision - t.scale, t.scale) if isinstance(t, T.DecimalType) else (DIGITS[INTEGERS.index(type(t))], 0) for t in (a, b)]))
        return T.DecimalType(whole + scale, scale) if whole + scale <= 38 else T.DoubleType()
    if isinstance(a, T.NumericType) and isinstance(b, T.NumericType):
        return T.DoubleType()
    days = (T.DateType, T.TimestampNTZType, T.TimestampType)
    if isinstance(a, days) and isinstance(b, days):
        return max(a, b, key=lambda t: days.index(type(t)))
    if isinstance(a, T.ArrayType) and isinstance(b, T.ArrayType):
        return T.ArrayType(common_type(a.elementType, b.elementType), True)
    if isinstance(a, T.StructType) and isinstance(b, T.StructType) and a.fieldNames() == b.fieldNames():
        return common_schema([a, b])  # Spark casts structs by place
    return T.StringType()


def common_schema(schemas: list[T.StructType]) -> T.StructType:
    """All columns of the schemas, in the order in which they come, each of the type that takes all its values."""
    found: dict[str, T.StructField] = {}
    for schema in schemas:
        for f in schema:
            old = found.get(f.name.lower())
            found[f.name.lower()] = T.StructField(old.name if old else f.name, common_type(old.dataType, f.dataType) if old else f.dataType, True)
    return T.StructType(list(found.values()))


def fit(df: DataFrame, schema: T.StructType) -> DataFrame:
    """``df`` with the columns and types of a schema that takes its values; those it lacks are NULL."""
    return widen(df, schema).select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in schema])

