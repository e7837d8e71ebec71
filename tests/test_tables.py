"""Sources, sinks, exports, schemas and configuration checks."""

import datetime as dt
import glob

import pytest
from pyspark.sql import functions as F

from rulewatch.plans import lifecycle, lint
from rulewatch.plans.charts import ChartSpec, chart
from rulewatch.sources import schemas
from rulewatch.sources.export import export_rows, read_csv, write_csv
from rulewatch.sources.tables import (
    Tables, catalog_table_names, catalog_tables, cleanup_plan, column_profile, find_column, load_configs, table_health,
)


def test_export_has_mark_separator_and_line_ends(spark, tmp_path):
    rows = [(1, 'a;"b"', dt.datetime(2024, 1, 1), True), (2, None, dt.datetime(2024, 1, 3), False), (3, "x\ny", dt.datetime(2024, 1, 2), False)]
    df = spark.createDataFrame(rows, "id int, note string, ArchiveDate timestamp_ntz, _is_false_positive boolean")
    out = export_rows(df, ["id"])
    write_csv(out, str(tmp_path / "csv"), one_file_rows=3)
    with pytest.raises(ValueError):
        write_csv(out, str(tmp_path / "cut"), one_file_rows=2)
    (path,) = glob.glob(str(tmp_path / "csv" / "part-*"))
    data = open(path, "rb").read()
    assert data.startswith("﻿id;note;ArchiveDate;FalsoPositivo\r\n".encode())
    assert data.decode().splitlines()[1] == "2;;2024-01-03 00:00:00;Não"
    assert '"a;""b""";' in data.decode() and data.endswith(b"Sim\r\n")
    assert out.limit(1).columns == ["id", "note", "ArchiveDate", "FalsoPositivo"]
    assert export_rows(df, ["id"], limit=2).count() == 2
    back = read_csv(spark, str(tmp_path / "csv"), out.columns).where("id = 1").first()
    assert back.note == 'a;"b"'


def test_nine_control_tables(spark):
    assert len(schemas.CONTROL_DDL) == 9
    sizes = {n: len(schemas.control_schema(n)) for n in schemas.CONTROL_DDL}
    assert (sizes["tb_test_configurations"], sizes["tb_tests_executions"], sizes["tb_incident_hashes"]) == (21, 16, 6)
    assert len(schemas.control_schema("tb_test_configurations", staged=True)) == 34
    assert not schemas.control_schema("tb_test_configurations")["test_id"].nullable
    frame = schemas.empty(spark, "tb_false_positives")
    assert frame.count() == 0 and schemas.schema_gaps(frame, schemas.control_schema("tb_false_positives")) == []
    old = frame.drop("match_criteria").withColumn("active", F.lit("yes"))
    assert schemas.schema_gaps(old, frame.schema) == ["missing match_criteria", "active is string, not boolean"]
    wide = schemas.widen(old, frame.schema)
    assert schemas.widen(wide, frame.schema).columns == wide.columns and "match_criteria" in wide.columns


def test_configs_from_json(spark, tmp_path):
    path = tmp_path / "rules.json"
    path.write_text('[{"test_id":"1","test_name":"a","output_table":"t","threshold":0,"frequency":"WEEKLY","query_type":"SQL","query_code":"x","status":"ACTIVE"},'
                    '{"test_id":"2","test_name":"b","output_table":"t","threshold":0,"frequency":"MONTHLY","query_type":"SQL","query_code":"x","status":"PAUSED"}]')
    rows = load_configs(spark, str(path), "first load", dt.datetime(2024, 1, 1), force_daily=True).orderBy("test_id").collect()
    assert [r.version for r in rows] == [1, 1] and [r.activated_at is None for r in rows] == [False, True]
    assert {r.frequency for r in rows} == {"DAILY"} and rows[0].asDict().keys() == set(schemas.control_schema("tb_test_configurations").names)


def test_health_reports_missing_tables(spark):
    def load(name):
        return spark.range(3) if name == "here" else spark.read.parquet("/nowhere/at/all")

    rows = {r.table_name: r for r in table_health(spark, Tables(load, ["here", "gone"]), ["here", "gone"]).collect()}
    assert rows["here"].row_count == 3 and rows["here"].error is None
    assert rows["gone"].row_count is None and "PATH_NOT_FOUND" in rows["gone"].error


def test_columns_are_found_by_name_or_word(spark):
    df = spark.sql("SELECT 'r' AS RiskId, 't' AS RiskTitle, 'high' AS Nivel, 1.5 AS amount, true AS flag, 1 AS _x, current_date() AS ArchiveDate")
    assert column_profile(df) == {"numeric_cols": ["amount"], "categorical_cols": ["RiskId", "RiskTitle", "Nivel", "flag"]}
    assert find_column(df, "R2InherentLevel", skip=("RiskId",)) == "Nivel" and find_column(df, "flag") == "flag"
    assert find_column(df.select("amount"), "x") is None


def test_catalog_tables(spark):
    spark.range(2).createOrReplaceTempView("probe_catalog")
    assert catalog_tables(spark, {"short": "probe_catalog"})["short"].count() == 2
    assert "probe_catalog" in {r.table_name for r in catalog_table_names(spark).collect()}


def test_cleanup_only_plans(spark):
    names = spark.createDataFrame([("tb_incidents_x",), ("tb_false_positives",), ("other",)], "table_name string")
    assert {r.table_name: r.action for r in cleanup_plan(spark, names).collect()} == {"tb_incidents_x": "drop", "tb_false_positives": "drop", "other": "keep"}


def test_rule_code(spark):
    rows = [
        ("ok", "SQL", None, "  -- note\n/* a;b\n */ with t AS (SELECT 1) SELECT * FROM t;"), ("two", "SQL", None, "SELECT 1; SELECT 2"),
        ("literal", "SQL", None, "SELECT ';' AS c"), ("empty", "SQL", None, "-- x"), ("update", "SQL", None, "UPDATE t SET a = 1"),
        ("selects", "sql", None, "selector"), ("python", "PYTHON", "import SubProcess", "x"), ("fine", "PYTHON", None, "df_incidents = spark.table('t')"),
        ("other", "R", None, "x"), ("none", None, None, "x"),
    ]
    df = spark.createDataFrame(rows, "test_id string, query_type string, imports string, query_code string")
    assert {r.test_id: r.error for r in lint.rule_code(df).collect()} == {
        "two": "several statements", "literal": "several statements", "empty": "empty", "update": "not a select", "selects": "not a select",
        "python": "forbidden text", "other": "unknown type", "none": "unknown type",
    }


def test_fp_criteria(spark):
    one = '{"column":"a","value":1}'
    rows = [("ok", f"[{one}]"), ("none", None), ("empty", "[]"), ("broken", "[{"), ("bad", '[{"column":"a b","value":1}]'), ("missing", '[{"value":1}]'),
            ("four", "[" + ",".join(f'{{"column":"c{i}","value":1}}' for i in range(4)) + "]"), ("twice", f"[{one},{one}]")]
    got = {r.fp_id: r.error for r in lint.fp_criteria(spark.createDataFrame(rows, "fp_id string, match_criteria string")).collect()}
    assert got == {"none": "no criteria", "empty": "no criteria", "broken": "no criteria", "bad": "bad column", "missing": "bad column",
                   "four": "over three criteria", "twice": "repeated column"}


HISTORY = "history_id string, test_id string, status_before string, status_after string, change_type string, version int, changed_by string, changed_at timestamp_ntz"


def history(spark, *steps):
    rows = [(f"H{i:02}", "T", *step, dt.datetime(2024, 1, 1 + i // 3, i)) for i, step in enumerate(steps)]
    return spark.createDataFrame(rows, HISTORY)


LEGAL = (
    (None, "DRAFT", "CREATED", 1, "ann"), ("DRAFT", "DRAFT", "EDITED", 2, "ann"), ("DRAFT", "UNDER_REVIEW", "SUBMITTED_FOR_REVIEW", 3, "ann"),
    ("UNDER_REVIEW", "REJECTED", "REJECTED", 3, "bob"), ("REJECTED", "UNDER_REVIEW", "SUBMITTED_FOR_REVIEW", 4, "ann"),
    ("UNDER_REVIEW", "ACTIVE", "APPROVED", 4, "bob"), ("ACTIVE", "PAUSED", "PAUSED", 4, "ann"), ("PAUSED", "PAUSED", "EDITED_PENDING_REVIEW", 4, "ann"),
    ("PAUSED", "PAUSED", "APPROVED", 5, "bob"), ("PAUSED", "PENDING_DELETE", "CANCELLED", 5, "ann"), ("PENDING_DELETE", "ACTIVE", "REJECTED", 5, "bob"),
    ("ACTIVE", "PENDING_DELETE", "CANCELLED", 5, "ann"), ("PENDING_DELETE", "CANCELLED", "APPROVED", 5, "bob"),
)


def test_a_legal_history_has_no_errors(spark):
    rows = history(spark, *LEGAL)
    assert lifecycle.transition_errors(rows).count() == 0
    state = lifecycle.current_state(rows).first()
    assert (state.status_after, state.version) == ("CANCELLED", 5)
    assert lifecycle.staged_edits(rows).first().state == "PROMOTED"


def test_illegal_steps_are_named(spark):
    rows = history(
        spark, (None, "ACTIVE", "CREATED", 1, "ann"), ("ACTIVE", "PAUSED", "PAUSED", 2, "ann"), ("DRAFT", "DRAFT", "EDITED", 3, "ann"),
    )
    assert {r.history_id: r.reason for r in lifecycle.transition_errors(rows).collect()} == {"H00": "transition", "H01": "version", "H02": "chain"}


EDIT = ("ACTIVE", "ACTIVE", "EDITED_PENDING_REVIEW", 1)


@pytest.mark.parametrize("steps,want", [
    ([(*EDIT, "ann")], ("ann", "PENDING", None)),
    ([(*EDIT, "ann"), ("ACTIVE", "ACTIVE", "REJECTED", 1, "bob")], ("ann", "REJECTED", None)),
    ([(*EDIT, "ann"), (*EDIT, "bob")], ("bob", "PENDING", "ann")),
    ([(*EDIT, "ann"), ("ACTIVE", "PENDING_DELETE", "CANCELLED", 1, "ann"), ("PENDING_DELETE", "ACTIVE", "REJECTED", 1, "bob")], ("ann", "PENDING", None)),
    ([(*EDIT, "ann"), ("ACTIVE", "PENDING_DELETE", "CANCELLED", 1, "ann"), ("PENDING_DELETE", "CANCELLED", "APPROVED", 1, "bob")], ("ann", "DISCARDED", None)),
])
def test_staged_edits(spark, steps, want):
    row = lifecycle.staged_edits(history(spark, *steps)).first()
    assert (row.author, row.state, row.blocked_by) == want


def test_nobody_reviews_their_own_work(spark):
    rows = history(
        spark, ("UNDER_REVIEW", "ACTIVE", "APPROVED", 1, "ann"), (*EDIT, "bob"), ("ACTIVE", "ACTIVE", "APPROVED", 2, "bob"),
        (*EDIT, "bob"), ("ACTIVE", "ACTIVE", "APPROVED", 3, "ann"), ("ACTIVE", "PENDING_DELETE", "CANCELLED", 3, "bob"), ("PENDING_DELETE", "CANCELLED", "APPROVED", 3, "ann"),
    )
    configs = spark.createDataFrame([("T", "ann")], "test_id string, created_by string")
    assert sorted(r.history_id for r in lifecycle.four_eyes_breaches(rows, configs, []).collect()) == ["H00", "H02", "H06"]
    assert lifecycle.four_eyes_breaches(rows, configs, ["ann", "bob"]).count() == 0


ARCHIVE = "g string, v int, ArchiveDate timestamp_ntz"


def archive(spark):
    rows = [("a", 1, 1), ("a", 2, 2), ("b", 9, 1), (None, 50, 2), ("c", None, 2)]
    return spark.createDataFrame([(g, v, dt.datetime(2024, 1, d, 5)) for g, v, d in rows], ARCHIVE)


def test_chart_fills_missing_cells_and_keeps_null_ones(spark):
    spec = ChartSpec.from_json("line", '{"group_by":"g","y_aggregation":"max","y_column":"v","date_range":"all","top_n_series":3}')
    got = {(r.x[-2:], r.series): r.y for r in chart(archive(spark), spec, "2024-02-01").collect()}
    assert got == {("01", "a"): 1, ("01", "b"): 9, ("01", "c"): 0, ("02", "a"): 2, ("02", "b"): 0, ("02", "c"): None}


def test_chart_ranges_labels_and_bad_columns(spark):
    rows = archive(spark)
    assert chart(rows, ChartSpec("kpi", y_aggregation="SUM", y_column="v", date_range="7d"), "2024-01-09").first().kpi_value == 52.0
    assert chart(rows.limit(0), ChartSpec("kpi", y_aggregation="MIN", y_column="v"), "2024-01-09").first().kpi_value == 0.0
    bars = chart(rows, ChartSpec("bar", x_axis="g", date_range="all"), "2024-01-09").collect()
    assert [(r.x, r.y) for r in bars] == [("a", 2), ("—", 1), ("b", 1), ("c", 1)]
    with pytest.raises(ValueError):
        chart(rows, ChartSpec("bar", x_axis="nothing"), "2024-01-09")


def test_preview_runs_nothing_but_a_select(spark):
    from rulewatch.plans.reports import preview_sql

    spark.range(30).createOrReplaceTempView("probe_preview")
    rows, error = preview_sql(spark, "SELECT id, id * 2 AS twice FROM probe_preview -- all")
    assert error is None and rows.columns == ["id", "twice"] and rows.count() == 10
    assert preview_sql(spark, "DROP VIEW probe_preview") == (None, "not a select") and spark.catalog.tableExists("probe_preview")
    assert "UNRESOLVED_COLUMN" in preview_sql(spark, "SELECT nothing FROM probe_preview")[1]
