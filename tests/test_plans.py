"""What the physical plans must and must not contain."""

import os
import re

import pytest

import __spark_entry__ as spark_entry
from checks import registry
from checks.registry import Inputs
from rulewatch.operators.grouping import recent_per_key
from rulewatch.rules.registry import build

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no driver tables here")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# Queries that write before they return would only repeat their work here.
LAZY = [k for k in registry.queries() if k not in ("s05_findings_archive", "s07_hash_log", "s08_replace_by_key", "s13_export", "e13_run_totals", "e13_deadline", "s03_load_configs", "s06_log_levels", "s07_adopted_log", "s08_snapshots", "w04_latest_state", "s05_changed_types", "r13_findings_page", "p15_indexed_search") and not k.startswith("e03_")]


@pytest.mark.parametrize("key", LAZY)
def test_no_cross_join_and_no_python(spark, key):
    text = plan(spark_entry.queries()[key](spark, FOLDER))
    assert "explode(sequence" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert not re.search(r"Python|Pandas|ArrowEval", text)


def test_filters_and_columns_reach_the_scan(spark):
    rows = Inputs(spark, FOLDER)["events"].selectExpr("*", "event_type AS action_name", "cast(ts AS date) AS event_date", "named_struct('email', props) AS user_identity")
    text = plan(build("permission_changes", {"audit": rows}, "2024-01-16", action="purchase").select("event_id"))
    assert "EqualTo(event_type,purchase)" in text
    orders = Inputs(spark, FOLDER)["orders"].selectExpr(
        "o_orderkey ParticipantId", "o_custkey DocumentNumberCd", "o_orderstatus StatusId", "o_orderdate CreatedAtDttm")
    text = plan(build("duplicate_documents", {"participant": orders}, None))
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_orderstatus:string>" in text and "EqualTo(o_orderstatus,1)" in text


def test_last_month_is_a_range_on_the_column(spark):
    from rulewatch.functions.calendar import in_last_month, on_day, previous_day

    events = Inputs(spark, FOLDER)["events"]
    assert "GreaterThanOrEqual(ts," in plan(events.where(in_last_month("ts", "2024-02-10")))
    assert "GreaterThanOrEqual(ts," in plan(events.where(on_day("ts", previous_day("2024-01-16"))))


def test_recent_rows_are_cut_before_the_shuffle(spark):
    text = plan(recent_per_key(Inputs(spark, FOLDER)["events"], "user_id", ["ts"], 14))
    assert "WindowGroupLimit" in text.split("Exchange", 1)[1]


def test_flagship_reads_findings_once(spark):
    text = plan(spark_entry.entry(spark))
    assert text.count("Window [") == 1


def test_the_latest_day_is_one_folder(spark, tmp_path):
    import datetime as dt

    from rulewatch.plans.reports import in_view
    from rulewatch.sources.archive import read_findings, write_findings

    for n in (1, 2, 3):
        write_findings(spark.range(n), str(tmp_path), "T1", dt.datetime(2024, 1, n, 6))
    archive = read_findings(spark, str(tmp_path), "T1")
    latest = in_view(archive)
    assert latest.count() == 3 and in_view(archive, date_from="2024-01-02").count() == 5
    scans = [line for line in plan(latest).splitlines() if "FileScan" in line]
    assert any(re.search(r"PartitionFilters: \[[^]]*archive_dt", line) for line in scans)


@pytest.mark.parametrize("key", ["l02_transition_errors", "l03_staged_edits", "l04_four_eyes"])
def test_life_cycle_needs_three_exchanges_at_most(spark, key):
    """Without broadcasts of measured tables; the carried rows are two a segment at most."""
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(spark_entry.queries()[key](spark, FOLDER))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    exchanges = [x for x in re.findall(r"\w*Exchange\b", text) if x == "Exchange"]
    assert len(exchanges) <= 3, text
