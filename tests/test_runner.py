"""The daily run: errors stay apart, repeats change nothing, states follow the logs."""

import datetime as dt
import json
import os
import threading
import time

import pytest
from pyspark.sql import functions as F

from rulewatch.functions.hashing import fp_row_hash
from rulewatch.operators.findings import criteria_shapes, flag_false_positives, flag_in_one_pass, set_hash
from rulewatch.plans.deadline import run_all
from rulewatch.plans.runner import run_rules, run_totals, runs_due
from rulewatch.rules.registry import RULES, rule
from rulewatch.sources.archive import read_findings, run_time, write_findings
from rulewatch.sources.logs import RunLog, read_log

CONFIG = ("test_id string, test_name string, output_table string, description string, responsible_area string, risco_id string, "
          "threshold int, frequency string, query_type string, query_code string, status string, should_activate_channel boolean")
FPS = "fp_id string, test_name string, row_hash string, match_criteria string, marked_by string, marked_at date, note string, active boolean"
SUP = "suppression_id string, test_id string, linked_entry_id string, active boolean, created_at timestamp"


if "bad rows" not in RULES:

    @rule("bad rows", ("data",))
    def bad_rows(tables, as_of):
        return tables["data"].where("bad")


if "never ends in a task" not in RULES:

    @rule("never ends in a task", ("data",))
    def never_ends_in_a_task(tables, as_of):
        def wait(batches):
            import time

            for batch in batches:
                while True:
                    time.sleep(0.1)
                yield batch

        return tables["data"].mapInArrow(wait, "n int, word string, bad boolean")

    @rule("never ends in the driver", ("data",))
    def never_ends_in_the_driver(tables, as_of):
        import time

        while True:
            time.sleep(0.1)

    @rule("loses tasks", ("data",))
    def loses_tasks(tables, as_of):
        def once(batches):
            from pyspark import TaskContext

            yield from batches
            if TaskContext.get().attemptNumber() == 0:
                raise ValueError("lost after it gave its rows")

        return tables["data"].repartition(3).mapInArrow(once, "n int, word string, bad boolean")


def day(n):
    return dt.datetime(2024, 1, n, 6)


@pytest.fixture()
def world(spark, tmp_path):
    configs = spark.createDataFrame(
        [
            ("T1", "python rule", "tb_incidents_1", "d", "area", "R1", 1, "DAILY", "PYTHON", "bad rows", "ACTIVE", None),
            ("T2", "sql rule", "tb_incidents_2", None, None, None, None, None, "sql", "SELECT * FROM probe_data WHERE n > 100", "ACTIVE", True),
            ("T3", "fails late", "tb_incidents_3", "d", "area", "R1", 0, "DAILY", "SQL", "SELECT cast(word AS int) AS n FROM probe_data", "ACTIVE", True),
            ("T4", "no table", "tb_incidents_4", "d", "area", "R1", 0, "DAILY", "SQL", "SELECT * FROM nowhere", "ACTIVE", True),
            ("T5", "strange type", "tb_incidents_5", "d", "area", "R1", 0, "DAILY", "R", "x", "ACTIVE", True),
            ("T6", "weekly", "tb_incidents_6", "d", "area", "R1", 0, "weekly", "PYTHON", "bad rows", "ACTIVE", True),
        ],
        CONFIG,
    )

    def run(n, rows, fps=(), suppressions=(), entries=(), hour=6, only=None, code=None, fp_schema=FPS, **more):
        data = spark.createDataFrame(rows or [], "n int, word string, bad boolean")
        data.createOrReplaceTempView("probe_data")
        mine = configs.where(F.col("test_id").isin(only)) if only else configs
        mine = mine.withColumn("query_code", F.lit(code)) if code else mine
        log = run_rules(
            spark, mine, {"data": data} if rows is not None else {}, day(n).replace(hour=hour), str(tmp_path),
            spark.createDataFrame(list(suppressions), SUP), spark.createDataFrame(list(entries), "RiskEntryId string, ClosingDate string"),
            spark.createDataFrame(list(fps), fp_schema), **more,
        )
        return {r.TestName: r for r in log.collect()}

    run.configs = configs
    return run, str(tmp_path), spark


ROWS = [(1, "a", True), (2, "b", True), (3, "c", False)]


def test_a_failing_rule_is_one_error_row_and_the_others_run(world):
    run, folder, _ = world
    log = run(2, ROWS)
    assert {n: r.TestResult for n, r in log.items()} == {
        "python rule": "FAILED", "sql rule": "PASSED", "fails late": "ERROR", "no table": "ERROR", "strange type": "ERROR",
    }
    assert "CAST_INVALID_INPUT" in log["fails late"].ErrorMessage and log["fails late"].IncidentCount == 0
    first = log["python rule"]
    assert (first.IncidentCount, first.IncidentCountRaw, first.Threshold, first.ShouldActivateChannel) == (2, 2, 1, True)
    assert (log["sql rule"].RiskId, log["sql rule"].Frequency, log["sql rule"].ErrorMessage) == ("N/A", "DAILY", None)


def test_states_follow_the_logs_and_repeats_change_nothing(world):
    run, folder, spark = world

    def state(log):
        r = log["python rule"]
        return r.TestResult, r.IsSupressed, r.IsRecurrent, r.IsContinued

    assert state(run(1, ROWS)) == ("FAILED", False, False, False)
    assert state(run(2, ROWS)) == ("FAILED", False, False, True)
    assert state(run(2, ROWS)) == ("FAILED", False, False, True)
    open_entry = [("S", "T1", "E", True, day(1))]
    assert state(run(3, ROWS, suppressions=open_entry, entries=[("E", "")])) == ("FAILED", True, False, False)
    assert state(run(4, ROWS)) == ("FAILED", False, True, False)
    known = [("F", "python rule", None, '[{"column":"word","value":"a"}]', "u", dt.date(2024, 1, 1), "ok", True)]
    assert state(run(5, ROWS, fps=known))[0] == "PASSED"

    archive = read_findings(spark, f"{folder}/findings", "T1")
    assert archive.count() == 10 and archive.where("_is_false_positive").count() == 1
    assert archive.groupBy("archive_dt").count().agg(F.max("count")).first()[0] == 2
    logs = read_log(spark, folder, "tb_tests_executions")
    assert logs.where("TestName = 'python rule'").count() == 5
    # Day 5 is a Friday.
    assert logs.where("TestName = 'weekly'").count() == 1
    hashes = read_log(spark, folder, "tb_incident_hashes")
    assert hashes.where("test_name = 'fails late'").count() == 0
    # The stored hash is the fingerprint that replaying all history gives, whatever the size.
    found = archive.where("archive_dt = '2024-01-01'").select("n", "word", "bad").withColumns({"test_name": F.lit("python rule"), "day": F.lit(1)})
    assert {r.incident_hash for r in hashes.where("test_name = 'python rule'").collect()} == {set_hash(found, ["test_name", "day"]).first().incident_hash}
    assert hashes.where("test_name = 'sql rule' AND incident_hash IS NULL AND row_count = 0").count() == 5
    sent = [r.payload for r in read_log(spark, folder, "outbox").where("test_name = 'python rule'").orderBy("execution_date").collect()]
    assert len(sent) == 2 and '"incident_count":2' in sent[0]


def test_runs_of_one_day_are_kept_and_compared(world):
    run, folder, spark = world
    assert run(1, ROWS)["python rule"].IsContinued is False
    assert run(1, ROWS, hour=9, only=["T1"])["python rule"].IsContinued is True
    logs = read_log(spark, folder, "tb_tests_executions")
    assert logs.count() == 6 and logs.where("TestName = 'python rule'").count() == 2
    # Repeating one rule of the first run leaves the other rows of that run and the later run alone.
    assert set(run(1, ROWS[:1], only=["T1"])) == {"python rule"}
    logs = {(r.TestName, r.ExecutionDate.hour): r for r in read_log(spark, folder, "tb_tests_executions").collect()}
    assert len(logs) == 6 and logs["python rule", 6].IncidentCountRaw == 1 and logs["python rule", 9].IncidentCountRaw == 2
    assert read_findings(spark, f"{folder}/findings", "T1").count() == 3


def test_a_rule_that_fails_on_a_repeat_leaves_no_findings(world):
    run, folder, spark = world
    run(1, ROWS)
    run(1, [(1, "a", None)], only=["T1"])
    spark.createDataFrame([], "other int").createOrReplaceTempView("probe_other")
    log = run(1, None, only=["T1"])
    assert log["python rule"].TestResult == "ERROR" and read_findings(spark, f"{folder}/findings", "T1").count() == 0


def test_text_that_is_no_query_is_not_run(world):
    run, folder, spark = world
    spark.range(1).createOrReplaceTempView("victim")
    log = run(1, ROWS, code="drop view victim", only=["T2"])
    assert log["sql rule"].TestResult == "ERROR" and "not a select" in log["sql rule"].ErrorMessage
    assert spark.catalog.tableExists("victim")


def test_totals(world):
    run, folder, spark = world
    run(1, ROWS)
    log = read_log(spark, folder, "tb_tests_executions")
    assert tuple(run_totals(run.configs, log).first()) == (5, 1, 3)


def test_a_run_time_does_not_depend_on_the_machine(spark):
    stamp = spark.range(1).select(run_time(dt.datetime(2024, 2, 5, 22)).cast("string"), run_time(dt.datetime(2024, 2, 5, 22, tzinfo=dt.timezone.utc)).cast("string")).first()
    assert set(stamp) == {"2024-02-05 22:00:00"}


def test_only_a_missing_log_is_empty(spark, tmp_path):
    assert read_log(spark, str(tmp_path), "tb_tests_executions").count() == 0
    (tmp_path / "log" / "_versions").mkdir(parents=True)
    (tmp_path / "log" / "_versions" / "000000000001.json").write_text('{"runs": [{"path": "runs/gone", "level": 0, "rows": 1, "low": 0, "high": 0}]}')
    with pytest.raises(Exception):
        read_log(spark, str(tmp_path), "tb_tests_executions").count()


def test_older_logs_and_false_positives_lack_columns(world):
    run, folder, spark = world
    old = spark.createDataFrame([("T1", "python rule", dt.datetime(2023, 12, 30), "FAILED")], "test_id string, TestName string, ExecutionDate timestamp, TestResult string")
    RunLog(spark, folder).adopt(old, "tb_tests_executions")
    assert run(1, ROWS, fps=[("F", "python rule", "x", True)], fp_schema="fp_id string, test_name string, row_hash string, active boolean")["python rule"].TestResult == "FAILED"


def test_columns_added_later_are_null_before(world):
    _, folder, spark = world
    write_findings(spark.createDataFrame([(1,)], "a int"), folder, "r", day(1))
    write_findings(spark.createDataFrame([(2, "x")], "a int, b string"), folder, "r", day(2))
    assert [(r.a, r.b) for r in read_findings(spark, folder, "r").orderBy("a").collect()] == [(1, None), (2, "x")]


def test_unknown_schedules_are_errors_not_silence(spark):
    configs = spark.createDataFrame(
        [("T1", "a", "DAILY", "ACTIVE"), ("T2", "b", None, "ACTIVE"), ("T3", "c", "Yearly", "ACTIVE"), ("T4", "d", "DAILY", "PAUSED"), ("T5", "e", "monthly", "ACTIVE")],
        "test_id string, test_name string, frequency string, status string",
    )
    due = runs_due(configs, dt.date(2024, 1, 5), dt.date(2024, 1, 6)).groupBy("test_name", "gate").count().collect()
    assert {(r.test_name, r.gate): r["count"] for r in due} == {("a", "RUN"): 2, ("b", "RUN"): 2, ("c", "ERROR"): 2, ("e", "RUN"): 1}
    with pytest.raises(ValueError):
        runs_due(configs, dt.date(2024, 1, 5), dt.date(2024, 1, 4))


def with_rule(run, body, test_id="T9"):
    """The usual rules and one more."""
    more = [(test_id, body, "tb_incidents_9", "d", "area", "R1", 0, "DAILY", "PYTHON", body, "ACTIVE", True)]
    return run.configs.unionByName(run.configs.sparkSession.createDataFrame(more, CONFIG))


def run_with(world, body, rows=ROWS, **more):
    run, folder, spark = world
    data = spark.createDataFrame(rows, "n int, word string, bad boolean")
    data.createOrReplaceTempView("probe_data")
    nothing = [spark.createDataFrame([], s) for s in (SUP, "RiskEntryId string, ClosingDate string", FPS)]
    return {r.TestName: r for r in run_rules(spark, with_rule(run, body), {"data": data}, day(2), folder, *nothing, **more).collect()}


@pytest.mark.parametrize("body", ["never ends in a task", "never ends in the driver"])
def test_a_rule_over_its_limit_is_an_error_and_the_others_finish(world, body):
    started = time.monotonic()
    log = run_with(world, body, limits={body: 2.0}, workers=2)
    assert log[body].TestResult == "ERROR" and "over its limit of 2 seconds" in log[body].ErrorMessage
    assert log["python rule"].IncidentCountRaw == 2 and log["sql rule"].TestResult == "PASSED"
    assert time.monotonic() - started < 60
    _, folder, spark = world
    assert read_findings(spark, f"{folder}/findings", "T9").count() == 0
    assert spark.range(100).repartition(4).count() == 100  # no task is left that blocks others


def test_all_places_taken_by_rules_that_never_end(spark):
    def body(item, attempt):
        while item < 3:
            time.sleep(0.05)
        attempt.begin_writing()
        return item

    found = run_all(spark, range(6), body, workers=2, limit=lambda item: 0.5, patience=0.3)
    assert [(i, v) for i, v, *_ in found] == [(0, None), (1, None), (2, None), (3, 3), (4, 4), (5, 5)]
    assert all("over its limit" in e for _, _, e, _ in found[:3])


def test_what_is_left_behind_does_not_write(spark):
    late = threading.Event()
    wrote = []

    def body(item, attempt):
        late.wait()
        attempt.begin_writing()
        wrote.append(item)

    assert run_all(spark, [1], body, limit=lambda item: 0.3, patience=0.1)[0][1] is None
    late.set()
    time.sleep(0.5)
    assert wrote == []


def test_a_folder_that_cannot_be_written_is_an_error_row(world):
    _, folder, _ = world
    os.makedirs(f"{folder}/findings")
    with open(f"{folder}/findings/T9", "w") as f:
        f.write("in the way")
    log = run_with(world, "bad rows")
    assert log["bad rows"].TestResult == "ERROR" and "while its findings were cleared" in log["bad rows"].ErrorMessage
    assert log["python rule"].IncidentCountRaw == 2


def test_tasks_that_are_repeated_count_once(world):
    _, folder, spark = world
    rows = [(i, None if i % 7 == 0 else f"w{i % 5}", True) for i in range(500)]
    log = run_with(world, "loses tasks", rows)
    assert (log["loses tasks"].IncidentCountRaw, log["loses tasks"].IncidentCount) == (500, 500)
    plain = spark.createDataFrame(rows, "n int, word string, bad boolean").withColumns({"test_name": F.lit("x"), "day": F.lit(1)})
    hashes = read_log(spark, folder, "tb_incident_hashes").where("test_name = 'loses tasks'").first()
    assert hashes.incident_hash == set_hash(plain, ["test_name", "day"]).first().incident_hash


def test_one_pass_flags_like_the_matcher(spark):
    """Criteria on one column, on several, on unknown ones, on the whole row, and unreadable ones."""
    rows = spark.createDataFrame([(i % 5, None if i % 3 == 0 else f"w{i % 4}") for i in range(60)], "n int, word string")
    whole = rows.withColumn("h", fp_row_hash(rows.columns)).where("n = 1 AND word = 'w1'").first().h
    marks = [
        ('[{"column":"n","value":"2"}]', None), ('[{"column":"word","value":""},{"column":"n","value":"3"}]', None),
        ('[{"column":"n","value":"4"},{"column":"no such","value":""}]', None), ("not json", whole), (None, ""),
    ]
    fps = spark.createDataFrame([(f"F{i}", "r", h, c, "u", dt.date(2024, 1, 1), "", True) for i, (c, h) in enumerate(marks)], FPS)
    want = flag_false_positives(rows, fps, [], rule="r")
    got = flag_in_one_pass(rows, fps, "r", criteria_shapes(fps)["r"])
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert 0 < got.where("_is_false_positive").count() < 60
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan ExistingRDD") + plan.count("LocalTableScan") >= 1 and "CartesianProduct" not in plan


def test_many_sets_of_criteria(world):
    run, folder, spark = world
    fps = [(f"F{i}", "python rule", None, json.dumps([{"column": c, "value": "a"} for c in names]), "u", dt.date(2024, 1, 1), "", True)
           for i, names in enumerate([["word"], *[[f"c{k}", "word"] for k in range(12)]])]
    assert run(1, ROWS, fps=fps)["python rule"].IncidentCount == 1


def test_runs_within_one_second_and_in_another_offset_stay_apart(spark, tmp_path):
    one = dt.datetime(2024, 1, 1, 6, 0, 0, 1)
    for run_ts, n in ((one, 1), (one.replace(microsecond=2), 2), (dt.datetime(2024, 1, 1, 23, tzinfo=dt.timezone(dt.timedelta(hours=-3))), 3)):
        write_findings(spark.range(n), str(tmp_path), "r", run_ts)
    found = read_findings(spark, str(tmp_path), "r")
    assert found.count() == 6
    # The folder's day is the stamp's day.
    assert found.where("CAST(archive_dt AS date) <> CAST(ArchiveDate AS date)").count() == 0
