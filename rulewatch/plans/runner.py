"""The daily run over all due rules.

Each rule is one job: its body is evaluated, flagged and written once, and the tasks that write sum what
its counts and its fingerprint need.  What reaches the driver is one small row a rule; nothing written is read
again.  A rule that fails, or that is not done within its limit of time, becomes one ERROR row and the others
go on.  Rules may run several times a day: a run is compared with the logged runs before it, and repeating it
replaces just its own rows.
"""

from __future__ import annotations

import datetime as dt
import traceback
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from rulewatch.functions.calendar import frequency_of, is_due
from rulewatch.operators.alerts import classify_after, open_suppressions, outbox
from rulewatch.operators.findings import (
    SUMS_DDL, criteria_shapes, flag_false_positives, flag_in_one_pass, run_result, set_sums, summed_hash,
)
from rulewatch.plans.deadline import run_all
from rulewatch.plans.lint import rule_code
from rulewatch.rules.registry import build
from rulewatch.sources.archive import moment_of, run_time, write_counted, write_findings
from rulewatch.sources.logs import RunLog, previous_of, run_log_of
from rulewatch.sources.schemas import CONTROL_DDL, control_schema, to_schema, widen

LIMIT_SECONDS = 7_200.0  # for one rule
SHAPES = 8  # sets of criteria columns that a rule's findings are looked up by in the job that writes them

# What is left in the archive of a run whose rule failed.
NO_FINDINGS = "_is_false_positive boolean"


def due_calendar(spark: SparkSession, first: dt.date, last: dt.date) -> DataFrame:
    """``(run_date, frequency)`` for every schedule due on every day."""
    days = (last - first).days + 1
    if days < 1:
        raise ValueError(f"{last} lies before {first}")
    run_date = F.date_add(F.lit(first), F.col("id").cast("int"))
    return (
        spark.range(days)
        .select(run_date.alias("run_date"), F.explode(F.array(*map(F.lit, ("DAILY", "WEEKLY", "MONTHLY")))).alias("_frequency"))
        .where(is_due(F.col("_frequency"), F.col("run_date")))
    )


def runs_due(configs: DataFrame, first: dt.date, last: dt.date) -> DataFrame:
    """Active rules by the days they are due; an unknown schedule gives ``gate='ERROR'``."""
    calendar = due_calendar(configs.sparkSession, first, last)
    active = configs.where(F.col("status") == "ACTIVE").select(
        "test_id", "test_name", frequency_of(F.col("frequency")).alias("_frequency")
    )
    known = F.col("_frequency").isin("DAILY", "WEEKLY", "MONTHLY")
    due = active.where(known).join(calendar, "_frequency").withColumn("gate", F.lit("RUN"))
    unknown = active.where(~known).select(
        "*", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("run_date"), F.lit("ERROR").alias("gate")
    )
    return due.unionByName(unknown).withColumnRenamed("_frequency", "frequency")


def _findings(spark, config, tables, as_of, params) -> DataFrame:
    if config["gate"] == "ERROR":
        raise ValueError(f"unknown frequency: {config['frequency']}")
    if config["code_error"]:
        raise ValueError(f"the code may not run: {config['code_error']}")
    kind = (config["query_type"] or "").upper()
    if kind == "SQL":
        return spark.sql(config["query_code"])
    if kind == "PYTHON":
        # The code of such a rule is the name of a registered function.
        return build(config["query_code"], tables, as_of, **params.get(config["query_code"], {}))
    raise ValueError(f"unknown query type: {config['query_type']}")


def run_totals(configs: DataFrame, log: DataFrame) -> DataFrame:
    """One row: active rules that ran, that were not due, and that failed, in a run's log."""
    ran = log.select(F.col("TestName").alias("test_name"), "TestResult")
    every = configs.where(F.col("status") == "ACTIVE").select("test_name").join(ran, "test_name", "left")
    return every.agg(
        F.count("TestResult").alias("executed"),
        F.count_if(F.col("TestResult").isNull()).alias("skipped"),
        F.count_if(F.col("TestResult") == "ERROR").alias("errors"),
    )


def run_rules(
    spark: SparkSession,
    configs: DataFrame,
    tables: Mapping[str, DataFrame],
    run_ts: dt.datetime,
    folder: str,
    suppressions: DataFrame,
    entries: DataFrame,
    false_positives: DataFrame,
    params: Mapping[str, dict] | None = None,
    workers: int = 4,
    limit_seconds: float | None = LIMIT_SECONDS,
    limits: Mapping[str, float] | None = None,
) -> DataFrame:
    """Run every rule due at ``run_ts``; returns their run-log rows as written.

    ``folder`` gets ``findings/<rule>`` by run and ``log``, see ``sources.logs``.  A rule that is not done
    after ``limit_seconds``, or its own of ``limits`` (by rule name), is an error.  To repeat single rules of a run, give their configurations only.
    """
    at, params = moment_of(spark, run_ts), params or {}
    as_of = dt.date.fromisoformat(at.day)
    false_positives = widen(false_positives, control_schema("tb_false_positives"))
    configs = widen(configs, to_schema(CONTROL_DDL["tb_test_configurations"]))
    due = runs_due(configs, as_of, as_of).select("test_id", "frequency", "gate")
    wrong = rule_code(configs.where(F.upper("query_type") == "SQL")).select("test_id", F.col("error").alias("code_error"))
    # One row per rule: the driver needs them, since every rule is a plan of its own.
    todo = [
        r.asDict()
        for r in configs.drop("frequency").join(due, "test_id").join(wrong, "test_id", "left").collect()
    ]
    for name in ("test_id", "test_name"):
        if len({c[name] for c in todo}) < len(todo):
            raise ValueError(f"two rules to run have one {name}")
    names = [c["test_name"] for c in todo]
    shapes = criteria_shapes(false_positives.where(F.col("test_name").isin(names)))

    def run_one(config, attempt):
        rule, test_id = config["test_name"], config["test_id"]
        found = _findings(spark, config, tables, as_of, params)
        if len(shapes.get(rule, ())) > SHAPES:  # too many look-ups for one plan: the findings are matched from a copy
            attempt.begin_writing()
            found = spark.read.parquet(write_findings(found, f"{folder}/raw_findings", test_id, run_ts)).drop("ArchiveDate")
            found = flag_false_positives(found, false_positives, [], rule=rule)
        else:
            found = flag_in_one_pass(found, false_positives, rule, shapes.get(rule, []))
        attempt.begin_writing()
        return write_counted(found, f"{folder}/findings", test_id, run_ts)

    outcomes = run_all(spark, todo, run_one, workers, lambda config: (limits or {}).get(config["test_name"], limit_seconds))
    facts = []
    for config, sums, error, seconds in outcomes:
        if error is not None:
            sums, seconds = {}, 0.0
            error += _clear(spark, folder, config["test_id"], run_ts)
        facts.append((config["test_id"], config["test_name"], seconds, error, *[sums.get(n) for n in set_sums()]))
    facts = spark.createDataFrame(facts, f"test_id string, test_name string, seconds float, error string, {SUMS_DDL}")
    log = RunLog(spark, folder)
    before = log.before(at, facts)
    states = classify_after(_runs(configs, facts, due, run_ts, suppressions, entries), previous_of(before))
    sent = outbox(states, configs).select("test_name", "message_id", "payload")
    return run_log_of(log.add(states.join(sent, "test_name", "left"), before, at)).drop("test_id")


def _clear(spark: SparkSession, folder: str, test_id: str, run_ts: dt.datetime) -> str:
    """Leave no findings of an earlier attempt of this run; if that fails too, the log still says what happened."""
    try:
        write_findings(spark.createDataFrame([], NO_FINDINGS), f"{folder}/findings", test_id, run_ts)
        return ""
    except Exception:
        return f"\nwhile its findings were cleared:\n{traceback.format_exc()}"


def _runs(configs, facts, due, run_ts, suppressions, entries) -> DataFrame:
    """One row per rule of this run, ready to be classified."""
    quiet = open_suppressions(suppressions, entries).where(F.col("open_since") <= run_time(run_ts))
    clean = F.coalesce("clean_count", F.lit(0))
    threshold = F.coalesce("threshold", F.lit(0))
    return (
        facts.withColumn("incident_hash", summed_hash())
        .join(configs.drop("test_name", "frequency"), "test_id")
        .join(due.select("test_id", "frequency"), "test_id")
        .join(quiet, "test_id", "left")
        .withColumns(
            {
                "description": F.coalesce("description", F.lit("")),
                "responsible_area": F.coalesce("responsible_area", F.lit("")),
                "risco_id": F.coalesce("risco_id", F.lit("N/A")),
                "threshold": threshold,
                "clean_count": clean,
                "result": F.when(F.col("error").isNotNull(), "ERROR").otherwise(run_result(clean, threshold)),
                "suppressed": F.col("open_since").isNotNull(),
                "channel": F.coalesce("should_activate_channel", F.lit(True)),
                "execution_date": run_time(run_ts),
            }
        )
    )
