"""Alert states: suppression, continuity, status ladder, outbox."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from rulewatch.functions.predicates import is_blank
from rulewatch.operators.grouping import latest_per_key


def open_suppressions(suppressions: DataFrame, entries: DataFrame) -> DataFrame:
    """Rules with an active suppression whose risk entry is open, and since when.

    An entry that does not exist counts as open.  Gives ``(test_id, open_since)``.
    """
    closed = entries.where(~is_blank("ClosingDate")).select(
        F.col("RiskEntryId").alias("linked_entry_id")
    )
    still_open = entries.where(is_blank("ClosingDate")).select(
        F.col("RiskEntryId").alias("linked_entry_id")
    )
    # Only entries known as closed and under no open row of the same id count as closed.
    shut = closed.join(still_open, "linked_entry_id", "left_anti")
    return (
        suppressions.where(F.col("active") & F.col("test_id").isNotNull())
        .join(shut, "linked_entry_id", "left_anti")
        .groupBy("test_id")
        .agg(F.min("created_at").alias("open_since"))
    )


def alert_state(
    result: Column, suppressed: Column, channel: Column,
    this_hash: Column, prev_hash: Column, prev_run: Column,
) -> dict[str, Column]:
    """The state columns of a run from its own result and the run before it.

    ``prev_hash`` is a struct ``(incident_hash)`` of the last hash-log row, or NULL
    if there is none; ``prev_run`` a struct ``(result, suppressed)`` of the last
    run-log row.
    """
    failed = result == "FAILED"
    is_suppressed = failed & suppressed
    same = prev_hash.isNotNull() & prev_hash["incident_hash"].eqNullSafe(this_hash)
    was_flagged = F.coalesce(prev_run["result"] == "FAILED", F.lit(False)) & ~F.coalesce(
        prev_run["suppressed"], F.lit(False)
    )
    open_alert = failed & ~suppressed
    continued = open_alert & same & was_flagged
    recurrent = open_alert & same & ~was_flagged
    return {
        "is_suppressed": is_suppressed,
        "is_recurrent": recurrent,
        "is_continued": continued,
        "should_notify": open_alert & ~continued & channel,
        "alert_state": F.when(result == "ERROR", "error")
        .when(~failed, "clean")
        .when(is_suppressed, "suppressed")
        .when(continued, "continued")
        .when(recurrent, "recurrent")
        .otherwise("new"),
    }


def classify_history(runs: DataFrame, order: list[str]) -> DataFrame:
    """Alert state of every run of every rule, in one window pass.

    ``runs`` has one row per rule and run: ``test_name``, the ``order`` columns,
    ``result`` (PASSED, FAILED, ERROR), ``incident_hash``, ``suppressed`` and
    ``channel``.  A state depends on the run before, never on the state before, so
    no step-by-step replay is needed.  An ERROR run leaves no hash; a run with no
    findings leaves a NULL hash, which is not the same as leaving none.

    Findings are already counted here, so a window group is the runs of one rule:
    one row per scheduled day, some 3,650 in ten years.
    """
    before = (
        Window.partitionBy("test_name")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    failed = F.col("result") == "FAILED"
    this_run = F.struct("result", (failed & F.col("suppressed")).alias("suppressed"))
    this_hash = F.when(F.col("result") != "ERROR", F.struct("incident_hash"))
    states = alert_state(
        F.col("result"), F.col("suppressed"), F.col("channel"),
        F.col("incident_hash"), F.col("_prev_hash"), F.col("_prev_run"),
    )
    return (
        runs.withColumns(
            {
                "_prev_run": F.last(this_run).over(before),
                "_prev_hash": F.last(this_hash, ignorenulls=True).over(before),
            }
        )
        .withColumns(states)
        .drop("_prev_run", "_prev_hash")
    )


def classify_run(runs: DataFrame, run_log: DataFrame, hash_log: DataFrame) -> DataFrame:
    """Alert state of new runs, one per rule, from the stored logs."""
    prev_run = run_log.groupBy(F.col("TestName").alias("test_name")).agg(
        F.max_by(
            F.struct(F.col("TestResult").alias("result"), F.col("IsSupressed").alias("suppressed")),
            "ExecutionDate",
        ).alias("_prev_run")
    )
    prev_hash = hash_log.groupBy("test_name").agg(
        F.max_by(F.struct("incident_hash"), "execution_date").alias("_prev_hash")
    )
    return classify_after(runs, prev_run.join(prev_hash, "test_name", "full"))


def classify_after(runs: DataFrame, previous: DataFrame) -> DataFrame:
    """Alert state of new runs from ``test_name, _prev_run, _prev_hash``, one row a rule."""
    joined = runs.join(previous, "test_name", "left")
    states = alert_state(
        F.col("result"), F.col("suppressed"), F.col("channel"),
        F.col("incident_hash"), F.col("_prev_hash"), F.col("_prev_run"),
    )
    return joined.withColumns(states).drop("_prev_run", "_prev_hash")


def latest_runs(run_log: DataFrame) -> DataFrame:
    return latest_per_key(run_log, ["TestName"], ["ExecutionDate"])


def any_active_suppression(suppressions: DataFrame) -> DataFrame:
    """Rules with an active suppression, whether or not its entry is still open."""
    return (
        suppressions.where(F.col("active"))
        .groupBy("test_id")
        .agg(F.min("suppression_id").alias("suppression_id"))
    )


def status_ladder(suppressed: Column) -> Column:
    """The seven status labels (fixed values) of a rule's latest run."""
    result = F.col("TestResult")
    return (
        F.when(result.isNull(), "nunca_rodou")
        .when(result == "PASSED", "sem_achados")
        .when(result == "ERROR", "erro")
        .when(suppressed & (result == "FAILED"), "em_tratamento")
        .when(F.col("IsRecurrent"), "reincidente")
        .when(F.col("IsContinued"), "persistente")
        .when(result == "FAILED", "novo_achado")
        .otherwise("sem_achados")
    )


def rule_status(
    configs: DataFrame, run_log: DataFrame, suppressions: DataFrame | None = None
) -> DataFrame:
    """Every rule with its latest run and status label.

    Without a suppression table the stored ``IsSupressed`` of the run is used, of
    any result, as the degraded form does.
    """
    latest = latest_runs(run_log).withColumnRenamed("TestName", "test_name")
    out = configs.join(latest, "test_name", "left")
    if suppressions is None:
        flag = F.coalesce(F.col("IsSupressed"), F.lit(False))
        ladder = F.when(
            flag & ~F.coalesce(F.col("TestResult").isin("PASSED", "ERROR"), F.lit(False)),
            "em_tratamento",
        ).otherwise(status_ladder(F.lit(False)))
        return out.withColumns({"has_active_suppression": F.lit(False), "alert_status": ladder})
    active = any_active_suppression(suppressions)
    has = F.col("suppression_id").isNotNull()
    return (
        out.join(active, "test_id", "left")
        .withColumns({"has_active_suppression": has, "alert_status": status_ladder(has)})
        .drop("suppression_id")
    )


def outbox(runs: DataFrame, configs: DataFrame) -> DataFrame:
    """One message row per run that should notify; sending is someone else's job.

    The id is a hash of rule and run, so a repeated run gives the same message.
    """
    message = {
        "test_name": "test_name",
        "description": "description",
        "responsible_area": "responsible_area",
        "risk_id": "risco_id",
        "output_table": "output_table",
        "threshold": "threshold",
        "incident_count": "clean_count",
        "execution_date": "execution_date",
    }
    return (
        runs.where(F.col("should_notify"))
        .select("test_name", "execution_date", "threshold", "clean_count")
        .join(configs.select("test_name", "description", "responsible_area", "risco_id", "output_table"), "test_name")
        .select(
            F.sha2(F.concat_ws("::", "test_name", "execution_date"), 256).alias("message_id"),
            "test_name",
            "execution_date",
            F.to_json(F.struct(*[F.col(c).alias(n) for n, c in message.items()])).alias("payload"),
        )
    )
