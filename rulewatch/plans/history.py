"""All rules and all past days in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rulewatch.operators.alerts import classify_history, open_suppressions
from rulewatch.operators.findings import run_counts, run_result


def summarise_runs(
    runs: DataFrame, findings: DataFrame, false_positives: DataFrame, configs: DataFrame,
    suppressions: DataFrame, entries: DataFrame,
) -> DataFrame:
    """One row per rule and run day: counts, fingerprint, result, suppression.

    ``runs`` has ``test_name``, ``run_date`` and ``broken``; a broken run is an ERROR
    whatever it found.  Findings are reduced to one row per run before any join.
    """
    keys = ["test_name", "run_date"]
    rules = configs.select(
        "test_name", "test_id", "threshold", F.col("should_activate_channel").alias("_channel")
    )
    quiet = open_suppressions(suppressions, entries)
    ok = ~F.col("broken")
    clean = F.when(ok, F.coalesce("clean_count", F.lit(0))).otherwise(0).cast("bigint")
    threshold = F.coalesce("threshold", F.lit(0))
    return (
        runs.join(run_counts(findings, false_positives, keys), keys, "left")
        .join(rules, "test_name", "left")
        .join(quiet, "test_id", "left")
        .select(
            *keys,
            "test_id",
            F.when(ok, F.coalesce("row_count", F.lit(0))).alias("row_count"),
            clean.alias("clean_count"),
            F.when(ok, F.col("incident_hash")).alias("incident_hash"),
            threshold.alias("threshold"),
            F.when(ok, run_result(clean, threshold)).otherwise("ERROR").alias("result"),
            F.coalesce(F.col("open_since") <= F.col("run_date"), F.lit(False)).alias("suppressed"),
            F.coalesce("_channel", F.lit(True)).alias("channel"),
        )
    )


def replay(
    runs: DataFrame, findings: DataFrame, false_positives: DataFrame, configs: DataFrame,
    suppressions: DataFrame, entries: DataFrame,
) -> DataFrame:
    """The alert state of every run of every rule."""
    summary = summarise_runs(runs, findings, false_positives, configs, suppressions, entries)
    return classify_history(summary, ["run_date"])


def error_rows(states: DataFrame) -> DataFrame:
    """The log rows of failed runs: no count, no fingerprint, one row per run."""
    return states.where(F.col("result") == "ERROR").select(
        "test_name", "run_date", "clean_count", "row_count", "incident_hash", "result", "alert_state"
    )
