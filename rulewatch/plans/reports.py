"""Reports over rules, runs, suppressions and false positives.

Each report reads the run log once and joins small per-rule aggregates; the
filters of the dashboard are plain predicates that Spark pushes to the scan.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from rulewatch.functions.calendar import since_days
from rulewatch.functions.predicates import contains_text, date_scope, is_blank, optional_filters
from rulewatch.functions.values import preview
from rulewatch.operators.alerts import rule_status
from rulewatch.operators.findings import flag_false_positives
from rulewatch.operators.grouping import first_per_key, latest_per_key, page_after, recent_per_key, top_groups, trend
from rulewatch.operators.joins import lookup_join
from rulewatch.plans.lint import rule_code
from rulewatch.sources.archive import Archive
from rulewatch.sources.export import export_rows
from rulewatch.sources.tables import find_column


def _rows(wide: DataFrame, key: str, counts: list[str]) -> DataFrame:
    """Columns of a one-row frame as ``(key, cnt)`` rows."""
    return wide.select(
        F.inline(F.array(*[F.struct(F.lit(c).alias(key), F.col(c).alias("cnt")) for c in counts]))
    )


def active(configs: DataFrame) -> DataFrame:
    return configs.where(F.col("status") == "ACTIVE")


def config_filter(area: str | None = None, test_name: str | None = None, notify: bool | None = None) -> Column:
    return optional_filters(
        {
            "responsible_area": ("=", area),
            "test_name": ("=", test_name),
            "should_activate_channel": ("=", notify),
        }
    )


def run_filter(date_from: str | None = None, date_to: str | None = None, result: str | None = None) -> Column:
    """Runs between two moments; a plain date as the end means its midnight."""
    test = optional_filters({"TestResult": ("=", result)})
    if date_from is not None:
        test = test & (F.col("ExecutionDate") >= F.lit(date_from).cast("timestamp_ntz"))
    if date_to is not None:
        test = test & (F.col("ExecutionDate") <= F.lit(date_to).cast("timestamp_ntz"))
    return test


def portfolio_stats(configs: DataFrame, run_log: DataFrame, suppressions: DataFrame, as_of) -> DataFrame:
    """Rules by status, results of the last 30 days, active rules by alert status."""
    status = F.col("status")
    rules = configs.agg(
        F.count_if(status == "ACTIVE").alias("active"),
        F.count_if(status == "PAUSED").alias("paused"),
        F.count_if(status.isin("UNDER_REVIEW", "PENDING_DELETE")).alias("under_review"),
    )
    result = F.col("TestResult")
    runs = run_log.where(since_days("ExecutionDate", as_of, 30)).agg(
        F.count_if(result == "PASSED").alias("cleared"),
        F.count_if(result == "FAILED").alias("flagged"),
        F.count_if(result == "ERROR").alias("error"),
    )
    alerts = (
        rule_status(active(configs), run_log, suppressions)
        .groupBy(F.col("alert_status").alias("label"))
        .agg(F.count(F.lit(1)).alias("cnt"))
    )
    sections = {
        "rules": _rows(rules, "label", rules.columns),
        "runs": _rows(runs, "label", runs.columns),
        "alerts": alerts,
    }
    out = None
    for name, frame in sections.items():
        part = frame.select(F.lit(name).alias("section"), "label", "cnt")
        out = part if out is None else out.unionByName(part)
    return out


def coverage(configs: DataFrame, **filters) -> DataFrame:
    """Active rules, and the risks and areas they cover, in one aggregation."""
    risk = F.when(F.col("risco_id") != "N/A", F.col("risco_id"))
    return active(configs).where(config_filter(**filters)).agg(
        F.count(F.lit(1)).alias("total_tests"),
        F.countDistinct(risk).alias("risks_covered"),
        F.countDistinct("responsible_area").alias("areas_covered"),
    )


def run_kpis(
    configs: DataFrame, run_log: DataFrame, date_from=None, date_to=None, result=None, **filters
) -> DataFrame:
    """Runs in total, cleared, flagged and in error; counted per rule before the join."""
    rules = configs.where(config_filter(**filters)).select(F.col("test_name").alias("TestName"))
    outcome = F.col("TestResult")
    counts = {
        "runs_total": F.count(F.lit(1)),
        "runs_cleared": F.count_if(outcome == "PASSED"),
        "runs_flagged": F.count_if(outcome == "FAILED"),
        "runs_error": F.count_if(outcome == "ERROR"),
    }
    per_rule = (
        run_log.where(run_filter(date_from, date_to, result))
        .groupBy("TestName")
        .agg(*[c.alias(n) for n, c in counts.items()])
    )
    return per_rule.join(rules, "TestName").agg(
        *[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in counts]
    )


def rules_by_area(configs: DataFrame, **filters) -> DataFrame:
    return (
        active(configs)
        .where(config_filter(**filters))
        .groupBy(F.col("responsible_area").alias("area"))
        .agg(F.count(F.lit(1)).alias("cnt"))
        .orderBy(F.desc("cnt"), "area")
    )


def rules_by_risk(configs: DataFrame, risks: DataFrame, n: int = 20, **filters) -> DataFrame:
    """The risks with the most active rules; a risk without a title shows its id."""
    rules = active(configs).where(config_filter(**filters) & (F.col("risco_id") != "N/A"))
    counts = top_groups(rules, "risco_id", F.count(F.lit(1)), n)
    titles = risks.select(F.col("RiskId").alias("risco_id"), "RiskTitle")
    return (
        counts.join(titles, "risco_id", "left")
        .select("risco_id", F.coalesce("RiskTitle", "risco_id").alias("risk_title"), "cnt")
        .orderBy(F.desc("cnt"), "risco_id")
    )


def rules_with_open_entries(
    configs: DataFrame, suppressions: DataFrame, entries: DataFrame, n: int = 20
) -> DataFrame:
    """Active rules by the number of existing open entries they are linked to."""
    linked = (
        suppressions.where(F.col("active"))
        .select("test_id", F.col("linked_entry_id").alias("RiskEntryId"))
        .distinct()
    )
    still_open = entries.where(is_blank("ClosingDate")).select("RiskEntryId").distinct()
    links = (
        linked.join(still_open, "RiskEntryId", "left_semi")
        .groupBy("test_id")
        .agg(F.count(F.lit(1)).alias("open_entries"))
    )
    return (
        active(configs)
        .join(links, "test_id")
        .select("test_name", "risco_id", "responsible_area", "open_entries")
        .orderBy(F.desc("open_entries"), "test_name")
        .limit(n)
    )


def fp_counts(false_positives: DataFrame) -> DataFrame:
    return (
        false_positives.where(F.col("active")).groupBy("test_name").agg(F.count(F.lit(1)).alias("fp_count"))
    )


def shown_incidents(raw: str = "IncidentCountRaw", clean: str = "IncidentCount") -> Column:
    """Raw count (else the clean one) less the number of false-positive *rules*, not below 0.

    An estimate, as shown in lists; the run itself counts matched rows exactly.
    """
    return F.greatest(
        F.lit(0).cast("bigint"),
        F.coalesce(F.col(raw), F.col(clean), F.lit(0)).cast("bigint") - F.coalesce("fp_count", F.lit(0)),
    )


def status_by_rule(
    configs: DataFrame, run_log: DataFrame, false_positives: DataFrame,
    date_from=None, date_to=None, **filters,
) -> DataFrame:
    """Last result of every active rule and its runs in the range.

    Latest run and counts come from a single aggregation of the run log; rules
    without runs in the range stay.
    """
    in_range = run_filter(date_from, date_to)
    last = F.struct("TestResult", "IncidentCountRaw", "IncidentCount", "ExecutionDate")
    runs = run_log.groupBy(F.col("TestName").alias("test_name")).agg(
        F.max_by(last, "ExecutionDate").alias("last"),
        F.count_if(in_range & F.col("TestResult").isNotNull()).alias("total_runs"),
        F.count_if(in_range & (F.col("TestResult") == "FAILED")).alias("flagged_runs"),
    )
    return (
        active(configs)
        .where(config_filter(**filters))
        .join(runs, "test_name", "left")
        .join(fp_counts(false_positives), "test_name", "left")
        .select(
            "test_name",
            "responsible_area",
            "risco_id",
            F.col("last.TestResult").alias("last_result"),
            shown_incidents("last.IncidentCountRaw", "last.IncidentCount").alias("last_incidents"),
            F.col("last.ExecutionDate").alias("last_run"),
            F.coalesce("total_runs", F.lit(0)).alias("total_runs"),
            F.coalesce("flagged_runs", F.lit(0)).alias("flagged_runs"),
        )
        .orderBy(F.desc("flagged_runs"), "test_name")
    )


def rule_list(
    configs: DataFrame, run_log: DataFrame, suppressions: DataFrame, false_positives: DataFrame
) -> DataFrame:
    """All rules with status, last run, false positives and suppression; newest edit first."""
    return (
        rule_status(configs, run_log, suppressions)
        .join(fp_counts(false_positives), "test_name", "left")
        .select(
            *configs.columns,
            F.col("TestResult").alias("last_result"),
            F.col("ExecutionDate").alias("last_run"),
            shown_incidents().alias("last_incident_count"),
            F.coalesce("fp_count", F.lit(0)).alias("active_fp_count"),
            "has_active_suppression",
            F.col("alert_status").alias("last_alert_status"),
        )
        .orderBy(F.desc("updated_at"), "test_name")
    )


def run_trend(run_log: DataFrame, n: int = 14) -> DataFrame:
    """Date, count and result of the last runs per rule, oldest first."""
    fields = {
        "d": F.col("ExecutionDate"),
        "n": F.coalesce("IncidentCount", F.lit(0)),
        "r": F.col("TestResult"),
    }
    return trend(run_log, "TestName", ["ExecutionDate"], fields, n)


def run_history(
    run_log: DataFrame, test_name: str | None = None, limit: int = 20, after: tuple | None = None
) -> DataFrame:
    """A page of runs, newest first, of one rule or of all.

    ``after`` is the last (ExecutionDate, TestName) of the page before.
    """
    rows = run_log.where(optional_filters({"TestName": ("=", test_name)}))
    return page_after(rows, "ExecutionDate", "TestName", after, limit)


def config_history(history: DataFrame, test_id: str | None = None) -> DataFrame:
    """Changes of one rule or of all, newest first."""
    rows = history.where(optional_filters({"test_id": ("=", test_id)}))
    return rows.orderBy(F.desc("changed_at"), F.desc("history_id"))


def hash_history(hash_log: DataFrame, n: int = 30) -> DataFrame:
    """The last fingerprints of every rule, by their first characters."""
    return recent_per_key(hash_log, "test_name", ["execution_date"], n).select(
        "test_name",
        "execution_date",
        "row_count",
        "is_suppressed",
        "is_recurrent",
        preview("incident_hash").alias("hash_preview"),
        "rn",
    )


def same_as_previous(hash_log: DataFrame) -> DataFrame:
    """Per rule, whether its two newest fingerprints are filled and equal."""
    newest = recent_per_key(hash_log, "test_name", ["execution_date"], 2)
    first = F.max(F.when(F.col("rn") == 1, F.col("incident_hash")))
    second = F.max(F.when(F.col("rn") == 2, F.col("incident_hash")))
    return newest.groupBy("test_name").agg(
        F.coalesce((first == second) & (first != ""), F.lit(False)).alias("is_same_as_previous")
    )


# Columns of an archive that no rule made.
ARCHIVE_KEYS = ("ArchiveDate", "archive_dt", "run_at")


def in_view(archive: DataFrame, search: str | None = None, day_column: Column | None = None, **scope) -> DataFrame:
    """The findings of the scope that hold the text."""
    days = date_scope(archive, search=search, day_column=day_column, **scope)
    return archive.where(days & contains_text(archive, search))


def findings_view(
    archive: DataFrame, false_positives: DataFrame, test_name: str, order: list[str],
    search: str | None = None, *, limit: int, day_column: Column | None = None, **scope,
) -> DataFrame:
    """A page of a rule's findings, newest first, with the false positive each matches.

    The stored flag is dropped: matching uses the false positives as they are now.
    The page is cut before matching, so only its rows are matched.
    """
    rows = in_view(archive, search, day_column, **scope)
    shown = rows.drop("_is_false_positive").orderBy(F.desc("ArchiveDate"), *order).limit(limit)
    return flag_false_positives(shown, false_positives, [*ARCHIVE_KEYS], attribute=True, rule=test_name)


def runs_in_scope(archive: Archive, search: str | None, date_from: str | None, date_to: str | None, all_dates: bool) -> list:
    """The runs of the scope that ``date_scope`` describes, newest first, by the names of their folders."""
    if all_dates or (search and search.strip() and not (date_from or date_to)):
        return archive.runs()
    if date_from or date_to:
        return archive.runs(date_from, date_to)
    runs = archive.runs()
    return [r for r in runs if r[0] == runs[0][0]]


def wanted_rows(search: str | None) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.where(contains_text(rows, search))


def findings_page(
    archive: Archive, false_positives: DataFrame, test_name: str, order: list[str], search: str | None = None, *,
    limit: int, date_from: str | None = None, date_to: str | None = None, all_dates: bool = False,
) -> tuple[DataFrame, bool]:
    """A page like ``findings_view`` gives it, and whether the scope has more rows.

    Only the newest folders that hold the page and one row more are opened; of a search, only files that may
    hold its text, as far as they are indexed.  Values are searched in the type in which they were written.
    """
    runs = runs_in_scope(archive, search, date_from, date_to, all_dates)
    opened, more = archive.newest(limit, wanted_rows(search), runs, search)
    none = [p for *_, p in archive.runs()[:1]]
    rows = archive.read(opened, wanted_rows(search)) if opened else archive.read(none).limit(0)
    return findings_view(rows, false_positives, test_name, order, limit=limit, all_dates=True), more


def page_summary(view: DataFrame, limited: bool) -> DataFrame:
    """Rows and false positives of a page, beside what is known of the rest."""
    counts = view.agg(F.count(F.lit(1)).alias("count"), F.count_if("_is_false_positive").alias("fp_count"))
    return counts.withColumn("limited", F.lit(limited))


def findings_export(
    archive: DataFrame, false_positives: DataFrame, test_name: str, order: list[str],
    search: str | None = None, limit: int | None = None, day_column: Column | None = None, **scope,
) -> DataFrame:
    """The rows of a CSV export under the filters of the view; all unless a limit is asked for."""
    rows = in_view(archive, search, day_column, **scope).drop("_is_false_positive")
    if limit is not None:
        rows = rows.orderBy(F.desc("ArchiveDate"), *order).limit(limit)
    flagged = flag_false_positives(rows, false_positives, [*ARCHIVE_KEYS], rule=test_name)
    return export_rows(flagged, order, limit)


def view_summary(view: DataFrame, scope: DataFrame) -> DataFrame:
    """Rows and false positives of a page, and whether its scope has more rows."""
    page = view.agg(F.count(F.lit(1)).alias("count"), F.count_if("_is_false_positive").alias("fp_count"))
    total = scope.select(F.count(F.lit(1))).scalar()
    return page.withColumn("limited", F.col("count") < total)


def last_hash(hash_log: DataFrame, test_name: str) -> DataFrame:
    """What the newest hash row of a rule says of its last run, beside a view of its findings."""
    rows = hash_log.where(F.col("test_name") == test_name)
    return latest_per_key(rows, ["test_name"], ["execution_date"]).select(
        "execution_date", "row_count", "is_suppressed", "is_recurrent", preview("incident_hash").alias("hash_preview")
    )


def run_dates(archive: DataFrame, n: int = 30) -> DataFrame:
    """The newest archive days."""
    return (
        archive.select(F.to_date("ArchiveDate").alias("exec_date"))
        .distinct()
        .orderBy(F.desc("exec_date"))
        .limit(n)
    )


def suppressions_with_entries(suppressions: DataFrame, entries: DataFrame, test_id: str | None = None) -> DataFrame:
    """Suppressions, of one rule or all, newest first, and the state of their risk entry; a
    missing entry is open."""
    suppressions = suppressions.where(optional_filters({"test_id": ("=", test_id)}))
    linked = entries.select(
        F.col("RiskEntryId").alias("linked_entry_id"),
        F.col("RiskEntryTitle").alias("entry_title"),
        F.col("Criticality").alias("entry_criticality"),
        F.col("ClosingDate").alias("entry_closing_date"),
    )
    joined = lookup_join(suppressions, linked, ["linked_entry_id"])
    return joined.withColumn("entry_is_open", is_blank("entry_closing_date")).orderBy(F.desc("created_at"), "suppression_id")


def search_entries(entries: DataFrame, q: str = "", open_only: bool = True, n: int = 50) -> DataFrame:
    """Risk entries by id or title."""
    rows = entries
    if q:
        rows = rows.where(F.col("RiskEntryId").like(f"%{q}%") | F.col("RiskEntryTitle").like(f"%{q}%"))
    if open_only:
        rows = rows.where(is_blank("ClosingDate"))
    return rows.orderBy("RiskEntryId").limit(n)


def fp_register(false_positives: DataFrame, configs: DataFrame, history: DataFrame) -> DataFrame:
    """Active false positives with their rule and the row they were marked on."""
    rules = configs.select(
        "test_name",
        "test_id",
        F.col("description").alias("test_description"),
        "responsible_area",
        F.col("status").alias("test_status"),
    )
    marked = first_per_key(
        history.where(F.col("event_type") == "marked").select("fp_id", "event_at", "fp_history_id", "row_data"),
        ["fp_id"],
        ["event_at", "fp_history_id"],
    ).select("fp_id", "row_data")
    return (
        lookup_join(false_positives.where(F.col("active")), rules, ["test_name"])
        .join(marked, "fp_id", "left")
        .select(
            "fp_id", "test_name", "row_hash", "note", "marked_by", "marked_at", "test_id",
            "test_description", "responsible_area", "test_status", "match_criteria", "row_data",
        )
        .orderBy(F.desc("marked_at"), "fp_id")
    )


def fp_list(false_positives: DataFrame, test_name: str | None = None) -> DataFrame:
    """False positives of one rule or of all, revoked ones too, newest first."""
    rows = false_positives.where(optional_filters({"test_name": ("=", test_name)}))
    return rows.orderBy(F.desc("marked_at"), "fp_id")


def fp_event_history(history: DataFrame, n: int = 200) -> DataFrame:
    return history.orderBy(F.desc("event_at"), "fp_history_id").limit(n)


def run_health(
    run_log: DataFrame, now: dt.datetime, stale_hours: int = 26, batch_hours: int = 2
) -> DataFrame:
    """When the last batch ended, whether that is too long ago, and what it did."""
    last = run_log.select(F.max("ExecutionDate")).scalar()
    batch = run_log.where(
        (F.col("ExecutionDate") > last - F.expr(f"INTERVAL {batch_hours} HOURS")) & (F.col("ExecutionDate") <= last)
    )
    failed = F.when(F.col("TestResult") == "ERROR", F.col("TestName"))
    end = F.max("ExecutionDate")
    limit = F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {stale_hours} HOURS")
    return batch.agg(
        end.alias("last_run_at"),
        F.countDistinct("TestName").alias("tests_executed"),
        F.countDistinct(failed).alias("errors"),
        F.coalesce(end < limit, F.lit(True)).alias("stale"),
    )


def risk_list(risks: DataFrame, level_column: str = "R2InherentLevel") -> DataFrame:
    """Risks with their level as text, wherever the level column is."""
    level = find_column(risks, level_column, skip=("RiskId", "RiskTitle"))
    extra = [F.col(level).cast("string").alias("RiskLevel")] if level else []
    return risks.select("RiskId", "RiskTitle", *extra).orderBy("RiskId")


def area_list(areas: DataFrame) -> DataFrame:
    return areas.where(F.col("Area").isNotNull()).select("Area").distinct().orderBy("Area")


def sample(findings: DataFrame, n: int = 10, order: list[str] | None = None) -> DataFrame:
    """A few rows of a rule, to look at before it is submitted; any rows without ``order``."""
    return (findings.orderBy(*order) if order else findings).limit(n)


def preview_sql(spark: SparkSession, code: str, n: int = 10) -> tuple[DataFrame | None, str | None]:
    """A few rows of a rule's SQL text, or why it cannot be shown.

    Text that is not one SELECT is never run.
    """
    row = spark.createDataFrame([("", "SQL", None, code)], "test_id string, query_type string, imports string, query_code string")
    wrong = rule_code(row).first()
    if wrong:
        return None, wrong["error"]
    try:
        return sample(spark.sql(code), n), None
    except AnalysisException as problem:
        return None, str(problem)


def rules_by_status(configs: DataFrame) -> DataFrame:
    return configs.groupBy("status").agg(F.count(F.lit(1)).alias("cnt")).orderBy("status")


