"""Findings, false positives and alert states on the driver's tables."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import DataFrame, functions as F

from checks.registry import SHARED_SQL, check
from checks.rules import audit_log
from rulewatch.functions.hashing import fp_row_hash
from rulewatch.operators.alerts import open_suppressions, outbox, rule_status
from rulewatch.operators.findings import (
    HALF_BITS, SLICE_DIGITS, SLICES, flag_false_positives, set_hash, with_row_hash,
)
from rulewatch.plans.history import error_rows, replay, summarise_runs
from rulewatch.plans.runner import run_rules, run_totals, runs_due
from rulewatch.rules.registry import RULES
from rulewatch.session import work_dir
from rulewatch.sources.logs import read_log
from rulewatch.sources.schemas import empty

KEYS = ["test_name", "run_date"]
DAY = "CAST(run_date AS VARCHAR) AS run_date"
ROW_HASH = "sha256(concat_ws('|', category, CAST(entity AS VARCHAR)))"
FP_HASH = "sha256(concat(coalesce(category, ''), '|', coalesce(CAST(entity AS VARCHAR), '')))"

FINGERPRINT = "sha256(concat_ws(':', count(*), {}))".format(
    ", ".join(
        f"sum(CAST('0x' || substr(h, {1 + SLICE_DIGITS * i}, {SLICE_DIGITS}) AS BIGINT) {half})"
        for i in range(SLICES)
        for half in (f">> {HALF_BITS}", f"& {(1 << HALF_BITS) - 1}")
    )
)

SHARED_SQL.update(
    sx_fp="""
        SELECT *, CASE WHEN json_valid(match_criteria) AND TRY(json_array_length(match_criteria)) > 0
                       THEN match_criteria END AS crit
        FROM fx_fp WHERE active""",
    sx_crit="""
        SELECT fp_id, json_extract_string(c, '$.column') AS col, coalesce(json_extract_string(c, '$.value'), '') AS val
        FROM (SELECT fp_id, unnest(from_json(crit, '["JSON"]')) AS c FROM sx_fp WHERE crit IS NOT NULL)""",
    sx_hit=f"""
        SELECT r.test_name, r.entity, r.category, p.fp_id, p.marked_at, p.note, p.marked_by
        FROM (SELECT DISTINCT test_name, entity, category FROM fx_findings) r
        JOIN sx_fp p ON p.test_name = r.test_name LEFT JOIN sx_crit c ON c.fp_id = p.fp_id
        GROUP BY r.test_name, r.entity, r.category, p.fp_id, p.marked_at, p.note, p.marked_by, p.crit, p.row_hash
        HAVING CASE WHEN p.crit IS NOT NULL
          THEN bool_and(coalesce(CASE c.col WHEN 'entity' THEN coalesce(CAST(r.entity AS VARCHAR), '')
                                            WHEN 'category' THEN coalesce(r.category, '') END = c.val, false))
          ELSE p.row_hash <> '' AND p.row_hash = {FP_HASH.replace("category", "r.category").replace("entity", "r.entity")} END""",
    sx_flagged="""
        SELECT f.*, EXISTS (SELECT 1 FROM sx_hit h WHERE h.test_name = f.test_name AND h.entity = f.entity
                            AND h.category IS NOT DISTINCT FROM f.category) AS fp
        FROM fx_findings f""",
    sx_open="""
        SELECT s.test_id, min(s.created_at) AS open_since
        FROM fx_suppression s LEFT JOIN fx_entry e ON e.RiskEntryId = s.linked_entry_id
        WHERE s.active AND (e.ClosingDate IS NULL OR trim(e.ClosingDate) = '') GROUP BY 1""",
    sx_run=f"""
        SELECT r.test_name, r.run_date, c.test_id,
               CASE WHEN NOT broken THEN coalesce(n, 0) END AS row_count,
               CASE WHEN broken THEN 0 ELSE coalesce(k, 0) END AS clean_count,
               CASE WHEN NOT broken THEN hash END AS incident_hash,
               coalesce(c.threshold, 0) AS threshold,
               CASE WHEN broken THEN 'ERROR' WHEN coalesce(k, 0) > coalesce(c.threshold, 0) THEN 'FAILED'
                    ELSE 'PASSED' END AS result,
               coalesce(o.open_since <= r.run_date, false) AS suppressed,
               coalesce(c.should_activate_channel, true) AS channel
        FROM fx_runs r
        LEFT JOIN (SELECT test_name, run_date, count(*) AS n, count(*) FILTER (WHERE NOT fp) AS k, {FINGERPRINT} AS hash
                   FROM (SELECT *, {ROW_HASH} AS h FROM sx_flagged) GROUP BY 1, 2) f
          ON f.test_name = r.test_name AND f.run_date = r.run_date
        LEFT JOIN fx_config c ON c.test_name = r.test_name
        LEFT JOIN sx_open o ON o.test_id = c.test_id""",
    sx_prev="""
        SELECT *, result = 'FAILED' AND suppressed AS is_suppressed,
               lag(result) OVER w AS prev_result,
               coalesce(lag(result = 'FAILED' AND suppressed) OVER w, false) AS prev_suppressed,
               last_value(CASE WHEN result <> 'ERROR' THEN {'h': incident_hash} END IGNORE NULLS)
                 OVER (PARTITION BY test_name ORDER BY run_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_log
        FROM sx_run WINDOW w AS (PARTITION BY test_name ORDER BY run_date)""",
    sx_state="""
        SELECT *, result = 'FAILED' AND NOT suppressed AND same AND NOT flagged AS is_recurrent,
               result = 'FAILED' AND NOT suppressed AND same AND flagged AS is_continued,
               result = 'FAILED' AND NOT suppressed AND NOT (same AND flagged) AND channel AS should_notify,
               CASE WHEN result = 'ERROR' THEN 'error' WHEN result = 'PASSED' THEN 'clean'
                    WHEN suppressed THEN 'suppressed' WHEN same AND flagged THEN 'continued'
                    WHEN same THEN 'recurrent' ELSE 'new' END AS alert_state
        FROM (SELECT *, prev_log IS NOT NULL AND prev_log.h IS NOT DISTINCT FROM incident_hash AS same,
                     coalesce(prev_result = 'FAILED', false) AND NOT prev_suppressed AS flagged FROM sx_prev)""",
)

def summary_of(t) -> DataFrame:
    return summarise_runs(
        t["fx_runs"], t["fx_findings"], t["fx_fp"], t["fx_config"], t["fx_suppression"], t["fx_entry"]
    )


def states_of(t) -> DataFrame:
    return replay(
        t["fx_runs"], t["fx_findings"], t["fx_fp"], t["fx_config"], t["fx_suppression"], t["fx_entry"]
    )


@check("e01_runs_due", """
    WITH days AS (SELECT CAST(unnest(generate_series(DATE '2024-01-01', DATE '2024-01-31', INTERVAL 1 DAY)) AS DATE) AS d),
    active AS (SELECT test_id, test_name, upper(coalesce(frequency, 'DAILY')) AS frequency FROM fx_config WHERE status = 'ACTIVE')
    SELECT test_id, test_name, frequency, CAST(d AS VARCHAR) AS run_date,
           CASE WHEN frequency IN ('DAILY', 'WEEKLY', 'MONTHLY') THEN 'RUN' ELSE 'ERROR' END AS gate
    FROM active, days
    WHERE CASE frequency WHEN 'DAILY' THEN true WHEN 'WEEKLY' THEN dayofweek(d) = 5 WHEN 'MONTHLY' THEN day(d) = 5 ELSE true END""")
def e01(t):
    return runs_due(t["fx_config"], dt.date(2024, 1, 1), dt.date(2024, 1, 31))


@check("e04_row_hash", f"SELECT test_name, {DAY}, entity, category, {ROW_HASH} AS row_hash FROM fx_findings")
def e04(t):
    return with_row_hash(t["fx_findings"], KEYS)


@check("e05_fingerprint", f"""
    SELECT test_name, {DAY}, count(*) AS row_count, {FINGERPRINT} AS incident_hash
    FROM (SELECT *, {ROW_HASH} AS h FROM fx_findings) GROUP BY ALL""")
def e05_fingerprint(t):
    return set_hash(t["fx_findings"], KEYS)


@check("e06_fp_row_hash", f"SELECT test_name, {DAY}, entity, category, {FP_HASH} AS row_hash FROM fx_findings")
def e06(t):
    return t["fx_findings"].withColumn("row_hash", fp_row_hash(["entity", "category"]))


@check("e07_fp_flags", f"SELECT test_name, {DAY}, entity, category, fp AS _is_false_positive FROM sx_flagged")
def e07(t):
    return flag_false_positives(t["fx_findings"], t["fx_fp"], KEYS)


@check("e08_fp_attribution", """
    WITH best AS (SELECT *, row_number() OVER (PARTITION BY test_name, entity, category ORDER BY marked_at, fp_id) AS rn FROM sx_hit)
    SELECT f.test_name, CAST(f.run_date AS VARCHAR) AS run_date, f.entity, f.category,
           b.fp_id IS NOT NULL AS _is_false_positive, b.fp_id AS _fp_id, b.note AS _fp_note,
           b.marked_by AS _fp_marked_by, CAST(b.marked_at AS VARCHAR) AS _fp_marked_at
    FROM fx_findings f LEFT JOIN best b ON b.rn = 1 AND b.test_name = f.test_name AND b.entity = f.entity
      AND b.category IS NOT DISTINCT FROM f.category""")
def e08(t):
    return flag_false_positives(t["fx_findings"], t["fx_fp"], KEYS, attribute=True)


@check("e10_result", f"SELECT test_name, {DAY}, row_count, clean_count, threshold, result FROM sx_run")
def e10(t):
    return summary_of(t).select(*KEYS, "row_count", "clean_count", "threshold", "result")


@check("e11_open_suppression", "SELECT test_id, CAST(open_since AS VARCHAR) AS open_since FROM sx_open")
def e11(t):
    return open_suppressions(t["fx_suppression"], t["fx_entry"])


STATE = ["clean_count", "incident_hash", "result", "is_suppressed", "is_recurrent", "is_continued", "should_notify", "alert_state"]


@check("e12_alert_state", f"SELECT test_name, {DAY}, {', '.join(STATE)} FROM sx_state")
def e12(t):
    return states_of(t).select(*KEYS, *STATE)


@check("e13_error_rows", f"""
    SELECT test_name, {DAY}, clean_count, row_count, incident_hash, result, alert_state
    FROM sx_state WHERE result = 'ERROR'""")
def e13(t):
    return error_rows(states_of(t))


# Labels (fixed values) in the order in which the facts of a rule are looked at.
SHARED_SQL["sx_labels"] = """
    SELECT * FROM (VALUES (1, 'never', 'nunca_rodou'), (2, 'PASSED', 'sem_achados'), (3, 'ERROR', 'erro'),
      (4, 'quiet', 'em_tratamento'), (5, 'again', 'reincidente'), (6, 'still', 'persistente'),
      (7, 'FAILED', 'novo_achado'), (8, 'any', 'sem_achados')) labels(priority, fact, label)"""
SHARED_SQL["sx_last"] = """
    SELECT TestName AS test_name, max(ExecutionDate) AS last_at,
           arg_max(struct_pack(res := TestResult, raw := IncidentCountRaw, clean := IncidentCount, quiet := IsSupressed,
                               again := IsRecurrent, still := IsContinued), ExecutionDate) AS run
    FROM fx_runlog GROUP BY 1"""


def ladder(quiet: str) -> str:
    """The first label that a fact of the rule's latest run calls for; ``quiet`` says when it is treated."""
    return f"""
    SELECT test_id, status, any_value(test_name) AS test_name, any_value(res) AS last_result, min_by(label, priority) AS label
    FROM (SELECT test_id, status, test_name, run.res AS res,
                 [coalesce(run.res, 'never'), CASE WHEN {quiet} THEN 'quiet' END, CASE WHEN run.again THEN 'again' END,
                  CASE WHEN run.still THEN 'still' END, 'any'] AS facts
          FROM fx_config LEFT JOIN sx_last USING (test_name)) rules
    JOIN sx_labels ON list_contains(facts, fact) GROUP BY test_id, status"""


SHARED_SQL["sx_ladder"] = ladder("run.res = 'FAILED' AND test_id IN (SELECT test_id FROM fx_suppression WHERE active)")
SHARED_SQL["sx_ladder_stored"] = ladder("run.quiet")
STATUS = ["test_id", "test_name", "TestResult AS last_result", "has_active_suppression", "alert_status"]


@check("e15_status_ladder", """
    SELECT test_id, test_name, last_result, test_id IN (SELECT test_id FROM fx_suppression WHERE active) AS has_active_suppression,
           label AS alert_status FROM sx_ladder""")
def e15(t):
    return rule_status(t["fx_config"], t["fx_runlog"], t["fx_suppression"]).selectExpr(*STATUS)


@check("e16_status_ladder_stored", """
    SELECT test_id, test_name, last_result, false AS has_active_suppression, label AS alert_status FROM sx_ladder_stored""")
def e16(t):
    return rule_status(t["fx_config"], t["fx_runlog"]).selectExpr(*STATUS)


@check("e17_outbox", """
    SELECT sha256(concat_ws('::', s.test_name, CAST(s.run_date AS VARCHAR))) AS message_id, s.test_name,
           CAST(s.run_date AS VARCHAR) AS execution_date,
           concat('{"test_name":"', s.test_name, '","description":"', c.description, '"',
                  CASE WHEN c.responsible_area IS NULL THEN '' ELSE concat(',"responsible_area":"', c.responsible_area, '"') END,
                  ',"risk_id":"', c.risco_id, '","output_table":"', c.output_table, '","threshold":', s.threshold,
                  ',"incident_count":', s.clean_count, ',"execution_date":"', s.run_date, '"}') AS payload
    FROM sx_state s JOIN fx_config c ON c.test_name = s.test_name WHERE s.should_notify""")
def e17(t):
    return outbox(states_of(t).withColumnRenamed("run_date", "execution_date"), t["fx_config"])


RULE_ROWS = [
    # name, body, frequency, threshold, type
    ("duplicate documents", "duplicate_documents", "DAILY", 0, "PYTHON"),
    ("invalid email", "invalid_email", "MONTHLY", 50, "PYTHON"),
    ("unmatched document", "unmatched_document", None, 100_000_000, "python"),
    ("weekly only", "invalid_phone", "WEEKLY", 0, "PYTHON"),
    ("no such body", "missing", "DAILY", 0, "PYTHON"),
    ("no such schedule", "invalid_phone", "YEARLY", 0, "PYTHON"),
    ("paused", "invalid_phone", "DAILY", 0, "PYTHON"),
]


@check("e03_run_rules", """
    WITH p AS (SELECT * FROM fx_participant WHERE StatusId = '1'),
    n AS (
      SELECT 'T0' AS test_id, 'duplicate documents' AS TestName, 0 AS Threshold, 'DAILY' AS Frequency,
             (SELECT count(*) FROM (SELECT DocumentNumberCd FROM p GROUP BY 1 HAVING count(DISTINCT ParticipantId) > 1)) AS raw,
             0 AS fps
      UNION ALL SELECT 'T1', 'invalid email', 50, 'MONTHLY', (SELECT count(*) FROM p WHERE EmailName LIKE '%acme%' OR EmailName IS NULL),
             (SELECT count(*) FROM p WHERE EmailName = 'f@acme')
      UNION ALL SELECT 'T2', 'unmatched document', 100000000, 'DAILY',
             (SELECT count(*) FROM p WHERE DocumentNumberCd NOT IN (SELECT DocumentCd FROM fx_establishment)), 0
      UNION ALL SELECT 'T4', 'no such body', 0, 'DAILY', NULL, 0 UNION ALL SELECT 'T5', 'no such schedule', 0, 'YEARLY', NULL, 0)
    SELECT TestName, Frequency, Threshold, raw AS IncidentCountRaw, coalesce(raw - fps, 0) AS IncidentCount,
           CASE WHEN raw IS NULL THEN 'ERROR' WHEN raw - fps > Threshold THEN 'FAILED' ELSE 'PASSED' END AS TestResult,
           raw IS NOT NULL AND raw - fps > Threshold AND test_id IN (SELECT test_id FROM sx_open WHERE open_since <= DATE '2024-02-05') AS IsSupressed,
           false AS IsRecurrent, false AS IsContinued, raw IS NULL AS has_error
    FROM n""")
def e03(t):
    log = daily_run(t, f"{work_dir(t.spark)}/runner-{uuid.uuid4().hex}", SIX)
    return log.select(
        "TestName", "Frequency", "Threshold", F.col("IncidentCountRaw").cast("bigint").alias("IncidentCountRaw"),
        F.col("IncidentCount").cast("bigint").alias("IncidentCount"), "TestResult", "IsSupressed", "IsRecurrent",
        "IsContinued", F.col("ErrorMessage").isNotNull().alias("has_error"),
    )


SIX, NINE = dt.datetime(2024, 2, 5, 6), dt.datetime(2024, 2, 5, 9)
CONFIG = (
    "test_id string, test_name string, output_table string, description string, responsible_area string, "
    "risco_id string, threshold int, frequency string, query_type string, query_code string, status string, "
    "should_activate_channel boolean"
)


def daily_run(t, folder: str, run_ts: dt.datetime, only: tuple[str, ...] = ()) -> DataFrame:
    configs = t.spark.createDataFrame(
        [
            (f"T{i}", name, f"tb_incidents_{i}", name, "area", "R1", threshold, frequency, kind, body,
             "PAUSED" if name == "paused" else "ACTIVE", True)
            for i, (name, body, frequency, threshold, kind) in enumerate(RULE_ROWS)
            if not only or f"T{i}" in only
        ],
        CONFIG,
    )
    fps = t.spark.createDataFrame(
        [("F1", "invalid email", None, '[{"column":"EmailName","value":"f@acme"}]', "u1", run_ts.date(), "known", True)],
        "fp_id string, test_name string, row_hash string, match_criteria string, marked_by string, "
        "marked_at date, note string, active boolean",
    )
    return run_rules(
        t.spark, configs, t.rules("participant", "establishment"), run_ts, folder,
        t["fx_suppression"], t["fx_entry"], fps, {"invalid_email": {"marker": "acme"}},
    )


def one_day(t) -> str:
    """A run at six, two of its rules again at nine, and one of them repeated for six."""
    folder = f"{work_dir(t.spark)}/runner-{uuid.uuid4().hex}"
    daily_run(t, folder, SIX)
    daily_run(t, folder, NINE, ("T0", "T1"))
    daily_run(t, folder, SIX, ("T1",))
    return folder


SHARED_SQL["sx_day"] = """
    WITH p AS (SELECT * FROM fx_participant WHERE StatusId = '1'),
    n AS (SELECT 'T0' AS id, 'duplicate documents' AS name, 0 AS threshold, (SELECT count(*) FROM (
            SELECT DocumentNumberCd FROM p GROUP BY 1 HAVING count(DISTINCT ParticipantId) > 1)) AS raw, 0 AS fps
          UNION ALL SELECT 'T1', 'invalid email', 50, count(*), count(*) FILTER (WHERE EmailName = 'f@acme')
          FROM p WHERE EmailName LIKE '%acme%' OR EmailName IS NULL),
    s AS (SELECT *, raw - fps > threshold AS failed,
                 id IN (SELECT test_id FROM sx_open WHERE open_since <= DATE '2024-02-05') AS quiet FROM n)
    SELECT name, moment, raw, raw - fps AS clean, failed, failed AND quiet AS suppressed,
           failed AND NOT quiet AND moment > '2024-02-05 07' AS again
    FROM s, (VALUES ('2024-02-05 06:00:00'), ('2024-02-05 09:00:00')) runs(moment)"""


@check("e03_two_runs_a_day", """
    SELECT name AS TestName, moment AS ExecutionDate, raw AS IncidentCountRaw, clean AS IncidentCount,
           CASE WHEN failed THEN 'FAILED' ELSE 'PASSED' END AS TestResult, suppressed AS IsSupressed, again AS IsContinued
    FROM sx_day
    UNION ALL SELECT 'unmatched document', '2024-02-05 06:00:00', count(*), count(*), 'PASSED', false, false
    FROM fx_participant WHERE StatusId = '1' AND DocumentNumberCd NOT IN (SELECT DocumentCd FROM fx_establishment)
    UNION ALL VALUES ('no such body', '2024-02-05 06:00:00', NULL, 0, 'ERROR', false, false),
                     ('no such schedule', '2024-02-05 06:00:00', NULL, 0, 'ERROR', false, false)""")
def e03_two_runs(t):
    log = read_log(t.spark, one_day(t), "tb_tests_executions")
    return log.select(
        "TestName", "ExecutionDate", F.col("IncidentCountRaw").cast("bigint").alias("IncidentCountRaw"),
        F.col("IncidentCount").cast("bigint").alias("IncidentCount"), "TestResult", "IsSupressed", "IsContinued",
    )


@check("s07_hash_log", """
    SELECT name AS test_name, moment AS execution_date, raw AS row_count, suppressed AS is_suppressed, true AS same_as_other_run
    FROM sx_day
    UNION ALL SELECT 'unmatched document', '2024-02-05 06:00:00', count(*), false, true
    FROM fx_participant WHERE StatusId = '1' AND DocumentNumberCd NOT IN (SELECT DocumentCd FROM fx_establishment)""")
def s07(t):
    log = read_log(t.spark, one_day(t), "tb_incident_hashes")
    hashes = log.groupBy("test_name").agg((F.countDistinct("incident_hash") <= 1).alias("same_as_other_run"))
    return log.join(hashes, "test_name").select(
        "test_name", "execution_date", F.col("row_count").cast("bigint").alias("row_count"), "is_suppressed", "same_as_other_run"
    )


PARAMS = {
    "sso_bypass": {"domain": "@acme", "marker": "7"}, "invalid_email": {"marker": "acme"},
    "employee_partners": {"own_document": "77"}, "overdue_training": {"hired_since": "1995-06-01"},
    **{f"due_before_registry_{k}": {"cutoff": dt.date(1998, 1, 1)} for k in ("new", "old", "new_type2", "old_type2")},
}


def library() -> list[str]:
    return sorted(r.name for r in RULES.values() if r.findings.__module__.startswith("rulewatch."))


@check("e03_all_rules", f"SELECT unnest({library()}) AS TestName, false AS has_error")
def e03_all(t):
    """Every rule of the library in one daily run: none fails."""
    names = library()
    configs = t.spark.createDataFrame(
        [(f"T{i}", n, f"tb_incidents_{n}", n, "area", "R1", 0, "DAILY", "PYTHON", n, "ACTIVE", True) for i, n in enumerate(names)], CONFIG
    )
    fps = empty(t.spark, "tb_false_positives")
    tables = {n: t[f"fx_{n}"] for r in RULES.values() if r.name in names for n in r.reads if n != "audit"}
    log = run_rules(
        t.spark, configs, tables | {"audit": audit_log(t)}, SIX, f"{work_dir(t.spark)}/runner-{uuid.uuid4().hex}",
        t["fx_suppression"], t["fx_entry"], fps, PARAMS,
    )
    return log.select("TestName", F.col("ErrorMessage").isNotNull().alias("has_error"))


@check("e13_run_totals", """
    SELECT 5 AS executed, 1 AS skipped, 2 AS errors FROM (SELECT count(*) FROM fx_participant)""")
def e13_totals(t):
    folder = f"{work_dir(t.spark)}/runner-{uuid.uuid4().hex}"
    log = daily_run(t, folder, SIX)
    rows = [(n, "PAUSED" if n == "paused" else "ACTIVE") for n, *_ in RULE_ROWS]
    return run_totals(t.spark.createDataFrame(rows, "test_name string, status string"), log)
