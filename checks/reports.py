"""Reports and charts on the driver's tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from checks.registry import SHARED_SQL, check
from rulewatch.plans import charts, reports
from rulewatch.sources.tables import readiness

AS_OF = dt.date(2024, 1, 31)
SHARED_SQL["sx_fp_rules"] = "SELECT test_name, count(*) AS marked FROM fx_fp WHERE active GROUP BY 1"


@check("r01_stats", """
    SELECT 'rules' AS section, 'active' AS label, count(*) FILTER (WHERE status = 'ACTIVE') AS cnt FROM fx_config
    UNION ALL SELECT 'rules', 'paused', count(*) FILTER (WHERE status = 'PAUSED') FROM fx_config
    UNION ALL SELECT 'rules', 'under_review', count(*) FILTER (WHERE status IN ('UNDER_REVIEW', 'PENDING_DELETE')) FROM fx_config
    UNION ALL SELECT 'runs', 'cleared', count(*) FROM fx_runlog WHERE TestResult = 'PASSED' AND ExecutionDate >= DATE '2024-01-01'
    UNION ALL SELECT 'runs', 'flagged', count(*) FROM fx_runlog WHERE TestResult = 'FAILED' AND ExecutionDate >= DATE '2024-01-01'
    UNION ALL SELECT 'runs', 'error', count(*) FROM fx_runlog WHERE TestResult = 'ERROR' AND ExecutionDate >= DATE '2024-01-01'
    UNION ALL SELECT 'alerts', label, count(*) FROM sx_ladder WHERE status = 'ACTIVE' GROUP BY label""")
def r01(t):
    return reports.portfolio_stats(t["fx_config"], t["fx_runlog"], t["fx_suppression"], AS_OF)


@check("r02_coverage", """
    SELECT count(*) AS total_tests, count(DISTINCT CASE WHEN risco_id <> 'N/A' THEN risco_id END) AS risks_covered,
           count(DISTINCT responsible_area) AS areas_covered
    FROM fx_config WHERE status = 'ACTIVE' AND should_activate_channel""")
def r02(t):
    return reports.coverage(t["fx_config"], notify=True)


@check("r03_run_kpis", """
    SELECT count(*) AS runs_total, count(*) FILTER (WHERE TestResult = 'PASSED') AS runs_cleared,
           count(*) FILTER (WHERE TestResult = 'FAILED') AS runs_flagged, count(*) FILTER (WHERE TestResult = 'ERROR') AS runs_error
    FROM fx_runlog e JOIN fx_config c ON c.test_name = e.TestName
    WHERE e.ExecutionDate >= TIMESTAMP '2024-01-05' AND e.ExecutionDate <= TIMESTAMP '2024-01-20'
      AND c.responsible_area = 'BUILDING'""")
def r03(t):
    return reports.run_kpis(t["fx_config"], t["fx_runlog"], "2024-01-05", "2024-01-20", area="BUILDING")


@check("r04_by_area", "SELECT responsible_area AS area, count(*) AS cnt FROM fx_config WHERE status = 'ACTIVE' GROUP BY 1")
def r04(t):
    return reports.rules_by_area(t["fx_config"])


@check("r05_by_risk", """
    SELECT c.risco_id, coalesce(r.RiskTitle, c.risco_id) AS risk_title, count(*) AS cnt
    FROM fx_config c LEFT JOIN fx_risk r ON r.RiskId = c.risco_id
    WHERE c.status = 'ACTIVE' AND c.risco_id <> 'N/A' GROUP BY c.risco_id, r.RiskTitle
    ORDER BY cnt DESC, c.risco_id LIMIT 20""")
def r05(t):
    return reports.rules_by_risk(t["fx_config"], t["fx_risk"])


@check("r06_open_entries", """
    SELECT c.test_name, c.risco_id, c.responsible_area, count(DISTINCT s.linked_entry_id) AS open_entries
    FROM fx_suppression s JOIN fx_config c ON c.test_id = s.test_id AND c.status = 'ACTIVE'
    JOIN fx_entry e ON e.RiskEntryId = s.linked_entry_id
    WHERE s.active AND (e.ClosingDate IS NULL OR trim(e.ClosingDate) = '')
    GROUP BY 1, 2, 3 ORDER BY open_entries DESC, c.test_name LIMIT 20""")
def r06(t):
    return reports.rules_with_open_entries(t["fx_config"], t["fx_suppression"], t["fx_entry"])


@check("r07_status_by_rule", """
    WITH in_range AS (
      SELECT TestName AS test_name, count(TestResult) AS runs, count(*) FILTER (WHERE TestResult = 'FAILED') AS bad
      FROM fx_runlog WHERE ExecutionDate BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-25' GROUP BY 1)
    SELECT test_name, responsible_area, risco_id, run.res AS last_result, CAST(last_at AS VARCHAR) AS last_run,
           greatest(0, coalesce(run.raw, run.clean, 0) - coalesce(marked, 0)) AS last_incidents,
           coalesce(runs, 0) AS total_runs, coalesce(bad, 0) AS flagged_runs
    FROM (SELECT * FROM fx_config WHERE status = 'ACTIVE')
    LEFT JOIN sx_last USING (test_name) LEFT JOIN sx_fp_rules USING (test_name) LEFT JOIN in_range USING (test_name)""")
def r07(t):
    return reports.status_by_rule(t["fx_config"], t["fx_runlog"], t["fx_fp"], "2024-01-10", "2024-01-25")


@check("r08_rule_list", """
    SELECT test_id, test_name, status, CAST(updated_at AS VARCHAR) AS updated_at, run.res AS last_result,
           CAST(last_at AS VARCHAR) AS last_run, coalesce(marked, 0) AS active_fp_count,
           greatest(0, coalesce(run.raw, run.clean, 0) - coalesce(marked, 0)) AS last_incident_count,
           test_id IN (SELECT test_id FROM fx_suppression WHERE active) AS has_active_suppression,
           label AS last_alert_status
    FROM fx_config JOIN (SELECT test_id, label FROM sx_ladder) USING (test_id)
    LEFT JOIN sx_last USING (test_name) LEFT JOIN sx_fp_rules USING (test_name)""")
def r08(t):
    shown = ["test_id", "test_name", "status", "updated_at", "last_result", "last_run", "last_incident_count",
             "active_fp_count", "has_active_suppression", "last_alert_status"]
    return reports.rule_list(t["fx_config"], t["fx_runlog"], t["fx_suppression"], t["fx_fp"]).select(*shown)


@check("r09_trend", """
    SELECT TestName, string_agg(concat_ws('/', CAST(ExecutionDate AS VARCHAR), IncidentCount, TestResult), ',' ORDER BY ExecutionDate) AS trend
    FROM (SELECT *, row_number() OVER (PARTITION BY TestName ORDER BY ExecutionDate DESC) AS rn FROM fx_runlog)
    WHERE rn <= 14 GROUP BY TestName""")
def r09(t):
    points = F.transform("trend", lambda p: F.concat_ws("/", p["d"].cast("string"), p["n"].cast("string"), p["r"]))
    return reports.run_trend(t["fx_runlog"]).withColumn("trend", points)


@check("r10_run_history", """
    WITH p AS (SELECT *, row_number() OVER (ORDER BY ExecutionDate DESC, TestName) AS rn FROM fx_runlog
               WHERE ExecutionDate < TIMESTAMP '2024-01-20' OR (ExecutionDate = TIMESTAMP '2024-01-20' AND TestName > 'rule-1'))
    SELECT * REPLACE (CAST(ExecutionDate AS VARCHAR) AS ExecutionDate), (SELECT max(rn) FROM p) > 20 AS has_more
    FROM p WHERE rn BETWEEN 1 AND 20""")
def r10(t):
    return reports.run_history(t["fx_runlog"], None, 20, (dt.datetime(2024, 1, 20), "rule-1"))


@check("r11_config_history", "SELECT * REPLACE (CAST(changed_at AS VARCHAR) AS changed_at) FROM fx_history")
def r11(t):
    return reports.config_history(t["fx_history"])


@check("r12_hash_history", """
    WITH h AS (SELECT *, row_number() OVER (PARTITION BY test_name ORDER BY execution_date DESC) AS rn FROM fx_hashlog)
    SELECT test_name, CAST(execution_date AS VARCHAR) AS execution_date, row_count, is_suppressed, is_recurrent,
           left(incident_hash, 8) AS hash_preview, rn FROM h WHERE rn <= 30""")
def r12(t):
    return reports.hash_history(t["fx_hashlog"])


@check("r13_findings_view", f"""
    WITH page AS (SELECT * EXCLUDE (_is_false_positive) FROM fx_archive
             WHERE lower(concat_ws(' ', event_id, user_id, event_type, amount, entity, category)) LIKE '%urch%5%'
             ORDER BY ArchiveDate DESC, event_id LIMIT 500),
    hits AS (
      SELECT g.event_id, p.fp_id, p.note, p.marked_by, p.marked_at
      FROM page g JOIN sx_fp p ON p.test_name = 'rule-3' LEFT JOIN sx_crit c ON c.fp_id = p.fp_id
      GROUP BY g.event_id, g.entity, g.category, p.fp_id, p.note, p.marked_by, p.marked_at, p.crit, p.row_hash
      HAVING CASE WHEN p.crit IS NOT NULL
        THEN bool_and(coalesce(CASE c.col WHEN 'entity' THEN coalesce(CAST(g.entity AS VARCHAR), '')
                                          WHEN 'category' THEN coalesce(g.category, '') END = c.val, false))
        ELSE false END),
    best AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY marked_at, fp_id) AS rn FROM hits)
    SELECT page.* REPLACE (CAST(ArchiveDate AS VARCHAR) AS ArchiveDate), b.fp_id IS NOT NULL AS _is_false_positive,
           b.fp_id AS _fp_id, b.note AS _fp_note, b.marked_by AS _fp_marked_by, CAST(b.marked_at AS VARCHAR) AS _fp_marked_at
    FROM page LEFT JOIN best b ON b.event_id = page.event_id AND b.rn = 1""")
def r13(t):
    return reports.findings_view(t["fx_archive"], t["fx_fp"], "rule-3", ["event_id"], search="urch%5", limit=500)


@check("r13_view_summary", """
    WITH hits AS (
      SELECT g.event_id FROM fx_archive g JOIN sx_fp p ON p.test_name = 'rule-3' JOIN sx_crit c ON c.fp_id = p.fp_id
      WHERE p.crit IS NOT NULL GROUP BY g.event_id, g.entity, g.category, p.fp_id
      HAVING bool_and(coalesce(CASE c.col WHEN 'entity' THEN coalesce(CAST(g.entity AS VARCHAR), '')
                                          WHEN 'category' THEN coalesce(g.category, '') END = c.val, false))),
    page AS (SELECT event_id FROM fx_archive ORDER BY ArchiveDate DESC, event_id LIMIT 500)
    SELECT count(*) AS count, count(*) FILTER (WHERE event_id IN (SELECT event_id FROM hits)) AS fp_count, count(*) < (SELECT count(*) FROM fx_archive) AS limited
    FROM page""")
def r13_summary(t):
    view = reports.findings_view(t["fx_archive"], t["fx_fp"], "rule-3", ["event_id"], limit=500, all_dates=True)
    return reports.view_summary(view, reports.in_view(t["fx_archive"], all_dates=True))


@check("r13_last_hash", """
    SELECT CAST(execution_date AS VARCHAR) AS execution_date, row_count, is_suppressed, is_recurrent,
           left(incident_hash, 8) AS hash_preview
    FROM fx_hashlog WHERE test_name = 'rule-3' ORDER BY fx_hashlog.execution_date DESC LIMIT 1""")
def r13_last_hash(t):
    return reports.last_hash(t["fx_hashlog"], "rule-3")


@check("r13_run_dates", """
    SELECT CAST(d AS VARCHAR) AS exec_date FROM (SELECT DISTINCT CAST(ArchiveDate AS DATE) AS d FROM fx_archive) ORDER BY d DESC LIMIT 30""")
def r13_dates(t):
    return reports.run_dates(t["fx_archive"])


@check("w06_same_as_previous", """
    WITH h AS (SELECT *, row_number() OVER (PARTITION BY test_name ORDER BY execution_date DESC) AS rn FROM fx_hashlog)
    SELECT a.test_name, coalesce(a.incident_hash = b.incident_hash, false) AS is_same_as_previous
    FROM h a LEFT JOIN h b ON b.test_name = a.test_name AND b.rn = 2 WHERE a.rn = 1""")
def w06(t):
    return reports.same_as_previous(t["fx_hashlog"])


@check("r15_suppressions", """
    SELECT s.* REPLACE (CAST(s.created_at AS VARCHAR) AS created_at), e.RiskEntryTitle AS entry_title, e.Criticality AS entry_criticality,
           e.ClosingDate AS entry_closing_date, e.ClosingDate IS NULL OR trim(e.ClosingDate) = '' AS entry_is_open
    FROM fx_suppression s LEFT JOIN fx_entry e ON e.RiskEntryId = s.linked_entry_id""")
def r15(t):
    return reports.suppressions_with_entries(t["fx_suppression"], t["fx_entry"])


@check("r15_of_one_rule", """
    SELECT suppression_id, linked_entry_id FROM fx_suppression WHERE test_id = 'T3'""")
def r15_rule(t):
    return reports.suppressions_with_entries(t["fx_suppression"], t["fx_entry"], "T3").select("suppression_id", "linked_entry_id")


@check("r16_entry_search", """
    SELECT * FROM fx_entry WHERE (RiskEntryId LIKE '%1%' OR RiskEntryTitle LIKE '%1%')
      AND (ClosingDate IS NULL OR trim(ClosingDate) = '') ORDER BY RiskEntryId LIMIT 50""")
def r16(t):
    return reports.search_entries(t["fx_entry"], "1")


@check("r17_fp_register", """
    SELECT f.fp_id, f.test_name, f.row_hash, f.note, f.marked_by, CAST(f.marked_at AS VARCHAR) AS marked_at, c.test_id,
           c.description AS test_description, c.responsible_area, c.status AS test_status, f.match_criteria, h.row_data
    FROM fx_fp f LEFT JOIN fx_config c ON c.test_name = f.test_name
    LEFT JOIN (SELECT fp_id, row_data FROM fx_fp_history WHERE event_type = 'marked') h ON h.fp_id = f.fp_id
    WHERE f.active""")
def r17(t):
    return reports.fp_register(t["fx_fp"], t["fx_config"], t["fx_fp_history"])


@check("r18_fp_events", """
    SELECT * REPLACE (CAST(event_at AS VARCHAR) AS event_at) FROM fx_fp_history
    ORDER BY fx_fp_history.event_at DESC, fp_history_id LIMIT 200""")
def r18(t):
    return reports.fp_event_history(t["fx_fp_history"])


@check("r18_fp_list", "SELECT * REPLACE (CAST(marked_at AS VARCHAR) AS marked_at) FROM fx_fp")
def r18_rule(t):
    return reports.fp_list(t["fx_fp"])


@check("r19_run_health", """
    WITH l AS (SELECT max(ExecutionDate) AS m FROM fx_runlog)
    SELECT CAST((SELECT m FROM l) AS VARCHAR) AS last_run_at, count(DISTINCT TestName) AS tests_executed,
           count(DISTINCT CASE WHEN TestResult = 'ERROR' THEN TestName END) AS errors,
           (SELECT m FROM l) < TIMESTAMP '2024-02-01 06:00:00' - INTERVAL 26 HOUR AS stale
    FROM fx_runlog WHERE ExecutionDate > (SELECT m FROM l) - INTERVAL 2 HOUR""")
def r19(t):
    return reports.run_health(t["fx_runlog"], dt.datetime(2024, 2, 1, 6))


@check("r20_reference_lists", """
    SELECT 'risk' AS kind, RiskId AS id, RiskTitle AS title, CAST(nivel_inerente AS VARCHAR) AS level FROM fx_risk
    UNION ALL SELECT DISTINCT 'area', Area, NULL, NULL FROM fx_area""")
def r20(t):
    risks = reports.risk_list(t["fx_risk"]).select(
        F.lit("risk").alias("kind"), F.col("RiskId").alias("id"), F.col("RiskTitle").alias("title"), F.col("RiskLevel").alias("level")
    )
    areas = reports.area_list(t["fx_area"]).select(F.lit("area").alias("kind"), F.col("Area").alias("id"))
    return risks.unionByName(areas, allowMissingColumns=True)


@check("r21_chart_kpi", "SELECT CAST(round(sum(amount), 4) AS DOUBLE) AS kpi_value FROM fx_archive WHERE ArchiveDate >= DATE '2024-01-24'")
def r21(t):
    spec = charts.ChartSpec.from_json("kpi", '{"y_aggregation":"sum","y_column":"amount","date_range":"7d"}')
    return charts.chart(t["fx_archive"], spec, AS_OF)


@check("r22_chart_by_day", "SELECT CAST(CAST(ArchiveDate AS DATE) AS VARCHAR) AS x, count(*) AS y FROM fx_archive GROUP BY 1")
def r22(t):
    return charts.chart(t["fx_archive"], charts.ChartSpec("line", date_range="all"), AS_OF)


@check("r22_chart_by_column", """
    SELECT coalesce(CAST(entity AS VARCHAR), '—') AS x, coalesce(avg(CAST(amount AS DOUBLE)), 0) AS y
    FROM fx_archive WHERE ArchiveDate >= DATE '2024-01-01' GROUP BY 1""")
def r22_column(t):
    spec = charts.ChartSpec.from_json("bar", '{"x_axis":"entity","y_aggregation":"AVG","y_column":"amount"}')
    return charts.chart(t["fx_archive"], spec, AS_OF)


SERIES = """
    WITH rows AS (SELECT *, CAST(CAST(ArchiveDate AS DATE) AS VARCHAR) AS x, CAST(user_id AS VARCHAR) AS series FROM fx_archive),
    top AS (SELECT series, sum(amount) AS total FROM rows GROUP BY 1 ORDER BY total DESC, series LIMIT 8)"""


@check("r23_chart_series", SERIES + """,
    cells AS (SELECT x, series, CAST(sum(amount) AS BIGINT) AS y FROM rows JOIN top USING (series) GROUP BY 1, 2)
    SELECT a.x, b.series, coalesce(c.y, 0) AS y
    FROM (SELECT DISTINCT x FROM cells) a CROSS JOIN (SELECT series FROM top) b LEFT JOIN cells c ON c.x = a.x AND c.series = b.series""")
def r23(t):
    spec = charts.ChartSpec("line", y_aggregation="SUM", y_column="amount", group_by="user_id", date_range="all")
    return charts.chart(t["fx_archive"], spec, AS_OF)


@check("j06_top_series", SERIES + """
    SELECT event_id, series FROM rows JOIN top USING (series)""")
def j06(t):
    spec = charts.ChartSpec("line", y_aggregation="SUM", y_column="amount", group_by="user_id", date_range="all")
    top = charts.top_series(t["fx_archive"], spec).select("series")
    rows = t["fx_archive"].select("event_id", F.col("user_id").cast("string").alias("series"))
    return rows.join(top, "series", "left_semi").select("event_id", "series")


@check("r25_by_status", "SELECT status, count(*) AS cnt FROM fx_config GROUP BY 1")
def r25(t):
    return reports.rules_by_status(t["fx_config"])


EXPECTED = {"ACTIVE": 25, "PAUSED": 3}


@check("r26_readiness", """
    SELECT 'archive findings' AS "check", true AS ok, NULL AS detail
    UNION ALL SELECT 'archive without stamp', false, NULL
    UNION ALL SELECT 'rules ACTIVE', count(*) FILTER (WHERE status = 'ACTIVE') = 25, CAST(count(*) FILTER (WHERE status = 'ACTIVE') AS VARCHAR) FROM fx_config
    UNION ALL SELECT 'rules PAUSED', count(*) FILTER (WHERE status = 'PAUSED') = 3, CAST(count(*) FILTER (WHERE status = 'PAUSED') AS VARCHAR) FROM fx_config
    UNION ALL SELECT 'table tb_incident_hashes', true, NULL
    UNION ALL SELECT 'table tb_tests_executions', false, 'Description, ErrorMessage, ExecutionTimeSec, Frequency, ResponsibleArea, RiskId, ShouldActivateChannel, Threshold'
    UNION ALL SELECT 'table ' || n, false, 'not found' FROM (VALUES ('tb_dashboard_charts'), ('tb_dashboard_views'),
      ('tb_false_positives'), ('tb_false_positives_history'), ('tb_test_configurations'),
      ('tb_test_configurations_history'), ('tb_test_suppressions')) v(n)""")
def r26(t):
    control = {"tb_incident_hashes": t["fx_hashlog"], "tb_tests_executions": t["fx_runlog"]}
    archives = {"findings": t["fx_archive"], "without stamp": t["fx_findings"]}
    return readiness(control, archives, t["fx_config"], EXPECTED)


@check("r14_findings_export", """
    WITH hits AS (
      SELECT g.event_id FROM fx_archive g JOIN sx_fp p ON p.test_name = 'rule-3' JOIN sx_crit c ON c.fp_id = p.fp_id
      WHERE p.crit IS NOT NULL GROUP BY g.event_id, g.entity, g.category, p.fp_id
      HAVING bool_and(coalesce(CASE c.col WHEN 'entity' THEN coalesce(CAST(g.entity AS VARCHAR), '')
                                          WHEN 'category' THEN coalesce(g.category, '') END = c.val, false)))
    SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, event_type, CAST(amount AS VARCHAR) AS amount,
           coalesce(CAST(entity AS VARCHAR), '') AS entity, coalesce(category, '') AS category, CAST(ArchiveDate AS VARCHAR) AS ArchiveDate,
           CASE WHEN event_id IN (SELECT event_id FROM hits) THEN 'Sim' ELSE 'Não' END AS FalsoPositivo
    FROM fx_archive""")
def r14(t):
    return reports.findings_export(t["fx_archive"], t["fx_fp"], "rule-3", ["event_id"], all_dates=True)


@check("r24_preview", "SELECT event_id, user_id, entity FROM fx_archive ORDER BY event_id LIMIT 10")
def r24(t):
    return reports.sample(t["fx_archive"].select("event_id", "user_id", "entity"), 10, ["event_id"])
