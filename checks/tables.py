"""Sources, sinks and single operators on the driver's tables."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F, types as T

from checks.fixtures import DRIVER_TABLES
from checks.registry import check
from rulewatch.functions.calendar import in_last_month, since_days
from rulewatch.functions.predicates import contains_text, date_scope
from rulewatch.functions.values import json_safe_rows, local_time_label, parse_date
from rulewatch.operators.grouping import (
    count_values, first_per_key, latest_per_key, page, page_after, values_of, recent_per_key, running_peak,
)
from rulewatch.operators.joins import in_any_list
from rulewatch.rules.consumption import weekly_volume
from rulewatch.session import work_dir
from rulewatch.sources.archive import apply_revocations, publish, read_findings, replace_by_key, write_findings
from rulewatch.sources.export import export_rows, read_csv, write_csv
from rulewatch.sources.schemas import append_rows, widen
from rulewatch.sources.tables import cleanup_plan, column_ranges, table_health


def scratch(t, name: str) -> str:
    """A folder of its own for each call."""
    return f"{work_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


# --- sources and sinks --------------------------------------------------------


@check("s05_findings_archive", """
    SELECT ParticipantId, DocumentNumberCd, EmailName, moment AS ArchiveDate, '2024-02-05' AS archive_dt, part AS run_at
    FROM fx_participant, (VALUES ('2024-02-05 06:00:00', '060000s'), ('2024-02-05 18:30:00', '183000s')) runs(moment, part)
    WHERE StatusId = '1' AND (EmailName LIKE '%acme%' OR EmailName IS NULL)""")
def s05(t):
    """Two runs of a day, the first written twice: the archive holds each run's findings once."""
    import rulewatch.rules as rules

    found = rules.build("invalid_email", t.rules("participant"), None, marker="acme").select(
        "ParticipantId", "DocumentNumberCd", "EmailName"
    )
    folder = scratch(t, "archive")
    for run_ts in (dt.datetime(2024, 2, 5, 6), dt.datetime(2024, 2, 5, 18, 30), dt.datetime(2024, 2, 5, 6)):
        write_findings(found, folder, "T/email", run_ts)
    return read_findings(t.spark, folder, "T/email")


@check("s08_replace_by_key", """
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderstatus <> 'P'
    UNION ALL SELECT o_orderkey, o_custkey, 'X', o_totalprice FROM orders WHERE o_orderstatus = 'P'""")
def s08(t):
    target = t["orders"].select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    new = target.where(F.col("o_orderstatus") == "P").withColumn("o_orderstatus", F.lit("X"))
    return publish(replace_by_key(target, new, "o_orderkey"), scratch(t, "replace"), "2")


@check("s09_soft_delete", """
    WITH l AS (SELECT suppression_id, event_type, row_number() OVER (PARTITION BY suppression_id ORDER BY event_at DESC, event_type DESC) AS rn
               FROM fx_suppression_event)
    SELECT s.suppression_id, s.test_id, coalesce(l.event_type <> 'revoked', s.active) AS active
    FROM fx_suppression s LEFT JOIN l ON l.suppression_id = s.suppression_id AND l.rn = 1""")
def s09(t):
    rows = apply_revocations(t["fx_suppression"], t["fx_suppression_event"], "suppression_id", "event_at", "revoked")
    return rows.select("suppression_id", "test_id", "active")


@check("s10_widen", """
    SELECT c_custkey AS id, c_name AS name, CAST(NULL AS VARCHAR) AS note, CAST(NULL AS BOOLEAN) AS pending FROM customer
    UNION ALL SELECT s_suppkey, NULL, s_name, NULL FROM supplier""")
def s10(t):
    schema = T.StructType.fromDDL("id bigint, note string, pending boolean")
    old = t["customer"].selectExpr("c_custkey AS id", "c_name AS name")
    return append_rows(widen(widen(old, schema), schema), t["supplier"].selectExpr("s_suppkey AS id", "s_name AS note"))


@check("s12_cleanup_plan", """
    SELECT DISTINCT output_table AS table_name, CASE WHEN starts_with(output_table, 'tb_incidents_') THEN 'drop' ELSE 'keep' END AS action
    FROM fx_config UNION ALL VALUES ('tb_incident_hashes', 'drop'), ('old_findings', 'drop'), ('somebody_elses', 'keep')""")
def s12(t):
    more = t.spark.createDataFrame([("tb_incident_hashes",), ("old_findings",), ("somebody_elses",)], "table_name string")
    names = t["fx_config"].select(F.col("output_table").alias("table_name")).unionByName(more)
    return cleanup_plan(t.spark, names, ["old_findings"])


@check("s13_export", """
    SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, event_type, CAST(amount AS VARCHAR) AS amount,
           coalesce(CAST(entity AS VARCHAR), '') AS entity, coalesce(category, '') AS category,
           CAST(ArchiveDate AS VARCHAR) AS ArchiveDate, CASE WHEN _is_false_positive THEN 'Sim' ELSE 'Não' END AS FalsoPositivo
    FROM fx_archive""")
def s13(t):
    path = scratch(t, "export")
    rows = export_rows(t["fx_archive"], ["event_id"])
    write_csv(rows, path)
    return read_csv(t.spark, path, rows.columns)


@check("s14_json_safe", """
    SELECT event_id, user_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '-03:00' AS ts, CAST(CAST(ts AS DATE) AS VARCHAR) AS day,
           CAST(CAST(value AS DECIMAL(12, 2)) AS DOUBLE) AS price, event_type AS raw,
           strftime(ts, '%Y-%m-%dT%H:%M:%S') || '-03:00' AS stamps, props
    FROM events""")
def s14(t):
    rows = t["events"].select(
        "event_id", "user_id", "ts", F.to_date("ts").alias("day"), F.col("value").cast("decimal(12,2)").alias("price"),
        F.col("event_type").cast("binary").alias("raw"), F.array("ts").alias("stamps"), "props",
    )
    return json_safe_rows(rows, "-03:00")


@check("s15_table_health", " UNION ALL ".join(
    f"SELECT '{n}' AS table_name, count(*) AS row_count, CAST(NULL AS VARCHAR) AS error FROM {n}"
    for n in DRIVER_TABLES
) + " UNION ALL SELECT 'gone', NULL, '''gone'''")
def s15(t):
    return table_health(t.spark, {n: t[n] for n in DRIVER_TABLES}, [*DRIVER_TABLES, "gone"])


@check("s16_column_profile", """
    SELECT 'event_id' AS column_name, 'numeric' AS kind, count(event_id) AS filled, CAST(min(event_id) AS VARCHAR) AS smallest, CAST(max(event_id) AS VARCHAR) AS largest FROM fx_archive
    UNION ALL SELECT 'user_id', 'numeric', count(user_id), CAST(min(user_id) AS VARCHAR), CAST(max(user_id) AS VARCHAR) FROM fx_archive
    UNION ALL SELECT 'event_type', 'categorical', count(event_type), min(event_type), max(event_type) FROM fx_archive
    UNION ALL SELECT 'amount', 'numeric', count(amount), CAST(min(amount) AS VARCHAR), CAST(max(amount) AS VARCHAR) FROM fx_archive
    UNION ALL SELECT 'entity', 'numeric', count(entity), CAST(min(entity) AS VARCHAR), CAST(max(entity) AS VARCHAR) FROM fx_archive
    UNION ALL SELECT 'category', 'categorical', count(category), min(category), max(category) FROM fx_archive""")
def s16(t):
    return column_ranges(t["fx_archive"])


# --- single operators -----------------------------------------------------------


@check("p05_last_month", """
    SELECT o_orderkey, CAST(o_orderdate AS VARCHAR) AS o_orderdate FROM orders
    WHERE o_orderdate >= TIMESTAMP '1997-12-01' AND o_orderdate < TIMESTAMP '1998-01-01'""")
def p05(t):
    rows = t["orders"].where(in_last_month("o_orderdate", "1998-01-10", inclusive_last_day=True))
    return rows.select("o_orderkey", "o_orderdate")


@check("p15_search", """
    SELECT event_id, event_type FROM fx_archive
    WHERE lower(concat_ws(' ', event_id, user_id, event_type, amount, entity, category)) LIKE '%1 click%'""")
def p15(t):
    return t["fx_archive"].where(contains_text(t["fx_archive"], " 1 CLICK ")).select("event_id", "event_type")


SCOPES = {
    "latest": ({}, "CAST(ArchiveDate AS DATE) = (SELECT CAST(max(ArchiveDate) AS DATE) FROM fx_archive)"),
    "range": ({"date_from": "2024-01-05", "date_to": "2024-01-07"}, "CAST(ArchiveDate AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-07'"),
    "from": ({"date_from": "2024-01-20"}, "CAST(ArchiveDate AS DATE) >= DATE '2024-01-20'"),
    "to": ({"date_to": "2024-01-04"}, "CAST(ArchiveDate AS DATE) <= DATE '2024-01-04'"),
    "search": ({"search": "click"}, "true"),
    "all": ({"all_dates": True, "date_from": "2024-01-20"}, "true"),
}


def _scope_check(name, arguments, where):
    @check(f"p16_scope_{name}", f"SELECT event_id, user_id FROM fx_archive WHERE {where}")
    def scoped(t):
        return t["fx_archive"].where(date_scope(t["fx_archive"], **arguments)).select("event_id", "user_id")


for _name, (_arguments, _where) in SCOPES.items():
    _scope_check(_name, _arguments, _where)


@check("p18_date_range", "SELECT event_id FROM fx_archive WHERE ArchiveDate >= DATE '2024-01-24'")
def p18(t):
    return t["fx_archive"].where(since_days("ArchiveDate", dt.date(2024, 1, 31), 7)).select("event_id")


@check("j05_any_list", """
    SELECT o_orderkey, o_custkey, a.x AS machines, b.x AS rich FROM orders
    LEFT JOIN (SELECT c_custkey, c_name AS x FROM customer WHERE c_mktsegment = 'MACHINERY') a ON a.c_custkey = o_custkey
    LEFT JOIN (SELECT c_custkey, c_mktsegment AS x FROM customer WHERE c_acctbal > 5000) b ON b.c_custkey = o_custkey
    WHERE a.x IS NOT NULL OR b.x IS NOT NULL""")
def j05(t):
    customers = t["customer"].withColumnRenamed("c_custkey", "o_custkey")
    lists = {
        "machines": (customers.where(F.col("c_mktsegment") == "MACHINERY"), "c_name"),
        "rich": (customers.where(F.col("c_acctbal") > 5000), "c_mktsegment"),
    }
    return in_any_list(t["orders"].select("o_orderkey", "o_custkey"), "o_custkey", lists)


@check("w01_latest_run", """
    SELECT TestName, CAST(ExecutionDate AS VARCHAR) AS ExecutionDate, IncidentCount, TestResult
    FROM (SELECT *, row_number() OVER (PARTITION BY TestName ORDER BY ExecutionDate DESC) AS rn FROM fx_runlog) WHERE rn = 1""")
def w01(t):
    runs = t["fx_runlog"].select("TestName", "ExecutionDate", "IncidentCount", "TestResult")
    return latest_per_key(runs, ["TestName"], ["ExecutionDate"])


@check("w02_recent_runs", """
    SELECT TestName, CAST(ExecutionDate AS VARCHAR) AS ExecutionDate, rn
    FROM (SELECT *, row_number() OVER (PARTITION BY TestName ORDER BY ExecutionDate DESC) AS rn FROM fx_runlog) WHERE rn <= 14""")
def w02(t):
    return recent_per_key(t["fx_runlog"].select("TestName", "ExecutionDate"), "TestName", ["ExecutionDate"], 14)


@check("w03_prev_peak", """
    WITH b AS (SELECT a.ClientCd, date_trunc('week', a.CreatedAtDttm)::DATE + 4 AS wk, count(*) AS qty
               FROM fx_assessment a JOIN fx_external_search x USING (AssessmentId)
               WHERE x.UrlParsedName <> 'cache' AND x.DataContractId <> 'other' AND dayofweek(a.CreatedAtDttm) BETWEEN 1 AND 5
               GROUP BY 1, 2)
    SELECT ClientCd, CAST(wk AS VARCHAR) AS Week, qty AS AssessmentTotalQty,
           max(qty) OVER (PARTITION BY ClientCd ORDER BY wk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS peak FROM b""")
def w03(t):
    weekly = weekly_volume(t.rules("assessment", "external_search", "contract_price")).select("ClientCd", "Week", "AssessmentTotalQty")
    return running_peak(weekly, "ClientCd", "Week", "AssessmentTotalQty", "peak")


@check("o03_page", """
    WITH n AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders)
    SELECT o_orderkey, o_totalprice, n - 200 AS rn, (SELECT count(*) FROM orders) > 700 AS has_more FROM n WHERE n BETWEEN 201 AND 700""")
def o03(t):
    return page(t["orders"].select("o_orderkey", "o_totalprice"), [F.desc("o_totalprice"), F.asc("o_orderkey")], 500, 200)


@check("o03_page_after", """
    WITH n AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 250000 OR (o_totalprice = 250000 AND o_orderkey > 5)
               ORDER BY o_totalprice DESC, o_orderkey LIMIT 51)
    SELECT * FROM (SELECT *, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS rn,
                          count(*) OVER () > 50 AS has_more FROM n) WHERE rn <= 50""")
def o03_after(t):
    return page_after(t["orders"].select("o_orderkey", "o_totalprice"), "o_totalprice", "o_orderkey", (250000.0, 5), 50)


@check("d01_distinct", "SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def d01(t):
    return t["lineitem"].select("l_partkey", "l_suppkey").distinct()


@check("d02_dedup", """
    SELECT o_custkey, o_orderkey, o_totalprice FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM orders) WHERE rn = 1""")
def d02(t):
    return first_per_key(t["orders"].select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], ["o_orderkey"])


@check("d03_last_wins", """
    SELECT user_id, event_id, event_type FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events WHERE user_id IS NOT NULL) WHERE rn = 1""")
def d03(t):
    rows = t["events"].where(F.col("user_id").isNotNull()).select("user_id", "event_id", "event_type", "ts")
    return latest_per_key(rows, ["user_id"], ["ts", "event_id"]).drop("ts")


@check("d05_difference", """
    SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 450000)""")
def d05(t):
    large = t["orders"].where(F.col("o_totalprice") > 450000).select(F.col("o_custkey").alias("c_custkey"))
    return t["customer"].select("c_custkey", "c_name").join(large, "c_custkey", "left_anti")


@check("a06_value_counts", "SELECT l_suppkey, count(DISTINCT l_partkey) AS distinct_count FROM lineitem GROUP BY 1")
def a06(t):
    return count_values(t["lineitem"], ["l_suppkey"], "l_partkey", "distinct_count")


@check("a06_values", """
    SELECT DISTINCT l_suppkey, l_partkey FROM lineitem
    WHERE l_suppkey IN (SELECT l_suppkey FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) > 40)""")
def a06_values(t):
    found = count_values(t["lineitem"], ["l_suppkey"], "l_partkey", "n", having=F.count("l_partkey") > 40)
    return values_of(t["lineitem"], found, ["l_suppkey"], "l_partkey")


@check("f11_multi_format_date", """
    SELECT AssetId, DueDt, CAST(coalesce(try_strptime(DueDt, '%Y-%m-%d'), try_strptime(DueDt, '%d/%m/%Y'),
                                         try_strptime(DueDt, '%d-%m-%Y'))::DATE AS VARCHAR) AS due FROM fx_asset""")
def f11(t):
    return t["fx_asset"].select("AssetId", "DueDt", parse_date("DueDt").alias("due"))


@check("f13_local_time", """
    SELECT event_id, strftime(ts - INTERVAL 3 HOUR, '%d-%b-%Y %I:%M:%S %p') || ' GMT-3' AS label FROM events""")
def f13(t):
    return t["events"].select("event_id", local_time_label("ts", "America/Sao_Paulo", "GMT-3").alias("label"))
