"""Logs, snapshots, archives and rules over their limit, on the driver's tables."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import functions as F

from checks.engine import CONFIG, PARAMS, SIX
from checks.registry import CHECKS, check
from rulewatch.plans import reports
from rulewatch.plans.runner import run_rules
from rulewatch.rules.registry import rule
from rulewatch.session import work_dir
from rulewatch.sources.archive import Archive, publish, publish_replaced, read_published, write_findings
from rulewatch.sources.levels import Levels
from rulewatch.sources.logs import RunLog
from rulewatch.sources.schemas import append_rows, control_schema, empty
from rulewatch.sources.tables import load_configs


def place(t, name: str) -> str:
    return f"{work_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


@rule("waits for ever", ("participant",))
def waits_for_ever(tables, as_of):
    """Every participant, if its tasks ever ended."""

    def wait(batches):
        import time

        for batch in batches:
            while batch.num_rows:
                time.sleep(0.1)
            yield batch

    one = tables["participant"].select("ParticipantId")
    return one.mapInArrow(wait, one.schema)


def run(t, names: list[str], tables: list[str], **more):
    configs = t.spark.createDataFrame(
        [(f"T{i}", n, f"tb_incidents_{n}", n, "area", "R1", 0, "DAILY", "PYTHON", n, "ACTIVE", True) for i, n in enumerate(names)], CONFIG
    )
    return run_rules(
        t.spark, configs, t.rules(*tables), SIX, place(t, "runner"), t["fx_suppression"], t["fx_entry"],
        empty(t.spark, "tb_false_positives"), PARAMS | {"due_before_registry_" + k: {"cutoff": dt.date(1998, 1, 1)} for k in ("new", "old")}, **more,
    )


@check("e13_deadline", """
    SELECT 'invalid_phone' AS TestName, count(*) AS raw, CASE WHEN count(*) > 0 THEN 'FAILED' ELSE 'PASSED' END AS TestResult, false AS late
    FROM ({phones}) UNION ALL VALUES ('waits for ever', NULL, 'ERROR', true)""".replace("{phones}", CHECKS["t11_invalid_phone"].sql))
def e13_deadline(t):
    log = run(t, ["waits for ever", "invalid_phone"], ["participant"], limits={"waits for ever": 2.0}, workers=1)
    late = F.coalesce(F.col("ErrorMessage").startswith("over its limit of 2 seconds"), F.lit(False))
    return log.select("TestName", F.col("IncidentCountRaw").cast("bigint").alias("raw"), "TestResult", late.alias("late"))


# Rules whose findings do not depend on the day of the run.
ANY_DAY = ("t05_duplicate_documents", "t07_unmatched_document", "t10_invalid_email", "t11_invalid_phone")


@check("e03_rule_counts", " UNION ALL ".join(f"SELECT '{k[4:]}' AS TestName, count(*) AS raw FROM ({CHECKS[k].sql})" for k in ANY_DAY))
def e03_rule_counts(t):
    """What the writing jobs summed is what the rules' own queries count."""
    log = run(t, [k[4:] for k in ANY_DAY], ["participant", "establishment"])
    return log.select("TestName", F.col("IncidentCountRaw").cast("bigint").alias("raw"))


@check("s06_log_levels", """
    SELECT event_id, concat('rule-', user_id) AS test_name, CASE WHEN event_id % 3 = 0 THEN 'again' ELSE event_type END AS result, CAST(ts AS VARCHAR) AS run
    FROM events""")
def s06(t):
    """Eleven parts, the last of which writes a third of the rows again, merged four at a time."""
    levels = Levels(t.spark, place(t, "levels"), fanout=4)
    rows = t["events"].select("event_id", F.concat(F.lit("rule-"), "user_id").alias("test_name"), F.col("event_type").alias("result"), "ts")
    parts = [(rows.where(F.pmod(F.xxhash64("event_id"), F.lit(10)) == k), k) for k in range(10)]
    parts.append((rows.where("event_id % 3 = 0").withColumn("result", F.lit("again")), 10))
    schema = rows.drop("ts").schema
    for df, k in parts:
        part = levels.write("runs", levels.stamped(df, F.col("ts"), k).drop("ts"))
        levels.versions.update(lambda d, n, part=part: d | {"runs": [*d.get("runs", []), part]})
        levels.merge("runs", schema, ["event_id"])
    return levels.read("runs", schema, ["event_id"]).withColumnRenamed("_run", "run")


@check("w04_latest_state", """
    WITH r AS (SELECT TestName AS test_name, max(ExecutionDate) AS run_at, arg_max(TestResult, ExecutionDate) AS result,
                      arg_max(IsSupressed, ExecutionDate) AS suppressed FROM fx_runlog GROUP BY 1),
    h AS (SELECT test_name, max(execution_date) AS hash_at, arg_max({'kept': incident_hash}, execution_date) AS last FROM fx_hashlog GROUP BY 1)
    SELECT test_name, CAST(run_at AS VARCHAR) AS run_at, result, suppressed, CAST(hash_at AS VARCHAR) AS hash_at, last.kept AS incident_hash
    FROM r FULL JOIN h USING (test_name)""")
def w04(t):
    log = RunLog(t.spark, place(t, "log"))
    log.adopt(t["fx_runlog"], "tb_tests_executions")
    log.adopt(t["fx_hashlog"], "tb_incident_hashes")
    return log.latest()


@check("s07_adopted_log", """
    SELECT test_name, CAST(execution_date AS VARCHAR) AS execution_date, incident_hash, row_count, is_suppressed, is_recurrent FROM fx_hashlog""")
def s07_adopted(t):
    log = RunLog(t.spark, place(t, "log"))
    log.adopt(t["fx_hashlog"], "tb_incident_hashes")
    return log.read("tb_incident_hashes").drop("test_id")


@check("s08_snapshots", """
    SELECT o_orderkey, o_orderstatus, 'now' AS seen FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END AS o_orderstatus FROM orders)
    UNION ALL SELECT o_orderkey, o_orderstatus, 'first' FROM orders""")
def s08_snapshots(t):
    """Two versions and a half-written one: the current and the first are read whole."""
    folder, target = place(t, "orders"), t["orders"].select("o_orderkey", "o_orderstatus")
    publish(target, folder, "first")
    publish_replaced(target.where("o_orderstatus = 'P'").withColumn("o_orderstatus", F.lit("X")), folder, "o_orderkey", "second")
    target.limit(10).write.parquet(f"{folder}/version=third/half")
    now, first = read_published(t.spark, folder), read_published(t.spark, folder, "first")
    return now.withColumn("seen", F.lit("now")).unionByName(first.withColumn("seen", F.lit("first")))


@check("s03_load_configs", """
    SELECT test_id, test_name, threshold, status, 'loader' AS created_by, '2024-01-01 00:00:00' AS created_at,
           CASE WHEN status = 'ACTIVE' THEN '2024-01-01 00:00:00' END AS activated_at, 1 AS version FROM fx_config""")
def s03(t):
    """Lists of rules, a file each, with the defaults of a first load."""
    folder, given = place(t, "configs"), ["test_id", "test_name", "threshold", "status"]
    lists = t["fx_config"].groupBy(F.pmod(F.xxhash64("test_id"), F.lit(64))).agg(F.to_json(F.collect_list(F.struct(*given))).alias("value"))
    lists.select("value").write.option("maxRecordsPerFile", 1).text(folder)
    loaded = load_configs(t.spark, folder, "loader", "2024-01-01 00:00:00")
    return loaded.select(*given, "created_by", "created_at", "activated_at", "version")


@check("s04_empty", """
    SELECT test_name, CAST(execution_date AS VARCHAR) AS execution_date, incident_hash, row_count, is_suppressed, is_recurrent FROM fx_hashlog""")
def s04(t):
    """An empty log of full schema takes rows of fewer columns."""
    none = empty(t.spark, "tb_incident_hashes")
    assert none.schema == control_schema("tb_incident_hashes")
    return append_rows(none, t["fx_hashlog"])


RUNS = 6


def changing_archive(t) -> Archive:
    """Six runs of findings, whose amount is first a short, then a long number, then text."""
    folder = place(t, "archive")
    rows = t["fx_archive"].select("event_id", "user_id", "event_type", "amount", "_is_false_positive")
    for k in range(RUNS):
        mine = rows.where(F.col("event_id") % RUNS == k)
        typed = mine.withColumn("amount", F.col("amount").cast(("int", "bigint", "string")[k // 2]))
        write_findings(typed.coalesce(1), folder, "T1", dt.datetime(2024, 1, 1 + k, 6))
    return Archive(t.spark, folder, "T1")


STORED = f"""
    SELECT event_id, user_id, event_type, CAST(amount AS VARCHAR) AS amount, _is_false_positive,
           CAST(TIMESTAMP '2024-01-01 06:00:00' + INTERVAL 1 DAY * (event_id % {RUNS}) AS VARCHAR) AS ArchiveDate FROM fx_archive"""


@check("s05_changed_types", STORED)
def s05_changed_types(t):
    return changing_archive(t).read().drop("archive_dt", "run_at")


MARK = """[{"column":"event_type","value":"purchase"}]"""


@check("r13_findings_page", f"""
    SELECT event_id, user_id, event_type, amount, ArchiveDate, event_type = 'purchase' AS _is_false_positive, count(*) OVER () > 450 AS limited
    FROM ({STORED}) WHERE lower(concat_ws(' ', event_id, user_id, event_type, amount)) LIKE '%p%ch%' ORDER BY ArchiveDate DESC, event_id LIMIT 450""")
def r13_page(t):
    """The newest findings with a text: only the runs that hold them are opened."""
    fps = t.spark.createDataFrame([("F", "a rule", None, MARK, "u", dt.date(2024, 1, 1), "", True)], "fp_id string, test_name string, row_hash string, match_criteria string, marked_by string, marked_at date, note string, active boolean")
    page, limited = reports.findings_page(changing_archive(t), fps, "a rule", ["event_id"], "p%ch", limit=450)
    return page.select("event_id", "user_id", "event_type", F.col("amount").cast("string").alias("amount"), "ArchiveDate", "_is_false_positive").withColumn("limited", F.lit(limited))


@check("p15_indexed_search", f"""
    SELECT event_id, user_id, event_type, amount FROM ({STORED}) WHERE lower(concat_ws(' ', event_id, user_id, event_type, amount)) LIKE '%123%'""")
def p15_indexed(t):
    """A search over the files that the index leaves."""
    archive = changing_archive(t)
    archive.index()
    files = archive.matching("123")
    return archive.read(files, reports.wanted_rows("123")).select("event_id", "user_id", "event_type", F.col("amount").cast("string").alias("amount"))
