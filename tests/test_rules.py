"""Rules on hand-made rows: borders and unusual input."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from rulewatch.functions.calendar import business_friday, in_last_month, is_due
from rulewatch.functions.values import first_non_empty, from_millis, json_safe_rows, local_time_label, parse_date
from rulewatch.rules.audit_log import acl_change_events
from rulewatch.rules.participants import SANCTION_LISTS
from rulewatch.rules.registry import RULES, build, rule, sql_rule


def ts(text):
    return dt.datetime.fromisoformat(text)


def test_28_rules():
    assert sum(r.findings.__module__.startswith("rulewatch.") for r in RULES.values()) == 28


def test_last_month_leaves_out_the_last_day_after_midnight(spark):
    df = spark.createDataFrame(
        [(ts(t),) for t in ("2023-12-31T23:59", "2024-01-01T00:00", "2024-01-31T00:00", "2024-01-31T10:00", "2024-02-01T00:00")],
        "t timestamp_ntz",
    )
    kept = [r.t for r in df.where(in_last_month("t", "2024-02-10")).orderBy("t").collect()]
    assert kept == [ts("2024-01-01T00:00"), ts("2024-01-31T00:00")]
    assert df.where(in_last_month("t", "2024-02-10", inclusive_last_day=True)).count() == 3


def test_weekend_rows_belong_to_the_friday_before(spark):
    days = ["2024-01-15", "2024-01-19", "2024-01-20", "2024-01-21", "2024-01-22"]
    df = spark.createDataFrame([(dt.date.fromisoformat(d),) for d in days], "d date")
    got = [str(r[0]) for r in df.orderBy("d").select(business_friday(F.col("d"))).collect()]
    assert got == ["2024-01-19"] * 4 + ["2024-01-26"]


def test_schedules(spark):
    df = spark.createDataFrame([(f, dt.date(2024, 1, 5)) for f in ("DAILY", "WEEKLY", "MONTHLY", "YEARLY")], "f string, d date")
    assert [r[0] for r in df.select(is_due(F.col("f"), F.col("d"))).collect()] == [True, True, True, None]
    assert df.where(is_due(F.col("f"), F.date_add("d", 1))).count() == 1


@pytest.mark.parametrize("text,want", [
    ("1998-01-10", "1998-01-10"), ("10/01/1998", "1998-01-10"), ("10-01-1998", "1998-01-10"),
    ("1998-01-10 08:30:00", "1998-01-10"), ("31/02/1998", None), ("10/01-1998", None), ("soon", None), (None, None),
])
def test_dates_in_several_formats(spark, text, want):
    row = spark.createDataFrame([(text,)], "t string").select(parse_date("t").alias("d")).first()
    assert (None if row.d is None else str(row.d)) == want


def test_values(spark):
    df = spark.createDataFrame([("", None, "u"), (None, "", None)], "a string, b string, c string")
    assert [r[0] for r in df.select(first_non_empty("a", "b", "c", default="unknown")).collect()] == ["u", "unknown"]
    one = spark.createDataFrame([("1704067200000", ts("2024-01-01T02:30"))], "ms string, t timestamp_ntz")
    row = one.select(from_millis(F.col("ms")).cast("string"), local_time_label("t", "America/Sao_Paulo", "GMT-3")).first()
    assert tuple(row) == ("2024-01-01 00:00:00", "31-Dec-2023 11:30:00 PM GMT-3")


def test_json_safe_reaches_nested_values(spark):
    df = spark.sql("""SELECT array(timestamp_ntz'2024-01-01 02:03:04') AS a, map('k', date'2024-01-02') AS m,
                      named_struct('x', cast(1.5 AS decimal(4,2)), 'y', X'C3A3') AS s, X'FF' AS bad, cast(NULL AS struct<z: date>) AS n""")
    row = json_safe_rows(df, "-03:00").first()
    assert row.a == ["2024-01-01T02:03:04-03:00"] and row.m == {"k": "2024-01-02"}
    assert (row.s.x, row.s.y, row.bad, row.n) == (1.5, "ã", "�", None)


def assessments(spark, weeks):
    """One client; per week the number of NFE look-ups on the Wednesday."""
    rows, n = [], 0
    for week, count in weeks.items():
        for _ in range(count):
            n += 1
            rows.append((n, "c", ts(week)))
    tables = {
        "assessment": spark.createDataFrame(rows, "AssessmentId int, ClientCd string, CreatedAtDttm timestamp_ntz"),
        "external_search": spark.createDataFrame([(r[0], "live", "invoice") for r in rows], "AssessmentId int, UrlParsedName string, DataContractId string"),
        "contract_price": spark.sql("SELECT 'invoice' AS DataContractId, 0.0293 AS UnitPriceAmt"),
    }
    return tables


def test_consumption_peak_needs_an_earlier_week(spark):
    first = assessments(spark, {"2024-01-10": 9})
    assert build("consumption_peak", first, dt.date(2024, 1, 10), minimum=0.0).count() == 0
    grown = assessments(spark, {"2024-01-03": 4, "2024-01-10": 6, "2024-01-13": 50, "2024-01-17": 90})
    row = build("consumption_peak", grown, dt.date(2024, 1, 10), minimum=0.0).first()
    # Saturdays do not count, nor do later weeks.
    assert (row.AssessmentTotalQty, str(row.CreatedAtDttm)) == (6, "2024-01-12")
    flat = assessments(spark, {"2024-01-03": 9, "2024-01-10": 11})
    assert build("consumption_peak", flat, dt.date(2024, 1, 10), minimum=0.0).count() == 0
    assert build("consumption_peak", grown, dt.date(2024, 1, 10)).count() == 0


def test_sanctions_keep_one_row_per_document(spark):
    people = [(2, 7, "b", "1"), (1, 7, "a", "1"), (3, 8, "c", "0"), (4, 9, "d", "1")]
    lists = {name: spark.createDataFrame([(7, "z", "1"), (7, "y", None), (8, "x", "1")], f"{document} int, {parts[0]} string, {parts[1]} string")
             for name, _, document, parts in SANCTION_LISTS}
    tables = {"participant": spark.createDataFrame(people, "ParticipantId int, DocumentNumberCd int, ParticipantName string, StatusId string"), **lists}
    rows = build("sanctions", tables, None).collect()
    assert [(r.DocumentNumberCd, r.ParticipantId, r.CEISIncidence) for r in rows] == [(7, 1, "y")]


def test_acl_changes_are_one_row_per_user(spark):
    audit = spark.sql("""SELECT id AS event_id, concat('r', id) AS request_id, 'a' AS account_id, timestamp_ntz'2024-01-15 10:00:00' AS event_time,
        date'2024-01-15' AS event_date, 'act' AS action_name, named_struct('email', if(id % 3 = 0, NULL, 'busy')) AS user_identity,
        map('k', concat('v', id)) AS request_params, named_struct('status_code', 200) AS response FROM range(90)""")
    out = {r.email: r for r in build("acl_changes", {"audit": audit}, dt.date(2024, 1, 16), action="act").collect()}
    assert {k: (r["count"], r.account_count, r.request_count) for k, r in out.items()} == {"busy": (60, 1, 60), None: (30, 1, 30)}
    events = acl_change_events({"audit": audit}, dt.date(2024, 1, 16), action="act").where("event_id = 4").first()
    assert (events.email, events.request_params, events.response) == ("busy", '{"k":"v4"}', '{"status_code":200}')


def test_downloads_count_by_the_whole_identity(spark):
    audit = spark.sql("""SELECT id AS event_id, 'r' AS request_id, 's' AS session_id, timestamp_ntz'2024-01-15 10:00:00' AS event_time,
        'downloadLargeResults' AS action_name, 'notebook' AS service_name, if(id = 0, NULL, named_struct('email', if(id < 4, NULL, 'e'), 'subject_name', if(id < 8, 'a', 'b'))) AS user_identity,
        map('notebookId', 'n', 'commandId', 'c') AS request_params FROM range(9)""")
    found = build("bulk_downloads", {"audit": audit}, dt.date(2024, 1, 16), at_least=3).collect()
    assert sorted(r.event_id for r in found) == [1, 2, 3, 4, 5, 6, 7]


def test_the_raw_event_stays_as_it_came(spark):
    feed = spark.sql("""SELECT 1 AS id, '2024-01-15 10:00:00' AS created_at, 'api_key_deleted' AS type, 'org' AS organization_id,
                        named_struct('email_address', '', 'user_id', cast(NULL AS string), 'api_key_id', 'k', 'id', 'i') AS actor, 't' AS token_id""")
    got = build("token_events", {"feed": feed}, dt.date(2024, 1, 16)).first()
    assert (got.incident_id, got.actor_identifier, got.token_reference, got.organization_uuid) == ("token_criado_ou_deletado::1", "k", "t", "org")
    assert '"actor":{"email_address":"","api_key_id":"k","id":"i"}' in got.raw_event
    late = feed.withColumn("created_at", F.lit("2024-01-15T22:30:00-03:00"))  # 01:30 of the 16th in UTC
    assert build("token_events", {"feed": late}, dt.date(2024, 1, 16)).count() == 0
    assert build("token_events", {"feed": late}, dt.date(2024, 1, 17)).count() == 1


def test_availability_without_requests_is_no_finding(spark):
    http = spark.createDataFrame([(dt.date(2024, 1, 15), "p", "/e", 0, 500), (dt.date(2024, 1, 15), "p", "/f", 1, 500)],
                                 "EventDt date, ProjectId string, EndpointTxt string, RequestCountQty int, HttpStatusCd int")
    rows = build("availability", {"http": http}, dt.date(2024, 1, 16)).collect()
    assert [(r.EndpointTxt, r.availability_pct) for r in rows] == [("/f", 0.0)]


def test_registry_checks_names_and_results(spark):
    @rule("probe not a frame", ())
    def probe(tables, as_of):
        return 1

    with pytest.raises(TypeError):
        build("probe not a frame", {}, None)
    with pytest.raises(KeyError):
        build("probe unknown", {}, None)
    with pytest.raises(ValueError):
        rule("sanctions", ())(probe)
    assert sql_rule(spark, "SELECT * FROM {t} WHERE id > :n", {"t": spark.range(5)}, {"n": 2}).count() == 2
