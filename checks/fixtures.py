"""Views that give the driver's tables the columns the rules and reports read.

Each is plain SQL over whole tables that Spark and DuckDB both run: braces name a
table or another view, ``TIMESTAMP_NTZ`` becomes DuckDB's ``TIMESTAMP``.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

from rulewatch.sources.tables import Tables, parquet_tables

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# The whole-row hash of a finding (category N, entity 2), as an old false positive has it.
OLD_HASH = hashlib.sha256(b"N|2").hexdigest()

VIEWS = {
    # --- what the rules read -------------------------------------------------
    "fx_user": """
        SELECT c_custkey AS UserId, c_name AS UserName,
               concat(lower(c_mktsegment), c_custkey,
                      CASE WHEN c_nationkey < 5 THEN '@acme.example' ELSE '@mail.example' END) AS EmailAddressTxt,
               CASE WHEN c_acctbal < 500 THEN 0 ELSE 1 END AS StatusId
        FROM {customer}""",
    "fx_user_company": "SELECT o_custkey AS UserId, o_orderkey % 1000 AS CompanyId FROM {orders}",
    "fx_company": "SELECT s_suppkey AS CompanyId, s_name AS CorporateName FROM {supplier}",
    "fx_participant": """
        SELECT o_orderkey AS ParticipantId, o_custkey AS DocumentNumberCd,
               concat('P', o_orderkey) AS ParticipantName,
               CASE WHEN o_orderstatus = 'P' THEN '0' ELSE '1' END AS StatusId,
               o_orderdate AS CreatedAtDttm, CAST(1 + o_orderkey % 2 AS int) AS DocumentTypeId,
               concat('u', o_custkey % 6) AS CreatedById,
               CASE WHEN o_custkey % 9 = 0 THEN NULL
                    ELSE concat(lower(o_orderstatus), '@', CASE WHEN o_custkey % 4 = 0 THEN 'acme' ELSE 'mail' END)
               END AS EmailName,
               CASE o_custkey % 10 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '1234567'
                    ELSE concat('9', CAST(10000000 + o_custkey * 7919 AS string)) END AS Phone1Num
        FROM {orders}""",
    "fx_establishment": """
        SELECT CASE WHEN c_acctbal >= 0 THEN c_custkey ELSE -c_custkey END AS DocumentCd,
               CAST(floor(c_custkey / 10) AS bigint) AS RootDocumentCd,
               DATE '1995-01-01' + CAST(c_custkey % 2400 AS int) AS ActivityStartDt,
               CASE WHEN c_nationkey = 1 THEN '01' WHEN c_nationkey = 2 THEN '02'
                    WHEN c_nationkey = 3 THEN '09' ELSE '00' END AS RegistrationStatusReasonCd,
               DATE '1996-01-01' + CAST(c_custkey % 700 AS int) AS RegistrationStatusDt
        FROM {customer}""",
    "fx_status_reason": """
        SELECT concat('0', r_regionkey) AS RegistrationStatusReasonCd,
               r_name AS RegistrationStatusReasonDesc FROM {region}""",
    "fx_fi_registration": """
        SELECT CASE WHEN c_mktsegment = 'MACHINERY' THEN c_custkey ELSE -c_custkey END AS FundDocumentCd,
               c_custkey + 100000 AS CvmCd, concat('Fund ', c_custkey) AS FundSocialName
        FROM {customer}""",
    "fx_fund_registration": """
        SELECT CASE WHEN c_nationkey = 6 THEN c_custkey ELSE -c_custkey END AS FundDocumentCd,
               c_custkey + 200000 AS FundRegistrationId
        FROM {customer}""",
    "fx_participant_nature": """
        SELECT l_orderkey AS ParticipantId, l_linenumber % 5 AS NatureOperationId,
               CASE WHEN l_returnflag = 'R' THEN 0 ELSE 1 END AS StatusId FROM {lineitem}""",
    "fx_nature": """
        SELECT r_regionkey AS NatureOperationId,
               CASE WHEN r_regionkey = 2 THEN 'FIDC' ELSE r_name END AS DescriptionDesc,
               CASE WHEN r_regionkey = 4 THEN '0' ELSE '1' END AS StatusCd FROM {region}""",
    "fx_ceis": """
        SELECT CASE WHEN c_nationkey = 3 THEN c_custkey END AS SanctionedCpfOrCnpjCd,
               c_custkey % 3 AS SanctionCodeCd, c_mktsegment AS SanctionCategoryDesc
        FROM {customer}""",
    "fx_cepim": """
        SELECT CASE WHEN c_nationkey = 4 THEN c_custkey END AS EntityCnpjCd,
               c_custkey % 5 AS AgreementNum, c_mktsegment AS GrantingAgencyDesc
        FROM {customer}""",
    "fx_cnep": """
        SELECT CASE WHEN c_nationkey IN (3, 7) THEN c_custkey END AS SanctionedCpfOrCnpjCd,
               c_custkey % 7 AS SanctionCodeCd, c_mktsegment AS SanctionCategoryDesc
        FROM {customer}""",
    "fx_leniency": """
        SELECT CASE WHEN c_acctbal > 9000 THEN c_custkey END AS SanctionedCompanyCnpjCd,
               c_custkey % 9 AS ProcessNum, c_mktsegment AS SanctioningOfficeDesc
        FROM {customer}""",
    "fx_historic": """
        SELECT event_id, ts AS CreatedAtDttm,
               concat('[', event_type, '] [user/participant id: ', user_id, ']') AS DescriptionTxt,
               concat('10.0.0.', CAST(floor(value) AS bigint) % 50) AS CreatedByIpCd
        FROM {events}""",
    "fx_asset": """
        SELECT l_orderkey * 10 + l_linenumber AS AssetId,
               CASE l_linenumber WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 39 ELSE 999 END AS TypeAssetId,
               l_linestatus AS StatusAssetId,
               CAST(CAST(o_orderdate AS date) AS string) AS RegistryDttm,
               CASE l_partkey % 4
                 WHEN 0 THEN CAST(CAST(l_shipdate AS date) AS string)
                 WHEN 1 THEN concat(substr(CAST(l_shipdate AS string), 9, 2), '/',
                                    substr(CAST(l_shipdate AS string), 6, 2), '/',
                                    substr(CAST(l_shipdate AS string), 1, 4))
                 WHEN 2 THEN concat(substr(CAST(l_shipdate AS string), 9, 2), '-',
                                    substr(CAST(l_shipdate AS string), 6, 2), '-',
                                    substr(CAST(l_shipdate AS string), 1, 4))
                 ELSE CASE WHEN l_tax > 0.07 THEN 'soon' ELSE CAST(CAST(l_shipdate AS date) AS string) END
               END AS DueDt
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey""",
    "fx_http": """
        SELECT CAST(ts AS date) AS EventDt, user_id % 5 AS ProjectId, concat('/e', user_id % 3) AS EndpointTxt,
               1 + CAST(floor(value) AS bigint) AS RequestCountQty,
               CASE WHEN event_type = 'error' AND value > 50 THEN 503 ELSE 200 END AS HttpStatusCd
        FROM {events}""",
    "fx_feed": """
        SELECT event_id AS id, CAST(ts AS string) AS created_at,
               CASE event_type WHEN 'signup' THEN 'API_key_created' WHEN 'error' THEN 'org_data_export_started'
                    ELSE event_type END AS type,
               CASE WHEN user_id % 3 = 0 THEN '' ELSE concat('u', user_id, '@mail.example') END AS actor_email,
               CASE WHEN user_id % 6 = 0 THEN NULL ELSE CAST(user_id AS string) END AS actor_user_id
        FROM {events}""",
    "fx_employee": """
        SELECT concat(CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN '' ELSE 'EX ' END, upper(c_name)) AS EmployeeName,
               concat('Emp', c_custkey, '@ACME.example') AS CorporateEmail, c_mktsegment AS DepartmentName,
               concat('class ', c_nationkey) AS ManagementClassName,
               DATE '1995-01-01' + CAST(c_custkey % 2400 AS int) AS HireDate
        FROM {customer}""",
    "fx_associate": """
        SELECT concat(CASE WHEN c_acctbal > 5000 THEN '' ELSE 'late ' END, lower(c_name)) AS AssociateName,
               c_nationkey AS AssociateQualificationCd, c_custkey * 7 AS AssociateDocumentCd,
               CAST(floor(c_custkey / 10) AS bigint) AS RootDocumentCd
        FROM {customer}""",
    "fx_public_company": """
        SELECT DISTINCT CAST(floor(c_custkey / 10) AS bigint) AS RootDocumentCd,
               concat('Company ', CAST(floor(c_custkey / 10) AS bigint)) AS CompanyName
        FROM {customer}""",
    "fx_partner_exception": """
        SELECT concat(CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE 'not ' END, c_name) AS AssociateName,
               concat('P', o_orderkey) AS ParticipantName
        FROM {orders} JOIN {customer} ON o_custkey = c_custkey""",
    "fx_hr_employee": """
        SELECT c_name AS Name, concat('Emp', c_custkey, '@ACME.example') AS CorporateEmail,
               c_mktsegment AS DepartmentName,
               DATE '1995-01-01' + CAST(c_custkey % 2400 AS int) AS AdmissionDate
        FROM {customer}""",
    "fx_training": """
        SELECT concat(CASE WHEN o_orderpriority = '2-HIGH' THEN 'emp' ELSE 'guest' END, o_custkey, '@acme.example') AS Email,
               concat('M', o_orderkey % 2) AS ModuleName,
               CAST(o_orderdate AS date) AS StartDate,
               CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS date) END AS CompletionDate,
               o_orderstatus AS Status
        FROM {orders}""",
    "fx_audit": """
        SELECT event_id, concat('r', event_id) AS request_id, concat('s', user_id) AS session_id,
               concat('a', user_id % 3) AS account_id, ts AS event_time, CAST(ts AS date) AS event_date,
               concat('user', user_id % 10, '@mail.example') AS user_email,
               CASE event_type WHEN 'click' THEN 'notebook' ELSE 'platform' END AS service_name,
               CASE event_type WHEN 'view' THEN 'downloadLargeResults' WHEN 'click' THEN 'runCommand'
                    WHEN 'signup' THEN 'generateDbToken' WHEN 'error' THEN 'revokeDbToken'
                    ELSE 'updatePermissionAssignment' END AS action_name,
               user_id % 25 AS workspace_id, user_id % 20 AS notebook_id,
               CAST(floor(value) AS bigint) % 20 AS command_id,
               CASE event_type WHEN 'click' THEN concat('select ', event_id) END AS command_text,
               CASE event_type WHEN 'error' THEN event_id - 1 ELSE event_id END AS token_hash,
               CAST((1704067200 + (event_id % 60) * 86400) * 1000 AS string) AS token_expiration_ms,
               props AS request_params
        FROM {events}""",
    "fx_workspace": """
        SELECT n_nationkey AS workspace_id,
               concat(n_name, CASE WHEN n_nationkey % 3 = 0 THEN '-prd' ELSE '-dev' END) AS workspace_name,
               concat('https://w', n_nationkey, '.example') AS workspace_url
        FROM {nation}""",
    "fx_assessment": """
        SELECT o_orderkey AS AssessmentId, CAST(floor(o_custkey / 75) AS bigint) AS ClientCd,
               o_orderdate AS CreatedAtDttm FROM {orders}""",
    "fx_external_search": """
        SELECT o_orderkey AS AssessmentId,
               CASE WHEN o_totalprice > 400000 THEN 'cache' WHEN o_totalprice < 3000 THEN NULL ELSE 'live'
               END AS UrlParsedName,
               CASE o_orderpriority WHEN '1-URGENT' THEN 'person' WHEN '2-HIGH' THEN 'company'
                    WHEN '3-MEDIUM' THEN 'invoice' ELSE 'other' END AS DataContractId
        FROM {orders}""",
    "fx_contract_price": """
        SELECT CASE r_regionkey WHEN 0 THEN 'person' WHEN 1 THEN 'company' WHEN 2 THEN 'invoice' ELSE r_name END AS DataContractId,
               CAST(0.0293 + r_regionkey * 0.0417 AS decimal(18, 6)) AS UnitPriceAmt
        FROM {region}""",
    "fx_asset_type": """
        SELECT CASE r_regionkey WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 37 + r_regionkey END AS TypeAssetId, r_name AS TypeAssetName
        FROM {region}""",
    "fx_policy_history": """
        SELECT concat('user', user_id % 10) AS UserEmailTxt, ts AS IngestedAtDttm,
               CASE event_type WHEN 'click' THEN 'disabled' WHEN 'error' THEN 'deleted' ELSE 'created'
               END AS ActionName,
               concat('p', user_id % 3) AS ProjectName, concat('r', event_id % 2) AS RepositoryName
        FROM {events}""",
    # --- control tables: one rule per customer, run on the days its user was active ----
    "fx_config": """
        SELECT concat('T', c_custkey) AS test_id,
               CASE WHEN c_custkey % 101 = 7 THEN concat('RULE-', c_custkey - 1)
                    WHEN c_custkey % 211 = 9 THEN ' ' ELSE concat('rule-', c_custkey) END AS test_name,
               CASE WHEN c_custkey % 97 = 5 THEN concat('Incidents-', c_custkey)
                    WHEN c_custkey % 89 = 3 THEN concat('tb_incidents_rule_', c_custkey - 1)
                    ELSE concat('tb_incidents_rule_', c_custkey) END AS output_table,
               concat('check ', c_name) AS description,
               CASE WHEN c_acctbal < -500 THEN NULL ELSE c_mktsegment END AS responsible_area,
               CASE WHEN c_custkey % 13 = 0 THEN 'N/A' ELSE concat('R', c_nationkey) END AS risco_id,
               CASE WHEN c_custkey % 4 = 0 THEN 1 ELSE 0 END AS threshold,
               CASE c_custkey % 7 WHEN 0 THEN NULL WHEN 1 THEN 'weekly' WHEN 2 THEN 'MONTHLY'
                    WHEN 3 THEN 'YEARLY' ELSE 'DAILY' END AS frequency,
               CASE c_custkey % 8 WHEN 0 THEN 'R' WHEN 1 THEN 'python' WHEN 2 THEN 'PYTHON' ELSE 'SQL' END AS query_type,
               CASE WHEN c_custkey % 16 = 1 THEN 'import subProcess' ELSE '' END AS imports,
               CASE c_custkey % 16
                    WHEN 2 THEN 'df_incidents = eval("1")' WHEN 3 THEN 'select 1; drop table x'
                    WHEN 4 THEN '/* a; b */ with t as (select 1) select * from t ;' WHEN 5 THEN 'delete from t'
                    WHEN 6 THEN '-- nothing' WHEN 7 THEN 'selected' WHEN 10 THEN 'df.write.parquet(x)'
                    WHEN 11 THEN '  ' WHEN 12 THEN NULL ELSE 'SELECT 1 -- ; fine' END AS query_code,
               CASE c_custkey % 10 WHEN 6 THEN 'PAUSED' WHEN 7 THEN 'UNDER_REVIEW' WHEN 8 THEN 'PENDING_DELETE'
                    WHEN 9 THEN CASE WHEN c_acctbal > 3000 THEN 'DRAFT' ELSE 'CANCELLED' END ELSE 'ACTIVE' END AS status,
               lower(c_mktsegment) AS category,
               concat('u', c_custkey % 4) AS created_by,
               DATE '2024-01-01' + CAST(c_custkey % 50 AS int) AS updated_at,
               1 + CAST(c_custkey % 3 AS int) AS version,
               c_custkey % 5 <> 1 AS should_activate_channel,
               'SQL' AS pending_query_type, 'import y' AS pending_imports,
               concat('SELECT ', c_custkey) AS pending_query_code, CAST(9 AS int) AS pending_threshold,
               'WEEKLY' AS pending_frequency, concat('new ', c_name) AS pending_description,
               'AREA' AS pending_responsible_area, 'R1' AS pending_risco_id,
               'cat' AS pending_category, false AS pending_should_activate_channel
        FROM {customer}""",
    "fx_risk": """
        SELECT concat(CASE WHEN n_regionkey <> 4 THEN 'R' ELSE 'X' END, n_nationkey) AS RiskId, n_name AS RiskTitle, n_regionkey AS nivel_inerente
        FROM {nation}""",
    "fx_area": "SELECT c_mktsegment AS Area FROM {customer}",
    "fx_entry": """
        SELECT concat('E', s_suppkey) AS RiskEntryId, s_name AS RiskEntryTitle,
               concat('C', s_nationkey % 3) AS Criticality, concat('area ', s_nationkey) AS ResponsibleArea,
               '2023-12-01' AS OpeningDate,
               CASE s_suppkey % 4 WHEN 0 THEN NULL WHEN 1 THEN '' WHEN 2 THEN '  ' ELSE '2024-01-15' END AS ClosingDate,
               '2024-12-01' AS ImplementationDeadline
        FROM {supplier}""",
    "fx_suppression": """
        SELECT concat('S', p_partkey) AS suppression_id,
               concat('T', CAST(floor(p_partkey / 13) AS bigint)) AS test_id,
               concat('rule-', CAST(floor(p_partkey / 13) AS bigint)) AS test_name,
               CASE WHEN p_size = 7 THEN NULL ELSE concat('E', p_size * 3) END AS linked_entry_id,
               p_name AS note, concat('u', p_size % 4) AS created_by,
               DATE '2024-01-01' + CAST(p_size AS int) AS created_at,
               p_partkey % 4 <> 0 AND p_type = 'PROMO' AS active
        FROM {part}""",
    "fx_suppression_event": """
        SELECT concat(CASE WHEN created_by IN ('u1', 'u2') THEN '' ELSE 'old-' END, suppression_id) AS suppression_id,
               created_at + CAST(3 AS int) AS event_at,
               CASE WHEN created_by = 'u1' THEN 'revoked' ELSE 'renewed' END AS event_type
        FROM {fx_suppression}""",
    "fx_fp": f"""
        SELECT concat('F', p_partkey) AS fp_id,
               concat('rule-', CAST(floor(p_partkey / 13) AS bigint)) AS test_name,
               CASE p_size % 3 WHEN 0 THEN '{OLD_HASH}' WHEN 1 THEN '' ELSE 'feed' END AS row_hash,
               CASE p_partkey % 6
                 WHEN 0 THEN concat('[{{{{"column":"entity","value":"', p_size % 50, '"}}}}]')
                 WHEN 1 THEN concat('[{{{{"column":"entity","value":"', p_size % 20, '"}}}},{{{{"column":"category","value":"N"}}}}]')
                 WHEN 2 THEN '[{{{{"column":"ghost","value":"1"}}}}]'
                 WHEN 3 THEN '[{{{{"column"'
                 WHEN 4 THEN concat('[{{{{"value":null,"column":"category"}}}},{{{{"column":"entity","value":', p_size % 20, '}}}}]')
               END AS match_criteria,
               concat('u', p_size % 4) AS marked_by, DATE '2024-01-01' + CAST(p_size AS int) AS marked_at,
               p_name AS note, p_partkey % 7 <> 0 AS active
        FROM {{part}}""",
    "fx_fp_criteria": """
        SELECT concat('F', p_partkey) AS fp_id,
               CASE p_size % 6
                 WHEN 0 THEN '[{{"column":"a","value":"1"}},{{"column":"b","value":null}},{{"column":"c","value":"3"}},{{"column":"d","value":"4"}}]'
                 WHEN 1 THEN '[{{"column":"a","value":"1"}},{{"column":" a ","value":"2"}}]'
                 WHEN 2 THEN concat('[{{"column":"', p_name, '","value":"1"}}]')
                 WHEN 3 THEN '[]' WHEN 4 THEN '[{{"column":"ok_1","value":"1"}}]' END AS match_criteria
        FROM {part}""",
    "fx_fp_history": """
        SELECT concat('H1-', p_partkey) AS fp_history_id, concat('F', p_partkey) AS fp_id, 'marked' AS event_type,
               concat('{{"id":', p_partkey, '}}') AS row_data,
               CASE WHEN p_size % 11 = 0 THEN ' ' ELSE p_name END AS note, concat('u', p_size % 4) AS actor,
               DATE '2024-01-01' + CAST(p_size AS int) AS event_at
        FROM {part}
        UNION ALL
        SELECT concat('H2-', p_partkey), concat(CASE WHEN p_type = 'PROMO' THEN 'F' ELSE 'G' END, p_partkey), 'unmarked',
               '{{}}', p_name, concat('u', p_size % 3), DATE '2024-02-01' + CAST(p_size AS int)
        FROM {part}""",
    "fx_runs": """
        SELECT concat('rule-', user_id) AS test_name, CAST(ts AS date) AS run_date, max(value) > 200 AS broken
        FROM {events} GROUP BY 1, 2""",
    "fx_findings": """
        SELECT concat('rule-', user_id) AS test_name,
               CASE WHEN value >= 30 THEN CAST(ts AS date) ELSE DATE '1990-01-01' END AS run_date,
               event_id % 3 AS entity, CASE WHEN event_type = 'error' THEN NULL ELSE 'N' END AS category
        FROM {events}""",
    "fx_runlog": """
        SELECT concat('rule-', user_id) AS TestName, ts AS ExecutionDate,
               CAST(floor(value) AS int) % 30 AS IncidentCount,
               CASE WHEN value < 20 THEN NULL ELSE CAST(floor(value) AS int) % 40 END AS IncidentCountRaw,
               CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'view' THEN 'PASSED' ELSE 'FAILED' END AS TestResult,
               event_type = 'click' AND value > 60 AS IsSupressed,
               event_type = 'purchase' AND value > 40 AS IsRecurrent,
               event_type = 'signup' AND value > 40 AS IsContinued
        FROM {events}""",
    "fx_hashlog": """
        SELECT concat('rule-', user_id) AS test_name, ts AS execution_date,
               CASE WHEN value < 10 THEN NULL ELSE concat('h', event_id % 3, 'abcdefghij') END AS incident_hash,
               CAST(floor(value) AS int) AS row_count, value > 90 AS is_suppressed, event_type = 'view' AS is_recurrent
        FROM {events} WHERE event_type <> 'error'""",
    "fx_history": """
        SELECT concat('H', event_id) AS history_id, concat('T', user_id) AS test_id,
               CASE event_type WHEN 'view' THEN 'EDITED_PENDING_REVIEW' WHEN 'click' THEN 'APPROVED'
                    WHEN 'signup' THEN 'REJECTED' WHEN 'purchase' THEN 'SUBMITTED_FOR_REVIEW'
                    ELSE CASE WHEN value < 25 THEN 'PAUSED' ELSE 'CANCELLED' END END AS change_type,
               CASE event_type WHEN 'view' THEN 'ACTIVE'
                    WHEN 'click' THEN CASE WHEN value < 30 THEN 'UNDER_REVIEW' WHEN value < 50 THEN 'PENDING_DELETE' ELSE 'ACTIVE' END
                    WHEN 'signup' THEN CASE WHEN value < 30 THEN 'UNDER_REVIEW' WHEN value < 50 THEN 'PENDING_DELETE' ELSE 'ACTIVE' END
                    WHEN 'purchase' THEN CASE WHEN value < 10 THEN NULL ELSE 'DRAFT' END
                    ELSE 'ACTIVE' END AS status_before,
               CASE event_type WHEN 'view' THEN 'ACTIVE'
                    WHEN 'click' THEN CASE WHEN value < 30 THEN 'ACTIVE' WHEN value < 50 THEN 'CANCELLED' ELSE 'ACTIVE' END
                    WHEN 'signup' THEN CASE WHEN value < 30 THEN 'REJECTED' ELSE 'ACTIVE' END
                    WHEN 'purchase' THEN 'UNDER_REVIEW'
                    ELSE CASE WHEN value < 25 THEN 'PAUSED' ELSE 'PENDING_DELETE' END END AS status_after,
               CAST(1 + floor(value / 40) AS int) AS version,
               concat('u', event_id % 4) AS changed_by, ts AS changed_at
        FROM {events}""",
    "fx_chart": """
        SELECT concat('C', p_partkey) AS chart_id,
               CASE WHEN p_size % 9 = 0 THEN 'area' WHEN p_size % 2 = 0 THEN 'line' ELSE 'kpi' END AS chart_type,
               CASE WHEN p_size % 7 = 0 THEN 'third' ELSE 'half' END AS width,
               concat('{{"x_axis":"', p_name, '","y_aggregation":"', CASE WHEN p_size % 5 = 0 THEN 'median' ELSE 'sum' END,
                      '","group_by":"', CASE WHEN p_size % 4 = 0 THEN 'none' ELSE lower(p_type) END,
                      '","date_range":"', CASE WHEN p_size % 6 = 0 THEN '1y' ELSE '7d' END, '"}}') AS config
        FROM {part}""",
    # --- one rule's archive ---------------------------------------------------
    "fx_archive": """
        SELECT event_id, user_id, event_type, CAST(floor(value) AS bigint) AS amount,
               CASE WHEN value < 5 THEN NULL ELSE event_id % 5 END AS entity,
               CASE WHEN event_type = 'error' THEN NULL ELSE 'N' END AS category,
               ts AS ArchiveDate, user_id % 9 = 0 AS _is_false_positive
        FROM {events}""",
}

_NAME = re.compile(r"\{(\w+)\}")


def tables(spark: SparkSession, folder: str) -> Tables:
    """Driver tables and views by name, for Spark."""

    def load(name: str) -> DataFrame:
        if name in VIEWS:
            text = VIEWS[name]
            used = {n: found[n] for n in set(_NAME.findall(text.replace("{{", "").replace("}}", "")))}
            return spark.sql(text, **used)
        return driver[name]

    driver = parquet_tables(spark, folder, DRIVER_TABLES)
    found = Tables(load, [*DRIVER_TABLES, *VIEWS])
    return found


def with_views(sql: str, extra: dict[str, str] | None = None) -> str:
    """A DuckDB query with the views it uses, and only those, in front."""
    texts = {**{n: _for_duckdb(t) for n, t in VIEWS.items()}, **(extra or {})}
    order: list[str] = []

    def visit(text):
        for name in texts:
            if re.search(rf"\b{name}\b", text) and name not in order:
                visit(texts[name])
                order.append(name)

    visit(sql)
    if not order:
        return sql
    views = ",\n".join(f"{n} AS ({texts[n]})" for n in order)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {views},\n{body[5:]}"
    return f"WITH {views}\n{body}"


def _for_duckdb(text: str) -> str:
    names = {n: n for n in (*DRIVER_TABLES, *VIEWS)}
    return text.format(**names).replace("TIMESTAMP_NTZ", "TIMESTAMP")
