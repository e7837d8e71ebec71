"""The rule catalogue on the driver's tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

import rulewatch.rules  # noqa: F401
from checks.registry import check
from rulewatch.rules.access import many_ips_addresses, sso_bypass_companies
from rulewatch.rules.audit_log import acl_change_events
from rulewatch.rules.participants import inactive_registration_natures
from rulewatch.rules.registry import build

YEAR98, JAN16 = dt.date(1998, 1, 10), dt.date(2024, 1, 16)
CUTOFF = dt.date(1998, 1, 1)

ACTIVE = "fx_participant WHERE StatusId = '1'"
NOT_FUND = """
    AND DocumentNumberCd NOT IN (SELECT FundDocumentCd FROM fx_fi_registration)
    AND DocumentNumberCd NOT IN (SELECT FundDocumentCd FROM fx_fund_registration)"""
LAST_MONTH = "CreatedAtDttm BETWEEN TIMESTAMP '1997-12-01' AND TIMESTAMP '1997-12-31'"


@check("t01_sso_bypass", """
    WITH u AS (SELECT * FROM fx_user WHERE StatusId = 1 AND regexp_matches(lower(EmailAddressTxt), '@acme')),
    l AS (SELECT DISTINCT u.UserId, c.CorporateName FROM u
          LEFT JOIN fx_user_company uc ON uc.UserId = u.UserId
          LEFT JOIN fx_company c ON c.CompanyId = uc.CompanyId)
    SELECT u.UserId, u.EmailAddressTxt, u.UserName,
           count(l.CorporateName) AS CompanyCount
    FROM u JOIN l ON l.UserId = u.UserId
    GROUP BY 1, 2, 3
    HAVING count(*) FILTER (WHERE contains(l.CorporateName, '7')) = 0""")
def t01(t):
    tables = t.rules("user", "user_company", "company")
    return build("sso_bypass", tables, JAN16, domain="@acme", marker="7")


@check("t01_companies", """
    WITH u AS (SELECT * FROM fx_user WHERE StatusId = 1 AND regexp_matches(lower(EmailAddressTxt), '@acme')),
    l AS (SELECT DISTINCT u.UserId, c.CorporateName FROM u
          JOIN fx_user_company uc ON uc.UserId = u.UserId JOIN fx_company c ON c.CompanyId = uc.CompanyId)
    SELECT * FROM l WHERE UserId NOT IN (SELECT UserId FROM l WHERE contains(CorporateName, '7'))""")
def t01_companies(t):
    return sso_bypass_companies(t.rules("user", "user_company", "company"), JAN16, domain="@acme", marker="7")


@check("t02_young_participants", f"""
    SELECT p.DocumentNumberCd, ParticipantId, ParticipantName,
           CAST(e.ActivityStartDt AS VARCHAR) AS CompanyActivityStartDt,
           CAST(CreatedAtDttm AS VARCHAR) AS ParticipantCreatedAt,
           datediff('day', e.ActivityStartDt, DATE '1998-01-10') AS DaysDifference
    FROM (SELECT * FROM {ACTIVE} AND {LAST_MONTH} {NOT_FUND}) p
    LEFT JOIN fx_establishment e ON e.DocumentCd = p.DocumentNumberCd
    WHERE datediff('day', e.ActivityStartDt, DATE '1998-01-10') <= 365""")
def t02(t):
    return build("young_participants", t.rules("participant", "establishment", "fi_registration", "fund_registration"), YEAR98)


@check("t03_wrong_fund_nature", f"""
    SELECT p.DocumentNumberCd, p.ParticipantId, p.ParticipantName, n.NatureOperationId, n.DescriptionDesc,
           CAST(p.CreatedAtDttm AS VARCHAR) AS CreatedAtDttm,
           CAST(NULL AS VARCHAR) AS FiCvmCd, CAST(NULL AS VARCHAR) AS FundRegistrationId
    FROM (SELECT * FROM {ACTIVE} {NOT_FUND}) p
    LEFT JOIN (SELECT * FROM fx_participant_nature WHERE StatusId = 1) pn ON pn.ParticipantId = p.ParticipantId
    LEFT JOIN fx_nature n ON n.NatureOperationId = pn.NatureOperationId
    WHERE n.DescriptionDesc = 'FIDC'""")
def t03(t):
    tables = t.rules("participant", "participant_nature", "nature", "fi_registration", "fund_registration")
    return build("wrong_fund_nature", tables, YEAR98)


def near_start(second: str) -> str:
    return f"""
    SELECT p.DocumentNumberCd, ParticipantId, ParticipantName,
           CAST(NULL AS VARCHAR) AS {second}, CAST(NULL AS VARCHAR) AS FundRegistrationId,
           CAST(e.ActivityStartDt AS VARCHAR) AS ActivityStartDt, CAST(CreatedAtDttm AS VARCHAR) AS CreatedAtDttm,
           datediff('day', e.ActivityStartDt, CAST(CreatedAtDttm AS DATE)) AS DaysDifference
    FROM (SELECT * FROM {ACTIVE} AND {LAST_MONTH} {NOT_FUND}) p
    LEFT JOIN fx_establishment e ON e.DocumentCd = p.DocumentNumberCd
    WHERE datediff('day', e.ActivityStartDt, CAST(CreatedAtDttm AS DATE)) <= 30"""


@check("t04_joined_near_start", near_start("FiCvmCd"))
def t04(t):
    return build("joined_near_start", t.rules("participant", "establishment", "fi_registration", "fund_registration"), YEAR98)


@check("t05_duplicate_documents", f"""
    SELECT DocumentNumberCd, count(DISTINCT ParticipantId) AS CountParticipantId
    FROM {ACTIVE} GROUP BY 1 HAVING count(DISTINCT ParticipantId) > 1""")
def t05(t):
    return build("duplicate_documents", t.rules("participant"), YEAR98)


@check("t06_sanctions", f"""
    WITH joined AS (
      SELECT p.DocumentNumberCd, p.ParticipantId, p.ParticipantName, p.StatusId,
             CEISIncidence, CEPIMIncidence, CNEPIncidence, LeniencyIncidence,
             row_number() OVER (PARTITION BY p.DocumentNumberCd ORDER BY p.ParticipantId) AS rn
      FROM (SELECT * FROM {ACTIVE}) p
      LEFT JOIN (SELECT SanctionedCpfOrCnpjCd AS DocumentNumberCd, SanctionCodeCd || '-' || SanctionCategoryDesc AS CEISIncidence FROM fx_ceis) USING (DocumentNumberCd)
      LEFT JOIN (SELECT EntityCnpjCd AS DocumentNumberCd, AgreementNum || '-' || GrantingAgencyDesc AS CEPIMIncidence FROM fx_cepim) USING (DocumentNumberCd)
      LEFT JOIN (SELECT SanctionedCpfOrCnpjCd AS DocumentNumberCd, SanctionCodeCd || '-' || SanctionCategoryDesc AS CNEPIncidence FROM fx_cnep) USING (DocumentNumberCd)
      LEFT JOIN (SELECT SanctionedCompanyCnpjCd AS DocumentNumberCd, ProcessNum || '-' || SanctioningOfficeDesc AS LeniencyIncidence FROM fx_leniency) USING (DocumentNumberCd)
      WHERE CEISIncidence IS NOT NULL OR CEPIMIncidence IS NOT NULL
         OR CNEPIncidence IS NOT NULL OR LeniencyIncidence IS NOT NULL)
    SELECT * EXCLUDE (rn) FROM joined WHERE rn = 1""")
def t06(t):
    return build("sanctions", t.rules("participant", "ceis", "cepim", "cnep", "leniency"), YEAR98)


@check("t07_unmatched_document", f"""
    SELECT p.DocumentNumberCd, ParticipantId, ParticipantName, DocumentTypeId, CreatedById,
           CAST(CreatedAtDttm AS VARCHAR) AS CreatedAtDttm, CAST(e.RootDocumentCd AS VARCHAR) AS RootDocumentCd
    FROM (SELECT * FROM {ACTIVE}) p LEFT JOIN fx_establishment e ON e.DocumentCd = p.DocumentNumberCd
    WHERE e.RootDocumentCd IS NULL""")
def t07(t):
    return build("unmatched_document", t.rules("participant", "establishment"), YEAR98)


@check("t08_joined_near_start_v2", near_start("FundSocialName"))
def t08(t):
    return build("joined_near_start_v2", t.rules("participant", "establishment", "fi_registration", "fund_registration"), YEAR98)


@check("t09_inactive_registration", f"""
    WITH natures AS (
      SELECT pn.ParticipantId, count(DISTINCT n.DescriptionDesc) AS NatureCount
      FROM fx_participant_nature pn
      LEFT JOIN (SELECT * FROM fx_nature WHERE StatusCd = '1') n USING (NatureOperationId)
      GROUP BY 1)
    SELECT p.ParticipantId, p.DocumentNumberCd, p.ParticipantName, p.StatusId,
           CAST(e.RegistrationStatusDt AS VARCHAR) AS RegistrationStatusDt, coalesce(o.NatureCount, 0) AS NatureCount,
           e.RegistrationStatusReasonCd, r.RegistrationStatusReasonDesc
    FROM (SELECT * FROM {ACTIVE}) p
    LEFT JOIN fx_establishment e ON e.DocumentCd = p.DocumentNumberCd
    LEFT JOIN fx_status_reason r USING (RegistrationStatusReasonCd)
    LEFT JOIN natures o ON o.ParticipantId = p.ParticipantId
    WHERE e.RegistrationStatusReasonCd <> '00'""")
def t09(t):
    tables = t.rules("participant", "establishment", "status_reason", "participant_nature", "nature")
    return build("inactive_registration", tables, YEAR98)


@check("t09_natures", f"""
    SELECT DISTINCT pn.ParticipantId, n.DescriptionDesc FROM fx_participant_nature pn
    JOIN (SELECT * FROM fx_nature WHERE StatusCd = '1') n USING (NatureOperationId)
    WHERE pn.ParticipantId IN (SELECT ParticipantId FROM (SELECT * FROM {ACTIVE}) p
      JOIN fx_establishment e ON e.DocumentCd = p.DocumentNumberCd WHERE e.RegistrationStatusReasonCd <> '00')""")
def t09_natures(t):
    tables = t.rules("participant", "establishment", "status_reason", "participant_nature", "nature")
    return inactive_registration_natures(tables, YEAR98)


@check("t10_invalid_email", f"""
    SELECT ParticipantId, DocumentNumberCd, ParticipantName, EmailName, CAST(CreatedAtDttm AS VARCHAR) AS CreatedAtDttm, CreatedById
    FROM {ACTIVE} AND (EmailName LIKE '%acme%' OR EmailName IS NULL)""")
def t10(t):
    return build("invalid_email", t.rules("participant"), YEAR98, marker="acme")


@check("t11_invalid_phone", f"""
    SELECT ParticipantId, DocumentNumberCd, ParticipantName, StatusId,
           CAST(CreatedAtDttm AS VARCHAR) AS CreatedAtDttm, DocumentTypeId, CreatedById, EmailName, Phone1Num
    FROM {ACTIVE} AND (Phone1Num IS NULL OR Phone1Num = '' OR length(Phone1Num) < 8
      OR Phone1Num LIKE '%12345%' OR regexp_matches(Phone1Num, '{"|".join(str(i) * 5 for i in range(10))}'))""")
def t11(t):
    return build("invalid_phone", t.rules("participant"), YEAR98)


@check("t12_many_ips", """
    WITH base AS (
      SELECT DISTINCT u.EmailAddressTxt, h.uid AS UserId, h.ip, h.d
      FROM (SELECT trim(regexp_extract(DescriptionTxt, 'user/participant id:\\s*([^\\]]+)\\]', 1)) AS uid,
                   CreatedByIpCd AS ip, CAST(CreatedAtDttm AS DATE) AS d
            FROM fx_historic
            WHERE CreatedAtDttm BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31') h
      LEFT JOIN fx_user u ON CAST(u.UserId AS VARCHAR) = h.uid
      WHERE u.EmailAddressTxt IS NOT NULL AND h.ip IS NOT NULL)
    SELECT EmailAddressTxt, UserId, CAST(d AS VARCHAR) AS "Date", count(*) AS DistinctIPCount
    FROM base GROUP BY EmailAddressTxt, UserId, d HAVING count(*) > 3""")
def t12(t):
    return build("many_ips", t.rules("historic", "user"), dt.date(2024, 2, 10))


@check("t12_addresses", """
    WITH h AS (
      SELECT DISTINCT trim(regexp_extract(DescriptionTxt, 'user/participant id:\\s*([^\\]]+)\\]', 1)) AS UserId,
             CreatedByIpCd, CAST(CAST(CreatedAtDttm AS DATE) AS VARCHAR) AS "Date"
      FROM fx_historic WHERE CreatedAtDttm BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31')
    SELECT * FROM h WHERE UserId IN (SELECT CAST(UserId AS VARCHAR) FROM fx_user WHERE EmailAddressTxt IS NOT NULL)
      AND (UserId, "Date") IN (SELECT (UserId, "Date") FROM h GROUP BY UserId, "Date" HAVING count(*) > 3)""")
def t12_addresses(t):
    return many_ips_addresses(t.rules("historic", "user"), dt.date(2024, 2, 10))


def due_before(types: str, new: bool) -> str:
    def parsed(column):
        return f"""coalesce(try_strptime({column}, '%Y-%m-%d'), try_strptime({column}, '%d/%m/%Y'),
                            try_strptime({column}, '%d-%m-%Y'))::DATE"""

    sign, moment = (">", "AFTER") if new else ("<=", "UNTIL")
    return f"""
    WITH parsed AS (SELECT *, {parsed("RegistryDttm")} AS r, {parsed("DueDt")} AS d
                    FROM fx_asset WHERE TypeAssetId IN ({types}))
    SELECT AssetId, TypeAssetId,
           coalesce(TypeAssetName, CAST(TypeAssetId AS VARCHAR)) AS TypeAssetName,
           StatusAssetId, RegistryDttm AS Registry_orig, DueDt AS Due_orig,
           CAST(r AS VARCHAR) AS RegistryDate_parsed, CAST(d AS VARCHAR) AS DueDate_parsed,
           datediff('day', r, d) AS Days_Due_minus_Registry, '{moment}' AS moment
    FROM parsed LEFT JOIN fx_asset_type USING (TypeAssetId)
    WHERE r IS NOT NULL AND d IS NOT NULL AND datediff('day', r, d) < 0
      AND r {sign} DATE '1998-01-01'"""


@check("t13_due_before_registry_new", due_before("1, 39", True))
def t13(t):
    return build("due_before_registry_new", t.rules("asset", "asset_type"), YEAR98, cutoff=CUTOFF)


@check("t14_due_before_registry_old", due_before("1, 39", False))
def t14(t):
    return build("due_before_registry_old", t.rules("asset", "asset_type"), YEAR98, cutoff=CUTOFF)


@check("t15_due_before_registry_new_type2", due_before("2", True))
def t15(t):
    return build("due_before_registry_new_type2", t.rules("asset", "asset_type"), YEAR98, cutoff=CUTOFF)


@check("t16_due_before_registry_old_type2", due_before("2", False))
def t16(t):
    return build("due_before_registry_old_type2", t.rules("asset", "asset_type"), YEAR98, cutoff=CUTOFF)


@check("t17_availability", """
    SELECT CAST(EventDt AS VARCHAR) AS EventDt, ProjectId, EndpointTxt,
           CAST(sum(RequestCountQty) AS BIGINT) AS total_requests,
           CAST(sum(CASE WHEN HttpStatusCd >= 500 THEN RequestCountQty ELSE 0 END) AS BIGINT) AS failed_requests,
           (1 - sum(CASE WHEN HttpStatusCd >= 500 THEN RequestCountQty ELSE 0 END) / sum(RequestCountQty)) * 100
             AS availability_pct
    FROM fx_http WHERE EventDt = DATE '2024-01-15' GROUP BY fx_http.EventDt, ProjectId, EndpointTxt
    HAVING (1 - sum(CASE WHEN HttpStatusCd >= 500 THEN RequestCountQty ELSE 0 END) / sum(RequestCountQty)) * 100 < 99.8""")
def t17(t):
    return build("availability", t.rules("http"), JAN16)


@check("t18_token_events", """
    WITH hits AS (
      SELECT *, CASE WHEN lower(type) IN ('api_key_created', 'api_key_deleted', 'admin_api_key_created',
          'admin_api_key_deleted', 'platform_api_key_created', 'platform_api_key_deleted', 'scoped_api_key_deleted')
          THEN 'token_criado_ou_deletado'
        WHEN lower(type) IN ('org_data_export_started', 'org_data_export_completed', 'org_members_exported',
          'student_data_exported') THEN 'extracao_dados_por_exportacao' END AS rule_id
      FROM fx_feed
      WHERE CAST(created_at AS TIMESTAMP) BETWEEN TIMESTAMP '2024-01-13' AND TIMESTAMP '2024-01-16')
    SELECT rule_id || '::' || id AS incident_id, rule_id, created_at AS event_created_at,
           CAST(id AS VARCHAR) AS activity_id, type AS activity_type, '' AS organization_uuid,
           coalesce(nullif(actor_email, ''), nullif(actor_user_id, ''), 'unknown') AS actor_identifier,
           '' AS token_reference,
           CASE rule_id WHEN 'token_criado_ou_deletado' THEN 'Evento de criacao/delecao de token/chave.'
                        ELSE 'Evento explicito de exportacao de dados.' END AS evidence,
           concat('{"id":', id, ',"created_at":"', created_at, '","type":"', type, '","actor":{"email_address":"', actor_email, '"',
                  CASE WHEN actor_user_id IS NULL THEN '' ELSE concat(',"user_id":"', actor_user_id, '"') END,
                  '}}') AS raw_event
    FROM hits WHERE rule_id IS NOT NULL""")
def t18(t):
    actor = F.struct(F.col("actor_email").alias("email_address"), F.col("actor_user_id").alias("user_id"))
    feed = t["fx_feed"].select("id", "created_at", "type", actor.alias("actor"))
    return build("token_events", {"feed": feed}, JAN16)


@check("t19_employee_partners", f"""
    WITH chain AS (
      SELECT e.CorporateEmail, upper(e.EmployeeName) AS AssociateName, e.DepartmentName, e.ManagementClassName,
             CAST(e.HireDate AS VARCHAR) AS HireDate, a.AssociateQualificationCd, a.AssociateDocumentCd, a.RootDocumentCd,
             p.CreatedById, c.CompanyName, s.DocumentCd, p.ParticipantId, upper(p.ParticipantName) AS ParticipantName,
             CAST(p.CreatedAtDttm AS VARCHAR) AS CreatedAtDttm
      FROM fx_employee e
      LEFT JOIN fx_associate a ON upper(a.AssociateName) = upper(e.EmployeeName)
      LEFT JOIN fx_public_company c ON c.RootDocumentCd = a.RootDocumentCd
      LEFT JOIN fx_establishment s ON s.RootDocumentCd = a.RootDocumentCd
      LEFT JOIN (SELECT * FROM {ACTIVE}) p ON p.DocumentNumberCd = s.DocumentCd
      WHERE p.ParticipantId IS NOT NULL AND s.DocumentCd <> 77)
    SELECT * FROM chain WHERE NOT EXISTS (
      SELECT 1 FROM fx_partner_exception x
      WHERE upper(x.AssociateName) = chain.AssociateName AND upper(x.ParticipantName) = chain.ParticipantName)""")
def t19(t):
    tables = t.rules("employee", "associate", "public_company", "establishment", "participant", "partner_exception")
    return build("employee_partners", tables, YEAR98, own_document="77")


@check("t20_overdue_training", """
    SELECT lower(e.CorporateEmail) AS Email, e.Name, CAST(e.AdmissionDate AS VARCHAR) AS AdmissionDate, e.DepartmentName,
           k.ModuleName, CAST(k.StartDate AS VARCHAR) AS StartDate,
           CAST(k.CompletionDate AS VARCHAR) AS CompletionDate, k.Status,
           datediff('day', e.AdmissionDate, DATE '1998-01-10') AS DateDifference
    FROM fx_hr_employee e LEFT JOIN fx_training k ON k.Email = lower(e.CorporateEmail)
    WHERE e.AdmissionDate >= DATE '1995-06-01' AND datediff('day', e.AdmissionDate, DATE '1998-01-10') >= 30
      AND k.CompletionDate IS NULL""")
def t20(t):
    return build("overdue_training", t.rules("hr_employee", "training"), YEAR98, hired_since="1995-06-01")


# Flat column of the fixture -> key of the log's ``request_params``.
PARAMS = {
    "notebook_id": "notebookId", "command_id": "commandId", "command_text": "commandText",
    "token_hash": "tokenHash", "token_expiration_ms": "tokenExpirationTime",
}
PLAIN = ("event_id", "request_id", "session_id", "account_id", "event_time", "event_date", "service_name", "action_name", "workspace_id")


def audit_log(t):
    """The log as a platform writes it: a struct for the user, a map for the request, a struct for the answer."""
    request = F.create_map(*[x for flat, key in PARAMS.items() for x in (F.lit(key), F.col(flat).cast("string"))])
    return t["fx_audit"].select(
        *PLAIN,
        F.struct(F.col("user_email").alias("email"), F.concat(F.lit("s-"), "account_id").alias("subject_name")).alias("user_identity"),
        request.alias("request_params"),
        F.struct(F.lit(200).alias("status_code"), F.col("request_params").alias("result")).alias("response"),
    )


def flat(found):
    """An event of the log by its parts."""
    params = [F.col("request_params")[key].alias(name) for name, key in PARAMS.items()]
    return found.select(*PLAIN, F.col("user_identity.email").alias("user_email"), *params, F.col("response.result").alias("result"))


FLAT = f"""{', '.join(PLAIN[:4])}, CAST(event_time AS VARCHAR) AS event_time, CAST(event_date AS VARCHAR) AS event_date,
           {', '.join(PLAIN[6:])}, user_email, {', '.join(f'CAST({c} AS VARCHAR) AS {c}' for c in PARAMS)}, request_params AS result"""


def audit_of(action: str, more: str = "") -> str:
    return f"SELECT {FLAT} FROM fx_audit WHERE action_name = '{action}' AND event_date = DATE '2024-01-15' {more}"


@check("t21_acl_changes", """
    SELECT user_email AS email, count(*) AS "count", count(DISTINCT account_id) AS account_count,
           count(DISTINCT request_id) AS request_count, CAST(min(event_time) AS VARCHAR) AS first_event_time,
           CAST(max(event_time) AS VARCHAR) AS last_event_time
    FROM fx_audit WHERE action_name = 'runCommand' AND event_date = DATE '2024-01-15'
    GROUP BY user_email""")
def t21(t):
    return build("acl_changes", {"audit": audit_log(t)}, JAN16, action="runCommand")


@check("t21_events", """
    SELECT user_email AS email, account_id, request_id, event_id, CAST(event_time AS VARCHAR) AS event_time,
           concat('{"notebookId":"', notebook_id, '","commandId":"', command_id, '","commandText":"', command_text,
                  '","tokenHash":"', token_hash, '","tokenExpirationTime":"', token_expiration_ms, '"}') AS request_params,
           concat('{"status_code":200,"result":"', replace(request_params, '"', '\\"'), '"}') AS response
    FROM fx_audit WHERE action_name = 'runCommand' AND event_date = DATE '2024-01-15'""")
def t21_events(t):
    return acl_change_events({"audit": audit_log(t)}, JAN16, action="runCommand")


@check("t22_acl_disabled", audit_of("revokeDbToken"))
def t22(t):
    return flat(build("acl_disabled", {"audit": audit_log(t)}, JAN16, action="revokeDbToken"))


@check("t23_bulk_downloads", """
    WITH d AS (SELECT *, user_email || '/s-' || account_id AS who FROM fx_audit WHERE action_name = 'downloadLargeResults'),
    q AS (SELECT who, CAST(event_time AS DATE) AS day FROM d
          WHERE CAST(event_time AS DATE) = DATE '2024-01-15' GROUP BY 1, 2 HAVING count(*) >= 3),
    c AS (SELECT notebook_id, command_id, command_text,
                 row_number() OVER (PARTITION BY notebook_id, command_id ORDER BY event_time, event_id) AS rn
          FROM fx_audit WHERE service_name = 'notebook' AND action_name IN ('runCommand', 'submitCommand')
            AND command_text IS NOT NULL)
    SELECT strftime(d.event_time - INTERVAL 3 HOUR, '%d-%b-%Y %I:%M:%S %p') || ' GMT-3' AS event_time,
           CAST(d.event_time AS VARCHAR) AS event_ts, d.who, c.command_text AS statement_text,
           CAST(d.notebook_id AS VARCHAR) AS notebook_id, CAST(d.command_id AS VARCHAR) AS command_id,
           d.request_id, d.event_id, d.session_id
    FROM d JOIN q ON q.who = d.who AND q.day = CAST(d.event_time AS DATE)
    LEFT JOIN c ON c.notebook_id = d.notebook_id AND c.command_id = d.command_id AND c.rn = 1""")
def t23(t):
    found = build("bulk_downloads", {"audit": audit_log(t)}, JAN16, at_least=3)
    who = F.concat_ws("/", "download_user_identity.email", "download_user_identity.subject_name")
    return found.withColumn("who", who).drop("download_user_identity")


@check("t24_credentials_created", audit_of("generateDbToken"))
def t24(t):
    return flat(build("credentials_created", {"audit": audit_log(t)}, JAN16, action="generateDbToken"))


@check("t25_unrevoked_tokens", """
    WITH r AS (SELECT token_hash, event_date AS revoke_date FROM fx_audit WHERE action_name = 'revokeDbToken')
    SELECT g.event_id, g.user_email, CAST(g.token_hash AS VARCHAR) AS token_hash, g.workspace_id, w.workspace_name, w.workspace_url,
           CAST(CAST(make_timestamp(CAST(g.token_expiration_ms AS BIGINT) * 1000) AS DATE) AS VARCHAR) AS expires_on
    FROM fx_audit g LEFT JOIN r ON r.token_hash = g.token_hash
    LEFT JOIN fx_workspace w ON w.workspace_id = g.workspace_id
    WHERE g.action_name = 'generateDbToken' AND r.revoke_date IS NULL
      AND make_timestamp(CAST(g.token_expiration_ms AS BIGINT) * 1000) >= TIMESTAMP '2024-02-01'
      AND w.workspace_name LIKE '%prd%'""")
def t25(t):
    found = build("unrevoked_tokens", {"audit": audit_log(t), "workspace": t["fx_workspace"]}, dt.date(2024, 2, 1))
    return found.select(
        "event_id", F.col("user_identity.email").alias("user_email"), "token_hash", "workspace_id", "workspace_name", "workspace_url",
        F.to_date("token_expiration_dt").alias("expires_on"),
    )


@check("t26_permission_changes", audit_of("updatePermissionAssignment", "AND user_email NOT LIKE '%user1@%'"))
def t26(t):
    return flat(build("permission_changes", {"audit": audit_log(t)}, JAN16, automation="user1@"))


@check("p13_nested_access", f"SELECT {FLAT} FROM fx_audit")
def p13(t):
    return flat(audit_log(t))


@check("a12_group_by_struct", """
    SELECT user_email AS email, 's-' || account_id AS subject_name, count(*) AS n FROM fx_audit GROUP BY 1, 2""")
def a12(t):
    return audit_log(t).groupBy("user_identity").agg(F.count("*").alias("n")).select("user_identity.*", "n")


@check("t27_consumption_peak", """
    WITH weekly AS (
      SELECT a.ClientCd, date_trunc('week', a.CreatedAtDttm)::DATE + 4 AS wk, count(*) AS qty,
             CAST(sum(p.UnitPriceAmt) AS DOUBLE) AS amount
      FROM fx_assessment a JOIN fx_external_search x USING (AssessmentId) JOIN fx_contract_price p USING (DataContractId)
      WHERE x.UrlParsedName <> 'cache' AND dayofweek(a.CreatedAtDttm) BETWEEN 1 AND 5 AND a.ClientCd IS NOT NULL
      GROUP BY 1, 2),
    peaks AS (
      SELECT *, max(amount) OVER (PARTITION BY ClientCd ORDER BY wk
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS peak FROM weekly)
    SELECT ClientCd, CAST(wk AS VARCHAR) AS CreatedAtDttm, amount AS AssessmentTotalValueAmt, qty AS AssessmentTotalQty
    FROM peaks WHERE wk = DATE '1995-03-03' AND amount >= 0.2
      AND (amount - coalesce(peak, amount)) / coalesce(peak, amount) >= 0.25""")
def t27(t):
    return build("consumption_peak", t.rules("assessment", "external_search", "contract_price"), dt.date(1995, 3, 1), minimum=0.2)


@check("t28_quality_gate_bypass", """
    SELECT UserEmailTxt, ProjectName, RepositoryName,
           count(*) FILTER (WHERE ActionName = 'disabled') AS disabled_count,
           count(*) FILTER (WHERE ActionName = 'deleted') AS deleted_count
    FROM fx_policy_history
    WHERE ActionName IN ('disabled', 'deleted') AND CAST(IngestedAtDttm AS DATE) = DATE '2024-01-15'
    GROUP BY 1, 2, 3""")
def t28(t):
    return build("quality_gate_bypass", t.rules("policy_history"), JAN16)
