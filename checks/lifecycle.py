"""Life-cycle and configuration checks on the driver's tables."""

from __future__ import annotations

from checks.registry import SHARED_SQL, check
from rulewatch.plans import lifecycle, lint
from rulewatch.plans.lifecycle import TRANSITIONS

STEPS = ", ".join(
    f"({'NULL' if before is None else repr(before)}, '{after}', '{change}', {moves})"
    for before, after, change, moves in TRANSITIONS
)
ORDERED = "PARTITION BY test_id ORDER BY changed_at, history_id"

SHARED_SQL.update(
    sx_step=f"SELECT * FROM (VALUES {STEPS}) v(b, a, c, moves)",
    sx_event=f"""
        SELECT *, change_type = 'EDITED_PENDING_REVIEW' AS staged,
               change_type IN ('APPROVED', 'REJECTED') AND (coalesce(status_before IN ('ACTIVE', 'PAUSED'), false)
                 OR (coalesce(status_before = 'PENDING_DELETE', false) AND change_type = 'APPROVED')) AS decided
        FROM fx_history""",
)
SHARED_SQL["sx_pending"] = f"""
        SELECT * EXCLUDE (p), p.who AS pending_author FROM (
          SELECT *, last_value(CASE WHEN staged THEN {{'who': changed_by}} WHEN decided THEN {{'who': CAST(NULL AS VARCHAR)}} END IGNORE NULLS)
                      OVER ({ORDERED} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM sx_event)"""


@check("l01_current_state", f"""
    SELECT test_id, status_after, version, changed_by, CAST(changed_at AS VARCHAR) AS changed_at, history_id
    FROM (SELECT *, row_number() OVER (PARTITION BY test_id ORDER BY changed_at DESC, history_id DESC) AS rn FROM fx_history)
    WHERE rn = 1""")
def l01(t):
    return lifecycle.current_state(t["fx_history"])


@check("l02_transition_errors", f"""
    WITH e AS (SELECT *, lag(status_after) OVER w AS prev_status, lag(version) OVER w AS prev_version,
                      row_number() OVER w AS n FROM fx_history WINDOW w AS ({ORDERED})),
    j AS (SELECT e.*, s.moves, s.c IS NOT NULL AS known FROM e LEFT JOIN sx_step s
          ON s.b IS NOT DISTINCT FROM e.status_before AND s.a = e.status_after AND s.c = e.change_type),
    r AS (SELECT *, CASE WHEN status_before IS DISTINCT FROM prev_status THEN 'chain' WHEN NOT known THEN 'transition'
                         WHEN version <> coalesce(prev_version, 0) + moves THEN 'version' END AS reason FROM j)
    SELECT history_id, test_id, change_type, status_before, status_after, version, reason FROM r WHERE reason IS NOT NULL""")
def l02(t):
    return lifecycle.transition_errors(t["fx_history"])


EDITS = """
    SELECT test_id, changed_at, history_id, changed_by,
           CASE WHEN staged THEN 'PENDING' WHEN status_before = 'PENDING_DELETE' THEN 'DISCARDED'
                WHEN change_type = 'APPROVED' THEN 'PROMOTED' ELSE 'REJECTED' END AS state,
           CASE WHEN staged THEN changed_by ELSE pending_author END AS author,
           CASE WHEN staged AND pending_author <> changed_by THEN pending_author END AS blocked_by,
           row_number() OVER (PARTITION BY test_id ORDER BY changed_at DESC, history_id DESC) AS rn
    FROM sx_pending WHERE staged OR (decided AND pending_author IS NOT NULL)"""
SHARED_SQL["sx_edit"] = EDITS


@check("l03_staged_edits", """
    SELECT test_id, author, state, changed_by AS last_by, CAST(changed_at AS VARCHAR) AS changed_at, blocked_by
    FROM sx_edit WHERE rn = 1""")
def l03(t):
    return lifecycle.staged_edits(t["fx_history"])


FIELDS = ("query_type", "imports", "query_code", "threshold", "frequency", "description",
          "responsible_area", "risco_id", "category", "should_activate_channel")


@check("l03_effective_configs", f"""
    SELECT c.test_id, c.status, c.version + CASE WHEN e.test_id IS NULL THEN 0 ELSE 1 END AS version,
           {", ".join(f"CASE WHEN e.test_id IS NULL THEN c.{f} ELSE c.pending_{f} END AS {f}" for f in FIELDS)}
    FROM fx_config c LEFT JOIN sx_edit e ON e.test_id = c.test_id AND e.rn = 1 AND e.state = 'PROMOTED'""")
def l03_configs(t):
    edits = lifecycle.staged_edits(t["fx_history"])
    return lifecycle.effective_configs(t["fx_config"], edits).select("test_id", "status", "version", *FIELDS)


@check("l04_four_eyes", """
    SELECT h.history_id, h.test_id, h.change_type, h.status_before, h.changed_by
    FROM sx_pending h LEFT JOIN fx_config c ON c.test_id = h.test_id
    WHERE h.change_type IN ('APPROVED', 'REJECTED') AND h.changed_by <> 'u2' AND h.changed_by =
      CASE WHEN h.decided AND h.status_before <> 'PENDING_DELETE' THEN h.pending_author
           WHEN h.status_before IN ('UNDER_REVIEW', 'PENDING_DELETE') THEN c.created_by END""")
def l04(t):
    return lifecycle.four_eyes_breaches(t["fx_history"], t["fx_config"], ["u2"])


@check("l05_uniqueness", """
    WITH n AS (SELECT test_id, 'test_name' AS field, lower(test_name) AS value FROM fx_config WHERE status <> 'CANCELLED'
               UNION ALL SELECT test_id, 'output_table', lower(output_table) FROM fx_config WHERE status <> 'CANCELLED')
    SELECT test_id, field, value FROM (SELECT *, count(*) OVER (PARTITION BY field, value) AS c FROM n) WHERE c > 1""")
def l05(t):
    return lint.duplicate_names(t["fx_config"])


@check("l06_required_fields", """
    SELECT * FROM (
      SELECT test_id, nullif(concat_ws(' | ',
        CASE WHEN trim(coalesce(test_name, '')) = '' THEN 'test_name' END,
        CASE WHEN output_table IS NULL OR output_table NOT LIKE 'tb\\_incidents\\_%' ESCAPE '\\' THEN 'output_table' END,
        CASE WHEN trim(coalesce(responsible_area, '')) = '' THEN 'responsible_area' END,
        CASE WHEN trim(coalesce(risco_id, '')) IN ('', 'N/A') THEN 'risco_id' END,
        CASE WHEN trim(coalesce(query_code, '')) = '' THEN 'query_code' END,
        CASE WHEN query_type IS NULL OR query_type NOT IN ('SQL', 'PYTHON') THEN 'query_type' END), '') AS errors
      FROM fx_config) WHERE errors IS NOT NULL""")
def l06(t):
    return lint.required_fields(t["fx_config"])


@check("l07_rule_code", """
    WITH c AS (
      SELECT test_id, upper(query_type) AS kind, lower(concat(coalesce(imports, ''), chr(10), coalesce(query_code, ''))) AS txt,
             trim(regexp_replace(regexp_replace(coalesce(query_code, ''), '/\\*(.|\\n)*?\\*/', ' ', 'g'), '--[^\\n]*', ' ', 'g')) AS sql
      FROM fx_config),
    e AS (SELECT test_id, CASE
        WHEN kind = 'SQL' THEN CASE WHEN sql = '' THEN 'empty'
          WHEN NOT regexp_matches(lower(sql), '^(select|with)\\b') THEN 'not a select'
          WHEN contains(rtrim(sql, ';'), ';') THEN 'several statements' END
        WHEN kind = 'PYTHON' THEN CASE WHEN contains(txt, 'os.system') OR contains(txt, 'subprocess') OR contains(txt, '__import__')
          OR contains(txt, 'open(') OR contains(txt, 'eval(') OR contains(txt, 'exec(') OR contains(txt, '.write.')
          OR contains(txt, 'saveastable') OR contains(txt, 'insertinto') THEN 'forbidden text' END
        ELSE 'unknown type' END AS error FROM c)
    SELECT * FROM e WHERE error IS NOT NULL""")
def l07(t):
    return lint.rule_code(t["fx_config"])


@check("l08_chart_specs", """
    WITH c AS (SELECT chart_id, chart_type, width, json_extract_string(config, '$.x_axis') AS x,
                      upper(json_extract_string(config, '$.y_aggregation')) AS y, json_extract_string(config, '$.group_by') AS g,
                      json_extract_string(config, '$.date_range') AS d FROM fx_chart),
    e AS (SELECT chart_id, nullif(concat_ws(' | ',
        CASE WHEN chart_type NOT IN ('line', 'bar', 'bar_h', 'pie', 'kpi') THEN 'chart_type' END,
        CASE WHEN width NOT IN ('half', 'full') THEN 'width' END,
        CASE WHEN d NOT IN ('7d', '30d', '90d', 'all') THEN 'date_range' END,
        CASE WHEN y NOT IN ('COUNT', 'SUM', 'AVG', 'MIN', 'MAX') THEN 'y_aggregation' END,
        CASE WHEN NOT regexp_matches(x, '^[a-zA-Z_][a-zA-Z0-9_]*$') THEN 'x_axis' END,
        CASE WHEN g NOT IN ('none', '') AND NOT regexp_matches(g, '^[a-zA-Z_][a-zA-Z0-9_]*$') THEN 'group_by' END), '') AS errors FROM c)
    SELECT * FROM e WHERE errors IS NOT NULL""")
def l08(t):
    return lint.chart_specs(t["fx_chart"])


@check("l09_fp_events", """
    WITH h AS (SELECT *, row_number() OVER (PARTITION BY fp_id ORDER BY event_at DESC, fp_history_id DESC) AS rn FROM fx_fp_history),
    v AS (SELECT fp_id, bool_or(event_type = 'marked' AND trim(coalesce(note, '')) <> '') AS valid FROM fx_fp_history GROUP BY 1)
    SELECT h.fp_id, h.event_type, CAST(h.event_at AS VARCHAR) AS event_at, h.actor, h.event_type = 'marked' AS active, v.valid
    FROM h JOIN v ON v.fp_id = h.fp_id WHERE rn = 1""")
def l09(t):
    return lifecycle.fp_states(t["fx_fp_history"])


@check("e09_fp_criteria", """
    WITH c AS (SELECT fp_id, match_criteria, coalesce(json_array_length(match_criteria), 0) AS n FROM fx_fp_criteria),
    i AS (SELECT fp_id, trim(coalesce(json_extract_string(x, '$.column'), '')) AS col
          FROM (SELECT fp_id, unnest(from_json(match_criteria, '["JSON"]')) AS x FROM c WHERE n > 0)),
    a AS (SELECT fp_id, bool_and(regexp_matches(col, '^[a-zA-Z_][a-zA-Z0-9_]*$')) AS fine, count(DISTINCT col) AS d FROM i GROUP BY 1),
    e AS (SELECT c.fp_id, CASE WHEN n < 1 THEN 'no criteria' WHEN NOT a.fine THEN 'bad column' WHEN n > 3 THEN 'over three criteria'
                               WHEN a.d < n THEN 'repeated column' END AS error FROM c LEFT JOIN a ON a.fp_id = c.fp_id)
    SELECT * FROM e WHERE error IS NOT NULL""")
def e09(t):
    return lint.fp_criteria(t["fx_fp_criteria"])


@check("f20_table_names", "SELECT test_id, output_table FROM fx_config WHERE NOT regexp_matches(output_table, '^[a-z0-9_]+$')")
def f20(t):
    return lint.table_names(t["fx_config"])
