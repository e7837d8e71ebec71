"""Availability, activity-feed and code-quality checks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, functions as F

from rulewatch.functions.calendar import on_day, previous_day
from rulewatch.functions.values import first_non_empty
from rulewatch.operators.grouping import latest_per_key
from rulewatch.rules.registry import rule


@rule("availability", ("http",))
def availability(tables, as_of, minimum_pct: float = 99.8) -> DataFrame:
    """Endpoints whose share of non-5xx requests was too low on the day before."""
    requests = F.col("RequestCountQty")
    share = F.try_divide(F.col("failed_requests"), F.col("total_requests"))
    return (
        tables["http"]
        .where(F.col("EventDt") == previous_day(as_of))
        .groupBy("EventDt", "ProjectId", "EndpointTxt")
        .agg(
            F.sum(requests).alias("total_requests"),
            F.sum(F.when(F.col("HttpStatusCd") >= 500, requests).otherwise(0)).alias("failed_requests"),
        )
        .withColumn("availability_pct", (F.lit(1) - share) * F.lit(100))
        .where(F.col("availability_pct") < minimum_pct)
    )


# Activity types by what they mean (fixed values).
TOKEN_CHANGES = (
    "api_key_created", "api_key_deleted", "admin_api_key_created", "admin_api_key_deleted",
    "platform_api_key_created", "platform_api_key_deleted", "scoped_api_key_deleted",
)
DATA_EXPORTS = (
    "org_data_export_started", "org_data_export_completed", "org_members_exported",
    "student_data_exported",
)
# Names and evidence of the two kinds, as the findings carry them (fixed values).
TOKEN_RULE, EXPORT_RULE = "token_criado_ou_deletado", "extracao_dados_por_exportacao"
EVIDENCE = {
    TOKEN_RULE: "Evento de criacao/delecao de token/chave.",
    EXPORT_RULE: "Evento explicito de exportacao de dados.",
}

FEED_FIELDS = (
    "actor_email", "actor_user_id", "actor_api_key_id", "actor_id",
    "api_key_id", "admin_api_key_id", "token_id", "organization_uuid", "organization_id",
)


# Flat name -> field of the feed's ``actor`` struct.
ACTOR_FIELDS = {
    "actor_email": "email_address",
    "actor_user_id": "user_id",
    "actor_api_key_id": "api_key_id",
    "actor_id": "id",
}


def flatten_activity(feed: DataFrame) -> DataFrame:
    """The fields of ``actor`` beside the columns of the feed, as far as it has them."""
    if "actor" not in feed.columns:
        return feed
    have = feed.schema["actor"].dataType.names
    return feed.withColumns({n: F.col("actor").getField(f) for n, f in ACTOR_FIELDS.items() if f in have})


@rule("token_events", ("feed",))
def token_events(tables, as_of: dt.date, look_back_days: int = 3) -> DataFrame:
    """Token changes and data exports of the last days, one row per event and kind.

    The look-back overlaps earlier runs on purpose, so late events are seen; the
    incident id makes repeats equal.
    """
    feed = tables["feed"]
    kind = F.lower("type")
    # A time with an offset is an instant; one without is read in the session's zone.
    at = F.col("created_at").try_cast("timestamp")
    end = F.lit(as_of).cast("timestamp")
    raw = F.to_json(F.struct(*feed.columns))  # the event as it came
    recent = (
        feed.withColumn("raw_event", raw)
        .where((at >= F.date_sub(F.lit(as_of), look_back_days)) & (at <= end))
        .withColumn(
            "rule_id",
            F.when(kind.isin(*TOKEN_CHANGES), TOKEN_RULE).when(kind.isin(*DATA_EXPORTS), EXPORT_RULE),
        )
        .where(F.col("rule_id").isNotNull())
    )
    recent = flatten_activity(recent)
    have = [c for c in FEED_FIELDS if c in recent.columns]

    def first_of(names, default):
        return first_non_empty(*[n for n in names if n in have], default=default)

    incidents = recent.select(
        F.concat_ws("::", "rule_id", F.col("id").cast("string")).alias("incident_id"),
        "rule_id",
        F.col("created_at").cast("string").alias("event_created_at"),
        F.col("id").cast("string").alias("activity_id"),
        F.col("type").alias("activity_type"),
        first_of(("organization_uuid", "organization_id"), "").alias("organization_uuid"),
        first_of(
            ("actor_email", "actor_user_id", "actor_api_key_id", "actor_id"), "unknown"
        ).alias("actor_identifier"),
        first_of(("api_key_id", "admin_api_key_id", "token_id"), "").alias("token_reference"),
        F.when(F.col("rule_id") == TOKEN_RULE, EVIDENCE[TOKEN_RULE])
        .otherwise(EVIDENCE[EXPORT_RULE])
        .alias("evidence"),
        "raw_event",
    )
    return latest_per_key(incidents, ["incident_id"], ["event_created_at", "raw_event"])


@rule("quality_gate_bypass", ("policy_history",))
def quality_gate_bypass(tables, as_of) -> DataFrame:
    """Who disabled or deleted quality-gate rules on the day before, and how many."""
    action = F.col("ActionName")
    return (
        tables["policy_history"]
        .where(action.isin("disabled", "deleted") & on_day("IngestedAtDttm", previous_day(as_of)))
        .groupBy("UserEmailTxt", "ProjectName", "RepositoryName")
        .agg(
            F.count_if(action == "disabled").alias("disabled_count"),
            F.count_if(action == "deleted").alias("deleted_count"),
        )
    )
