"""Checks on a platform audit log.

The log is read as it is: who acted is a struct ``user_identity``, what they asked for a
map ``request_params``, and the answer a struct ``response``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rulewatch.functions.calendar import day, on_day, previous_day
from rulewatch.functions.values import from_millis, local_time_label
from rulewatch.operators.grouping import first_per_key
from rulewatch.operators.joins import lookup_join, without
from rulewatch.rules.registry import rule

EMAIL = "user_identity.email"


def param(name: str) -> Column:
    return F.col("request_params")[name]


def actions_of_day_before(tables, as_of, action: str) -> DataFrame:
    return tables["audit"].where(
        (F.col("action_name") == action) & (F.col("event_date") == previous_day(as_of))
    )


@rule("acl_changes", ("audit",))
def acl_changes(tables, as_of, action: str = "changeDbTokenAcl") -> DataFrame:
    """Who changed access lists on the day before, and how much: one row per user.

    The events themselves are the rows of :func:`acl_change_events`.
    """
    return (
        actions_of_day_before(tables, as_of, action)
        .groupBy(F.col(EMAIL).alias("email"))
        .agg(
            F.count("event_id").alias("count"),
            F.countDistinct("account_id").alias("account_count"),
            F.countDistinct("request_id").alias("request_count"),
            F.min("event_time").alias("first_event_time"),
            F.max("event_time").alias("last_event_time"),
        )
    )


def acl_change_events(tables, as_of, action: str = "changeDbTokenAcl") -> DataFrame:
    """The events that :func:`acl_changes` counts, with request and answer as JSON."""
    return actions_of_day_before(tables, as_of, action).select(
        F.col(EMAIL).alias("email"),
        "account_id",
        "request_id",
        "event_id",
        "event_time",
        F.to_json("request_params").alias("request_params"),
        F.to_json("response").alias("response"),
    )


@rule("acl_disabled", ("audit",))
def acl_disabled(tables, as_of, action: str = "disableTableAcls") -> DataFrame:
    """Access lists turned off on the day before."""
    return actions_of_day_before(tables, as_of, action)


@rule("credentials_created", ("audit",))
def credentials_created(tables, as_of, action: str = "createCredential") -> DataFrame:
    """External credentials created on the day before."""
    return actions_of_day_before(tables, as_of, action)


@rule("permission_changes", ("audit",))
def permission_changes(
    tables, as_of, action: str = "updatePermissionAssignment", automation: str = "terraform"
) -> DataFrame:
    """Permission changes by people on the day before.

    Events without an e-mail are left out: the comparison gives NULL for them.
    """
    return actions_of_day_before(tables, as_of, action).where(~F.col(EMAIL).contains(automation))


@rule("bulk_downloads", ("audit",))
def bulk_downloads(
    tables, as_of, at_least: int = 5, zone: str = "America/Sao_Paulo", zone_label: str = "GMT-3"
) -> DataFrame:
    """Downloads of users with at least five on the day before, with the command run.

    A user is the whole identity.  Sort the result by ``event_ts``; the label beside it
    does not sort by time.
    """
    audit = tables["audit"]
    downloads = audit.where(
        (F.col("action_name") == "downloadLargeResults")
        & on_day("event_time", previous_day(as_of))
    ).select(
        "event_id", "request_id", "session_id", "event_time", F.col("user_identity").alias("download_user_identity"),
        param("notebookId").alias("notebook_id"), param("commandId").alias("command_id"),
    )
    heavy = (
        downloads.groupBy("download_user_identity")
        .agg(F.count(F.lit(1)).alias("n"))
        .where((F.col("n") >= at_least) & F.col("download_user_identity").isNotNull())
    )
    events = downloads.join(heavy, "download_user_identity", "left_semi")
    place = ["notebook_id", "command_id"]
    wanted = events.select(*place).distinct()
    commands = audit.where(
        (F.col("service_name") == "notebook")
        & F.col("action_name").isin("runCommand", "submitCommand")
        & param("commandText").isNotNull()
    ).select(
        param("notebookId").alias("notebook_id"), param("commandId").alias("command_id"),
        param("commandText").alias("statement_text"), "event_time", "event_id",
    )
    commands = commands.join(wanted, place, "left_semi")
    # One command per notebook and id: the earliest, so the choice is repeatable.
    texts = first_per_key(commands, place, ["event_time", "event_id"]).select(*place, "statement_text")
    return lookup_join(events, texts, place).select(
        local_time_label("event_time", zone, zone_label).alias("event_time"),
        F.col("event_time").alias("event_ts"),
        "download_user_identity",
        "statement_text",
        "notebook_id",
        "command_id",
        "request_id",
        "event_id",
        "session_id",
    )


@rule("unrevoked_tokens", ("audit", "workspace"))
def unrevoked_tokens(tables, as_of, marker: str = "prd") -> DataFrame:
    """Tokens neither revoked nor expired, in workspaces whose name has the marker."""
    audit = tables["audit"]
    revoked = audit.where(
        (F.col("action_name") == "revokeDbToken") & F.col("event_date").isNotNull()
    ).select(param("tokenHash").alias("token_hash"))
    workspaces = tables["workspace"].where(F.col("workspace_name").contains(marker))
    live = (
        audit.where(F.col("action_name") == "generateDbToken")
        .withColumn("token_expiration_dt", from_millis(param("tokenExpirationTime")))
        .withColumn("token_hash", param("tokenHash"))
        .where(day(as_of) <= F.col("token_expiration_dt"))
    )
    return lookup_join(
        without(live, revoked, "token_hash"),
        workspaces.select("workspace_id", "workspace_name", "workspace_url"),
        ["workspace_id"],
        "inner",
    )
