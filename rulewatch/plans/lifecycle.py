"""The life cycle of rules, read from their event log.

Status and version after an event are authoritative; the kind of change is not (a
deletion request is logged as CANCELLED while the rule only waits for approval).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rulewatch.operators.grouping import latest_per_key, previous_values
from rulewatch.operators.joins import lookup_join
from rulewatch.sources.schemas import STAGED_FIELDS

ORDER = ["changed_at", "history_id"]

# Allowed steps as (status before, status after, change, version step) (fixed values).
TRANSITIONS = (
    (None, "DRAFT", "CREATED", 1),
    (None, "UNDER_REVIEW", "SUBMITTED_FOR_REVIEW", 1),
    ("DRAFT", "DRAFT", "EDITED", 1),
    ("REJECTED", "DRAFT", "EDITED", 1),
    ("DRAFT", "UNDER_REVIEW", "SUBMITTED_FOR_REVIEW", 1),
    ("REJECTED", "UNDER_REVIEW", "SUBMITTED_FOR_REVIEW", 1),
    ("UNDER_REVIEW", "ACTIVE", "APPROVED", 0),
    ("UNDER_REVIEW", "REJECTED", "REJECTED", 0),
    ("ACTIVE", "PAUSED", "PAUSED", 0),
    ("PAUSED", "ACTIVE", "REACTIVATED", 0),
    ("ACTIVE", "ACTIVE", "EDITED_PENDING_REVIEW", 0),
    ("PAUSED", "PAUSED", "EDITED_PENDING_REVIEW", 0),
    ("ACTIVE", "ACTIVE", "APPROVED", 1),
    ("PAUSED", "PAUSED", "APPROVED", 1),
    ("ACTIVE", "ACTIVE", "REJECTED", 0),
    ("PAUSED", "PAUSED", "REJECTED", 0),
    ("ACTIVE", "PENDING_DELETE", "CANCELLED", 0),
    ("PAUSED", "PENDING_DELETE", "CANCELLED", 0),
    ("PENDING_DELETE", "CANCELLED", "APPROVED", 0),
    ("PENDING_DELETE", "ACTIVE", "REJECTED", 0),
    ("DRAFT", "CANCELLED", "CANCELLED", 0),
    ("REJECTED", "CANCELLED", "CANCELLED", 0),
)


def current_state(history: DataFrame) -> DataFrame:
    """Status and version of every rule after its last event."""
    return latest_per_key(
        history.select("test_id", "status_after", "version", "changed_by", *ORDER), ["test_id"], ORDER
    )


def transition_errors(history: DataFrame) -> DataFrame:
    """Events that do not follow from the event before, with the reason.

    ``chain``: the status before is not the one the last event left.
    ``transition``: no such step exists.  ``version``: the version moved otherwise
    than the step does.  An event is listed once, under the first that applies.
    """
    known = history.withColumn("_before", F.coalesce("status_before", F.lit("-")))
    events = previous_values(
        known,
        ["test_id"],
        ORDER,
        {"_prev": F.struct(F.col("status_after").alias("status"), "version")},
    )
    step = F.lit(None).cast("int")
    for before, after, change, moves in TRANSITIONS:
        step = F.when(
            (F.col("_before") == (before or "-"))
            & (F.col("status_after") == after)
            & (F.col("change_type") == change),
            moves,
        ).otherwise(step)
    expected = F.coalesce(F.col("_prev.version"), F.lit(0)) + step
    reason = (
        F.when(~F.coalesce("_prev.status", F.lit("-")).eqNullSafe(F.col("_before")), "chain")
        .when(step.isNull(), "transition")
        .when(F.col("version") != expected, "version")
    )
    return events.withColumn("reason", reason).where(F.col("reason").isNotNull()).select(
        "history_id", "test_id", "change_type", "status_before", "status_after", "version", "reason"
    )


def with_pending_author(history: DataFrame) -> DataFrame:
    """Events plus who had an undecided staged edit just before each of them.

    A staged edit opens it; its approval or rejection closes it, and so does the
    approval of a deletion.  Rejecting a deletion leaves it open.
    """
    staged = F.col("change_type") == "EDITED_PENDING_REVIEW"
    decided = F.col("change_type").isin("APPROVED", "REJECTED") & (
        F.col("status_before").isin("ACTIVE", "PAUSED")
        | ((F.col("status_before") == "PENDING_DELETE") & (F.col("change_type") == "APPROVED"))
    )
    author = F.when(staged, F.struct(F.col("changed_by").alias("author"))).when(
        decided, F.struct(F.lit(None).cast("string").alias("author"))
    )
    events = previous_values(history, ["test_id"], ORDER, {"_pending": author})
    return events.withColumns(
        {"pending_author": F.col("_pending.author"), "_staged": staged, "_decided": decided}
    ).drop("_pending")


def staged_edits(history: DataFrame) -> DataFrame:
    """The state of each rule's last staged edit: PENDING, PROMOTED, REJECTED or DISCARDED.

    ``blocked_by`` names the author whose undecided edit the last one ran into.
    """
    events = with_pending_author(history)
    effective = F.col("_decided") & F.col("pending_author").isNotNull()
    steps = events.where(F.col("_staged") | effective).select(
        "test_id",
        *ORDER,
        "changed_by",
        F.when(F.col("_staged"), "PENDING")
        .when(F.col("status_before") == "PENDING_DELETE", "DISCARDED")
        .when(F.col("change_type") == "APPROVED", "PROMOTED")
        .otherwise("REJECTED")
        .alias("state"),
        F.when(F.col("_staged"), F.col("changed_by")).otherwise(F.col("pending_author")).alias("author"),
        F.when(F.col("_staged") & (F.col("pending_author") != F.col("changed_by")), F.col("pending_author")).alias(
            "blocked_by"
        ),
    )
    return latest_per_key(steps, ["test_id"], ORDER).select(
        "test_id", "author", "state", F.col("changed_by").alias("last_by"), "changed_at", "blocked_by"
    )


def effective_configs(configs: DataFrame, edits: DataFrame) -> DataFrame:
    """Configurations as they run: staged fields where the edit was promoted."""
    promoted = edits.where(F.col("state") == "PROMOTED").select("test_id", F.lit(True).alias("_promoted"))
    take = F.coalesce("_promoted", F.lit(False))
    fields = {f: F.when(take, F.col(f"pending_{f}")).otherwise(F.col(f)) for f in STAGED_FIELDS}
    fields["version"] = F.col("version") + F.when(take, 1).otherwise(0)
    return configs.join(promoted, "test_id", "left").withColumns(fields).drop("_promoted")


def four_eyes_breaches(history: DataFrame, configs: DataFrame, allowed: list[str]) -> DataFrame:
    """Reviews by the person who created the rule, or submitted the staged edit."""
    creators = configs.select("test_id", "created_by")
    reviews = with_pending_author(history).where(F.col("change_type").isin("APPROVED", "REJECTED"))
    own_edit = F.col("_decided") & (F.col("status_before") != "PENDING_DELETE")
    other = F.col("status_before").isin("UNDER_REVIEW", "PENDING_DELETE")
    answerable = F.when(own_edit, F.col("pending_author")).when(other, F.col("created_by"))
    return (
        lookup_join(reviews, creators, ["test_id"])
        .withColumn("answerable", answerable)
        .where((F.col("answerable") == F.col("changed_by")) & ~F.col("changed_by").isin(*allowed))
        .select("history_id", "test_id", "change_type", "status_before", "changed_by")
    )


def fp_states(events: DataFrame) -> DataFrame:
    """Whether each false positive is active, from its mark and unmark events.

    ``valid`` is false if the event that marked it has no note.
    """
    last = latest_per_key(
        events.select("fp_id", "event_at", "fp_history_id", "event_type", "actor"),
        ["fp_id"],
        ["event_at", "fp_history_id"],
    )
    noted = events.groupBy("fp_id").agg(
        F.bool_or(
            (F.col("event_type") == "marked") & (F.trim(F.coalesce("note", F.lit(""))) != "")
        ).alias("valid")
    )
    return last.join(noted, "fp_id").select(
        "fp_id", "event_type", "event_at", "actor", (F.col("event_type") == "marked").alias("active"), "valid"
    )
