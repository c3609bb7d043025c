"""Batches of incident edits and comments, with their audit trail."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fenceline.functions.ordered import last_known_before
from fenceline.settings import INCIDENT_STATUSES


def _steps(incidents: DataFrame, changes: DataFrame) -> DataFrame:
    """Each change request of a known incident with the status and assignee just before it."""
    allowed = F.col("status").isNull() | F.lower("status").isin(*INCIDENT_STATUSES)
    asked = changes.filter(allowed).withColumn("status", F.lower("status"))
    before = last_known_before(
        asked, "incident_id", "changed_at", "change_id", ["status", "assignee"], "earlier_"
    )
    start = incidents.select(
        "incident_id", F.col("status").alias("start_status"), F.col("assignee").alias("start_assignee")
    )
    steps = before.join(start, "incident_id")
    old_status = F.coalesce("earlier_status", "start_status")
    # An earlier request with an empty assignee means "unassigned".
    old_assignee = F.when(F.col("earlier_assignee").isNull(), F.col("start_assignee")).otherwise(
        F.nullif("earlier_assignee", F.lit(""))
    )
    return steps.withColumn("old_status", old_status).withColumn("old_assignee", old_assignee).withColumn(
        "moved", F.col("status").isNotNull() & (F.col("status") != F.col("old_status"))
    )


def invalid_changes(changes: DataFrame) -> DataFrame:
    """Requests that name a status outside the allowed list. They are rejected: neither the incident nor the
    audit trail changes by them."""
    return changes.filter(F.col("status").isNotNull() & ~F.lower("status").isin(*INCIDENT_STATUSES))


def apply_changes(incidents: DataFrame, changes: DataFrame) -> DataFrame:
    """Incidents after all requests (incident_id, change_id, changed_at, status, assignee,
    resolution_reason; NULL leaves a field alone, an empty assignee clears it).

    ``resolved_at`` follows the last request that really changed the status.
    """
    order = F.struct("changed_at", "change_id")

    def last(column, condition=None):
        condition = F.col(column).isNotNull() if condition is None else condition
        return F.max_by(column, F.when(condition, order))

    final = _steps(incidents, changes).groupBy("incident_id").agg(
        last("status").alias("new_status"),
        last("assignee").alias("new_assignee"),
        last("resolution_reason").alias("new_reason"),
        last("status", F.col("moved")).alias("moved_to"),
        F.max(F.when(F.col("moved"), F.col("changed_at"))).alias("moved_at"),
        F.max("changed_at").alias("changed_at"),
    )
    values = {
        "status": F.coalesce("new_status", "status"),
        "assignee": F.when(F.col("new_assignee").isNull(), F.col("assignee")).otherwise(
            F.nullif("new_assignee", F.lit(""))
        ),
        "resolution_reason": F.coalesce("new_reason", "resolution_reason"),
        "resolved_at": F.when(F.col("moved_to").isNull(), F.col("resolved_at")).when(
            F.col("moved_to") == "resolved", F.col("moved_at")
        ),
        "updated_at": F.coalesce("changed_at", "updated_at"),
    }
    joined = incidents.join(final, "incident_id", "left")
    return joined.select(*[values.get(c, F.col(c)).alias(c) for c in incidents.columns])


def audit_notes(incidents: DataFrame, changes: DataFrame) -> DataFrame:
    """One note per real change, in the words of the audit trail."""
    nobody = F.lit("unassigned")
    asked = F.col("assignee")
    reassigned = asked.isNotNull() & ~asked.eqNullSafe(F.col("old_assignee"))

    def note(condition, text, kind):
        return F.when(condition, F.struct(text.alias("content"), F.lit(kind).alias("note_type")))

    notes = F.array(
        note(
            F.col("moved"),
            F.concat(F.lit("Status changed from "), "old_status", F.lit(" to "), "status"),
            "status_change",
        ),
        note(
            reassigned,
            F.concat(
                F.lit("Assignment changed from "),
                F.coalesce("old_assignee", nobody),
                F.lit(" to "),
                F.coalesce(F.nullif("assignee", F.lit("")), nobody),
            ),
            "assignment",
        ),
        note(F.col("resolution_reason").isNotNull(), F.lit("Resolution reason updated"), "assignment"),
    )
    return _steps(incidents, changes).select(
        "incident_id",
        "change_id",
        F.lit("system").alias("author"),
        F.inline(F.filter(notes, lambda n: n.isNotNull())),
        F.col("changed_at").alias("created_at"),
    )


def comment_notes(incidents: DataFrame, comments: DataFrame) -> DataFrame:
    """Comments (incident_id, content, author, created_at) on incidents that exist."""
    return comments.join(incidents.select("incident_id"), "incident_id", "left_semi").select(
        "incident_id",
        F.coalesce("author", F.lit("user")).alias("author"),
        "content",
        F.lit("comment").alias("note_type"),
        "created_at",
    )
