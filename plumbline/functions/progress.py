"""Schedule status, progress, variance and risk as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Reported status -> schedule status; a word that is missing here makes no claim (null).
REPORTED = {
    "completed": "COMPLETED",
    "complete": "COMPLETED",
    "done": "COMPLETED",
    "finished": "COMPLETED",
    "started": "IN_PROGRESS",
    "in_progress": "IN_PROGRESS",
    "ongoing": "IN_PROGRESS",
    "delayed": "IN_PROGRESS",
    "blocked": "ON_HOLD",
    "on_hold": "ON_HOLD",
    "held_up": "ON_HOLD",
    "not_started": "NOT_STARTED",
    "pending": "NOT_STARTED",
    "cancelled": "CANCELLED",
}
# Progress by status, and the changes of status that are allowed.
PROGRESS = {"NOT_STARTED": 0.0, "IN_PROGRESS": 0.5, "ON_HOLD": 0.5, "COMPLETED": 1.0, "CANCELLED": 0.0}
TRANSITIONS = [
    ("NOT_STARTED", "IN_PROGRESS"),
    ("NOT_STARTED", "CANCELLED"),
    ("IN_PROGRESS", "COMPLETED"),
    ("IN_PROGRESS", "ON_HOLD"),
    ("IN_PROGRESS", "CANCELLED"),
    ("ON_HOLD", "IN_PROGRESS"),
    ("ON_HOLD", "CANCELLED"),
]
AUTO, REVIEW = 0.85, 0.65  # confidence from which a match is taken, and from which it is reviewed


def looked_up(key: Column, table: dict) -> Column:
    """The table's value of key, null if there is none."""
    return F.try_element_at(F.create_map(*[F.lit(x) for x in chain(*table.items())]), key)


def schedule_status(reported: Column) -> Column:
    """The schedule status that a report claims; null, which is not NOT_STARTED, if it claims none."""
    key = F.regexp_replace(F.lower(F.trim(F.coalesce(reported, F.lit("")))), r"[\s-]+", "_")
    return looked_up(key, REPORTED)


def status_label(reported: Column) -> Column:
    return F.coalesce(schedule_status(reported), F.lit("UNKNOWN"))


def export_status(raw: Column) -> Column:
    """Canonical status of a schedule export; unknown words pass in lower case, nothing is planned."""
    v = F.lower(F.trim(raw))
    out = F.when(v.isin("tk_notstart", "not started", "not_started", "planned", "inactive"), "planned")
    out = out.when(v.isin("tk_active", "in progress", "in_progress", "started", "active"), "in_progress")
    out = out.when(v.isin("tk_complete", "completed", "complete", "finished", "done"), "completed")
    out = out.when(v.isin("delayed", "overdue"), "delayed").when(v.isin("suspended", "on hold", "paused"), "suspended")
    return F.when(raw.isNull() | (raw == ""), "planned").otherwise(out.otherwise(v))


def progress(status: Column) -> Column:
    return looked_up(status, PROGRESS)


def quantity_progress(planned: Column, actual: Column, strict: bool = False) -> Column:
    """Percent of the planned quantity, 100 at most; bad input raises if strict, else gives null."""
    bad = (planned <= 0) | (actual < 0) | planned.isNull() | actual.isNull()
    value = F.least(actual / planned * 100, F.lit(100.0))
    return F.when(bad, F.raise_error("planned quantity must be positive and actual not negative").cast("double") if strict else F.lit(None)).otherwise(value)


def variance_days(planned: Column, actual: Column) -> Column:
    return F.datediff(actual, planned)


def inclusive_days(start: Column, finish: Column) -> Column:
    return F.datediff(finish, start) + 1


def schedule_risk(variance: Column, percent: Column) -> Column:
    """HIGH, MEDIUM or LOW from days late and percent done; null without a variance."""
    out = F.when(variance > 7, "HIGH").when((variance > 3) & (percent < 50), "HIGH").when(variance > 0, "MEDIUM")
    return F.when(variance.isNotNull(), out.otherwise("LOW"))


def review_decision(confidence: Column) -> Column:
    """AUTO, REVIEW or REJECT; a confidence outside 0 to 1 raises."""
    bad = (confidence < 0) | (confidence > 1)
    out = F.when(confidence >= AUTO, "AUTO").when(confidence >= REVIEW, "REVIEW").otherwise("REJECT")
    return F.when(bad, F.raise_error("confidence must lie between 0 and 1").cast("string")).otherwise(out)


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence >= AUTO, "HIGH").when(confidence >= REVIEW, "MEDIUM").otherwise("LOW")


def routed(confidence: Column, auto: float | Column = AUTO, review: float | Column = REVIEW) -> Column:
    return F.when(confidence >= auto, "auto_linked").when(confidence >= review, "pending_review").otherwise("unmatched")


def severity_order(level: Column) -> Column:
    """0 for HIGH, 1 for MEDIUM, 2 for LOW, 3 for anything else."""
    return F.when(level == "HIGH", 0).when(level == "MEDIUM", 1).when(level == "LOW", 2).otherwise(3)


def delay_conflict(planned: Column, actual: Column) -> Column:
    """Severity of finishing late: HIGH beyond 7 days, MEDIUM below, null in time."""
    late = F.datediff(actual, planned)
    return F.when(late > 7, "HIGH").when(late > 0, "MEDIUM")


def contradicts(a: Column, b: Column) -> Column:
    """Whether completed work is reported as going on or not begun, in either order."""
    one = lambda x, y: (x == "COMPLETED") & y.isin("IN_PROGRESS", "NOT_STARTED")
    return F.coalesce(one(a, b) | one(b, a), F.lit(False))


def transition_allowed(before: Column, after: Column) -> Column:
    return F.concat_ws(">", before, after).isin([f"{a}>{b}" for a, b in TRANSITIONS])
