"""The live schedule: state folded from claims, schedule rows, summaries, conflicts, review queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import progress as P
from plumbline.functions.numbers import ratio, rounded
from plumbline.operators.scan import row_number, running_max, scanned


def fold_state(activities: DataFrame, claims: DataFrame, parity: bool = False) -> DataFrame:
    """State of each activity that has claims: status, actual_start, start_inferred, actual_finish, evidence.

    claims: activity_id, seq, event_id, event_date, status (null: evidence only). COMPLETED stays; the last COMPLETED
    gives the finish; the first mapped claim gives the start, or the planned start (inferred) if that claim already is a
    completion. One shuffle on the activity: minima and maxima by seq, no ordered scan.
    """
    moves = F.col("status").isin("COMPLETED", "IN_PROGRESS", "ON_HOLD")
    done = F.col("status") == "COMPLETED"
    last = lambda c, when: F.max_by(c, F.when(when, F.col("seq")))
    first = lambda c, when: F.min_by(c, F.when(when, F.col("seq")))
    s = claims.groupBy("activity_id").agg(
        F.coalesce(F.max(F.when(done, F.lit("COMPLETED"))), last("status", moves), F.lit("NOT_STARTED")).alias("status"),
        last("event_date", done).alias("actual_finish"),
        first("status", moves).alias("__first"),
        first("event_date", moves).alias("__date"),
        first("event_date", moves & ~done).alias("__later"),
        F.count_distinct("event_id").alias("evidence"),
    )
    out = s.join(activities.select("activity_id", "planned_start"), "activity_id")
    begun = F.col("__first") == "COMPLETED"
    return out.select(
        "activity_id", "status",
        F.when(begun, F.coalesce("planned_start", "__later")).otherwise(F.col("__date")).alias("actual_start"),
        F.coalesce(begun, F.lit(False)).alias("start_inferred"), "actual_finish", "evidence",
    )


def schedule_rows(activities: DataFrame, actuals: DataFrame) -> DataFrame:
    """Every activity with its actual state (NOT_STARTED without one), variance, progress in percent, and risk."""
    out = activities.join(actuals.select("activity_id", "status", "actual_finish"), "activity_id", "left")
    out = out.withColumn("status", F.coalesce("status", F.lit("NOT_STARTED")))
    out = out.withColumn("variance_days", P.variance_days(F.col("planned_finish"), F.col("actual_finish")))
    out = out.withColumn("progress", P.progress(F.col("status")) * 100)
    return out.withColumn("risk", P.schedule_risk(F.col("variance_days"), F.col("progress")))


def project_summary(rows: DataFrame) -> DataFrame:
    """One row: counts by status, delayed, mean progress (0 to 1, 0 of nothing) of activities with both planned dates."""
    rows = rows.where(F.col("planned_start").isNotNull() & F.col("planned_finish").isNotNull())
    s = lambda v: F.count_if(F.col("status") == v)
    return rows.agg(
        F.count("*").alias("total"), s("COMPLETED").alias("completed"), s("IN_PROGRESS").alias("in_progress"),
        F.count_if(F.col("variance_days") > 0).alias("delayed"), rounded(F.coalesce(F.avg(F.col("progress") / 100), F.lit(0.0)), 4).alias("mean_progress"),
    )


def progress_dashboard(rows: DataFrame) -> DataFrame:
    more = rows.agg(rounded(F.avg("variance_days"), 2).alias("mean_variance"), F.max("variance_days").alias("worst_variance"), F.count_if(F.col("risk") == "HIGH").alias("high_risk"))
    return project_summary(rows).join(F.broadcast(more), how="cross")  # one row each


def status_pivot(rows: DataFrame) -> DataFrame:
    return rows.groupBy("discipline").pivot("status", list(P.PROGRESS)).count().na.fill(0)


def schedule_window(rows: DataFrame) -> DataFrame:
    """First and last of all dates, and the disciplines in order."""
    return rows.agg(
        F.min(F.array_min(F.array("planned_start", "planned_finish", "actual_finish"))).alias("first_day"),
        F.max(F.array_max(F.array("planned_start", "planned_finish", "actual_finish"))).alias("last_day"),
        F.array_join(F.sort_array(F.collect_set("discipline")), ",").alias("disciplines"),
    )


# ---- conflicts -------------------------------------------------------------------------------------------------


def same_day_conflicts(claims: DataFrame) -> DataFrame:
    """Activity and day (or "undated") with two statuses and two sources at least; HIGH where completed work is contradicted."""
    day = F.coalesce(F.date_format("event_date", "yyyy-MM-dd"), F.lit("undated"))
    c = claims.where(F.col("status").isNotNull()).withColumn("day", day)
    has = lambda v: F.bool_or(F.col("status") == v)
    g = c.groupBy("activity_id", "day").agg(
        F.countDistinct("status").alias("statuses"), F.countDistinct("source").alias("sources"), F.count("*").alias("claims"),
        (has("COMPLETED") & (has("IN_PROGRESS") | has("NOT_STARTED"))).alias("hard"),
    )
    g = g.where((F.col("statuses") > 1) & (F.col("sources") > 1))
    sev = F.when(F.col("hard"), "HIGH").otherwise("MEDIUM")
    return g.select(F.concat_ws("-", F.lit("CFL"), "activity_id", "day").alias("conflict_id"), "activity_id", "day", "statuses", "sources", "claims", sev.alias("severity"))


def claim_labels(claims: DataFrame) -> DataFrame:
    """Claims of same-day conflicts, labelled by source and, where a source reports again, the number of the report."""
    day = F.coalesce(F.date_format("event_date", "yyyy-MM-dd"), F.lit("undated"))
    c = claims.where(F.col("status").isNotNull()).withColumn("day", day)
    c = c.join(same_day_conflicts(claims).select("activity_id", "day"), ["activity_id", "day"], "left_semi")
    nth = F.row_number().over(Window.partitionBy("activity_id", "day", "source").orderBy("ts", "seq"))
    c = c.withColumn("nth", nth)
    name = F.when(F.col("nth") > 1, F.format_string("source %d (report %d)", "source", "nth")).otherwise(F.format_string("source %d", "source"))
    return c.select("event_id", "activity_id", "day", name.alias("label"))


def contradiction_pairs(claims: DataFrame) -> DataFrame:
    """Pairs of claims of one activity and day, by different sources, of which one denies the other's completion."""
    c = claims.where(F.col("status").isin("COMPLETED", "IN_PROGRESS", "NOT_STARTED") & F.col("event_date").isNotNull())
    a = c.where("status = 'COMPLETED'").select("activity_id", "event_date", F.col("event_id").alias("done_event"), F.col("source").alias("s"))
    b = c.where("status <> 'COMPLETED'").select("activity_id", "event_date", F.col("event_id").alias("other_event"), F.col("source").alias("t"), "status")
    out = a.join(b, ["activity_id", "event_date"]).where("s <> t")
    return out.select("activity_id", "done_event", "other_event", "status")


def state_regressions(claims: DataFrame) -> DataFrame:
    """Claims after the first completion of their activity, by another source, that take it back."""
    done = claims.where("status = 'COMPLETED'").groupBy("activity_id").agg(F.min_by(F.struct("event_id", "source", "ts", "seq"), F.struct("event_date", "ts", "seq")).alias("d"))
    late = claims.where(F.col("status").isin("IN_PROGRESS", "NOT_STARTED", "ON_HOLD")).join(done, "activity_id")
    after = F.struct("ts", "seq") > F.struct("d.ts", "d.seq")
    out = late.where(after & (F.col("source") != F.col("d.source")))
    return out.groupBy("activity_id").agg(F.min("d.event_id").alias("completed_by"), F.count("*").alias("regressions"), F.array_join(F.sort_array(F.collect_set("status")), ",").alias("statuses"))


def all_conflicts(claims: DataFrame) -> DataFrame:
    same = same_day_conflicts(claims).select("conflict_id", "activity_id", F.lit("same_day").alias("kind"), "severity")
    back = state_regressions(claims).select(F.concat_ws("-", F.lit("REG"), "activity_id").alias("conflict_id"), "activity_id", F.lit("state_regression").alias("kind"), F.lit("HIGH").alias("severity"))
    return same.unionByName(back)


def transition_violations(claims: DataFrame) -> DataFrame:
    """Changes of status between successive claims of an activity that the rules do not allow, counted."""
    w = Window.partitionBy("activity_id").orderBy("seq")
    moved = claims.where(F.col("status").isNotNull()).withColumn("before", F.lag("status").over(w)).where("before is not null and before <> status")
    bad = moved.where(~P.transition_allowed(F.col("before"), F.col("status")))
    return bad.groupBy("before", F.col("status").alias("after")).agg(F.count("*").alias("n"))


# ---- links, audit, queue ---------------------------------------------------------------------------------------


def link_sets(claims: DataFrame) -> DataFrame:
    """Events, sources and latest known status of each activity."""
    return claims.groupBy("activity_id").agg(
        F.count("*").alias("events"), F.countDistinct("source").alias("sources"), (F.count("*") > 1).alias("many_to_one"),
        F.max_by("status", F.when(F.col("status").isNotNull(), F.col("seq"))).alias("latest"),
    )


def daily_timeline(events: DataFrame, stages: list[str]) -> DataFrame:
    """Days and their number of events of the given stages; days of other stages alone count 0."""
    return events.groupBy(F.to_date("ts").alias("day")).agg(F.count_if(F.col("stage").isin(stages)).alias("n"))


def priority_queue(events: DataFrame, weights: list[float], now) -> DataFrame:
    """Review queue: score by weighted urgency and rank (from 1, ties by event_id) of events(event_id, seq, ts, confidence,
    risk, fan_out, delay_rate). Urgency is confidence, risk, fan-out against the largest so far in the order of seq, hours
    waiting and delay rate. The running maximum and the ranks are scans over ranges, so that no window holds the queue."""
    hours = (F.unix_timestamp(F.lit(now).cast("timestamp")) - F.unix_timestamp("ts")) / 3600
    risk = F.when(F.col("risk") == "HIGH", 1.0).when(F.col("risk") == "MEDIUM", 0.5).when(F.col("risk") == "LOW", 0.1).otherwise(0.0)
    seen = scanned(events, ["seq"], most=running_max(F.col("fan_out")))
    parts = [F.col("confidence"), risk, F.least(ratio(F.col("fan_out"), F.greatest("most", F.lit(1))), F.lit(1.0)), F.greatest(F.least(hours / 24, F.lit(1.0)), F.lit(0.0)), F.col("delay_rate")]
    score = rounded(sum((p * w for p, w in zip(parts, weights, strict=True)), F.lit(0.0)), 3)
    out = seen.select("event_id", score.alias("score"), F.col("most").alias("max_fan_out"), (-score).alias("urgency"))
    return scanned(out, ["urgency", "event_id"], rank=row_number()).select("event_id", "score", "max_fan_out", "rank")
