"""Rules of data quality over planned activities: one pass, an issue row for each rule that a row breaks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ISSUE = "struct<issue_type:string,severity:string,field:string>"


def blank(c: str) -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin("", "none", "null", "nan"), F.lit(True))


def issues(kept: DataFrame, tree: DataFrame | None = None, summaries: DataFrame | None = None) -> DataFrame:
    """(activity_id, issue_type, severity, field) of kept activities (activity_id, activity_name, wbs_id, start_raw,
    planned_start, finish_raw, planned_finish, predecessors array). tree(node): known WBS ids. summaries: rows read but
    not kept. A duplicate id is one issue however often it occurs."""
    rule = lambda test, kind, severity, field: F.when(test, F.struct(F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity"), F.lit(field).alias("field")))
    bad = lambda raw, day: F.col(day).isNull() & F.col(raw).isNotNull() | F.col(raw).isNull()
    rules = [
        rule(blank("activity_id"), "missing_id", "ERROR", "activity_id"),
        rule(blank("activity_name"), "missing_name", "WARNING", "activity_name"),
        rule(bad("start_raw", "planned_start"), "invalid_date", "ERROR", "planned_start"),
        rule(bad("finish_raw", "planned_finish"), "invalid_date", "ERROR", "planned_finish"),
        rule(F.col("planned_finish") < F.col("planned_start"), "finish_before_start", "ERROR", "planned_finish"),
        rule(blank("wbs_id"), "missing_wbs", "WARNING", "wbs_id"),
        rule(F.array_contains("predecessors", F.col("activity_id")), "circular_predecessor", "WARNING", "predecessors"),
    ]
    flat = kept.select("activity_id", F.explode(F.array_compact(F.array(*rules))).alias("i")).select("activity_id", "i.*")
    twice = kept.where(~blank("activity_id")).groupBy("activity_id").agg(F.count("*").alias("n")).where("n > 1")
    mark = lambda df, kind, severity, field: df.select("activity_id", F.lit(kind).alias("issue_type"), F.lit(severity).alias("severity"), F.lit(field).alias("field"))
    out = flat.unionByName(mark(twice, "duplicate_id", "ERROR", "activity_id"))
    if tree is not None:
        lost = kept.where(~blank("wbs_id")).join(tree.select(F.col("node").alias("wbs_id")), "wbs_id", "left_anti")
        out = out.unionByName(mark(lost, "missing_wbs", "INFO", "wbs_id"))
    if summaries is not None:
        out = out.unionByName(mark(summaries, "non_l5_l6", "INFO", "wbs_level"))
    return out


def rollup(found: DataFrame) -> DataFrame:
    """Counts by type and severity, by type, and of all."""
    r = found.rollup("issue_type", "severity").agg(F.count("*").alias("n"))
    return r.select(F.coalesce("issue_type", F.lit("all")).alias("issue_type"), F.coalesce("severity", F.lit("all")).alias("severity"), "n")


def level_of(raw: Column) -> Column:
    """The first whole number of a level, 6 without one."""
    return F.coalesce(F.regexp_extract(raw, r"(\d+)", 1).try_cast("int"), F.lit(6))


def is_work(level: Column, wbs_id: Column, activity_id: Column, duration: Column, summary: Column) -> Column:
    """Whether a row is work (level 5 or 6) and not a summary: by flag, level, level mark in the ids, else by duration."""
    mark = r"(?i)\bL[56]\b"
    return F.when(summary, False).when(level.isin(5, 6), True).when(wbs_id.rlike(mark) | activity_id.rlike(mark), True).otherwise((level >= 5) | (duration > 0))
