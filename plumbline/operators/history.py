"""History of finished work: delay statistics, causes, productivity, risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.numbers import ratio, rounded

ENOUGH = 3  # rows of an exact type from which history of that type alone is used


def filtered(history: DataFrame, delayed_only: bool = False, **equal: str) -> DataFrame:
    """Rows that fit all given values; discipline, activity_type and location_type regardless of case."""
    for name, value in equal.items():
        fold = name in ("discipline", "activity_type", "location_type")
        history = history.where((F.lower(name) == value.lower()) if fold else (F.col(name) == value))
    return history.where("delayed") if delayed_only else history


def positive_mean(c: str) -> Column:
    return F.coalesce(F.avg(F.when(F.col(c) > 0, F.col(c))), F.lit(0.0))


def delay_stats(history: DataFrame, *by: str) -> DataFrame:
    """Per group: n, n_delayed, delay_frequency, mean_variance, mean_planned and mean_actual (over positive values)."""
    return history.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.count_if("delayed").alias("n_delayed"),
        rounded(ratio(F.count_if("delayed"), F.count("*")), 3).alias("delay_frequency"),
        rounded(F.avg("variance_days"), 2).alias("mean_variance"),
        rounded(positive_mean("planned_days"), 2).alias("mean_planned"),
        rounded(positive_mean("actual_days"), 2).alias("mean_actual"),
    )


def duration_by_type(history: DataFrame) -> DataFrame:
    return delay_stats(history, "discipline", "activity_type").select("discipline", "activity_type", "n", "mean_planned", "mean_actual", "mean_variance")


def top_causes(history: DataFrame, n: int = 5) -> DataFrame:
    """The n most common causes; frequency among all delayed rows, those without a cause included."""
    late = history.where("delayed")
    total = late.agg(F.count("*").alias("total"))
    ranked = late.where(F.col("delay_cause").isNotNull()).groupBy("delay_cause").agg(F.count("*").alias("n"))
    out = ranked.join(F.broadcast(total), how="cross")  # one row
    return out.select("delay_cause", "n", rounded(ratio(F.col("n"), F.col("total")), 3).alias("frequency")).orderBy(F.desc("n"), "delay_cause").limit(n)


def cause_share(history: DataFrame) -> DataFrame:
    """Causes within a discipline and their share of its delays that have a cause."""
    counted = history.where(F.col("delayed") & F.col("delay_cause").isNotNull()).groupBy("discipline", "delay_cause").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("discipline"))
    return counted.withColumn("share", rounded(ratio(F.col("n"), total), 4))


def over_baseline(history: DataFrame, least: float = 2) -> DataFrame:
    """Groups whose mean variance, unrounded, is at least `least`."""
    return (
        history.groupBy("discipline", "activity_type")
        .agg(F.count("*").alias("n"), F.avg("variance_days").alias("v"), F.max("variance_days").alias("worst"), ratio(F.count_if("delayed"), F.count("*")).alias("f"))
        .where(F.col("v") >= least)
        .select("discipline", "activity_type", "n", rounded(F.col("v"), 2).alias("mean_variance"), "worst", rounded(F.col("f"), 3).alias("delay_frequency"))
    )


def risk_level(frequency: Column) -> Column:
    return F.when(frequency.isNull(), "UNKNOWN").when(frequency >= 0.60, "HIGH").when(frequency >= 0.35, "MEDIUM").otherwise("LOW")


def buffer_days(mean_variance: Column, frequency: Column) -> Column:
    """Days to plan in: the mean variance, with a fifth more where most rows are late; none below zero."""
    plain = F.ceil(mean_variance)
    more = F.greatest(plain, F.ceil(rounded(mean_variance * 1.2, 6)))
    return F.greatest(F.lit(0), F.when(frequency >= 0.60, more).otherwise(plain)).cast("long")


def risk_profile(history: DataFrame, *by: str) -> DataFrame:
    """delay_stats with risk, confidence of the sample, and buffer."""
    s = delay_stats(history, *by)
    sure = F.when(F.col("n") >= 10, "high").when(F.col("n") >= 4, "medium").otherwise("low")
    return s.withColumns(
        {"risk_level": risk_level(F.col("delay_frequency")), "confidence": sure, "buffer": buffer_days(F.col("mean_variance"), F.col("delay_frequency"))}
    )


def assess(activities: DataFrame, history: DataFrame) -> DataFrame:
    """Risk of each activity (activity_id, discipline, activity_type): from history of its discipline and type where
    there are ENOUGH rows, else from history of its discipline, else UNKNOWN. One aggregate of each grain, two joins."""
    exact = risk_profile(history, "discipline", "activity_type").where(F.col("n") >= ENOUGH)
    wide = risk_profile(history, "discipline")
    cols = ["n", "delay_frequency", "mean_variance", "risk_level", "confidence", "buffer"]
    e = exact.select("discipline", "activity_type", *[F.col(c).alias(f"e_{c}") for c in cols])
    w = wide.select("discipline", *[F.col(c).alias(f"w_{c}") for c in cols])
    out = activities.join(e, ["discipline", "activity_type"], "left").join(w, "discipline", "left")
    pick = {c: F.when(F.col("e_n").isNotNull(), F.col(f"e_{c}")).otherwise(F.col(f"w_{c}")) for c in cols}
    return out.select(
        "activity_id", F.coalesce(pick["n"], F.lit(0)).cast("long").alias("n"), pick["delay_frequency"].alias("delay_frequency"),
        F.coalesce(pick["risk_level"], F.lit("UNKNOWN")).alias("risk_level"), F.coalesce(pick["confidence"], F.lit("none")).alias("confidence"),
        F.coalesce(pick["buffer"], F.lit(0)).cast("long").alias("buffer"),
    )


def productivity(history: DataFrame) -> DataFrame:
    """Benchmarks of each discipline and type, and of all rows (discipline and type "all"): one scan, grouping sets."""
    history.createOrReplaceTempView("__history")
    out = history.sparkSession.sql("""
        select coalesce(discipline, 'all') as discipline, coalesce(activity_type, 'all') as activity_type, count(*) as n,
               avg(case when actual_days > 0 then actual_days end) as days, avg(variance_days) as v,
               count_if(delayed) / count(*) as f, avg(productivity) as rate, max(productivity) as best, min(productivity) as worst
        from __history group by grouping sets ((discipline, activity_type), ())""")
    return out.select(
        "discipline", "activity_type", "n", rounded(F.col("days"), 2).alias("mean_days"), rounded(F.col("v"), 2).alias("mean_variance"), rounded(F.col("f"), 3).alias("delay_frequency"),
        rounded(F.col("rate"), 3).alias("rate_avg"), rounded(F.col("best"), 3).alias("rate_best"), rounded(F.col("worst"), 3).alias("rate_worst"),
    )


def below_average(current: DataFrame, history: DataFrame, percent: float = 10) -> DataFrame:
    """current(discipline, activity_type, rate) with percent below the group's mean rate and whether that is over `percent`."""
    avg = history.where("productivity is not null").groupBy("discipline", "activity_type").agg(F.avg("productivity").alias("mean"))
    below = rounded((F.col("mean") - F.col("rate")) / F.nullif(F.col("mean"), F.lit(0.0)) * 100, 1)
    out = current.join(avg, ["discipline", "activity_type"], "left").withColumn("percent_below", below)
    return out.select("discipline", "activity_type", "rate", "percent_below", F.coalesce(F.col("percent_below") > percent, F.lit(False)).alias("flagged"))


def kb_stats(history: DataFrame) -> DataFrame:
    """Rows of each discipline by quality of record, and how many are delayed."""
    q = lambda v: F.count_if(F.col("record_quality") == v).alias(v)
    return history.groupBy("discipline").agg(F.count("*").alias("total"), q("verified"), q("provisional"), q("rejected"), F.count_if("delayed").alias("delayed"))
