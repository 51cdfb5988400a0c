"""Evaluation on labelled reports: fields, ways of matching, kinds of errors."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.labels import same_label
from plumbline.functions.numbers import rounded
from plumbline.operators.matching import first_by_score
from plumbline.operators.review import best_overlap

FIELDS = ["discipline", "asset", "status", "event_date", "activity_type", "location"]
# Disciplines that a label may expect, in the order in which they are looked for.
EXPECTED = ["piping", "electrical", "civil", "instrumentation", "mechanical"]
# Decisions that count as having noticed that a report is ambiguous, and a note's words that ask for an asset.
NOTICED = ["clarification_needed", "review", "unmatched"]
ASSET_NOTES = "asset|line|identifier"


def labelled(truth: DataFrame, events: DataFrame) -> DataFrame:
    """Labelled reports beside the extracted event of most words in common, as extraction_metrics takes them.

    truth: sources.reports.labelled_truth, events: extracted() with an id. The expected discipline is the first of the known
    ones that the activity's name or the note speaks of; a label without an event in common stays, with found false."""
    about = F.lower(F.concat_ws(" ", "correct_activity_name", "note"))
    expected = F.lit(None).cast("string")
    for d in reversed(EXPECTED):
        expected = F.when(about.contains(d), d).otherwise(expected)
    said = events.select("id", F.col("raw_text").alias("text"))
    met = best_overlap(truth.select(F.col("event_id").alias("id"), F.col("input_text").alias("text")), said)
    got = met.join(events.select(F.col("id").alias("event_id"), *FIELDS), "event_id").drop("event_id", "overlap").withColumnRenamed("truth_id", "event_id")
    out = truth.select("event_id", (F.col("correct_activity_id") == "AMBIGUOUS").alias("ambiguous"), expected.alias("expected_discipline"), "note").join(got.withColumn("found", F.lit(True)), "event_id", "left")
    return out.withColumn("found", F.coalesce("found", F.lit(False)))


def extraction_metrics(truth: DataFrame) -> DataFrame:
    """One row of accuracies by field, over all fields, and by event, three digits; null without labelled reports.

    truth: a row per labelled report with ambiguous, expected_discipline, note, found (whether an event was found for it)
    and the event's fields. Ambiguous reports don't count, those without an event are wrong in every field. A discipline
    is right if it is the expected one or none is expected, the other fields if they are there. An event is right with
    its discipline, a known status, and an asset where the note speaks of one.
    """
    there = {f: F.col(f).isNotNull() & (F.col(f).cast("string") != "") for f in FIELDS}
    there["discipline"] = same_label(F.col("discipline"), F.col("expected_discipline"))
    there["status"] = there["status"] & (F.col("status") != "unknown")
    asset = there["asset"] | ~F.coalesce(F.lower("note").rlike(ASSET_NOTES), F.lit(False))
    right = {f: F.coalesce(F.col("found") & t, F.lit(False)) for f, t in there.items()}
    whole = right["discipline"] & right["status"] & asset
    t = truth.where(~F.coalesce("ambiguous", F.lit(False)))
    sums = t.agg(F.count("*").alias("total"), *[F.count_if(c).alias(f) for f, c in right.items()], F.count_if(whole).alias("whole"))
    share = lambda c, of=1: rounded(c / F.nullif(F.col("total") * of, F.lit(0)), 3)
    every = reduce(Column.__add__, [F.col(f) for f in FIELDS])
    return sums.select(
        F.col("total").alias("total_events"), *[share(F.col(f)).alias(f"{f}_accuracy") for f in FIELDS],
        share(every, len(FIELDS)).alias("overall_field_accuracy"), share(F.col("whole")).alias("event_level_accuracy"),
    )


def top_by_containment(queries: DataFrame, activities: DataFrame, keep: int = 1) -> DataFrame:
    """(query, activity_id, score, rank): activities by the share of their words that a query has. Both: id, words, an array
    of distinct words. They meet by common words only."""
    q = queries.select(F.col("id").alias("query"), F.explode("words").alias("w"))
    a = activities.select(F.col("id").alias("activity_id"), F.explode("words").alias("w"), F.size("words").alias("n"))
    hits = q.join(a, "w").groupBy("query", "activity_id").agg((F.count("*") / F.first("n")).alias("score"))
    return first_by_score(hits, keep)


def baseline_comparison(predictions: DataFrame) -> DataFrame:
    """predictions(method, expected, predicted, decision): correct, wrong, total and accuracy (percent) of each method.

    An ambiguous report (expected is null) is right if it was noticed; a method without decisions gets it for free.
    """
    noticed = F.col("decision").isNull() | F.col("decision").isin(*NOTICED)
    ok = F.when(F.col("expected").isNull(), noticed).otherwise(F.col("predicted").eqNullSafe(F.col("expected")))
    out = predictions.groupBy("method").agg(F.count_if(ok).alias("correct"), F.count_if(~ok).alias("wrong"), F.count("*").alias("total"))
    return out.withColumn("accuracy", rounded(F.col("correct") * 100 / F.col("total"), 1))


def error_kind(text: Column, expected: Column, predicted: Column, wanted: Column, got: Column, decision: Column) -> Column:
    """The kind of error in a match, null if it is right. wanted and got: disciplines of the expected and the found activity."""
    wrong = ~predicted.eqNullSafe(expected)
    tagged = F.lower(text).contains("line") | text.rlike(r"[A-Z]+-\d+")
    return (
        F.when(expected.isNull(), F.when(decision == "auto_linked", "ambiguity_not_detected"))
        .when(wrong & ~wanted.eqNullSafe(got), "discipline_confusion")
        .when(wrong & tagged, "identifier_miss")
        .when(wrong, "other")
    )


def error_kinds(matches: DataFrame) -> DataFrame:
    """How many errors of each kind; matches has the columns that error_kind takes, by its names."""
    kind = error_kind(*[F.col(c) for c in ("text", "expected", "predicted", "wanted", "got", "decision")])
    return matches.select(kind.alias("kind")).where("kind is not null").groupBy("kind").agg(F.count("*").alias("n"))


def settled(tracked: DataFrame, claims: DataFrame, trusted: Column) -> DataFrame:
    """Tracked reports (event_id, link_state) of a conflict's claims(event_id, conflict_id): approved where the source is
    trusted, else superseded; the others keep their state."""
    c = claims.select("event_id", "conflict_id").distinct()
    state = F.when(F.col("conflict_id").isNull(), F.col("link_state")).when(trusted, "approved").otherwise("superseded")
    return tracked.join(c, "event_id", "left").withColumn("link_state", state)
