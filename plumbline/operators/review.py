"""Work on linked reports: lists and searches, the registry of conflicts, audit, evaluation, policies and their reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.functions.numbers import dot, ratio, rounded
from plumbline.functions.progress import severity_order
from plumbline.operators.matching import spread, text_ratio

WAITING = ("pending_review", "clarification_needed", "unmatched")

# Names, risk scores, delay rates and first weights of the routing policy, and the factors of the queue.
ACTIONS = ["auto_link", "ask_clarification", "send_to_planner"]
RISK_SCORES = {"HIGH": 1.0, "MEDIUM": 0.5, "LOW": 0.1}
DELAY_RATES = {"piping": 0.68, "electrical": 0.42, "civil": 0.38, "instrumentation": 0.55, "mechanical": 0.50}
AGENT_WEIGHTS = [
    [2.5, 1.5, -0.3, 0.0, 0.0, 1.2, -0.5, -1.5],
    [0.0, -3.0, 0.0, 0.0, 0.0, -2.0, 0.5, 2.0],
    [0.8, 0.5, 1.2, 0.7, 0.4, 0.0, 0.3, 0.0],
]
FACTORS = ["match confidence", "schedule risk", "cascade impact", "time in queue", "discipline delay rate"]

# Weights of the fields that two reports of one event share, and of their texts.
FIELD_WEIGHTS = {"asset": 3.0, "activity_type": 2.0, "event_date": 1.5, "discipline": 1.0, "status": 1.0}
TEXT_WEIGHT = 1.5
# Fields by which pairs meet: the first of these that both have.
WAYS = [("asset",), ("activity_type", "event_date"), ("activity_type",), ("event_date",), ("discipline", "status"), ("discipline",), ("status",)]


# ---- lists -----------------------------------------------------------------------------------------------------


def listed(events: DataFrame, link_state: str | None = None, discipline: str | None = None, waiting: bool = False) -> DataFrame:
    """Events of a link state and, regardless of case, of a discipline; waiting: only those that a planner still has to see."""
    if link_state is not None:
        events = events.where(F.col("link_state") == link_state)
    if discipline is not None:
        events = events.where(F.lower("discipline") == discipline.lower())
    return events.where(F.col("link_state").isin(*WAITING)) if waiting else events


def search(activities: DataFrame, term: str, fields: list[str], limit: int, order: str = "activity_id") -> DataFrame:
    """The first `limit` activities of which a field contains term, regardless of case, with the number of all such (total)."""
    hit = F.lit(False)
    for f in fields:
        hit = hit | F.coalesce(F.contains(F.lower(F.col(f).cast("string")), F.lit(term.lower())), F.lit(False))
    return first_of(activities.where(hit), limit, F.col(order))


def first_of(rows: DataFrame, limit: int, *order: Column) -> DataFrame:
    """The first rows in order and, as total, how many there are: two passes, so that no window gathers the rows."""
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*order).limit(limit).join(F.broadcast(total), how="cross")  # one row


def touched(rows: DataFrame, evidence: DataFrame, discipline: str | None = None) -> DataFrame:
    """Schedule rows for which there is evidence, of a discipline if one is given."""
    if discipline is not None:
        rows = rows.where(F.lower("discipline") == discipline.lower())
    return rows.join(evidence, "activity_id", "left_semi")


def audit_feed(log: DataFrame, stage: str, limit: int = 200) -> DataFrame:
    """The newest entries (seq) of a stage, which is written in capitals, and the number of all."""
    return first_of(log.where(F.upper("stage") == stage.upper()), limit, F.desc("seq"))


def audit_chain(log: DataFrame, schedule: DataFrame) -> DataFrame:
    """Entries with what the schedule says of their activity; entries of no known activity stay."""
    return log.join(schedule, "activity_id", "left")


def ingest_summary(events: DataFrame, by: str) -> DataFrame:
    """Of each batch: events, and how many went which way."""
    n = lambda s: F.count_if(F.col("link_state") == s)
    return events.groupBy(by).agg(
        F.count("*").alias("events_detected"), n("auto_linked").alias("auto_linked"), n("pending_review").alias("needs_review"),
        n("clarification_needed").alias("needs_clarification"), n("unmatched").alias("unmatched"),
    )


def risk_histogram(risks: DataFrame) -> DataFrame:
    n = lambda v: F.count_if(F.col("risk_level") == v).alias(v.lower())
    return risks.agg(F.count("*").alias("count"), n("HIGH"), n("MEDIUM"), n("LOW"))


def risk_ranking(risks: DataFrame, limit: int) -> DataFrame:
    """The first activities by risk, then by how often their kind is late, ties by id, ranked from 1."""
    ahead = [severity_order(F.col("risk_level")), F.desc_nulls_last("delay_frequency"), F.col("activity_id")]
    best = risks.orderBy(*ahead).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(*ahead)))  # limit rows


# ---- conflicts -------------------------------------------------------------------------------------------------


def conflict_registry(found: DataFrame, known: DataFrame, now) -> DataFrame:
    """The registry after a new search. found: conflict_id, activity_id, severity; known has detected_at and resolved too.

    Resolved conflicts are not raised again; what was known keeps its detected_at; what was not found again stays.
    """
    f = found.select("conflict_id", F.struct("activity_id", "severity").alias("f"))
    k = known.select("conflict_id", F.struct("activity_id", "severity", "detected_at", "resolved").alias("k"))
    both = f.join(k, "conflict_id", "full")
    done = F.coalesce(F.col("k.resolved"), F.lit(False))
    fresh = ~done & F.col("f").isNotNull()
    return both.select(
        "conflict_id", F.coalesce("f.activity_id", "k.activity_id").alias("activity_id"), F.when(fresh, F.col("f.severity")).otherwise(F.col("k.severity")).alias("severity"),
        F.coalesce("k.detected_at", F.lit(now).cast("timestamp")).alias("detected_at"), done.alias("resolved"),
    )


# ---- duplicates and feedback -----------------------------------------------------------------------------------


def compared(text: Column) -> Column:
    """Lower case, signs as blanks, single blanks."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"(?U)[^\w\s]", " "), r"(?U)\s+", " ")


def meeting(plain: DataFrame) -> DataFrame:
    """plain with has (the fields that an event has), and a row for each such set that occurs, other: key is then the way by
    which it meets those events, the first of WAYS whose fields both have, with its own values."""
    plain = plain.withColumn("has", F.array_compact(F.array(*[F.when(F.col(f).isNotNull(), F.lit(f)) for f in FIELD_WEIGHTS])))
    kinds = [r.has for r in plain.select("has").distinct().collect()]  # 2^5 at most
    key = F.lit(None)
    for i, way in reversed(list(enumerate(WAYS))):
        both = F.forall(F.array(*map(F.lit, way)), lambda f: F.array_contains("has", f) & F.array_contains("other", f))
        key = F.when(both, F.struct(F.lit(i).alias("way"), F.array(*way).alias("values"))).otherwise(key)
    other = F.explode(F.array(*[F.array(*map(F.lit, k)).cast("array<string>") for k in kinds])) if kinds else F.lit(None).cast("array<string>")
    return plain.withColumn("other", other).withColumn("key", key).where("key is not null")


def weighted_duplicates(events: DataFrame, threshold: float = 0.80) -> DataFrame:
    """(a, b, similarity): pairs of events(id, text and the fields of FIELD_WEIGHTS) of at least the threshold, a before b.

    Similarity is the weight of equal fields and of the texts' ratio over that of fields that both have. From a threshold
    of 0.8 on, a pair must agree in the assets if both have one, else in those of kind and day that both have, else in those
    of discipline and status, any other way it reaches 0.786 at most. Which of these it is follows from the fields that
    either has: pairs meet by that, and so only by the values that they must share, not by a discipline that all have. Those
    that have no field in common are not compared. Texts are compared only where fields and lengths leave hope.
    """
    if threshold < 0.8:
        raise ValueError("pairs meet by fields that they must share from a threshold of 0.8 on")
    plain = events.select("id", compared(F.col("text")).alias("text"), *[F.nullif(F.lower(F.trim(F.col(f).cast("string"))), F.lit("")).alias(f) for f in FIELD_WEIGHTS])
    met = meeting(plain)
    a, b = met.alias("a"), met.alias("b")
    both = {f: F.col(f"a.{f}").isNotNull() & F.col(f"b.{f}").isNotNull() for f in FIELD_WEIGHTS}
    total, same = F.lit(TEXT_WEIGHT), F.lit(0.0)
    for f, w in FIELD_WEIGHTS.items():
        total = total + F.when(both[f], w).otherwise(0.0)
        same = same + F.when(F.col(f"a.{f}") == F.col(f"b.{f}"), w).otherwise(0.0)
    meet = (F.col("a.key") == F.col("b.key")) & (F.col("a.has") == F.col("b.other")) & (F.col("a.other") == F.col("b.has"))
    pairs = a.join(b, meet & (F.col("a.id") < F.col("b.id")))
    near = pairs.select(F.col("a.id").alias("a"), F.col("b.id").alias("b"), F.col("a.text").alias("x"), F.col("b.text").alias("y"), total.alias("total"), same.alias("same"))
    most = F.coalesce(ratio(2 * F.least(F.length("x"), F.length("y")), F.length("x") + F.length("y")), F.lit(1.0))
    near = near.where(F.col("same") + TEXT_WEIGHT * most >= (threshold - 0.0006) * F.col("total"))
    sim = rounded((F.col("same") + TEXT_WEIGHT * text_ratio("x", "y")) / F.col("total"), 3)
    return spread(near).select("a", "b", sim.alias("similarity")).where(F.col("similarity") >= threshold)


def feedback_boost(candidates: DataFrame, feedback: DataFrame) -> DataFrame:
    """candidates(event_id, activity_id, text) with boost: a tenth of the best ratio, above 0.6, of the text with that of an
    approved feedback(activity_id, text, approved) for the activity; rejected feedback takes nothing away."""
    said = feedback.where("approved").select("activity_id", F.lower("text").alias("said")).distinct()
    met = spread(candidates.join(said, "activity_id")).withColumn("r", text_ratio(F.lower("text"), "said")).where("r > 0.6")
    best = met.groupBy("event_id", "activity_id").agg(rounded(F.max("r") * 0.10, 4).alias("boost"))
    return candidates.join(best, ["event_id", "activity_id"], "left").withColumn("boost", F.coalesce("boost", F.lit(0.0)))


# ---- evaluation ------------------------------------------------------------------------------------------------


def explained(evidence: Column) -> Column:
    """Rollup of array<struct<signal, matched, boost>>: semantic_score, total_boost of other signals that match, final_score, counts."""
    semantic = F.aggregate(F.filter(evidence, lambda e: e["signal"] == "semantic_similarity"), F.lit(0.0), lambda s, e: s + e["boost"])
    boost = F.aggregate(F.filter(evidence, lambda e: (e["signal"] != "semantic_similarity") & e["matched"]), F.lit(0.0), lambda s, e: s + e["boost"])
    return F.struct(
        rounded(semantic, 3).alias("semantic_score"), rounded(boost, 3).alias("total_boost"), rounded(semantic + boost, 3).alias("final_score"),
        F.size(F.filter(evidence, lambda e: e["matched"])).alias("matched_signals"), F.size(evidence).alias("total_signals"),
    )


def best_overlap(truth: DataFrame, events: DataFrame) -> DataFrame:
    """(truth_id, event_id, overlap): the event of most words in common with each labelled text, the first of equals.

    Both have id and text. Words of the labelled texts, a bounded set, meet those of the events."""
    split = lambda df, name: df.select(F.col("id").alias(name), F.explode(F.array_distinct(F.split(F.lower(F.trim("text")), r"\s+"))).alias("w")).where("w <> ''")
    n = split(truth, "truth_id").join(split(events, "event_id"), "w").groupBy("truth_id", "event_id").agg(F.count("*").alias("overlap"))
    best = n.groupBy("truth_id").agg(F.min_by(F.struct("event_id", "overlap"), F.struct(-F.col("overlap"), "event_id")).alias("b"))
    return best.select("truth_id", "b.event_id", "b.overlap")


def match_accuracy(results: DataFrame) -> DataFrame:
    """results(difficulty, expected, predicted, decision) by difficulty and over all: n, correct, accuracy. An ambiguous
    report (expected is null) counts as handled if it was not linked."""
    right = F.when(F.col("expected").isNull(), F.col("decision") != "auto_linked").otherwise(F.coalesce(F.col("predicted") == F.col("expected"), F.lit(False)))
    g = results.withColumn("right", right).rollup("difficulty").agg(F.count("*").alias("n"), F.count_if("right").alias("correct"))
    return g.select(F.coalesce("difficulty", F.lit("all")).alias("difficulty"), "n", "correct", rounded(ratio(F.col("correct"), F.col("n")), 3).alias("accuracy"))


# ---- policies --------------------------------------------------------------------------------------------------


def looked_up(value: Column, table: dict[str, float], other: float) -> Column:
    out = F.lit(other)
    for k, v in table.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def agent_features(confidence: Column, scores: Column, risk: Column, fan_out: Column, most: Column, discipline: Column, text: Column) -> Column:
    """The eight features of the routing policy, in order: confidence, lead of the best of scores, risk, fan-out against
    the largest so far, delay rate of the discipline, whether an identifier stands in the text, candidates of .5 or more
    (five are all), whether the text has at most six words."""
    unit = lambda x: F.greatest(F.least(x.cast("double"), F.lit(1.0)), F.lit(0.0))
    s = F.sort_array(scores, asc=False)
    gap = F.when(F.size(s) >= 2, F.get(s, F.lit(0)) - F.get(s, F.lit(1))).when(F.size(s) == 1, F.get(s, F.lit(0))).otherwise(0.0)
    few = F.size(F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")) <= 6
    return F.array(
        unit(confidence), unit(gap), looked_up(risk, RISK_SCORES, 0.0), F.least(ratio(fan_out, F.greatest(most, F.lit(1))), F.lit(1.0)), looked_up(F.lower(discipline), DELAY_RATES, 0.3),
        F.when(F.size(T.identifiers(text)) > 0, 1.0).otherwise(0.0), F.least(F.size(F.filter(scores, lambda x: x >= 0.5)) / 5, F.lit(1.0)), F.when(few, 1.0).otherwise(0.0),
    )


def explored(seq: Column, updates: Column, seed: str, actions: int, start: float = 0.10, decay: float = 0.99, least: float = 0.02) -> Column:
    """The action that exploration takes, counted from 0, or null where the best one is taken: with a chance that shrinks
    from start by decay an update, to least. Chance is the digest of seed and seq, so that a replay explores alike."""
    drawn = lambda a, b: F.conv(F.substr(F.md5(F.concat(F.lit(seed + ":"), seq.cast("string"))), F.lit(a), F.lit(b)), 16, 10).cast("long")
    rate = F.greatest(F.lit(least), F.lit(start) * F.pow(F.lit(decay), updates.cast("double")))
    return F.when(drawn(1, 8) / F.lit(float(2**32)) < rate, F.pmod(drawn(9, 8), F.lit(actions)).cast("int"))


def q_values(features: Column, weights: list[list[float]] = AGENT_WEIGHTS) -> Column:
    return F.array(*[rounded(dot(features, F.array(*map(F.lit, w))), 4) for w in weights])


def chosen(q: Column) -> Column:
    """The action of the highest value, the first of equals."""
    return F.get(F.array(*map(F.lit, ACTIONS)), F.array_position(q, F.array_max(q)).cast("int") - 1)


def link_state(confidence: Column, action: Column, activity: Column, unclear: Column) -> Column:
    """Where a report goes: without confidence unmatched; then by the action, a link needing an activity; a report that the
    matcher finds unclear is asked about unless it was linked."""
    linked = (confidence > 0) & (action == "auto_link") & activity.isNotNull()
    asked = ((confidence > 0) & (action == "ask_clarification")) | F.coalesce(unclear, F.lit(False))
    return F.when(linked, "auto_linked").when(asked, "clarification_needed").when(confidence > 0, "pending_review").otherwise("unmatched")


def agent_reward(action: Column, approved: Column, confidence: Column, reassigned: Column) -> Column:
    planner = F.when(reassigned, 2.0).when(~approved, 1.5).when(confidence < 0.80, 1.0).otherwise(-0.5)
    return F.when(action == "send_to_planner", planner).when(action == "ask_clarification", F.when(approved, 0.8).otherwise(-0.3)).otherwise(-2.0)


def queue_reward(approved: Column, risk: Column, hours: Column) -> Column:
    return F.when(~approved, -1.0).otherwise(looked_up(risk, {"HIGH": 2.0, "MEDIUM": 1.0, "LOW": 0.5}, 0.3) + 0.3 * F.least(hours / 24, F.lit(1.0)))


def contributions(features: Column, weights: list[float], names: list[str] = FACTORS) -> Column:
    """array<struct<contribution, nr, factor>>, the largest share first, equals in the order of the factors."""
    parts = [F.struct((-rounded(F.get(features, F.lit(i)) * w, 3)).alias("minus"), F.lit(i).alias("nr"), F.lit(n).alias("factor")) for i, (w, n) in enumerate(zip(weights, names, strict=True))]
    return F.transform(F.sort_array(F.array(*parts)), lambda x: F.struct((-x["minus"]).alias("contribution"), x["nr"].alias("nr"), x["factor"].alias("factor")))
