"""Matching reports to planned activities in two stages, the index of terms that it stands on, and what is asked back.

The first stage finds the ten activities of highest term weight, by a join of terms that reports and activities share; the
second weighs context on these ten alone, keeps the three best and decides. Every signal is kept with the candidate, so
that a decision explains itself. Activities may be added while matching goes on: the index keeps the counts of terms and
what every addition changed in the numbers that weights are made of, so that nothing is read again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.functions.numbers import rounded
from plumbline.functions.progress import AUTO, REVIEW, routed
from plumbline.operators.matching import temporal_fit, terms
from plumbline.operators.review import feedback_boost
from plumbline.operators.scan import scratch

FIRST, LAST = 10, 3  # candidates that are weighed, and kept
DEALT = 5_000  # texts whose terms a task holds, about

# What a signal adds to the score, and the lead under which a vague report is asked back.
BOOSTS = {"identifier": 0.20, "discipline": 0.15, "location": 0.10, "wbs": 0.05}
CLOSE = 0.08
FIELD_OPTIONS = {"discipline": ["piping", "electrical", "civil", "instrumentation", "mechanical"], "status": ["started", "in_progress", "completed"]}


# ---- the index of terms ----------------------------------------------------------------------------------------


@dataclass
class TermIndex:
    """counts: (id, token, tf, version); ids: (id, version); frequencies: (token, df, version), what each version added;
    texts that were replaced take their share off. A version is the number of an addition."""

    counts: DataFrame
    ids: DataFrame
    frequencies: DataFrame
    version: int

    def live(self) -> DataFrame:
        """(id, token, tf) of the last version of each id."""
        last = self.ids.groupBy("id").agg(F.max("version").alias("version"))
        return self.counts.join(last, ["id", "version"], "left_semi").select("id", "token", "tf")

    def document_frequencies(self) -> DataFrame:
        """(token, df): the sum over versions, tokens that are gone left out."""
        return self.frequencies.groupBy("token").agg(F.sum("df").alias("df")).where("df > 0")

    def weights(self) -> DataFrame:
        """(id, token, weight): smooth idf ln((1 + n) / (1 + df)) + 1, each text of length 1."""
        n = self.ids.select("id").distinct().count()
        w = self.live().join(self.document_frequencies(), "token").withColumn("w", F.col("tf") * (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1))
        norm = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
        return w.join(norm, "id").select("id", "token", (F.col("w") / F.col("norm")).alias("weight"))

    def asked(self, texts: DataFrame) -> DataFrame:
        """(query, token, qw) of texts(query, text): terms that the index lacks count for nothing.

        Texts are dealt by query once; their terms stay where the text is and meet the stored frequencies there, which
        Spark sends to all tasks as long as they are small."""
        n = self.ids.select("id").distinct().count()
        idf = scratch(self.document_frequencies().select("token", (F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1).alias("idf")), "term-idf")
        dealt = texts.repartition(max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-texts.count() // DEALT)), "query")
        known = dealt.select("query", F.explode(terms(F.col("text"))).alias("token")).join(idf, "token")
        w = known.groupBy("query", "token").agg((F.count("*") * F.first("idf")).alias("w"))
        norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("query")))
        return w.select("query", "token", (F.col("w") / norm).alias("qw"))

    def add(self, texts: DataFrame) -> TermIndex:
        """The index with texts(id, text) added in a new version; an id that is there already is replaced.

        Only the new texts are read. Texts of an id that repeats within an addition count once, the least of them."""
        v = self.version + 1
        new = scratch(_counted(texts).withColumn("version", F.lit(v)), "term-counts")
        ids = scratch(texts.select("id").distinct().withColumn("version", F.lit(v)), "term-ids")
        gone = self.live().join(ids.select("id"), "id", "left_semi").groupBy("token").agg((-F.count("*")).alias("df"))
        moved = new.groupBy("token").agg(F.count("*").alias("df")).unionByName(gone).groupBy("token").agg(F.sum("df").alias("df")).where("df <> 0")
        moved = scratch(moved.withColumn("version", F.lit(v)), "term-frequencies")
        return TermIndex(self.counts.unionByName(new), self.ids.unionByName(ids), self.frequencies.unionByName(moved), v)


def _counted(texts: DataFrame) -> DataFrame:
    one = texts.groupBy("id").agg(F.min("text").alias("text"))
    return one.select("id", F.explode(terms(F.col("text"))).alias("token")).groupBy("id", "token").agg(F.count("*").alias("tf"))


def term_index(texts: DataFrame) -> TermIndex:
    """The index of texts(id, text), in version 0."""
    counts = scratch(_counted(texts).withColumn("version", F.lit(0)), "term-counts")
    ids = scratch(texts.select("id").distinct().withColumn("version", F.lit(0)), "term-ids")
    freq = scratch(counts.groupBy("token").agg(F.count("*").alias("df")).withColumn("version", F.lit(0)), "term-frequencies")
    return TermIndex(counts, ids, freq, 0)


def activity_text(a: str = "") -> Column:
    """Name, discipline, location and WBS id of an activity, those that are there."""
    return F.concat_ws(" ", *[F.nullif(F.col(a + c), F.lit("")) for c in ("activity_name", "discipline", "location", "wbs_id")])


# ---- matching --------------------------------------------------------------------------------------------------


def coalesced_events(raw: DataFrame) -> DataFrame:
    """Reports of whatever shape under one set of names: the text is raw_text, else description, else event_text, blank ones
    passed over; the day event_date, else date; the source source_id, else source; the status status, else status_hint."""
    have = lambda *names: F.coalesce(*[F.nullif(F.col(n).cast("string"), F.lit("")) for n in names if n in raw.columns], F.lit(None).cast("string"))
    return raw.select(
        F.coalesce(have("event_id"), F.lit("unknown")).alias("event_id"), F.coalesce(have("raw_text", "description", "event_text"), F.lit("")).alias("event_text"),
        have("discipline").alias("discipline"), have("location").alias("location"), F.try_to_date(F.substring(have("event_date", "date"), 1, 10), "yyyy-MM-dd").alias("event_date"),
        F.coalesce(have("source_id", "source"), F.lit("unknown")).alias("source"), F.coalesce(have("status", "status_hint"), F.lit("unknown")).alias("status_hint"),
    )


def first_stage(events: DataFrame, index: TermIndex, activities: DataFrame, keep: int = FIRST) -> DataFrame:
    """(event_id, activity_id, semantic, place): the `keep` activities of highest term weight, ties of eight digits by id.

    A report that shares terms with fewer has others of no weight after them, in the order of ids, as many as there are."""
    q = index.asked(events.select(F.col("event_id").alias("query"), F.col("event_text").alias("text")))
    weights = scratch(index.weights(), "term-weights")
    near = q.join(weights, "token").groupBy(F.col("query").alias("event_id"), F.col("id").alias("activity_id")).agg(F.sum(F.col("qw") * F.col("weight")).alias("semantic"))
    order = Window.partitionBy("event_id").orderBy(F.desc(rounded(F.col("semantic"), 8)), "activity_id")
    near = scratch(near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep), "first-stage")
    held = near.groupBy("event_id").agg(F.collect_set("activity_id").alias("held"))
    pool = [r[0] for r in activities.select("activity_id").distinct().orderBy("activity_id").limit(2 * keep).collect()]  # 2 * keep ids
    kind = dict(activities.dtypes)["activity_id"]
    short = events.select("event_id").join(held, "event_id", "left").withColumn("held", F.coalesce("held", F.array().cast(f"array<{kind}>"))).where(F.size("held") < keep)
    ids = F.array(*[F.lit(p) for p in pool]).cast(f"array<{kind}>")
    rest = F.slice(F.filter(ids, lambda x: ~F.array_contains(F.col("held"), x)), F.lit(1), F.lit(keep) - F.size("held"))
    more = short.select("event_id", F.posexplode(rest).alias("k", "activity_id"), F.size("held").alias("n"))
    return near.unionByName(more.select("event_id", "activity_id", F.lit(0.0).alias("semantic"), (F.col("n") + F.col("k") + 1).cast("int").alias("place")))


def dependency_counts(activities: DataFrame, completed: DataFrame) -> DataFrame:
    """(activity_id, listed, done): predecessors that an activity lists, and those of them in completed(activity_id)."""
    flat = activities.select("activity_id", F.explode_outer(F.array_distinct("predecessors")).alias("p"))
    done = completed.select(F.col("activity_id").alias("p")).distinct().withColumn("is_done", F.lit(1))
    return flat.join(done, "p", "left").groupBy("activity_id").agg(F.count("p").alias("listed"), F.count("is_done").alias("done"))


def signals(e: str = "e_", a: str = "a_") -> dict[str, Column]:
    """What each signal adds for a report (columns e_) and an activity (columns a_); 0 where it says nothing."""
    yes = lambda test, x: F.when(F.coalesce(test, F.lit(False)), x).otherwise(0.0)
    found = F.col(f"{e}identifiers")
    tags = F.filter(found, lambda x: x.rlike(r"^[A-Za-z]+-\d+$"))
    lead = lambda x: F.upper(F.substr(F.regexp_extract(x, "^([A-Za-z]+)", 1), F.lit(1), F.lit(3)))
    there = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    listed, done = F.coalesce(f"{a}listed", F.lit(0)), F.coalesce(f"{a}done", F.lit(0))
    return {
        "identifier": yes(F.exists(found, lambda x: F.contains(F.upper(F.col(f"{a}activity_name")), F.upper(x))), BOOSTS["identifier"]),
        "discipline": yes(there(f"{e}discipline") & (F.lower(f"{e}discipline") == F.lower(f"{a}discipline")), BOOSTS["discipline"]),
        "location": yes(there(f"{e}location") & F.contains(F.lower(f"{a}location"), F.lower(f"{e}location")), BOOSTS["location"]),
        "wbs": yes(there(f"{a}wbs_id") & F.exists(tags, lambda x: F.startswith(F.upper(F.col(f"{a}wbs_id")), lead(x))), BOOSTS["wbs"]),
        "temporal": F.coalesce(temporal_fit(F.col(f"{e}event_date"), F.col(f"{a}planned_start"), F.col(f"{a}planned_finish")), F.lit(0.0)),
        "dependency": F.when(listed == 0, 0.03).when(done == listed, 0.05).when(done > 0, 0.02).otherwise(0.0),
    }


def hybrid_match(events: DataFrame, activities: DataFrame, completed: DataFrame, index: TermIndex | None = None, feedback: DataFrame | None = None, auto: float = AUTO, review: float = REVIEW) -> DataFrame:
    """One row for each report: event_id, activity_id, confidence, decision, question, candidates (the LAST best with their
    scores and evidence), lead (null with one candidate).

    events: as coalesced_events() gives them, event_id unique. activities: activity_id, activity_name, discipline, location,
    wbs_id, planned_start, planned_finish, predecessors; completed: activity_id. A score is the term weight and all signals,
    1 at most; ties of eight digits go to the place in the first stage. A vague report without an identifier whose two best
    are closer than CLOSE gets a question and no activity. Without activities there are no rows.

    Reports are stored once and their texts dealt once, for the first stage; behind it texts go along only where a question
    or feedback needs them.
    """
    events = scratch(events, "reports")
    if index is None:
        index = term_index(activities.select(F.col("activity_id").alias("id"), activity_text().alias("text")))
    near = first_stage(events, index, activities)
    found = T.identifiers(F.col("event_text"))
    vague = T.is_vague(F.col("event_text")) & (F.size(found) == 0)
    e = events.select(
        "event_id", *[F.col(c).alias(f"e_{c}") for c in ("discipline", "location", "event_date")], found.alias("e_identifiers"), vague.alias("e_vague"),
        (F.when(vague, F.col("event_text")) if feedback is None else F.col("event_text")).alias("e_event_text"),
    )
    a = activities.join(dependency_counts(activities, completed), "activity_id", "left")
    a = a.select("activity_id", *[F.col(c).alias(f"a_{c}") for c in ("activity_name", "discipline", "location", "wbs_id", "planned_start", "planned_finish", "listed", "done")])
    met = near.join(a, "activity_id").join(e, "event_id")
    said = signals()
    if feedback is not None:
        b = feedback_boost(met.select("event_id", "activity_id", F.col("e_event_text").alias("text")), feedback).select("event_id", "activity_id", "boost")
        met = met.join(b, ["event_id", "activity_id"], "left")
        said["feedback"] = F.coalesce("boost", F.lit(0.0))
    shown = F.array(
        F.struct(F.lit("semantic_similarity").alias("signal"), F.lit(True).alias("matched"), F.col("semantic").alias("boost")),
        *[F.struct(F.lit(k).alias("signal"), (c > 0).alias("matched"), c.cast("double").alias("boost")) for k, c in said.items()],
    )
    met = met.withColumn("evidence", shown).withColumn("score", F.least(F.aggregate("evidence", F.lit(0.0), lambda s, x: s + x["boost"]), F.lit(1.0)))
    best = Window.partitionBy("event_id").orderBy(F.desc(rounded(F.col("score"), 8)), "place")
    top = met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= LAST)
    row = F.struct("rank", "activity_id", F.col("a_activity_name").alias("name"), rounded(F.col("score"), 3).alias("score"), "evidence")
    out = top.groupBy("event_id").agg(F.array_sort(F.collect_list(row)).alias("candidates"), F.max("score").alias("s"), F.max(F.when(F.col("rank") == 2, F.col("score"))).alias("second"), F.first("e_vague").alias("vague"), F.first("e_event_text").alias("event_text"))
    text = F.col("event_text")
    unclear = F.col("vague") & F.coalesce(F.col("s") - F.col("second") < CLOSE, F.lit(False))
    names = F.transform("candidates", lambda c: c["name"])
    return out.select(
        "event_id", F.when(~unclear, F.get("candidates", F.lit(0))["activity_id"]).alias("activity_id"), rounded(F.col("s"), 3).alias("confidence"),
        F.when(unclear, "clarification_needed").otherwise(routed(F.col("s"), auto, review)).alias("decision"), F.when(unclear, asked_back(text, names)).alias("question"), "candidates",
        (F.col("s") - F.col("second")).alias("lead"),
    )


def asked_back(text: Column, names: Column) -> Column:
    """A question over the names of the best candidates: for line or equipment, else for unit or area, else for more."""
    asset, line, place = text.rlike(r"(?i)\b[A-Z]+-\d+\b"), text.rlike(r"(?i)\bline\b"), text.rlike(r"(?i)\bunit\b|\barea\b")
    ask = F.when(~asset & ~line, F.concat(F.lit("Line or equipment of '"), text, F.lit("'?"))).when(~place, F.lit("Unit or area of this work?")).otherwise(F.lit("Which of these activities?"))
    return F.concat_ws("\n- ", ask, names)


def links(matches: DataFrame, events: DataFrame) -> DataFrame:
    """Rows of the table of links for reports that were linked without review: event_id, activity_id, confidence, status_hint."""
    return matches.where("decision = 'auto_linked'").join(events.select("event_id", "status_hint"), "event_id").select("event_id", "activity_id", "confidence", "status_hint")


def link_lookup(link_rows: DataFrame, by: str, **equal) -> DataFrame:
    """The links of an event or activity, or all of them, gathered by `by`: (by, links) in the order of confidence."""
    for k, v in equal.items():
        link_rows = link_rows.where(F.col(k) == v)
    other = "activity_id" if by == "event_id" else "event_id"
    return link_rows.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), other))), lambda x: x[other]).alias("links"))


def public_events(tracked: DataFrame, activities: DataFrame) -> DataFrame:
    """Reports as lists show them: of a rejected or superseded one the proposal is no link, but stays as proposed_activity_id.

    tracked: event_id, link_state, linked_activity_id, matched_activity_id, confidence and more, which are kept."""
    against = F.coalesce(F.col("link_state").isin("rejected", "superseded"), F.lit(False))
    names = activities.select(F.col("activity_id").alias("__a"), F.col("activity_name").alias("matched_activity_name")).dropDuplicates(["__a"])
    out = tracked.withColumnRenamed("matched_activity_id", "proposed_activity_id").withColumn("matched_activity_id", F.coalesce("linked_activity_id", F.when(~against, F.col("proposed_activity_id"))))
    return out.join(names, F.col("matched_activity_id") == F.col("__a"), "left").drop("__a", "linked_activity_id")


# ---- questions and their options -------------------------------------------------------------------------------


def option_candidates(events: DataFrame, activities: DataFrame, keep: int = 5) -> DataFrame:
    """(event_id, activity_id, place, fitting): the first activities, by id, that fit a report's discipline, location and
    type, where it has them; where none fits, the first of all.

    Disciplines are equal, a location lies in the activity's, a type in its name, regardless of case. Reports that ask alike
    meet activities once, by discipline, and each of these is one row with `keep` ids, so that neither many reports nor a
    hot discipline makes more pairs than distinct questions times their activities."""
    low = lambda c: F.nullif(F.lower(c), F.lit(""))
    e = events.select("event_id", low("discipline").alias("d"), low("location").alias("l"), low("activity_type").alias("t"))
    asks = scratch(e.select("d", "l", "t").distinct(), "asked")
    a = activities.select("activity_id", F.lower("discipline").alias("ad"), F.lower("location").alias("al"), F.lower("activity_name").alias("an"))
    fits = (F.col("l").isNull() | F.contains("al", F.col("l"))) & (F.col("t").isNull() | F.contains("an", F.col("t")))
    least = F.array_sort(F.collect_list("activity_id"))  # `keep` ids
    part = F.pmod(F.xxhash64("activity_id"), F.lit(256))
    named = asks.where("d is not null").join(a, F.col("d") == F.col("ad")).where(fits)
    # questions without a discipline are a set of locations and types, asked of all activities slice by slice
    every = asks.where("d is null").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(255)))).join(a.withColumn("part", part), "part").where(fits)
    met = named.select("d", "l", "t", "activity_id").unionByName(every.select("d", "l", "t", "activity_id"))
    rank = F.row_number().over(Window.partitionBy("d", "l", "t").orderBy("activity_id"))
    firsts = met.withColumn("r", rank).where(F.col("r") <= keep).groupBy("d", "l", "t").agg(least.alias("ids"))
    all_ids = [r[0] for r in activities.select("activity_id").orderBy("activity_id").limit(keep).collect()]  # `keep` ids
    kind = dict(activities.dtypes)["activity_id"]
    same = lambda x, y: x["d"].eqNullSafe(y["d"]) & x["l"].eqNullSafe(y["l"]) & x["t"].eqNullSafe(y["t"])
    out = e.join(firsts, same(e, firsts), "left").select(e["event_id"], "ids")
    ids = F.coalesce("ids", F.array(*[F.lit(i) for i in all_ids]).cast(f"array<{kind}>"))
    return out.select("event_id", F.col("ids").isNotNull().alias("fitting"), F.posexplode(ids).alias("place", "activity_id")).select("event_id", "activity_id", (F.col("place") + 1).alias("place"), "fitting")


def clarification_options(events: DataFrame, activities: DataFrame, keep: int = 5) -> DataFrame:
    """(event_id, field, options) of events(event_id, missing, discipline, location, activity_type): the field that is asked
    for first (asset, discipline, status, location, else detail) and what may be chosen.

    For an asset the options are activities, "id — name", fitting ones or else the first; for discipline and status fixed
    values; else none. Events that miss nothing are left out."""
    order = ["asset", "discipline", "status", "location"]
    field = F.lit("detail")
    for f in reversed(order):
        field = F.when(F.array_contains("missing", f), f).otherwise(field)
    ask = events.where(F.size("missing") > 0).withColumn("field", field)
    names = activities.select("activity_id", F.concat_ws(" — ", F.col("activity_id").cast("string"), F.coalesce("activity_name", F.lit("?"))).alias("option"))
    c = option_candidates(ask.where("field = 'asset'"), activities, keep).join(names, "activity_id")
    shown = c.groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "option"))), lambda x: x["option"]).alias("found"))
    fixed = F.lit(None).cast("array<string>")
    for f, values in FIELD_OPTIONS.items():
        fixed = F.when(F.col("field") == f, F.array(*map(F.lit, values))).otherwise(fixed)
    return ask.join(shown, "event_id", "left").select("event_id", "field", F.coalesce("found", fixed).alias("options"))
