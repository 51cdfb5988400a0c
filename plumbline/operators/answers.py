"""Questions about history: which canned query each asks for, what that answers, and a line that says it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions import labels as L
from plumbline.functions.numbers import ratio, rounded
from plumbline.operators import history as H

# Patterns of a question, in order, and the query it asks for; any other question is a search.
INTENTS = [
    (r"\b(cause|causes|why|reason|what.+delay)\b", "delay_causes"),
    (r"\b(how long|duration|take|typical|average time|days)\b", "duration_stats"),
    (r"\b(worst|most delay|high.+delay|discipline.*delay|delay.*discipline)\b", "discipline_risk"),
    (r"\b(similar|like|resembl|comparable|find.+historical|show.+histor)\b", "similar_activities"),
    (r"\b(exceed|over.+baseline|longer than planned|baseline)\b", "baseline_exceedance"),
    (r"\b(risk|probability|chance.*delay|likely.*delay)\b", "risk_profile"),
    (r"\b(productivity|rate|spools.+day|crew|output)\b", "productivity"),
]
FREE = ("discipline_risk", "baseline_exceedance")  # asked of all history, whatever the question names


def intent(question: Column) -> Column:
    """The query that a question asks for: the first pattern that fits, else generic_search."""
    out = F.lit("generic_search")
    for pattern, name in reversed(INTENTS):
        out = F.when(F.lower(question).rlike(pattern), name).otherwise(out)
    return out


def grains(history: DataFrame) -> DataFrame:
    """history once for each of discipline and type, discipline, type and all that it counts for (d, t; null: any)."""
    d, t, null = F.lower("discipline"), F.lower("activity_type"), F.lit(None).cast("string")
    each = F.array(*[F.struct(a.alias("d"), b.alias("t")) for a in (d, null) for b in (t, null)])
    return history.withColumn("g", F.explode(F.array_distinct(each))).withColumns({"d": F.col("g.d"), "t": F.col("g.t")}).drop("g")


def answered(questions: DataFrame, history: DataFrame, least: float = 2, disciplines: list[str] | None = None, types: list[str] | None = None) -> DataFrame:
    """(question_id, intent, discipline, activity_type, summary) of questions(question_id, question) over history.

    The names that a question can have are those of functions.labels, or the given ones; a risk without a type is that of
    erection. Each canned query is made once for every grain that questions ask for, and questions meet the rows by grain,
    so that neither their number nor a hot grain repeats any work. Summaries say the top row, ties by name; a search has
    none of its own. Without history a summary says that there is nothing.
    """
    low = F.lower("question")
    named = lambda names: F.coalesce(*[F.when(F.contains(low, F.lit(n)), n) for n in names])
    q = questions.select(
        "question_id", intent(F.col("question")).alias("intent"), (named(disciplines) if disciplines else L.asked_discipline(F.col("question"))).alias("discipline"),
        (named(sorted(types, key=lambda x: (-len(x), x))) if types else L.asked_type(F.col("question"))).alias("activity_type"),
    )
    q = q.withColumn("activity_type", F.when(F.col("intent") == "risk_profile", F.coalesce("activity_type", F.lit("erection"))).otherwise(F.col("activity_type")))
    free = F.col("intent").isin(*FREE)
    q = q.withColumns({"d": F.when(~free & F.col("intent").isin("delay_causes", "duration_stats", "risk_profile", "productivity"), F.col("discipline")), "t": F.when(F.col("intent").isin("duration_stats", "risk_profile", "productivity"), F.col("activity_type"))})
    g = grains(history)
    percent = lambda c: F.format_number(c * 100, 0)
    late = g.where("delayed")
    c = late.where(F.col("delay_cause").isNotNull()).groupBy("d", "t", "delay_cause").agg(F.count("*").alias("n"))
    c = c.groupBy("d", "t").agg(F.min_by(F.struct("delay_cause", "n"), F.struct((-F.col("n")).alias("n"), "delay_cause")).alias("top"))
    total = late.groupBy("d", "t").agg(F.count("*").alias("total"))
    c = c.alias("c").join(total.alias("l"), F.col("c.d").eqNullSafe(F.col("l.d")) & F.col("c.t").eqNullSafe(F.col("l.t"))).select("c.d", "c.t", "top", "total")
    causes = c.select(F.lit("delay_causes").alias("of"), "d", "t", F.concat(F.lit("top cause of delay: "), "top.delay_cause", F.lit(", "), percent(rounded(ratio(F.col("top.n"), F.col("total")), 3)), F.lit(" %")).alias("said"))
    s = H.delay_stats(g.withColumnsRenamed({"discipline": "gd", "activity_type": "gt"}), "d", "t", "gd", "gt")
    first = s.groupBy("d", "t").agg(F.min_by(F.struct("gd", "gt", "mean_planned", "mean_actual", "delay_frequency"), F.struct("gd", "gt")).alias("r"))
    days = lambda x: F.format_number(x, 2)
    durations = first.select(F.lit("duration_stats").alias("of"), "d", "t", F.concat("r.gd", F.lit(" "), "r.gt", F.lit(": planned "), days(F.col("r.mean_planned")), F.lit(", actual "), days(F.col("r.mean_actual")), F.lit(", delayed "), percent(F.col("r.delay_frequency")), F.lit(" %")).alias("said"))
    profile = H.risk_profile(g, "d", "t").select(F.lit("risk_profile").alias("of"), "d", "t", F.concat(F.lit("risk "), "risk_level", F.lit(", delayed "), percent(F.col("delay_frequency")), F.lit(" %, buffer "), F.col("buffer").cast("string")).alias("said"))
    rates = g.groupBy("d", "t").agg(rounded(F.avg("productivity"), 3).alias("r")).where("r is not null").select(F.lit("productivity").alias("of"), "d", "t", F.concat(F.lit("mean rate "), F.format_number("r", 3)).alias("said"))
    null = F.lit(None).cast("string")
    worst = H.delay_stats(history, "discipline").agg(F.min_by(F.struct("discipline", "delay_frequency"), F.struct((-F.col("delay_frequency")).alias("f"), "discipline")).alias("r")).where("r is not null")
    risks = worst.select(F.lit("discipline_risk").alias("of"), null.alias("d"), null.alias("t"), F.concat(F.lit("most often delayed: "), "r.discipline", F.lit(", "), percent(F.col("r.delay_frequency")), F.lit(" %")).alias("said"))
    over = H.over_baseline(history, least).agg(F.min_by(F.struct("discipline", "activity_type", "mean_variance"), F.struct((-F.col("mean_variance")).alias("v"), "discipline", "activity_type")).alias("r")).where("r is not null")
    beyond = over.select(F.lit("baseline_exceedance").alias("of"), null.alias("d"), null.alias("t"), F.concat(F.lit("most over plan: "), "r.discipline", F.lit(" "), "r.activity_type", F.lit(", "), days(F.col("r.mean_variance")), F.lit(" days")).alias("said"))
    rows = causes.unionByName(durations).unionByName(profile).unionByName(rates).unionByName(risks).unionByName(beyond)
    a, b = q.alias("q"), rows.alias("r")
    met = a.join(b, (F.col("q.intent") == F.col("r.of")) & F.col("q.d").eqNullSafe(F.col("r.d")) & F.col("q.t").eqNullSafe(F.col("r.t")), "left")
    none = F.when(F.col("intent").isin("similar_activities", "generic_search"), "asks for a search").otherwise("nothing is known of this")
    return met.select("question_id", "intent", "discipline", "activity_type", F.coalesce("said", none).alias("summary"))


def all_five(history: DataFrame, least: float = 2, causes: int = 5) -> DataFrame:
    """(query, discipline, activity_type, cause, n, value) of the five canned queries in one table: mean actual days by type,
    how often disciplines are late, the most common causes and their share, types over plan and by how much, risk by type."""
    null = lambda c: F.lit(None).cast("string").alias(c)
    d, t = F.col("discipline"), F.col("activity_type")
    parts = [
        H.duration_by_type(history).select(F.lit("duration_by_type").alias("query"), d, t, null("cause"), "n", F.col("mean_actual").alias("value")),
        H.delay_stats(history, "discipline").select(F.lit("delay_by_discipline").alias("query"), d, null("activity_type"), null("cause"), "n", F.col("delay_frequency").alias("value")),
        H.top_causes(history, causes).select(F.lit("common_causes").alias("query"), null("discipline"), null("activity_type"), F.col("delay_cause").alias("cause"), "n", F.col("frequency").alias("value")),
        H.over_baseline(history, least).select(F.lit("over_baseline").alias("query"), d, t, null("cause"), "n", F.col("mean_variance").alias("value")),
        H.risk_profile(history, "discipline", "activity_type").select(F.lit("risk_profile").alias("query"), d, t, F.col("risk_level").alias("cause"), "n", F.col("delay_frequency").alias("value")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def with_quality(history: DataFrame, marks: DataFrame) -> DataFrame:
    """history(record_id, record_quality, ...) with the quality that marks(record_id, quality, seq) say last; marks of no
    record change nothing, and a lookup of one record is a filter on record_id, which reaches the scan."""
    last = marks.groupBy("record_id").agg(F.max_by("quality", "seq").alias("__q"))
    return history.join(last, "record_id", "left").withColumn("record_quality", F.coalesce("__q", "record_quality")).drop("__q")


def parse_result(activities: DataFrame, found: DataFrame) -> DataFrame:
    """What a parse of files came to, by source_file: activities, errors, warnings, valid (no error). found: issues with source_file."""
    a = activities.groupBy("source_file").agg(F.count("*").alias("activities"))
    n = lambda s: F.count_if(F.col("severity") == s)
    i = found.groupBy("source_file").agg(n("ERROR").alias("errors"), n("WARNING").alias("warnings"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    out = a.join(i, "source_file", "left").select("source_file", "activities", zero("errors"), zero("warnings"))
    return out.withColumn("valid", F.col("errors") == 0)
