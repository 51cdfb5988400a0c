"""Queries over labels, questions, terms and evaluation; texts and labels are drawn from fixed lists by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import labels as L
from plumbline.functions import text as T
from plumbline.functions.numbers import rounded
from plumbline.functions.progress import routed
from plumbline.operators import evaluation as E
from plumbline.operators import matching as M
from plumbline.operators import quality as Q
from plumbline.operators import review as R
from plumbline.operators import schedule as S
from plumbline.plans import bindings as B
from plumbline.plans import review_queries as V
from plumbline.plans import text_queries
from plumbline.plans.history_queries import _r
from plumbline.plans.schedule_queries import NOW

LABELS = ["Piping Works", "ELEC", "e&i", " Civ. ", "Static Equipment", "SCADA panel", "Fire water", "Painting ", "pipefitting", "concrete pipe", "control_room", ""]
ASSETS = ["L24", "l-7A", "V-301", " Line 3 ", "Lx"]
HINTS = ["steel has not yet come", "crew unable to enter", "weld failed twice", "material not here", "went on", "not yet received", "cannot be done"]
QUESTIONS = ["How long does piping hydrotest take", "civil backfilling delays", "Cable tray installation in electrical", "what about Insulation", "who is late"]


def _keys(s, d):
    return B.table(s, d, "part").select(F.col("p_partkey").cast("long").alias("k"))


def _of(values, key="k"):
    return F.get(F.array(*map(F.lit, values)), F.pmod(F.col(key), F.lit(len(values))).cast("int"))


def _forms(s, d):
    raw, kind, sign = _of(LABELS), _of(ASSETS), F.lit("Tie-in #4,  Unit.B!")
    said = F.when(F.col("k") % 3 > 0, F.lit("Loop-Check "))
    expected = F.when(F.col("k") % 4 > 0, _of(["loop_check", "welding"]))
    return _keys(s, d).select(
        "k", L.discipline_alias(raw).alias("discipline"), L.asset_name(kind).alias("asset"), L.plain(sign).alias("search_form"), L.plain(sign, r"[^\w\s-]", "").alias("match_form"), L.same_label(said, expected).alias("same")
    )


def _asks(s, d):
    q = _of(QUESTIONS)
    return _keys(s, d).select("k", L.asked_discipline(q).alias("discipline"), L.asked_type(q).alias("activity_type"))


def _questions(s, d):
    text = F.when(F.col("activity_id") % 3 == 0, F.lit("done at last")).otherwise(F.col("text"))
    names = F.array(*[F.lit(x) for x in ("Erect A", "Erect B", "Erect C", "Erect D")])
    return text_queries._reports(s, d).select("activity_id", L.clarification_question(text, names).alias("question"))


def _levels(s, d):
    k = F.col("k")
    wbs = F.when(k % 11 == 0, F.lit("A.L5.1")).otherwise("A.1")
    return _keys(s, d).select("k", Q.is_work(Q.level_of(F.concat(F.lit("Level "), (k % 8).cast("string"))), wbs, k.cast("string"), k % 4, k % 13 == 0).alias("work"))


def _truth(s, d):
    k = F.col("k")
    there = lambda n, v: F.when(k % n > 0, F.lit(v))
    return _keys(s, d).select(
        (k % 10 == 0).alias("ambiguous"), (k % 17 > 0).alias("found"), F.when(k % 2 == 0, "civil").alias("expected_discipline"), there(3, "Named by its line").alias("note"), _of(["Civil", "piping", None]).alias("discipline"),
        there(4, "Line 4").alias("asset"), F.when(k % 6 > 0, "completed").otherwise("unknown").alias("status"), there(5, "2024-01-15").alias("event_date"), there(9, "welding").alias("activity_type"), there(7, "Unit 2").alias("location"),
    )


def _asked(s, d):
    """Texts without their first word ask for the texts; every tenth is taken as ambiguous."""
    b = B.table(s, d, "benchmark").select(F.col("item_id").cast("long").alias("id"), "text")
    return b, b.select((-F.col("id") - 1).alias("id"), F.regexp_replace("text", r"^\S+\s+", "").alias("text"))


def _tfidf_top(s, d, keep):
    b, q = _asked(s, d)
    t = M.tfidf(b.unionByName(q), "id", "text")
    top = M.top_by_tfidf(t.where("id < 0"), t.where("id >= 0"), keep)
    return top.select((-F.col("query") - 1).alias("query_id"), "rank", F.col("activity_id").alias("item_id"), rounded(F.col("score"), 6).alias("score"))


def _baselines(s, d):
    b, q = _asked(s, d)
    set_of = lambda t: t.select("id", F.array_distinct(F.filter(F.split(L.plain(F.col("text"), r"[^\w\s-]", ""), " "), lambda w: w != "")).alias("words"))
    exact = E.top_by_containment(set_of(q), set_of(b)).select((-F.col("query") - 1).alias("id"), F.col("activity_id").alias("predicted"), F.lit(None).cast("string").alias("decision"))
    tfidf = _tfidf_top(s, d, 1).select(F.col("query_id").alias("id"), F.col("item_id").alias("predicted"), routed(F.col("score")).alias("decision"))
    found = exact.withColumn("method", F.lit("exact")).unionByName(tfidf.withColumn("method", F.lit("tfidf")))
    every = b.select("id", F.when(F.col("id") % 10 > 0, F.col("id")).alias("expected"), F.explode(F.array(F.lit("exact"), F.lit("tfidf"))).alias("method"))
    return E.baseline_comparison(every.join(found, ["id", "method"], "left"))


def _errors(s, d):
    a = B.activities(s, d)
    k = F.col("activity_id")
    return E.error_kinds(a.select(
        _of(["Line 4 done", "V-301 up", "all set"], "activity_id").alias("text"), F.when(k % 10 > 0, k).alias("expected"), F.when(k % 7 > 0, F.when(k % 4 == 0, k).otherwise(k + 1)).alias("predicted"),
        F.col("discipline").alias("wanted"), F.when(k % 5 == 0, "BUILDING").otherwise(F.col("discipline")).alias("got"), F.when(k % 20 == 0, "auto_linked").otherwise("review").alias("decision"),
    ))


def _settled(s, d):
    c = B.claims(s, d).where("status is not null").withColumn("day", F.coalesce(F.date_format("event_date", "yyyy-MM-dd"), F.lit("undated")))
    of = c.join(S.same_day_conflicts(B.claims(s, d)).select("activity_id", "day", "conflict_id"), ["activity_id", "day"])
    return E.settled(V._tracked(s, d), of, F.col("source") == 0).select("event_id", "conflict_id", "link_state")


def _confirmed(s, d):
    c = V._tracked(s, d)
    level = F.when(F.col("event_id") % 3 == 0, "High").when(F.col("event_id") % 3 == 1, "")
    return c.select("event_id", rounded(L.confirmed(F.col("confidence")), 6).alias("confidence"), L.risk_or_low(level).alias("risk"))


def _events(s, d):
    a = text_queries._reports(s, d).select(F.concat(F.lit("o"), F.col("activity_id").cast("string")).alias("id"), F.col("day"), F.lit("report").alias("kind"))
    return a.unionByName(B.claims(s, d).select(F.concat(F.lit("e"), F.col("event_id").cast("string")).alias("id"), F.col("event_date").alias("day"), F.lit("message").alias("kind")))


def _in_order(s, d):
    return R.first_of(B.activities(s, d).select("activity_id", "planned_start"), 50, F.coalesce(F.col("planned_start").cast("string"), F.lit("")), F.col("activity_id"))


def _conflicts(s, d):
    reg = R.conflict_registry(S.same_day_conflicts(B.claims(s, d)), V._known(s, d), NOW)
    return R.first_of(reg.select("conflict_id", "severity", "detected_at"), 50, F.col("severity") != "HIGH", F.col("detected_at"), F.col("conflict_id"))


QUERIES = {
    "status_hints": lambda s, d: _keys(s, d).select("k", T.reported_status(_of(HINTS)).alias("status")),
    "label_forms": _forms,
    "question_entities": _asks,
    "clarification_questions": _questions,
    "confirmed_reports": _confirmed,
    "work_levels": _levels,
    "event_union": _events,
    "schedule_in_order": _in_order,
    "conflicts_in_order": _conflicts,
    "settled_conflicts": _settled,
    "tfidf_topk": lambda s, d: _tfidf_top(s, d, 3),
    "baseline_comparison": _baselines,
    "extraction_metrics": lambda s, d: E.extraction_metrics(_truth(s, d)),
    "error_kinds": _errors,
}


def _pick(values, key="p_partkey"):
    quoted = ", ".join("null" if v is None else "'" + v.replace("'", "''") + "'" for v in values)
    return f"[{quoted}][({key} % {len(values)} + 1)::int]"


_TFIDF = r"""b as (select item_id::bigint as id, text from benchmark), u as (select * from b union all select -id - 1, regexp_replace(text, '^\S+\s+', '') from b),
w as (select id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]{2,}') as w from u),
k as (select id, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) as token from w),
tf as (select id, token, count(*) as tf from k group by 1, 2), df as (select token, count(*) as df from tf group by 1),
x as (select id, token, tf * (ln((1 + (select count(*) from u)) / (1 + df)) + 1) as w from tf join df using (token)), n as (select id, sqrt(sum(w * w)) as norm from x group by 1),
t as (select id, token, w / norm as w from x join n using (id)), p as (select -a.id - 1 as query_id, c.id as item_id, sum(a.w * c.w) as s from t a join t c on a.id < 0 and c.id >= 0 and a.token = c.token group by 1, 2),
top as (select *, cast(row_number() over (partition by query_id order by cast(round(cast(s as decimal(38,10)), 8) as double) desc, item_id) as int) as rank from p)"""
_WORDS = r"list_distinct(list_filter(regexp_split_to_array(trim(regexp_replace(regexp_replace(lower(text), '[^\p{L}\p{M}\p{N}_\s-]', '', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x <> ''))"
_TRUTH = f"""t as (select p_partkey as k, {_pick(['civil', 'piping', None])} as d from part where p_partkey % 10 <> 0),
f as (select k % 17 > 0 and (k % 2 <> 0 or coalesce(d = 'civil', false)) as d, k % 17 > 0 and k % 4 > 0 as a, k % 17 > 0 and k % 6 > 0 as s, k % 17 > 0 and k % 5 > 0 as e, k % 17 > 0 and k % 9 > 0 as y, k % 17 > 0 and k % 7 > 0 as l, k % 4 > 0 or k % 3 = 0 as o from t)"""
_SHARE = lambda x, of=1: _r(f"({x}) / (count(*) * {of})", 3)

ORACLE = {
    "status_hints": f"select p_partkey::bigint as k, {_pick(['not_started', 'blocked', 'blocked', 'not_started', 'unknown', 'not_started', 'blocked'])} as status from part",
    "label_forms": f"""select p_partkey::bigint as k, {_pick(['piping', 'electrical', 'electrical', 'civil', 'mechanical', 'instrumentation', 'hse', 'painting', 'pipefitting', 'piping', 'control_room', None])} as discipline,
{_pick(['Line 24', 'Line 7A', 'V-301', 'Line 3', 'Lx'])} as asset, 'tie-in 4 unit.b' as search_form, 'tie-in 4 unitb' as match_form, p_partkey % 4 = 0 or (p_partkey % 3 > 0 and p_partkey % 2 = 0) as same from part""",
    "question_entities": f"select p_partkey::bigint as k, {_pick(['piping', 'civil', 'electrical', None, None])} as discipline, {_pick(['hydrotest', 'backfilling', 'cable tray installation', 'insulation', None])} as activity_type from part",
    "clarification_questions": f"""{text_queries._W} select activity_id, case when activity_id % 3 = 0 then 'Which line or equipment does ''done at last'' refer to?' when contains(text, 'Substation') then 'Which unit or area did this happen in?'
else 'Can you be more specific? Multiple activities match.' end || chr(10) || 'Possible matches:' || chr(10) || '  - Erect A' || chr(10) || '  - Erect B' || chr(10) || '  - Erect C' as question from reports""",
    "confirmed_reports": f"{V._T} select event_id, {_r('least(confidence + 0.15::double, 0.99::double)', 6)} as confidence, case when event_id % 3 = 0 then 'HIGH' else 'LOW' end as risk from tracked",
    "work_levels": "select p_partkey::bigint as k, case when p_partkey % 13 = 0 then false else p_partkey % 8 >= 5 or p_partkey % 11 = 0 or p_partkey % 4 > 0 end as work from part",
    "event_union": f"{V._W} select 'o' || o_orderkey as id, cast(o_orderdate as date) as day, 'report' as kind from orders union all select 'e' || event_id, event_date, 'message' from claims",
    "schedule_in_order": f"{V._W} select activity_id, planned_start, (select count(*) from activities) as total from activities order by planned_start nulls first, activity_id limit 50",
    "conflicts_in_order": V.ORACLE["conflict_registry"].replace("\nselect coalesce", ", registry as (select coalesce") + ") select conflict_id, severity, detected_at, (select count(*) from registry) as total from registry order by severity <> 'HIGH', detected_at, conflict_id limit 50",
    "settled_conflicts": f"""{V._T}, {V._SAME}, x as (select event_id, conflict_id from claims c join found f on c.status is not null and f.conflict_id = 'CFL-' || c.activity_id || '-' || coalesce(strftime(c.event_date, '%Y-%m-%d'), 'undated'))
select event_id, conflict_id, case when conflict_id is null then link_state when source = 0 then 'approved' else 'superseded' end as link_state from tracked left join x using (event_id)""",
    "tfidf_topk": f"with {_TFIDF} select query_id, rank, item_id, {_r('s', 6)} as score from top where rank <= 3",
    "baseline_comparison": f"""with {_TFIDF}, ws as (select id, {_WORDS} as ws from u), we as (select id, unnest(ws) as w, len(ws) as n from ws),
eh as (select -a.id - 1 as id, c.id as item_id, count(*) / first(c.n) as s from we a join we c on a.id < 0 and c.id >= 0 and a.w = c.w group by 1, 2), e1 as (select id, item_id from eh qualify row_number() over (partition by id order by round(s, 8) desc, item_id) = 1),
m as (select 'exact' as method, b.id, e1.item_id as predicted, true as noticed from b left join e1 using (id) union all select 'tfidf', b.id, top.item_id, coalesce({_r('s', 6)} < 0.65, true) from b left join top on top.query_id = b.id and rank = 1),
g as (select method, case when id % 10 = 0 then noticed else coalesce(predicted = id, false) end as ok from m) select method, count_if(ok) as correct, count_if(not ok) as wrong, count(*) as total, {_r('count_if(ok) * 100 / count(*)', 1)} as accuracy from g group by 1""",
    "extraction_metrics": f"""with {_TRUTH} select count(*) as total_events, {_SHARE('count_if(d)')} as discipline_accuracy, {_SHARE('count_if(a)')} as asset_accuracy, {_SHARE('count_if(s)')} as status_accuracy, {_SHARE('count_if(e)')} as event_date_accuracy,
{_SHARE('count_if(y)')} as activity_type_accuracy, {_SHARE('count_if(l)')} as location_accuracy, {_SHARE('count_if(d) + count_if(a) + count_if(s) + count_if(e) + count_if(y) + count_if(l)', 6)} as overall_field_accuracy, {_SHARE('count_if(d and s and o)')} as event_level_accuracy from f""",
    "error_kinds": f"""{V._W}, m as (select activity_id as k, discipline, {_pick(['Line', 'V-', None], 'activity_id')} as tag, case when activity_id % 7 > 0 then case when activity_id % 4 = 0 then activity_id else activity_id + 1 end end as p from activities),
e as (select case when k % 10 = 0 then case when k % 20 = 0 then 'ambiguity_not_detected' end when p = k then null when k % 5 = 0 and discipline <> 'BUILDING' then 'discipline_confusion' when tag is not null then 'identifier_miss' else 'other' end as kind from m)
select kind, count(*) as n from e where kind is not null group by 1""",
}
