"""Queries over tracked reports: lists, audit, registry, evaluation, duplicates, policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.numbers import containment, rounded
from plumbline.functions.progress import routed
from plumbline.operators import history as H
from plumbline.operators import matching as M
from plumbline.operators import review as R
from plumbline.operators import schedule as S
from plumbline.plans import bindings as B
from plumbline.plans import text_queries
from plumbline.plans.history_queries import _r
from plumbline.plans.schedule_queries import NOW, WEIGHTS

DAY = "2024-01-15 00:00:00"  # when the known conflicts were detected


def _tracked(s, d):
    """Claims with the discipline of their activity and where their confidence sends them."""
    a = B.activities(s, d).select("activity_id", "discipline")
    conf = rounded(F.least(F.col("value") / 300, F.lit(1.0)), 6)
    return B.claims(s, d).join(a, "activity_id", "left").withColumn("confidence", conf).withColumn("link_state", routed(F.col("confidence")))


def _known(s, d):
    old = S.same_day_conflicts(B.claims(s, d)).where("activity_id % 3 = 0")
    old = old.select("conflict_id", "activity_id", F.lit("MEDIUM").alias("severity"), F.lit(DAY).cast("timestamp").alias("detected_at"), (F.col("activity_id") % 2 == 0).alias("resolved"))
    gone = s.range(1).select(F.lit("CFL-gone").alias("conflict_id"), F.lit(-1).cast("long").alias("activity_id"), F.lit("HIGH").alias("severity"), F.lit(DAY).cast("timestamp").alias("detected_at"), F.lit(False).alias("resolved"))
    return old.unionByName(gone)


def _risks(s, d):
    h = B.history(s, d)
    kinds = B.table(s, d, "part").select(F.col("p_partkey").cast("long").alias("activity_id"), F.col("p_type").alias("discipline"), F.col("p_brand").alias("activity_type"))
    return H.assess(kinds, h)


def _evidence(s, d):
    k = F.col("p_partkey")
    one = lambda name, test, boost: F.struct(F.lit(name).alias("signal"), test.alias("matched"), boost.cast("double").alias("boost"))
    sem = F.col("p_size") / 64
    e = F.array(one("identifier", k % 2 == 0, F.lit(0.20)), one("discipline", k % 3 == 0, F.lit(0.15)), one("location", k % 5 == 0, F.lit(0.10)), one("semantic_similarity", sem > 0.3, sem))
    return B.table(s, d, "part").select(k.alias("k"), R.explained(e).alias("x")).select("k", "x.*")


def _accuracy(s, d):
    v = text_queries._vectors(s, d).select("id", "label")
    t = text_queries._top(s, d, 1).select("query_id", "item_id", rounded(F.col("score"), 6).alias("score"))
    a, b = v.select(F.col("id").alias("query_id"), F.col("label").alias("x")), v.select(F.col("id").alias("item_id"), F.col("label").alias("predicted"))
    n = F.expr("query_id div 20")
    level = F.get(F.array(*map(F.lit, ["easy", "medium", "hard", "very_hard"])), (n % 4).cast("int"))
    return R.match_accuracy(t.join(a, "query_id").join(b, "item_id").select(level.alias("difficulty"), F.when(n % 5 != 0, F.col("x")).alias("expected"), "predicted", routed(F.col("score")).alias("decision")))


def _overlap(s, d):
    truth = B.table(s, d, "benchmark").select(F.col("item_id").alias("id"), "text")
    said = B.table(s, d, "conversations").select(F.struct("conv_id", "turn").alias("id"), "text")
    return R.best_overlap(truth, said).select("truth_id", "event_id.conv_id", "event_id.turn", "overlap")


def _containment(s, d):
    w = text_queries._reports(s, d).select("activity_id", M.words(F.col("text")).alias("ws"))
    asked = F.split(F.lit("hydrotest of line 7 was completed in unit 3"), " ")
    return w.select("activity_id", rounded(containment(asked, F.col("ws")), 6).alias("score"))


def _duplicates(s, d):
    c = B.claims(s, d)
    tag = F.concat(F.lit("V-"), F.col("activity_id").cast("string"))
    text = F.concat(tag, F.lit(" "), F.col("stage"), F.lit(", source "), F.col("source").cast("string"))
    e = c.select(F.col("event_id").alias("id"), text.alias("text"), F.when(F.col("event_id") % 4 != 0, tag).alias("asset"), F.col("stage").alias("activity_type"), F.date_trunc("hour", "ts").alias("event_date"), F.lit("civil").alias("discipline"), "status")
    return R.weighted_duplicates(e)


def _feedback(s, d):
    r = text_queries._reports(s, d)
    a = r.select(F.col("activity_id").alias("event_id"), (F.col("activity_id") % 50).alias("activity_id"), "text")
    f = r.where("activity_id < 200").select((F.col("activity_id") % 50).alias("activity_id"), "text", (F.col("activity_id") % 3 > 0).alias("approved"))  # a labelled set
    return R.feedback_boost(a, f).select("event_id", "activity_id", "boost")


def _features(s, d):
    t = _tracked(s, d)
    risk = F.when(F.col("status") == "ON_HOLD", "HIGH").when(F.col("status") == "IN_PROGRESS", "MEDIUM").otherwise("LOW")
    text = F.concat(F.lit("Line "), F.col("activity_id").cast("string"), F.lit(" "), F.col("stage"), F.when(F.col("source") == 0, " as the crew has reported today").otherwise(""))
    scores = F.array(F.col("confidence"), F.col("confidence") * 0.75)
    f = R.agent_features(F.col("confidence"), scores, risk, F.col("activity_id") % 7, F.lit(6), F.lit("Piping"), text)
    return t.select("event_id", "confidence", "activity_id", F.col("source").alias("source"), f.alias("f"))


def _agent(s, d):
    q = _features(s, d).withColumn("action", R.chosen(R.q_values(F.col("f"))))
    state = R.link_state(F.col("confidence"), F.col("action"), F.when(F.col("activity_id") % 5 != 0, F.col("activity_id")), F.col("source") == 2)
    reward = R.agent_reward(F.col("action"), F.col("source") > 0, F.col("confidence"), F.col("source") == 2)
    return q.select("event_id", "action", state.alias("link_state"), reward.alias("reward"))


def _explained_queue(s, d):
    f = F.array(F.col("confidence"), F.when(F.col("status") == "ON_HOLD", 1.0).otherwise(0.1), (F.col("activity_id") % 7) / 6, F.lit(1.0), F.lit(0.3))
    c = F.get(R.contributions(f, WEIGHTS), F.lit(0))
    return _tracked(s, d).select("event_id", c.alias("c")).select("event_id", F.col("c.factor").alias("top_driver"), F.col("c.contribution").alias("contribution"))


def _schedule(s, d):
    return B.activities(s, d).select("activity_id", "planned_start", "discipline")


QUERIES = {
    "event_list": lambda s, d: R.listed(_tracked(s, d), "unmatched", "building").select("event_id", "confidence"),
    "review_queue": lambda s, d: R.listed(_tracked(s, d), waiting=True).select("event_id", "link_state"),
    "activity_search": lambda s, d: R.search(B.activities(s, d).select("activity_id", "discipline", "location"), "tion_1", ["discipline", "location"], 25),
    "touched_schedule": lambda s, d: R.touched(B.activities(s, d), B.claims(s, d), "Building").select("activity_id", "planned_start"),
    "audit_feed": lambda s, d: R.audit_feed(B.claims(s, d), "PURCHASE").select("seq", "event_id", "total"),
    "audit_chain": lambda s, d: R.audit_chain(B.claims(s, d).select("activity_id", "event_id", "stage"), _schedule(s, d)),
    "conflict_registry": lambda s, d: R.conflict_registry(S.same_day_conflicts(B.claims(s, d)), _known(s, d), NOW),
    "ingest_summary": lambda s, d: R.ingest_summary(_tracked(s, d), "source"),
    "risk_histogram": lambda s, d: R.risk_histogram(_risks(s, d)),
    "risk_ranking": lambda s, d: R.risk_ranking(_risks(s, d), 50).select("rank", "activity_id", "risk_level", "delay_frequency"),
    "match_explanation": _evidence,
    "accuracy_by_class": _accuracy,
    "best_overlap": _overlap,
    "token_containment": _containment,
    "weighted_duplicates": _duplicates,
    "feedback_boost": _feedback,
    "agent_decision": _agent,
    "priority_explained": _explained_queue,
}

_W = "with recursive " + B.SQL
_T = f"""{_W}, c0 as (select c.*, a.discipline, {_r('least(c.value / 300, 1.0)', 6)} as confidence from claims c left join activities a using (activity_id)),
tracked as (select *, case when confidence >= 0.85 then 'auto_linked' when confidence >= 0.65 then 'pending_review' else 'unmatched' end as link_state from c0)"""
_SAME = """found as (select 'CFL-' || activity_id || '-' || coalesce(strftime(event_date, '%Y-%m-%d'), 'undated') as conflict_id, activity_id,
case when bool_or(status = 'COMPLETED') and bool_or(status in ('IN_PROGRESS', 'NOT_STARTED')) then 'HIGH' else 'MEDIUM' end as severity
from claims where status is not null group by activity_id, coalesce(strftime(event_date, '%Y-%m-%d'), 'undated') having count(distinct status) > 1 and count(distinct source) > 1)"""
_A = f"""{_W}, e as (select discipline, activity_type, count(*) as n, {_r('count_if(delayed) / count(*)', 3)} as f from history group by 1, 2 having count(*) >= 3),
w as (select discipline, {_r('count_if(delayed) / count(*)', 3)} as f from history group by 1),
a as (select p_partkey as activity_id, coalesce(e.f, w.f) as delay_frequency from part left join e on e.discipline = p_type and e.activity_type = p_brand left join w on w.discipline = p_type),
risks as (select *, case when delay_frequency is null then 'UNKNOWN' when delay_frequency >= 0.60 then 'HIGH' when delay_frequency >= 0.35 then 'MEDIUM' else 'LOW' end as risk_level from a)"""
_FEATURES = ["confidence", "confidence - confidence * 0.75::double", "case status when 'ON_HOLD' then 1.0 when 'IN_PROGRESS' then 0.5 else 0.1 end::double", "(activity_id % 7)::double / 6", "0.68::double", "1.0::double",
             "(case when confidence >= 0.5 then 1 else 0 end + case when confidence * 0.75::double >= 0.5 then 1 else 0 end)::double / 5", "case when source = 0 then 0.0 else 1.0 end::double"]
_Q = [_r("0.0::double + " + " + ".join(f"f{i} * {x}::double" for i, x in enumerate(w)), 4) for w in R.AGENT_WEIGHTS]

ORACLE = {
    "event_list": f"{_T} select event_id, confidence from tracked where link_state = 'unmatched' and lower(discipline) = 'building'",
    "review_queue": f"{_T} select event_id, link_state from tracked where link_state <> 'auto_linked'",
    "activity_search": f"{_W}, h as (select activity_id, discipline, location from activities where contains(lower(discipline), 'tion_1') or contains(lower(location), 'tion_1')) select *, (select count(*) from h) as total from h order by activity_id limit 25",
    "touched_schedule": f"{_W} select activity_id, planned_start from activities where lower(discipline) = 'building' and activity_id in (select activity_id from claims)",
    "audit_feed": f"{_W}, h as (select seq, event_id from claims where upper(stage) = 'PURCHASE') select *, (select count(*) from h) as total from h order by seq desc limit 200",
    "audit_chain": f"{_W} select c.activity_id, event_id, stage, planned_start, discipline from claims c left join activities a using (activity_id)",
    "conflict_registry": f"""{_W}, {_SAME}, known as (select conflict_id, activity_id, 'MEDIUM' as severity, timestamp '{DAY}' as detected_at, activity_id % 2 = 0 as resolved from found where activity_id % 3 = 0
union all select 'CFL-gone', -1, 'HIGH', timestamp '{DAY}', false)
select coalesce(f.conflict_id, k.conflict_id) as conflict_id, coalesce(f.activity_id, k.activity_id) as activity_id, case when f.conflict_id is not null and not coalesce(k.resolved, false) then f.severity else k.severity end as severity,
coalesce(k.detected_at, timestamp '{NOW}') as detected_at, coalesce(k.resolved, false) as resolved from found f full join known k on f.conflict_id = k.conflict_id""",
    "ingest_summary": f"{_T} select source, count(*) as events_detected, count_if(link_state = 'auto_linked') as auto_linked, count_if(link_state = 'pending_review') as needs_review, count_if(link_state = 'clarification_needed') as needs_clarification, count_if(link_state = 'unmatched') as unmatched from tracked group by 1",
    "risk_histogram": f"{_A} select count(*) as count, count_if(risk_level = 'HIGH') as high, count_if(risk_level = 'MEDIUM') as medium, count_if(risk_level = 'LOW') as low from risks",
    "risk_ranking": f"{_A} select cast(row_number() over (order by case risk_level when 'HIGH' then 0 when 'MEDIUM' then 1 when 'LOW' then 2 else 3 end, delay_frequency desc nulls last, activity_id) as int) as rank, activity_id, risk_level, delay_frequency from risks qualify rank <= 50",
    "match_explanation": f"""with e as (select p_partkey as k, p_size::double / 64 as s, p_partkey % 2 = 0 as a, p_partkey % 3 = 0 as b, p_partkey % 5 = 0 as c from part),
t as (select *, case when a then 0.20::double else 0 end + case when b then 0.15::double else 0 end + case when c then 0.10::double else 0 end as t from e)
select k, {_r('s', 3)} as semantic_score, {_r('t', 3)} as total_boost, {_r('s + t', 3)} as final_score, cast(a::int + b::int + c::int + (s > 0.3)::int as int) as matched_signals, cast(4 as int) as total_signals from t""",
    "accuracy_by_class": f"""with {text_queries._VEC}, c as (select {_r('s', 6)} as score, ['easy', 'medium', 'hard', 'very_hard'][((query_id // 20) % 4 + 1)::int] as difficulty, case when (query_id // 20) % 5 <> 0 then x end as expected, y from t where rank = 1),
g as (select difficulty, case when expected is null then score < 0.85 else expected = y end as ok from c)
select coalesce(difficulty, 'all') as difficulty, count(*) as n, count_if(ok) as correct, {_r('count_if(ok) / count(*)', 3)} as accuracy from g group by rollup (difficulty)""",
    "best_overlap": r"""with t as (select item_id, unnest(list_distinct(regexp_split_to_array(lower(trim(text)), '\s+'))) as w from benchmark),
e as (select conv_id, turn, unnest(list_distinct(regexp_split_to_array(lower(trim(text)), '\s+'))) as w from conversations),
n as (select item_id, conv_id, turn, count(*) as overlap from t join e using (w) where w <> '' group by 1, 2, 3)
select item_id as truth_id, conv_id, turn, overlap from n qualify row_number() over (partition by item_id order by overlap desc, conv_id, turn) = 1""",
    "token_containment": f"{text_queries._W} select activity_id, {_r('''len(list_intersect(['hydrotest', 'of', 'line', '7', 'was', 'completed', 'in', 'unit', '3'], list_distinct(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)))) / 9''', 6)} as score from reports",
    "agent_decision": f"""{_T}, f as (select event_id, activity_id, source, confidence, {', '.join(f'{x} as f{i}' for i, x in enumerate(_FEATURES))} from tracked),
q as (select *, {_Q[0]} as a, {_Q[1]} as b, {_Q[2]} as c from f),
p as (select *, case when a >= b and a >= c then 'auto_link' when b >= c then 'ask_clarification' else 'send_to_planner' end as action from q)
select event_id, action, case when confidence > 0 and action = 'auto_link' and activity_id % 5 <> 0 then 'auto_linked' when (confidence > 0 and action = 'ask_clarification') or coalesce(source = 2, false) then 'clarification_needed' when confidence > 0 then 'pending_review' else 'unmatched' end as link_state,
case action when 'send_to_planner' then case when source = 2 then 2.0 when not source > 0 then 1.5 when confidence < 0.80 then 1.0 else -0.5 end when 'ask_clarification' then case when source > 0 then 0.8 else -0.3 end else -2.0 end::double as reward from p""",
    "priority_explained": f"""{_T}, x as (select event_id, {_r('confidence * 0.40::double', 3)} as a, {_r("case status when 'ON_HOLD' then 1.0::double else 0.1::double end * 0.30::double", 3)} as b, {_r('(activity_id % 7)::double / 6 * 0.15::double', 3)} as c, 0.1::double as d, 0.015::double as e from tracked)
select event_id, case greatest(a, b, c, d, e) when a then 'match confidence' when b then 'schedule risk' when c then 'cascade impact' when d then 'time in queue' else 'discipline delay rate' end as top_driver, greatest(a, b, c, d, e) as contribution from x""",
}
