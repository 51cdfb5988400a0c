"""Questions, the five canned queries at once, marks of quality, and every rule of data quality broken by some row."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import answers as A
from plumbline.operators import quality as Q
from plumbline.plans import bindings as B
from plumbline.plans.history_queries import _RISK, _STATS, _W, _r

# What customers ask, by their number; {d} is a discipline and {t} a type that history has, or none.
ASKED = [
    "Why is {d} late?", "How long does {t} of {d} take?", "Which discipline has the worst delay?", "Show me something similar to {t}", "What goes over the baseline?",
    "What is the risk of {t} in {d}?", "crew output for {t}", "Good morning", "What usually delays {d}?", "duration of {d}",
]
DISCIPLINES, TYPES = ["promo", "economy", "standard", "small"], ["brand#11", "brand#21", "brand#34", "brand#5"]


def _history(s, d):
    return B.history(s, d).where("record_quality = 'verified'")


def _questions(s, d):
    c, k = B.table(s, d, "customer"), F.col("c_custkey")
    pick = lambda values, by: F.get(F.array(*map(F.lit, [*values, "it"])), F.pmod(F.floor(k / by), F.lit(len(values) + 1)).cast("int"))
    text = F.get(F.array(*map(F.lit, ASKED)), F.pmod(k, F.lit(len(ASKED))).cast("int"))
    return c.select(k.alias("question_id"), F.replace(F.replace(text, F.lit("{d}"), pick(DISCIPLINES, 10)), F.lit("{t}"), pick(TYPES, 50)).alias("question"))


def _answers(s, d):
    return A.answered(_questions(s, d), _history(s, d), 900, DISCIPLINES, TYPES)


def _broken(s, d):
    """Orders as activities, of which some break each rule: a number twice, none, no day, levels that are kept apart."""
    o, k = B.table(s, d, "orders"), F.col("o_orderkey")
    day = F.when(k % 29 == 0, "some day").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    rows = o.select(
        F.when(k % 23 == 0, " ").when(k % 31 == 0, (k - 1).cast("string")).otherwise(k.cast("string")).alias("activity_id"), F.when(k % 11 == 0, "None").otherwise("name").alias("activity_name"),
        F.when(k % 13 == 0, "").otherwise(F.col("o_orderpriority")).alias("wbs_id"), day.alias("start_raw"), F.try_to_date(day, "yyyy-MM-dd").alias("planned_start"), F.lit("x").alias("finish_raw"),
        F.date_add(F.to_date("o_orderdate"), F.when(k % 17 == 0, -1).otherwise(5)).alias("planned_finish"), F.array(F.when(k % 19 == 0, k).otherwise(k + 1).cast("string")).alias("predecessors"),
        (k % 7 == 0).alias("summary"),
    )
    return Q.issues(rows.where("not summary"), None, rows.where("summary"))


def _marked(s, d):
    li = B.table(s, d, "lineitem")
    h = li.where("l_linenumber = 1").groupBy(F.col("l_orderkey").alias("record_id")).agg(F.max("l_returnflag").alias("record_quality"))
    marks = B.table(s, d, "events").where("event_type = 'click'").select(F.floor(F.abs("value") * 5).cast("long").alias("record_id"), F.when(F.col("event_id") % 2 == 0, "verified").otherwise("rejected").alias("quality"), F.col("event_id").alias("seq"))
    return A.with_quality(h, marks)


QUERIES = {
    "answered_questions": _answers,
    "all_five": lambda s, d: A.all_five(_history(s, d), 900),
    "quality_rules_all": _broken,
    "marked_quality": _marked,
}

_ID = "case when o_orderkey % 23 = 0 then ' ' when o_orderkey % 31 = 0 then (o_orderkey - 1)::varchar else o_orderkey::varchar end"
_PICK = lambda values, by: f"[{', '.join(repr(v) for v in [*values, 'it'])}][((c_custkey // {by}) % {len(values) + 1} + 1)::int]"
_ASKED = ", ".join("'" + q.replace("'", "''") + "'" for q in ASKED)
_P = "cast(cast(round_even({} * 100, 0) as bigint) as varchar)"

ORACLE = {
    "answered_questions": f"""{_W}, v as (select * from history where record_quality = 'verified'),
q0 as (select c_custkey as question_id, c_custkey % 10 as k, lower(replace(replace([{_ASKED}][(c_custkey % 10 + 1)::int], '{{d}}', {_PICK(DISCIPLINES, 10)}), '{{t}}', {_PICK(TYPES, 50)})) as x from customer),
q as (select *, ['delay_causes', 'duration_stats', 'discipline_risk', 'similar_activities', 'baseline_exceedance', 'risk_profile', 'productivity', 'generic_search', 'generic_search', 'duration_stats'][(k + 1)::int] as intent,
  case {' '.join(f"when contains(x, '{v}') then '{v}'" for v in DISCIPLINES)} end as discipline, case {' '.join(f"when contains(x, '{v}') then '{v}'" for v in sorted(TYPES, key=lambda z: (-len(z), z)))} end as t0 from q0),
r as (select *, case when intent = 'risk_profile' then coalesce(t0, 'erection') else t0 end as activity_type from q),
e as (select *, case when intent in ('delay_causes', 'duration_stats', 'risk_profile', 'productivity') then discipline end as d, case when intent in ('duration_stats', 'risk_profile', 'productivity') then activity_type end as t from r),
gr as (select distinct d, t from e), g as (select gr.d, gr.t, v.* from gr join v on (gr.d is null or lower(v.discipline) = gr.d) and (gr.t is null or lower(v.activity_type) = gr.t)),
c as (select d, t, delay_cause, count(*) as n, sum(count(*)) over (partition by d, t) as total from g where delayed group by 1, 2, 3),
ca as (select d, t, 'top cause of delay: ' || delay_cause || ', ' || {_P.format(_r('n / total', 3))} || ' %' as said from c where delay_cause is not null qualify row_number() over (partition by d, t order by n desc, delay_cause) = 1),
s as (select d, t, discipline, activity_type, {_STATS} from g group by 1, 2, 3, 4),
du as (select d, t, discipline || ' ' || activity_type || ': planned ' || printf('%.2f', mean_planned) || ', actual ' || format('{{:,.2f}}', mean_actual) || ', delayed ' || {_P.format('delay_frequency')} || ' %' as said from s qualify row_number() over (partition by d, t order by discipline, activity_type) = 1),
s0 as (select d, t, {_STATS} from g group by 1, 2), s1 as (select *, {_RISK} from s0), ri as (select d, t, 'risk ' || risk_level || ', delayed ' || {_P.format('delay_frequency')} || ' %, buffer ' || buffer as said from s1),
pr as (select d, t, 'mean rate ' || printf('%.3f', {_r('avg(productivity)', 3)}) as said from g group by 1, 2),
w0 as (select discipline, {_STATS} from v group by 1), w as (select 'most often delayed: ' || discipline || ', ' || {_P.format('delay_frequency')} || ' %' as said from w0 order by delay_frequency desc, discipline limit 1),
o as (select discipline, activity_type, {_r('avg(variance_days)', 2)} as mv from v group by 1, 2 having avg(variance_days) >= 900), ov as (select 'most over plan: ' || discipline || ' ' || activity_type || ', ' || format('{{:,.2f}}', mv) || ' days' as said from o order by mv desc, discipline, activity_type limit 1),
al as (select 'delay_causes' as i, * from ca union all select 'duration_stats', * from du union all select 'risk_profile', * from ri union all select 'productivity', * from pr union all select 'discipline_risk', null, null, said from w union all select 'baseline_exceedance', null, null, said from ov)
select question_id, intent, discipline, activity_type, coalesce(said, case when intent in ('similar_activities', 'generic_search') then 'asks for a search' else 'nothing is known of this' end) as summary
from e left join al on i = intent and e.d is not distinct from al.d and e.t is not distinct from al.t""",
    "all_five": f"""{_W}, v as (select * from history where record_quality = 'verified'), s as (select discipline, activity_type, {_STATS} from v group by 1, 2), r as (select *, {_RISK} from s), d as (select discipline, {_STATS} from v group by 1),
c as (select delay_cause, count(*) as n, {_r('count(*) / (select count(*) from v where delayed)', 3)} as f from v where delayed and delay_cause is not null group by 1 order by n desc, delay_cause limit 5)
select 'duration_by_type' as query, discipline, activity_type, null as cause, n, mean_actual as value from s union all select 'delay_by_discipline', discipline, null, null, n, delay_frequency from d union all select 'common_causes', null, null, delay_cause, n, f from c
union all select 'over_baseline', discipline, activity_type, null, count(*), {_r('avg(variance_days)', 2)} from v group by discipline, activity_type having avg(variance_days) >= 900 union all select 'risk_profile', discipline, activity_type, risk_level, n, delay_frequency from r""",
    "quality_rules_all": f"""with o as (select *, {_ID} as activity_id, o_orderkey as k from orders), w as (select * from o where k % 7 <> 0),
i as (select activity_id, 'missing_id' as issue_type, 'ERROR' as severity, 'activity_id' as field from w where k % 23 = 0 union all select activity_id, 'missing_name', 'WARNING', 'activity_name' from w where k % 11 = 0
union all select activity_id, 'invalid_date', 'ERROR', 'planned_start' from w where k % 29 = 0 union all select activity_id, 'finish_before_start', 'ERROR', 'planned_finish' from w where k % 17 = 0 and k % 29 <> 0
union all select activity_id, 'missing_wbs', 'WARNING', 'wbs_id' from w where k % 13 = 0 union all select activity_id, 'circular_predecessor', 'WARNING', 'predecessors' from w where activity_id = case when k % 19 = 0 then k else k + 1 end::varchar
union all select activity_id, 'duplicate_id', 'ERROR', 'activity_id' from w where trim(activity_id) <> '' group by activity_id having count(*) > 1 union all select activity_id, 'non_l5_l6', 'INFO', 'wbs_level' from o where k % 7 = 0) select * from i""",
    "marked_quality": """with h as (select l_orderkey as record_id, max(l_returnflag) as q from lineitem where l_linenumber = 1 group by 1),
m as (select cast(floor(abs(value) * 5) as bigint) as record_id, max_by(case when event_id % 2 = 0 then 'verified' else 'rejected' end, event_id) as said from events where event_type = 'click' group by 1)
select record_id, coalesce(said, q) as record_quality from h left join m using (record_id)""",
}
