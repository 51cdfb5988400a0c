"""Queries over activities, claims, trees and precedence."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import progress as P
from plumbline.functions import text as T
from plumbline.functions.numbers import rounded
from plumbline.operators import graph as G
from plumbline.operators import review as R
from plumbline.operators import schedule as S
from plumbline.plans import bindings as B
from plumbline.plans.history_queries import _r

ROOT, SLIP = 3, 5
WEIGHTS = [0.40, 0.30, 0.15, 0.10, 0.05]
NOW = "2024-02-01 00:00:00"


def _rows(s, d):
    return S.schedule_rows(B.activities(s, d), B.actuals(s, d))


def _part_activities(s, d):
    p = B.table(s, d, "part")
    return p.select(F.col("p_partkey").cast("long").alias("activity_id"), F.date_add(F.lit("2024-01-01").cast("date"), F.col("p_size")).alias("planned_finish"))


def _queue(s, d):
    c = B.claims(s, d).withColumns(
        {
            "confidence": F.least(F.abs("value") / 1000, F.lit(1.0)),
            "risk": F.when(F.col("status") == "ON_HOLD", "HIGH").when(F.col("status") == "IN_PROGRESS", "MEDIUM").otherwise("LOW"),
            "fan_out": F.pmod("activity_id", F.lit(7)),
            "delay_rate": F.lit(0.3),
        }
    )
    return S.priority_queue(c.where(F.col("status").isNotNull()), WEIGHTS, NOW)


def _measures(s, d):
    """Planned days, lateness, and what a confidence read off the order's number comes to."""
    a = B.activities(s, d).join(B.actuals(s, d), "activity_id")
    sure = F.pmod("activity_id", F.lit(101)) / 100
    return a.select(
        "activity_id", P.inclusive_days(F.col("planned_start"), F.col("planned_finish")).alias("days"), P.delay_conflict(F.col("planned_finish"), F.col("actual_finish")).alias("late"), P.confidence_band(sure).alias("band"),
        P.review_decision(sure).alias("decision"), P.status_label(F.lower("status")).alias("status"), P.contradicts(F.col("status"), F.when(F.col("activity_id") % 2 == 0, "COMPLETED").otherwise("NOT_STARTED")).alias("contradicted"),
        T.search_text(F.col("discipline"), F.when(F.col("activity_id") % 3 > 0, F.col("location")), F.lit("")).alias("text"), rounded(R.queue_reward(F.col("status") == "COMPLETED", F.when(F.col("activity_id") % 2 == 0, "HIGH").otherwise("LOW"), F.pmod("activity_id", F.lit(48)).cast("double")), 4).alias("reward"),
    )


def _listed(s, d):
    """Successors as exports list them, some of them unknown; the fan-out of each."""
    p, k = B.table(s, d, "part"), F.col("p_partkey")
    rows = p.select(k.cast("string").alias("id"), F.concat((k * 2).cast("string"), F.lit("; "), (k * 2 + 1).cast("string"), F.lit(","), F.when(k % 5 == 0, "none such").otherwise("")).alias("successors"))
    return G.edges_from_lists(rows, "id", "successors")


def _outline(s, d):
    """Outline numbers of nations and suppliers; those of nations whose number a fourth divides are left out."""
    p, n = B.table(s, d, "supplier"), B.table(s, d, "nation")
    two = F.concat_ws(".", F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string"))
    leaf = p.join(n, p.s_nationkey == n.n_nationkey).select(F.concat_ws(".", two, F.col("s_suppkey").cast("string")).alias("outline"))
    return G.outline_parents(leaf.unionByName(n.where("n_nationkey % 4 > 0").select(two.alias("outline"))))


QUERIES = {
    "planned_measures": _measures,
    "listed_edges": _listed,
    "outline_parents": _outline,
    "schedule_rows": lambda s, d: _rows(s, d).select("activity_id", "status", "variance_days", "progress", "risk"),
    "project_summary": lambda s, d: S.project_summary(_rows(s, d)),
    "progress_dashboard": lambda s, d: S.progress_dashboard(_rows(s, d)),
    "status_pivot": lambda s, d: S.status_pivot(_rows(s, d)),
    "schedule_window": lambda s, d: S.schedule_window(_rows(s, d)),
    "top_variance": lambda s, d: _rows(s, d).where("variance_days <> 0").orderBy(F.desc(F.abs("variance_days")), "activity_id").limit(12).select("activity_id", "variance_days"),
    "state_fold": lambda s, d: S.fold_state(B.activities(s, d), B.claims(s, d)),
    "same_day_conflicts": lambda s, d: S.same_day_conflicts(B.claims(s, d)),
    "claim_labels": lambda s, d: S.claim_labels(B.claims(s, d)),
    "contradiction_pairs": lambda s, d: S.contradiction_pairs(B.claims(s, d)),
    "state_regressions": lambda s, d: S.state_regressions(B.claims(s, d)),
    "all_conflicts": lambda s, d: S.all_conflicts(B.claims(s, d)),
    "transition_violations": lambda s, d: S.transition_violations(B.claims(s, d)),
    "link_sets": lambda s, d: S.link_sets(B.claims(s, d)),
    "daily_timeline": lambda s, d: S.daily_timeline(B.claims(s, d), ["signup", "view"]),
    "priority_queue": _queue,
    "tree_paths": lambda s, d: G.tree_paths(B.tree(s, d)),
    "context_inheritance": lambda s, d: G.inherited(B.tree(s, d), "zone"),
    "cascade_impact": lambda s, d: G.cascade(_part_activities(s, d), B.precedence(s, d), ROOT, SLIP),
    "cascade_summary": lambda s, d: G.cascade_summary(G.cascade(_part_activities(s, d), B.precedence(s, d), ROOT, SLIP), SLIP),
    "fan_out": lambda s, d: G.fan_out(B.precedence(s, d), B.table(s, d, "part").select(F.col("p_partkey").cast("long").alias("node"))),
}

_W = "with recursive " + B.SQL
_ROWS = """rows as (select a.*, coalesce(x.status, 'NOT_STARTED') as status, x.actual_finish, date_diff('day', planned_finish, x.actual_finish) as variance_days,
case coalesce(x.status, 'NOT_STARTED') when 'COMPLETED' then 100.0::double when 'IN_PROGRESS' then 50.0::double when 'ON_HOLD' then 50.0::double else 0.0::double end as progress
from activities a left join actuals x using (activity_id)), rated as (select *, case when variance_days is null then null when variance_days > 7 or (variance_days > 3 and progress < 50) then 'HIGH' when variance_days > 0 then 'MEDIUM' else 'LOW' end as risk from rows)"""
_WR = f"{_W}, {_ROWS}"
_SUMMARY = f"count(*) as total, count_if(status = 'COMPLETED') as completed, count_if(status = 'IN_PROGRESS') as in_progress, count_if(variance_days > 0) as delayed, {_r('coalesce(avg(progress / 100), 0)', 4)} as mean_progress"
_SAME = """g as (select activity_id, coalesce(strftime(event_date, '%Y-%m-%d'), 'undated') as day, count(distinct status) as statuses, count(distinct source) as sources, count(*) as claims,
bool_or(status = 'COMPLETED') and (bool_or(status = 'IN_PROGRESS') or bool_or(status = 'NOT_STARTED')) as hard from claims where status is not null group by 1, 2 having count(distinct status) > 1 and count(distinct source) > 1),
same as (select 'CFL-' || activity_id || '-' || day as conflict_id, activity_id, day, statuses, sources, claims, case when hard then 'HIGH' else 'MEDIUM' end as severity from g)"""
_BACK = """d as (select activity_id, min_by({e: event_id, s: source, t: ts, q: seq}, {d: event_date, t: ts, q: seq}) as d from claims where status = 'COMPLETED' group by 1),
back as (select activity_id, min(d.e) as completed_by, count(*) as regressions, array_to_string(list_sort(list(distinct status)), ',') as statuses
from claims join d using (activity_id) where status in ('IN_PROGRESS', 'NOT_STARTED', 'ON_HOLD') and (ts > d.t or (ts = d.t and seq > d.q)) and source <> d.s group by 1)"""
_CASCADE = f"""r(node, depth) as (select dst, 1 from precedence where src = {ROOT} union all select p.dst, depth + 1 from r join precedence p on r.node = p.src),
hit as (select node as activity_id, min(depth) as depth from r group by 1),
hits as (select activity_id, cast(depth as int) as depth, date '2024-01-01' + p_size as planned_finish, date '2024-01-01' + p_size + {SLIP} as shifted_finish,
not exists (select 1 from precedence where src = activity_id) as milestone from hit join part on activity_id = p_partkey)"""

ORACLE = {
    "planned_measures": f"""{_W}, a as (select *, (activity_id % 101) / 100 as c from activities join actuals using (activity_id)) select activity_id, 31::int as days, case when actual_finish > planned_finish + 7 then 'HIGH' when actual_finish > planned_finish then 'MEDIUM' end as late,
case when c >= 0.85 then 'HIGH' when c >= 0.65 then 'MEDIUM' else 'LOW' end as band, case when c >= 0.85 then 'AUTO' when c >= 0.65 then 'REVIEW' else 'REJECT' end as decision, status,
(status = 'COMPLETED' and activity_id % 2 = 1) or (status in ('IN_PROGRESS', 'NOT_STARTED') and activity_id % 2 = 0) as contradicted, concat_ws(' ', discipline, case when activity_id % 3 > 0 then location end) as text,
{_r("case when status <> 'COMPLETED' then -1.0::double else case when activity_id % 2 = 0 then 2.0::double else 0.5::double end + 0.3::double * least((activity_id % 48) / 24, 1.0) end", 4)} as reward from a""",
    "listed_edges": "select a.p_partkey::varchar as src, b.p_partkey::varchar as dst from part a join part b on b.p_partkey = a.p_partkey * 2 or b.p_partkey = a.p_partkey * 2 + 1",
    "outline_parents": """with n as (select n_regionkey || '.' || n_nationkey as code, n_nationkey from nation) select code || '.' || s_suppkey as outline, case when n_nationkey % 4 > 0 then code end as parent from supplier join n on s_nationkey = n_nationkey
union all select code, null from n where n_nationkey % 4 > 0""",
    "schedule_rows": f"{_WR} select activity_id, status, variance_days, progress, risk from rated",
    "project_summary": f"{_WR} select {_SUMMARY} from rated",
    "progress_dashboard": f"{_WR} select {_SUMMARY}, {_r('avg(variance_days)', 2)} as mean_variance, max(variance_days) as worst_variance, count_if(risk = 'HIGH') as high_risk from rated",
    "status_pivot": f"{_WR} select discipline, " + ", ".join(f'count_if(status = \'{s}\') as "{s}"' for s in ("NOT_STARTED", "IN_PROGRESS", "ON_HOLD", "COMPLETED", "CANCELLED")) + " from rated group by 1",
    "schedule_window": f"{_WR} select min(least(planned_start, planned_finish, actual_finish)) as first_day, max(greatest(planned_start, planned_finish, actual_finish)) as last_day, array_to_string(list_sort(list(distinct discipline)), ',') as disciplines from rated",
    "top_variance": f"{_WR} select activity_id, variance_days from rated where variance_days <> 0 order by abs(variance_days) desc, activity_id limit 12",
    "state_fold": f"""{_W}, m as (select *, status in ('COMPLETED', 'IN_PROGRESS', 'ON_HOLD') as moves from claims),
s as (select activity_id, coalesce(max(case when status = 'COMPLETED' then 'COMPLETED' end), max_by(status, seq) filter (where moves), 'NOT_STARTED') as status,
max_by(event_date, seq) filter (where status = 'COMPLETED') as actual_finish, min_by(status, seq) filter (where moves) as first_status, min_by(event_date, seq) filter (where moves) as first_date,
min_by(event_date, seq) filter (where moves and status <> 'COMPLETED') as later, count(distinct event_id) as evidence from m group by 1)
select s.activity_id, s.status, case when first_status = 'COMPLETED' then coalesce(planned_start, later) else first_date end as actual_start, coalesce(first_status = 'COMPLETED', false) as start_inferred, s.actual_finish, evidence
from s join activities using (activity_id)""",
    "same_day_conflicts": f"{_W}, {_SAME} select * from same",
    "claim_labels": f"""{_W}, {_SAME}, c as (select *, strftime(event_date, '%Y-%m-%d') as day from claims where status is not null),
n as (select c.*, row_number() over (partition by activity_id, day, source order by ts, seq) as nth from c semi join same using (activity_id, day))
select event_id, activity_id, day, 'source ' || source || case when nth > 1 then ' (report ' || nth || ')' else '' end as label from n""",
    "contradiction_pairs": f"""{_W} select a.activity_id, a.event_id as done_event, b.event_id as other_event, b.status from claims a join claims b on a.activity_id = b.activity_id and a.event_date = b.event_date
and a.status = 'COMPLETED' and b.status in ('IN_PROGRESS', 'NOT_STARTED') and a.source <> b.source""",
    "state_regressions": f"{_W}, {_BACK} select * from back",
    "all_conflicts": f"{_W}, {_SAME}, {_BACK} select conflict_id, activity_id, 'same_day' as kind, severity from same union all select 'REG-' || activity_id, activity_id, 'state_regression', 'HIGH' from back",
    "transition_violations": f"""{_W}, m as (select status as after, lag(status) over (partition by activity_id order by seq) as before from claims where status is not null)
select before, after, count(*) as n from m where before is not null and before <> after and (before, after) not in (('NOT_STARTED','IN_PROGRESS'), ('NOT_STARTED','CANCELLED'), ('IN_PROGRESS','COMPLETED'), ('IN_PROGRESS','ON_HOLD'), ('IN_PROGRESS','CANCELLED'), ('ON_HOLD','IN_PROGRESS'), ('ON_HOLD','CANCELLED')) group by 1, 2""",
    "link_sets": f"{_W} select activity_id, count(*) as events, count(distinct source) as sources, count(*) > 1 as many_to_one, max_by(status, seq) filter (where status is not null) as latest from claims group by 1",
    "daily_timeline": f"{_W} select event_date as day, count_if(stage in ('signup', 'view')) as n from claims group by 1",
    "priority_queue": f"""{_W}, q as (select *, activity_id % 7 as fan_out, max(activity_id % 7) over (order by seq rows unbounded preceding) as most from claims where status is not null),
p as (select event_id, most as max_fan_out, {_r('''0.0 + least(abs(value) / 1000, 1.0) * 0.40::double + case status when 'ON_HOLD' then 1.0::double when 'IN_PROGRESS' then 0.5::double else 0.1::double end * 0.30::double
+ least(fan_out / greatest(most, 1), 1.0) * 0.15::double + greatest(least(((epoch(timestamp '2024-02-01') - floor(epoch(ts))) / 3600) / 24, 1.0), 0.0) * 0.10::double + 0.3::double * 0.05::double''', 3)} as score from q)
select *, row_number() over (order by score desc, event_id) as rank from p""",
    "tree_paths": f"""{_W}, t(node, level, path) as (select node, 1, name from tree where parent is null union all select c.node, level + 1, path || ' > ' || c.name from t join tree c on c.parent = t.node) select * from t""",
    "context_inheritance": f"{_W} select a.node, coalesce(a.zone, b.zone, c.zone) as value from tree a left join tree b on a.parent = b.node left join tree c on b.parent = c.node",
    "cascade_impact": f"{_W}, {_CASCADE} select * from hits",
    "cascade_summary": f"{_W}, {_CASCADE} select count(*) as affected, max(depth) as deepest, count_if(milestone) as milestones, count(*) || case when count(*) = 1 then ' activity' else ' activities' end || ' affected, up to {SLIP} days' as summary from hits",
    "fan_out": f"""{_W}, r(root, node) as (select src, dst from precedence union all select root, p.dst from r join precedence p on r.node = p.src)
select p_partkey as node, coalesce(n, 0) as fan_out from part left join (select root, count(distinct node) as n from r group by 1) on p_partkey = root""",
}
