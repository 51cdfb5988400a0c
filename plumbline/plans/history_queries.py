"""Queries over history records."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.operators import history as H
from plumbline.plans import bindings as B


def _below(s, d):
    h = B.history(s, d)
    current = h.where("record_quality = 'provisional'").groupBy("discipline", "activity_type").agg(F.min("productivity").alias("rate"))
    return H.below_average(current, h.where("record_quality = 'verified'"))


def _dashboard(s, d):
    acts = B.activities(s, d).select("activity_id", F.col("discipline").alias("segment"))
    parts = B.table(s, d, "part").groupBy("p_partkey").agg(F.first("p_type").alias("discipline"), F.first("p_brand").alias("activity_type"))
    first = B.table(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("activity_id")).agg(F.min("l_partkey").alias("p_partkey"))
    typed = acts.join(first, "activity_id").join(parts, "p_partkey").select("activity_id", "discipline", "activity_type")
    return H.assess(typed, B.history(s, d).where("record_quality = 'verified'"))


QUERIES = {
    "delay_by_category": lambda s, d: H.delay_stats(B.history(s, d), "discipline"),
    "duration_by_type": lambda s, d: H.duration_by_type(B.history(s, d)),
    "top_delay_causes": lambda s, d: H.top_causes(B.history(s, d), 3),
    "cause_share": lambda s, d: H.cause_share(B.history(s, d)),
    "over_baseline": lambda s, d: H.over_baseline(B.history(s, d), 900),
    "risk_profile": lambda s, d: H.risk_profile(B.history(s, d), "discipline", "activity_type"),
    "risk_dashboard": _dashboard,
    "productivity_benchmark": lambda s, d: H.productivity(B.history(s, d)),
    "below_average_flag": _below,
    "kb_stats": lambda s, d: H.kb_stats(B.history(s, d)),
    "kb_filter": lambda s, d: H.filtered(B.history(s, d), True, discipline="promo", record_quality="verified").groupBy("activity_type", "delay_cause").agg(F.count("*").alias("n")),
}

_R = "cast(round(cast({} as decimal(38,10)), {}) as double)"


def _r(x: str, digits: int) -> str:
    return _R.format(x, digits)


_STATS = f"""count(*) as n, count_if(delayed) as n_delayed, {_r('count_if(delayed) / count(*)', 3)} as delay_frequency, {_r('avg(variance_days)', 2)} as mean_variance,
{_r('coalesce(avg(case when planned_days > 0 then planned_days end), 0)', 2)} as mean_planned, {_r('coalesce(avg(case when actual_days > 0 then actual_days end), 0)', 2)} as mean_actual"""
_RISK = f"""case when delay_frequency >= 0.60 then 'HIGH' when delay_frequency >= 0.35 then 'MEDIUM' else 'LOW' end as risk_level,
case when n >= 10 then 'high' when n >= 4 then 'medium' else 'low' end as confidence,
cast(greatest(0, case when delay_frequency >= 0.60 then greatest(ceil(mean_variance), ceil({_r('mean_variance * 1.2', 6)})) else ceil(mean_variance) end) as bigint) as buffer"""
_W = "with " + B.SQL

ORACLE = {
    "delay_by_category": f"{_W} select discipline, {_STATS} from history group by discipline",
    "duration_by_type": f"{_W}, s as (select discipline, activity_type, {_STATS} from history group by 1, 2) select discipline, activity_type, n, mean_planned, mean_actual, mean_variance from s",
    "top_delay_causes": f"{_W}, late as (select * from history where delayed) select delay_cause, count(*) as n, {_r('count(*) / (select count(*) from late)', 3)} as frequency from late where delay_cause is not null group by 1 order by n desc, delay_cause limit 3",
    "cause_share": f"{_W} select discipline, delay_cause, count(*) as n, {_r('count(*) / sum(count(*)) over (partition by discipline)', 4)} as share from history where delayed and delay_cause is not null group by 1, 2",
    "over_baseline": f"{_W} select discipline, activity_type, count(*) as n, {_r('avg(variance_days)', 2)} as mean_variance, max(variance_days) as worst, {_r('count_if(delayed) / count(*)', 3)} as delay_frequency from history group by 1, 2 having avg(variance_days) >= 900",
    "risk_profile": f"{_W}, s as (select discipline, activity_type, {_STATS} from history group by 1, 2) select *, {_RISK} from s",
    "risk_dashboard": f"""{_W}, v as (select * from history where record_quality = 'verified'),
e0 as (select discipline, activity_type, {_STATS} from v group by 1, 2 having count(*) >= 3), e as (select *, {_RISK} from e0),
w0 as (select discipline, {_STATS} from v group by 1), w as (select *, {_RISK} from w0),
typed as (select l_orderkey as activity_id, p_type as discipline, p_brand as activity_type from (select l_orderkey, min(l_partkey) as k from lineitem group by 1) join part on k = p_partkey join orders on l_orderkey = o_orderkey)
select activity_id, coalesce(e.n, w.n, 0) as n, case when e.n is not null then e.delay_frequency else w.delay_frequency end as delay_frequency,
coalesce(e.risk_level, w.risk_level, 'UNKNOWN') as risk_level, coalesce(e.confidence, w.confidence, 'none') as confidence, coalesce(e.buffer, w.buffer, 0) as buffer
from typed t left join e on t.discipline = e.discipline and t.activity_type = e.activity_type left join w on t.discipline = w.discipline""",
    "productivity_benchmark": f"""{_W} select coalesce(discipline, 'all') as discipline, coalesce(activity_type, 'all') as activity_type, count(*) as n, {_r('avg(case when actual_days > 0 then actual_days end)', 2)} as mean_days,
{_r('avg(variance_days)', 2)} as mean_variance, {_r('count_if(delayed) / count(*)', 3)} as delay_frequency, {_r('avg(productivity)', 3)} as rate_avg, {_r('max(productivity)', 3)} as rate_best, {_r('min(productivity)', 3)} as rate_worst
from history group by grouping sets ((discipline, activity_type), ())""",
    "below_average_flag": f"""{_W}, c as (select discipline, activity_type, min(productivity) as rate from history where record_quality = 'provisional' group by 1, 2),
a as (select discipline, activity_type, avg(productivity) as mean from history where record_quality = 'verified' group by 1, 2),
j as (select c.*, {_r('(mean - rate) / nullif(mean, 0) * 100', 1)} as percent_below from c left join a using (discipline, activity_type)) select *, coalesce(percent_below > 10, false) as flagged from j""",
    "kb_stats": f"{_W} select discipline, count(*) as total, count_if(record_quality = 'verified') as verified, count_if(record_quality = 'provisional') as provisional, count_if(record_quality = 'rejected') as rejected, count_if(delayed) as delayed from history group by 1",
    "kb_filter": f"{_W} select activity_type, delay_cause, count(*) as n from history where delayed and lower(discipline) = 'promo' and record_quality = 'verified' group by 1, 2",
}
