"""Queries over texts, vectors, event windows and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.functions.numbers import dot, jaccard, rounded
from plumbline.operators import answers as A
from plumbline.operators import matching as M
from plumbline.operators import quality as Q
from plumbline.operators.scan import following, scanned
from plumbline.plans import bindings as B
from plumbline.plans.history_queries import _r
from plumbline.streaming import jobs

# Pairs of thresholds that are tried.
SWEEP = [(0.90, 0.70), (0.85, 0.65), (0.80, 0.60), (0.75, 0.55), (0.70, 0.50)]
AGENT = [[2.5, 1.5, -0.3, -1.5], [0.0, -3.0, 0.0, 2.0], [0.8, 0.5, 1.2, 0.0]]


def _reports(s, d):
    """A written report for every order."""
    k = F.col("o_orderkey")
    num = lambda n: F.pmod(k, F.lit(n)).cast("string")
    phrase = F.when(k % 5 == 0, "was completed").when(k % 5 == 1, "is in progress").when(k % 5 == 2, "not started, awaiting crew").when(k % 5 == 3, "could not be done").otherwise("went on")
    work = F.when(k % 3 == 0, "Erection").when(k % 3 == 1, "Hydrotest").otherwise("Cable pulled")
    tag = F.when(k % 4 == 0, "V-").when(k % 4 == 1, "P-").when(k % 4 == 2, "FT-").otherwise("K-")
    place = F.when(k % 7 == 0, "Substation").when(k % 7 == 1, "Area B").otherwise(F.concat(F.lit("Unit "), num(9)))
    amount = F.when(k % 2 == 0, F.concat(num(40), F.lit(" of 40 joints"))).otherwise(F.concat(num(90), F.lit(" spools")))
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    text = F.concat(work, F.lit(" of Line "), num(60), F.lit(" "), phrase, F.lit(" at "), place, F.lit(", "), tag, num(300), F.lit("; "), amount, F.lit(" on "), day)
    return B.table(s, d, "orders").select(k.alias("activity_id"), text.alias("text"), F.to_date("o_orderdate").alias("day"))


def _vectors(s, d):
    return B.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"), "label")


def _top(s, d, keep):
    v = _vectors(s, d)
    out = M.top_by_cosine(v.where("id % 20 = 0"), v, keep + 1).where("query_id <> item_id")
    rank = F.row_number().over(M.Window.partitionBy("query_id").orderBy(F.desc(rounded(F.col("score"), 8)), "item_id"))
    return out.withColumn("rank", rank).where(F.col("rank") <= keep)


def _scored(s, d):
    v = _vectors(s, d).select("id", "label")
    t = _top(s, d, 1).select("query_id", "item_id", rounded(F.col("score"), 6).alias("score"))
    a, b = v.select(F.col("id").alias("query_id"), F.col("label").alias("x")), v.select(F.col("id").alias("item_id"), F.col("label").alias("y"))
    return t.join(a, "query_id").join(b, "item_id").select("query_id", "score", (F.col("x") == F.col("y")).alias("correct"))


def _gaps(s, d):
    t = _top(s, d, 2).select(F.col("query_id").alias("query"), "rank", rounded(F.col("score"), 6).alias("score"))
    out = M.decided(t, F.lit("the pump is being aligned at last, says the crew"))
    return out.select("query", "score", rounded(F.col("gap"), 6).alias("gap"), "decision")


def _jaccard(s, d):
    w = B.table(s, d, "benchmark").select("item_id", M.words(F.col("text")).alias("ws"))
    a, b = w.select(F.col("item_id").alias("a"), F.col("ws").alias("x")), w.select(F.col("item_id").alias("b"), F.col("ws").alias("y"))
    # each item against all, in the table's fixed small size; tokens bring pairs together
    near = a.select("a", F.explode("x").alias("w")).join(b.select("b", F.explode("y").alias("w")), "w").where("a <> b").select("a", "b").distinct()
    sim = near.join(a, "a").join(b, "b").select("a", "b", rounded(jaccard(F.col("x"), F.col("y")), 6).alias("score"))
    rank = F.row_number().over(M.Window.partitionBy("a").orderBy(F.desc("score"), "b"))
    return sim.withColumn("rank", rank).where("rank <= 3")


def _sentences(s, d):
    lines = B.table(s, d, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    said = lines.select("doc_id", F.explode(F.split("line", r"[.!]\s+")).alias("x")).where(F.length("x") > 5)
    return said.groupBy("doc_id").agg(F.count("*").alias("sentences"), F.max(F.length("x")).alias("longest"))


def _quality(s, d):
    o = B.table(s, d, "orders")
    k = F.col("o_orderkey")
    kept = o.select(
        k.cast("string").alias("activity_id"), F.when(k % 11 == 0, "").otherwise(F.lit("name")).alias("activity_name"), F.when(k % 13 == 0, None).otherwise(F.col("o_orderpriority")).alias("wbs_id"),
        F.lit("x").alias("start_raw"), F.to_date("o_orderdate").alias("planned_start"), F.lit("x").alias("finish_raw"), F.date_add(F.to_date("o_orderdate"), F.when(k % 17 == 0, -1).otherwise(5)).alias("planned_finish"),
        F.array(F.when(k % 19 == 0, k).otherwise(k - 1).cast("string")).alias("predecessors"),
    )
    tree = o.select(F.col("o_orderpriority").alias("node")).where("o_orderpriority <> '5-LOW'").distinct()
    return Q.issues(kept, tree)


def _parsed(s, d):
    """Each customer's orders as one export file."""
    a = B.table(s, d, "orders").select(F.concat(F.lit("file-"), F.col("o_custkey").cast("string")).alias("source_file"), F.col("o_orderkey").cast("string").alias("activity_id"))
    return A.parse_result(a, _quality(s, d).join(a, "activity_id"))


def _fit(s, d):
    a = B.activities(s, d).withColumn("c", F.pmod("activity_id", F.lit(100)))
    e = B.claims(s, d).groupBy("activity_id").agg(F.min("event_date").alias("day"))
    out = a.join(e, "activity_id").withColumn("boost", M.temporal_fit(F.col("day"), F.col("planned_start"), F.col("planned_finish")))
    return out.select("activity_id", "boost")


def _ready(s, d):
    p = B.table(s, d, "part").select(F.col("p_partkey").cast("long").alias("k"), "p_size")
    preds = F.when(F.col("k") % 5 == 0, F.array().cast("array<bigint>")).otherwise(F.array(F.expr("k div 2"), F.col("k") - 1))
    done = F.array(F.expr("k div 2"), F.when(F.col("p_size") > 25, F.col("k") - 1).otherwise(F.lit(-1)))
    none = F.array(F.lit(-5).cast("bigint"))
    return p.select("k", M.dependency_fit(preds, F.when(F.col("p_size") % 7 == 0, none).otherwise(done)).alias("boost"))


def _argmax(s, d):
    c = B.claims(s, d)
    f = [F.least(F.abs("value") / 1000, F.lit(1.0)), F.pmod("event_id", F.lit(10)) / 10, F.when(F.col("status") == "ON_HOLD", 1.0).otherwise(0.1), F.pmod("event_id", F.lit(2)).cast("double")]
    v = F.array(*f)
    q = F.array(*[rounded(dot(v, F.array(*map(F.lit, w))), 6) for w in AGENT])
    names = F.array(F.lit("auto_link"), F.lit("ask_clarification"), F.lit("send_to_planner"))
    return c.select("event_id", q.alias("q")).select("event_id", F.get(names, F.array_position("q", F.array_max("q")).cast("int") - 1).alias("action"))


def _replay(s, d):
    c = B.claims(s, d).where("status = 'COMPLETED'")
    steps = c.select("seq", F.when(F.col("source") == 0, 1.0).otherwise(-1.0).alias("reward"), F.array(F.least(F.abs("value") / 1000, F.lit(1.0)), F.lit(0.3)).alias("features"))
    return s.createDataFrame([(i, w) for i, w in enumerate(M.replay_policy(steps, [0.4, 0.05]))], "feature int, weight double")


def _ratio(s, d):
    b = scanned(B.table(s, d, "benchmark").select("item_id", "text"), ["item_id"], next=following(F.col("text")))
    return b.select("item_id", M.text_ratio("text", "next").alias("ratio"))


def _arrivals(s, d):
    """Events as they arrive: every seventh is told two days after it happened."""
    e = B.table(s, d, "events").select("event_id", "ts")
    return e.withColumn("ts", F.when(F.col("event_id") % 7 == 0, F.col("ts") - F.expr("interval 2 days")).otherwise(F.col("ts")))


def _distinct_texts(s, d, *by):
    t = B.table(s, d, "documents").where("text is not null")
    return t.groupBy("text", *by).agg(F.min("doc_id").alias("id"))


def _pairs(s, d):
    """Documents of one language, each distinct text once, under the first id that has it."""
    return M.duplicate_pairs(_distinct_texts(s, d, "lang").withColumnRenamed("lang", "discipline"), 0.7, ("discipline",))


def _all_pairs(s, d):
    """Documents whatever their language, each distinct text once, and less alike."""
    return M.duplicate_pairs(_distinct_texts(s, d), 0.5, ())


QUERIES = {
    "status_extract": lambda s, d: _reports(s, d).select("activity_id", T.reported_status(F.col("text")).alias("status")),
    "location_extract": lambda s, d: _reports(s, d).select("activity_id", T.location(F.col("text")).alias("location")),
    "asset_extract": lambda s, d: _reports(s, d).select("activity_id", F.array_join(T.assets(F.col("text")), "|").alias("assets")),
    "quantity_extract": lambda s, d: _reports(s, d).select("activity_id", T.quantity(F.col("text")).alias("q")).select("activity_id", "q.quantity", "q.unit"),
    "date_normalize": lambda s, d: _reports(s, d).select("activity_id", T.event_date(F.col("text")).alias("day")),
    "work_type": lambda s, d: _reports(s, d).select("activity_id", T.work_type(F.col("text")).alias("kind"), T.planned_type(F.col("text")).alias("planned")),
    "sentence_split": _sentences,
    "vector_topk": lambda s, d: _top(s, d, 5).select("query_id", "rank", "item_id", rounded(F.col("score"), 6).alias("score")),
    "score_gap_routing": _gaps,
    "threshold_sweep": lambda s, d: M.threshold_sweep(_scored(s, d), SWEEP),
    "token_jaccard_topk": _jaccard,
    "dedupe_pairs": _pairs,
    "dedupe_pairs_all": _all_pairs,
    "dedupe_groups_all": lambda s, d: M.duplicate_groups(_all_pairs(s, d)),
    "dedupe_groups": lambda s, d: M.duplicate_groups(_pairs(s, d)),
    "fuzzy_ratio": _ratio,
    "quality_issues": _quality,
    "quality_rollup": lambda s, d: Q.rollup(_quality(s, d)),
    "parse_results": _parsed,
    "duplicate_ids": lambda s, d: B.table(s, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n")).where("n > 1"),
    "orphans_anti": lambda s, d: B.table(s, d, "orders").join(B.table(s, d, "lineitem"), F.expr("o_orderkey = l_orderkey"), "left_anti").select("o_orderkey"),
    "existing_semi": lambda s, d: B.table(s, d, "customer").join(B.table(s, d, "orders"), F.expr("c_custkey = o_custkey"), "left_semi").select("c_custkey"),
    "temporal_fit": _fit,
    "dependency_ready": _ready,
    "policy_argmax": _argmax,
    "policy_replay": _replay,
    "tumbling_counts": lambda s, d: jobs.window_counts(B.table(s, d, "events"), "1 hour"),
    "sliding_counts": lambda s, d: jobs.window_counts(B.table(s, d, "events"), "2 hours", "1 hour"),
    "session_counts": lambda s, d: jobs.session_counts(B.table(s, d, "events"), "30 minutes"),
    "late_rows": lambda s, d: jobs.late_rows(_arrivals(s, d), "1 day"),
}

_K = "o_orderkey"
_TEXT = f"""reports as (select o_orderkey as activity_id, case {_K} % 3 when 0 then 'Erection' when 1 then 'Hydrotest' else 'Cable pulled' end || ' of Line ' || ({_K} % 60) || ' '
|| case {_K} % 5 when 0 then 'was completed' when 1 then 'is in progress' when 2 then 'not started, awaiting crew' when 3 then 'could not be done' else 'went on' end || ' at '
|| case {_K} % 7 when 0 then 'Substation' when 1 then 'Area B' else 'Unit ' || ({_K} % 9) end || ', ' || case {_K} % 4 when 0 then 'V-' when 1 then 'P-' when 2 then 'FT-' else 'K-' end || ({_K} % 300) || '; '
|| case when {_K} % 2 = 0 then ({_K} % 40) || ' of 40 joints' else ({_K} % 90) || ' spools' end || ' on ' || strftime(o_orderdate, '%Y-%m-%d') as text from orders)"""
_W = "with recursive " + B.SQL + ", " + _TEXT
_CASES = " ".join(f"when contains(lower(trim(text)), '{p}') then '{v}'" for p, v in sorted(T.STATUS_PHRASES.items(), key=lambda x: -len(x[0])))
_VEC = """v as (select vec_id as id, cast(embedding as double[]) as v, label from embeddings),
p as (select a.id as query_id, b.id as item_id, a.label as x, b.label as y, list_cosine_similarity(a.v, b.v) as s from v a join v b on a.id % 20 = 0 and a.id <> b.id),
t as (select *, cast(row_number() over (partition by query_id order by cast(round(cast(s as decimal(38,10)), 8) as double) desc, item_id) as int) as rank from p)"""
_Q = """o as (select *, cast(o_orderkey as varchar) as activity_id, o_orderkey as k from orders),
i as (select activity_id, 'missing_name' as issue_type, 'WARNING' as severity, 'activity_name' as field from o where k % 11 = 0
union all select activity_id, 'finish_before_start', 'ERROR', 'planned_finish' from o where k % 17 = 0
union all select activity_id, 'missing_wbs', 'WARNING', 'wbs_id' from o where k % 13 = 0
union all select activity_id, 'circular_predecessor', 'WARNING', 'predecessors' from o where k % 19 = 0
union all select activity_id, 'missing_wbs', 'INFO', 'wbs_id' from o where k % 13 <> 0 and o_orderpriority = '5-LOW'
union all select activity_id, 'duplicate_id', 'ERROR', 'activity_id' from o group by activity_id having count(*) > 1)"""


def _near(key: str, least: float) -> str:
    return f"""t as (select min(doc_id) as id, {key} as key, list_distinct(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) as ws from documents where text is not null group by all),
p as (select a.id as a, b.id as b, len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws))) as s from t a join t b on a.id < b.id and a.key = b.key and least(len(a.ws), len(b.ws)) >= {least} * greatest(len(a.ws), len(b.ws)) and len(a.ws) > 0),
q as materialized (select a, b, {_r('s', 3)} as similarity from p where s >= {least})"""


_GREEDY = """ids as (select row_number() over (order by x) as i, x from (select a as x from q union select b from q)),
g(i, taken) as (select 0::bigint, []::struct(p bigint, d bigint, s double)[] union all
  select ids.i, case when list_contains(list_transform(taken, lambda z: z.d), x) then taken else list_concat(taken, coalesce((select list({p: q.a, d: q.b, s: q.similarity}) from q where q.a = x and not list_contains(list_transform(taken, lambda z: z.d), q.b)), [])) end
  from g join ids on ids.i = g.i + 1)
select z.p as primary, z.d as duplicate, z.s as similarity from (select unnest(taken) as z from g where i = (select max(i) from ids))"""
_WIN = "select time_bucket(interval '1 hour', ts) as w"
_DOTS = [" + ".join(f"{w}::double * f{i}" for i, w in enumerate(ws)) for ws in AGENT]

ORACLE = {
    "status_extract": f"{_W} select activity_id, case {_CASES} else 'unknown' end as status from reports",
    "location_extract": f"{_W} select activity_id, case when regexp_matches(text, 'Unit [0-9]') then 'Unit ' || regexp_extract(text, 'Unit ([0-9]+)', 1) when regexp_matches(text, 'Area ') then 'Area B' else 'Substation' end as location from reports",
    "asset_extract": f"{_W} select activity_id, 'Line ' || regexp_extract(text, 'Line ([0-9]+)', 1) || '|' || regexp_extract(text, '((V|P|FT|K)-[0-9]+)', 1) as assets from reports",
    "quantity_extract": f"{_W} select activity_id, cast(regexp_extract(text, '; ([0-9]+)', 1) as double) as quantity, case when contains(text, ' of 40 joints') then 'of 40' else 'spools' end as unit from reports",
    "date_normalize": "select o_orderkey as activity_id, cast(o_orderdate as date) as day from orders",
    "work_type": "select o_orderkey as activity_id, case o_orderkey % 3 when 0 then 'erection' when 1 then 'hydrotest' else 'cable_pulling' end as kind, case o_orderkey % 3 when 0 then 'erection' when 1 then 'hydrotest' else 'cable pulling' end as planned from orders",
    "sentence_split": r"with l as (select doc_id, unnest(string_split(text, chr(10))) as line from documents), x as (select doc_id, unnest(regexp_split_to_array(line, '[.!]\s+')) as x from l) select doc_id, count(*) as sentences, cast(max(length(x)) as int) as longest from x where length(x) > 5 group by 1",
    "vector_topk": f"with {_VEC} select query_id, rank, item_id, {_r('s', 6)} as score from t where rank <= 5",
    "score_gap_routing": f"with {_VEC}, r as (select query_id as query, rank, {_r('s', 6)} as score from t where rank <= 2), g as (select *, score - lead(score) over (partition by query order by rank) as gap from r) select query, score, {_r('gap', 6)} as gap, case when score >= 0.85 then 'auto_linked' when score >= 0.65 then 'pending_review' else 'unmatched' end as decision from g where rank = 1",
    "threshold_sweep": f"with {_VEC}, c as (select {_r('s', 6)} as score, x = y as correct from t where rank = 1), h(auto, review) as (values (0.90, 0.70), (0.85, 0.65), (0.80, 0.60), (0.75, 0.55), (0.70, 0.50)) select cast(auto as double) as auto, cast(review as double) as review, count_if(score >= auto) as linked, count_if(score >= auto and not correct) as wrong, count_if(score < auto and score >= review) as reviewed, count_if(score < review) as unmatched from c, h group by 1, 2",
    "token_jaccard_topk": f"with w as (select item_id, list_distinct(regexp_extract_all(lower(text), '([a-z0-9]+)', 1)) as ws from benchmark), p as (select a.item_id as a, b.item_id as b, {_r('len(list_intersect(a.ws, b.ws)) / len(list_distinct(list_concat(a.ws, b.ws)))', 6)} as score from w a join w b on a.item_id <> b.item_id and len(list_intersect(a.ws, b.ws)) > 0) select a, b, score, cast(row_number() over (partition by a order by score desc, b) as int) as rank from p qualify rank <= 3",
    "dedupe_pairs": f"with {_near('lang', 0.7)} select * from q",
    "dedupe_pairs_all": f"with {_near('1', 0.5)} select * from q",
    "dedupe_groups": f"with recursive {_near('lang', 0.7)}, {_GREEDY}",
    "dedupe_groups_all": f"with recursive {_near('1', 0.5)}, {_GREEDY}",
    "quality_issues": f"with {_Q} select * from i",
    "parse_results": f"""with {_Q}, f as (select 'file-' || o_custkey as source_file, activity_id from o), n as (select source_file, count_if(severity = 'ERROR') as e, count_if(severity = 'WARNING') as w from i join f using (activity_id) group by 1)
select source_file, count(*) as activities, cast(coalesce(any_value(e), 0) as bigint) as errors, cast(coalesce(any_value(w), 0) as bigint) as warnings, coalesce(any_value(e), 0) = 0 as valid from f left join n using (source_file) group by 1""",
    "quality_rollup": f"with {_Q} select coalesce(issue_type, 'all') as issue_type, coalesce(severity, 'all') as severity, count(*) as n from i group by rollup (issue_type, severity)",
    "duplicate_ids": "select l_orderkey, l_linenumber, count(*) as n from lineitem group by 1, 2 having count(*) > 1",
    "orphans_anti": "select o_orderkey from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)",
    "existing_semi": "select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey)",
    "temporal_fit": f"{_W}, e as (select activity_id, min(event_date) as day from claims group by 1) select activity_id, case when day between planned_start and planned_finish then 0.05 when least(abs(date_diff('day', planned_start, day)), abs(date_diff('day', planned_finish, day))) <= 7 then 0.02 else 0.0 end::double as boost from activities join e using (activity_id)",
    "dependency_ready": "with d as (select p_partkey::bigint as k, p_size, list_distinct(case when p_size % 7 = 0 then [-5] else [p_partkey // 2, case when p_size > 25 then p_partkey - 1 else -1 end] end) as done from part), n as (select *, case when k % 5 = 0 then 0 else 2 end as preds, len(list_filter(list_distinct([k // 2, k - 1]), lambda x: list_contains(done, x))) as hit from d) select k, case when preds = 0 then 0.03 when hit = 2 then 0.05 when hit > 0 then 0.02 else 0.0 end::double as boost from n",
    "policy_argmax": f"{_W}, f as (select event_id, least(abs(value) / 1000, 1.0) as f0, (event_id % 10) / 10 as f1, case when status = 'ON_HOLD' then 1.0::double else 0.1::double end as f2, (event_id % 2)::double as f3 from claims), q as (select event_id, {_r('0.0 + ' + _DOTS[0], 6)} as a, {_r('0.0 + ' + _DOTS[1], 6)} as b, {_r('0.0 + ' + _DOTS[2], 6)} as c from f) select event_id, case when a >= b and a >= c then 'auto_link' when b >= c then 'ask_clarification' else 'send_to_planner' end as action from q",
    "tumbling_counts": f"with e as ({_WIN}, event_type, value from events) select w as window_start, w + interval '1 hour' as window_end, event_type, count(*) as n from e group by 1, 2, 3",
    "sliding_counts": f"with e as ({_WIN}, event_type from events), x as (select unnest([w, w - interval '1 hour']) as w, event_type from e) select w as window_start, w + interval '2 hours' as window_end, event_type, count(*) as n from x group by 1, 2, 3",
    "session_counts": """with e as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval '30 minutes' then 0 else 1 end as fresh from events),
s as (select *, sum(fresh) over (partition by user_id order by ts rows unbounded preceding) as k from e) select user_id, min(ts) as session_start, max(ts) + interval '30 minutes' as session_end, count(*) as n from s group by user_id, k""",
    "late_rows": "with a as (select event_id, case when event_id % 7 = 0 then ts - interval '2 days' else ts end as ts from events), e as (select event_id, ts, max(ts) over (order by event_id rows unbounded preceding) as seen from a) select event_id from e where ts < seen - interval '1 day'",
}
