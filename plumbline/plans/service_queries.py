"""Queries over review work in time: clarifications, decisions, weights before every decision."""

from __future__ import annotations

from pyspark.sql import functions as F

from plumbline.functions.numbers import dot, rounded
from plumbline.operators import graph as G
from plumbline.operators import linking as K
from plumbline.operators import search as Q
from plumbline.operators.review import ACTIONS, AGENT_WEIGHTS, explored
from plumbline.operators.scan import previous, row_number, scanned, weight_trace
from plumbline.plans import bindings as B
from plumbline.plans.history_queries import _r
from plumbline.streaming import clarify, decisions

PATIENCE = 20 * 60
NOW = "2024-01-02 00:00:00"
# Learning rate and bounds of the routing policy's weights.
RATE, LOW, HIGH = 0.05, -10.0, 10.0


def _messages(s, d):
    """A user's turn asks, an assistant's answers, ever more slowly within a conversation; some answers name an order."""
    c = B.table(s, d, "conversations")
    ts = F.lit("2024-01-01").cast("timestamp") + F.make_interval(hours=F.pmod("conv_id", F.lit(24)).cast("int"), mins=(3 * F.col("turn") * F.col("turn")).cast("int"))
    n = F.length("text")
    text = F.when(n % 3 == 0, F.concat(n.cast("string"), F.lit(" — "), F.col("text"))).otherwise(F.col("text"))
    kind = F.when(F.col("role") == "user", "question").when(F.col("role") == "assistant", "answer")
    return c.select(F.col("conv_id").alias("key"), F.col("turn").alias("seq"), ts.alias("ts"), kind.alias("kind"), text.alias("text"))


def _outcomes(s, d):
    return clarify.clarifications(_messages(s, d), PATIENCE, NOW)


def _rematched(s, d):
    return clarify.rematched(_outcomes(s, d), B.table(s, d, "orders").select(F.col("o_orderkey").cast("string").alias("activity_id")))


def _decisions(s, d):
    """A purchase approves, an error rejects, a click reassigns (some to nothing known), a signup is no decision that counts."""
    e = B.table(s, d, "events")
    t = F.col("event_type")
    what = F.when(t == "purchase", "approve").when(t == "error", "reject").when(t == "click", "reassign").when(t == "signup", "postpone")
    named = F.when(t == "click", F.when(F.col("event_id") % 5 == 0, None).when(F.col("event_id") % 7 == 0, -1).otherwise(F.floor(F.abs("value") * 10).cast("long")))
    return e.where(what.isNotNull()).select(F.col("event_id").alias("seq"), F.col("user_id").alias("event_id"), what.alias("decision"), named.alias("activity_id"), F.concat(F.lit("r"), F.col("event_id") % 4).alias("reviewer"))


def _review(s, d):
    m = B.table(s, d, "customer").select(F.col("c_custkey").alias("event_id"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_custkey") * 2).alias("matched_activity_id"))
    return decisions.review_state(_decisions(s, d), m, B.table(s, d, "orders").select(F.col("o_orderkey").alias("activity_id")))


def _chains(s, d):
    """A decision gives way to the next on the same event; the last of each chain stands."""
    rows = scanned(_decisions(s, d).select("seq", "event_id").withColumn("back", -F.col("seq")), ["event_id", "back"], later=previous(F.struct("event_id", "seq")))
    p = rows.select(F.col("seq").alias("id"), F.when(F.col("later.event_id") == F.col("event_id"), F.col("later.seq")).alias("next"))
    return decisions.live_heads(p)


def _steps(s, d):
    c = B.claims(s, d).where("status is not null")
    k = F.col("event_id")
    f = [F.least(F.abs("value") / 1000, F.lit(1.0)), F.pmod(k, F.lit(10)) / 10, F.when(F.col("status") == "ON_HOLD", 1.0).otherwise(0.1), F.pmod(k, F.lit(4)) / 4, F.lit(0.3), F.pmod(k, F.lit(2)).cast("double"), F.pmod(k, F.lit(5)) / 5, F.pmod(k, F.lit(3)).cast("double") / 4]
    reward = F.when(k % 3 == 0, 2.0).when(k % 3 == 1, -0.5).otherwise(F.when(k % 2 == 0, 0.8).otherwise(-2.0))
    return c.select("seq", F.pmod(F.floor(k / 3), F.lit(3)).cast("int").alias("action"), reward.alias("reward"), F.array(*f).alias("features"))


def _trace(s, d):
    """What the policy would choose before each step, by the weights it had then, and what the step did to the weights."""
    steps = _steps(s, d)
    t = weight_trace(steps, AGENT_WEIGHTS, RATE, LOW, HIGH).join(steps.select("seq", "features"), "seq")
    t = scanned(t, ["seq"], n=row_number())
    k = len(AGENT_WEIGHTS[0])
    q = F.array(*[rounded(dot(F.slice("weights", i * k + 1, k), F.col("features")), 6) for i in range(len(AGENT_WEIGHTS))])
    t = t.withColumn("q", q).withColumn("updates", F.col("n") - 1)
    wild = explored(F.col("seq"), F.col("updates"), "policy", len(ACTIONS))
    t = t.withColumn("wild", wild)
    best = F.array_position("q", F.array_max("q")).cast("int") - 1
    total = lambda c: rounded(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 6)
    named = lambda i: F.get(F.array(*map(F.lit, ACTIONS)), i)
    return t.select("seq", "updates", named(F.coalesce("wild", best)).alias("chosen"), F.col("wild").isNotNull().alias("explored"), F.array_max("q").alias("best_q"), named(F.col("action")).alias("action"), total("before").alias("before"), total("after").alias("after"))


def _records(s, d):
    """A vector is a record of the discipline of its label; every ninth isn't verified; its order tells how late it was."""
    v, o = B.table(s, d, "embeddings"), B.table(s, d, "orders")
    k, actual = F.col("vec_id"), (F.lit(22) + F.col("o_custkey") % 20).cast("int")
    kind = F.when(k % 2 == 0, "t0").otherwise(F.concat(F.lit("t"), k % 40))
    return v.join(o, k == o.o_orderkey).select(
        k.alias("id"), F.col("embedding").alias("v"), F.concat(F.lit("D"), F.col("label") % 5).alias("discipline"), kind.alias("activity_type"),
        F.when(k % 9 == 0, "provisional").otherwise("verified").alias("record_quality"), F.lit(30).alias("planned_days"), actual.alias("actual_days"), (actual - 30).alias("variance_days"),
        (actual > 30).alias("delayed"), F.when((actual > 30) & (k % 11 > 0), F.col("o_orderpriority")).alias("delay_cause"),
    )


def _planned(s, d):
    """Every seventh vector is a planned activity too; some have a discipline without records, some no type."""
    k = F.col("id")
    return _records(s, d).where(k % 7 == 0).select(k.alias("activity_id"), "v", F.when(k % 35 == 0, "dx").otherwise(F.lower("discipline")).alias("discipline"), F.when(k % 3 > 0, F.col("activity_type")).alias("activity_type"))


def _found(s, d, keep):
    q = _records(s, d).where("id % 20 = 0").select("id", "v")
    return Q.semantic_search(q, _records(s, d), keep)


def _probed(s, d):
    """The inverted file's hits that the exact search has too, of all that it has."""
    r = Q.usable(_records(s, d), "verified")
    q = _records(s, d).where("id % 20 = 0").select("id", "v")
    return Q.probed_search(q, Q.inverted_file(r, 32), 5, 16).select("query_id", "rank", "item_id", rounded(F.col("score"), 6).alias("score"))


def _risks(s, d):
    return Q.risk_from_records(_planned(s, d), _records(s, d))


def _evidence(s, d):
    p = _planned(s, d)
    hits = Q.semantic_search(p.select(F.col("activity_id").alias("id"), "v"), _records(s, d), 8)
    rows = Q.evidence(hits, _records(s, d), ["discipline", "variance_days"])
    said = F.array_join(F.transform("records", lambda r: F.concat_ws(":", r["record_id"].cast("string"), r["discipline"], r["variance_days"].cast("string"))), " ")
    risk = _risks(s, d).select(F.col("activity_id").alias("query_id"), "risk_level", "path")
    return risk.join(rows, "query_id", "left").select(F.col("query_id").alias("activity_id"), "risk_level", "path", F.size("records").alias("n"), said.alias("records"))


def _written(s, d):
    """Documents as reports of whatever shape: two of three name their source as a tag, some have their text under another name."""
    t, k = B.table(s, d, "documents"), F.col("doc_id")
    o = B.table(s, d, "orders").select(F.col("o_orderkey").alias("doc_id"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm").alias("date"))
    text = F.when(k % 3 > 0, F.concat(F.upper(F.regexp_replace("source", "([0-9])", "-$1").substr(1, 5)), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    return t.join(o, "doc_id", "left").select(
        k.alias("event_id"), F.when(k % 4 > 0, text).otherwise(F.lit("")).alias("raw_text"), F.when(k % 4 == 0, text).alias("description"), F.when(k % 5 > 0, F.upper("lang")).alias("discipline"),
        F.when(k % 7 > 0, F.col("source")).alias("location"), "date", F.when(k % 2 == 0, "completed").alias("status_hint"),
    )


def _reported(s, d):
    return K.coalesced_events(_written(s, d)).withColumn("event_id", F.col("event_id").cast("long"))


def _items(s, d):
    """Benchmark passages as planned activities, with the days of the orders of their numbers."""
    b, k = B.table(s, d, "benchmark"), F.col("item_id").cast("long")
    o = B.table(s, d, "orders").select(F.col("o_orderkey").alias("k"), F.to_date("o_orderdate").alias("day"), "o_orderstatus")
    lang = F.get(F.array(*map(F.lit, ["en", "de", "fr", "es"])), F.pmod(k, F.lit(4)).cast("int"))
    out = b.join(o, k == F.col("k"), "left").select(
        k.alias("activity_id"), F.when(k % 2 == 0, F.concat(F.col("text"), F.lit(" SRC-"), (k % 10).cast("string"))).otherwise(F.col("text")).alias("activity_name"), lang.alias("discipline"),
        F.concat(F.lit("Area src"), (k % 20).cast("string")).alias("location"), F.when(k % 3 == 0, "SRC.1").otherwise("X.1").alias("wbs_id"), F.col("day").alias("planned_start"), F.date_add("day", 30).alias("planned_finish"),
        F.when(k % 4 == 0, F.array().cast("array<bigint>")).otherwise(F.array(k - 1, k + 1)).alias("predecessors"), "o_orderstatus",
    )
    return out.drop("o_orderstatus"), out.where("o_orderstatus = 'F'").select("activity_id")


def _matched(s, d):
    a, done = _items(s, d)
    return K.hybrid_match(_reported(s, d), a, done)


def _matches(s, d):
    m = _matched(s, d)
    shown = F.array_join(F.transform("candidates", lambda c: F.concat_ws(":", c["activity_id"].cast("string"), F.format_number(c["score"], 3))), " ")
    first = F.get("candidates", F.lit(0))["evidence"]
    said = F.array_join(F.transform(F.filter(first, lambda e: e["matched"]), lambda e: e["signal"]), ",")
    return m.select("event_id", "activity_id", "confidence", "decision", F.col("question").isNotNull().alias("asked"), shown.alias("candidates"), said.alias("signals"))


def _weights(s, d):
    """Weights after the index of three fifths of the passages has been added to twice, one text having been another before."""
    b = B.table(s, d, "benchmark").select(F.col("item_id").cast("long").alias("id"), "text")
    first = b.where("id % 5 < 3").withColumn("text", F.when(F.col("id") % 10 == 1, F.concat(F.lit("before it was changed "), F.col("text"))).otherwise(F.col("text")))
    index = K.term_index(first).add(b.where("id % 5 = 3")).add(b.where("id % 5 = 4 or id % 10 = 1"))
    return index.weights().select("id", "token", rounded(F.col("weight"), 6).alias("weight"))


def _options(s, d):
    """What is missing of an event is read off its number; its discipline and location are those of activities, or of none."""
    e = B.table(s, d, "events")
    k = F.col("event_id")
    missing = F.when(k % 6 < 3, F.array(F.lit("status"), F.lit("asset"))).when(k % 6 == 3, F.array(F.lit("discipline"), F.lit("status"))).when(k % 6 == 4, F.array(F.lit("status"))).otherwise(F.when(k % 4 == 1, F.array(F.lit("location"))).otherwise(F.array().cast("array<string>")))
    asked = e.select(
        k.alias("event_id"), missing.alias("missing"), F.when(k % 5 == 0, None).when(k % 11 == 0, "nothing").otherwise(F.get(F.array(*map(F.lit, ["building", "AUTOMOBILE", "machinery"])), (k % 3).cast("int"))).alias("discipline"),
        F.when(k % 7 < 3, F.substring(F.concat(F.lit("n"), F.col("event_type")), 1, 1)).alias("location"), F.when(k % 13 == 0, "1").alias("activity_type"),
    )
    a = B.activities(s, d).withColumn("activity_name", F.concat(F.lit("order "), F.col("activity_id").cast("string")))
    return K.clarification_options(asked, a).select("event_id", "field", F.array_join("options", "|").alias("options"))


def _tracked(s, d):
    c = B.table(s, d, "events")
    k = F.col("event_id")
    state = F.get(F.array(*map(F.lit, ["auto_linked", "approved", "rejected", "superseded", "pending_review"])), (k % 5).cast("int"))
    return c.select(k.alias("event_id"), state.alias("link_state"), F.when(k % 5 == 1, F.col("user_id")).alias("linked_activity_id"), F.when(k % 9 > 0, F.floor(F.abs("value") * 3).cast("long")).alias("matched_activity_id"), rounded(F.least(F.abs("value") / 1000, F.lit(1.0)), 3).alias("match_confidence"))


def _shown(s, d):
    names = B.table(s, d, "part").select(F.col("p_partkey").cast("long").alias("activity_id"), F.col("p_name").alias("activity_name"))
    return K.public_events(_tracked(s, d), names)


def _nodes(s, d):
    """Suppliers' codes, region.nation.supplier; most nations and no regions but one have a row of their own."""
    p, n = B.table(s, d, "supplier"), B.table(s, d, "nation")
    code = F.concat_ws(".", F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string"), F.col("s_suppkey").cast("string"))
    leaf = p.join(n, p.s_nationkey == n.n_nationkey).select(code.alias("code"), F.col("s_name").alias("name"), F.lit(None).cast("string").alias("discipline"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_name")).alias("location"))
    mid = n.where("n_nationkey % 4 > 0").select(F.concat_ws(".", F.col("n_regionkey").cast("string"), F.col("n_nationkey").cast("string")).alias("code"), F.col("n_name").alias("name"), F.when(F.col("n_nationkey") % 3 == 0, "civil").alias("discipline"), F.col("n_name").alias("location"))
    top = B.table(s, d, "region").where("r_regionkey = 1").select(F.col("r_regionkey").cast("string").alias("code"), F.col("r_name").alias("name"), F.lit("piping").alias("discipline"), F.lit(None).cast("string").alias("location"))
    return G.wbs_nodes(leaf.unionByName(mid).unionByName(top))


QUERIES = {
    "hybrid_match": _matches,
    "match_links": lambda s, d: K.links(_matched(s, d), _reported(s, d)),
    "link_lookup": lambda s, d: K.link_lookup(K.links(_matched(s, d), _reported(s, d)), "activity_id").select("activity_id", F.array_join(F.col("links").cast("array<string>"), ",").alias("events")),
    "term_index_added": _weights,
    "clarification_options": _options,
    "public_events": _shown,
    "wbs_nodes": _nodes,
    "semantic_search": lambda s, d: _found(s, d, 5).select("query_id", "rank", "item_id", rounded(F.col("score"), 6).alias("score")),
    "semantic_search_probed": _probed,
    "risk_assess_full": _risks,
    "risk_evidence": _evidence,
    "clarification_outcomes": _outcomes,
    "clarification_rematch": _rematched,
    "review_state": _review,
    "decision_chains": _chains,
    "policy_trace": _trace,
}

_MESSAGES = """m as (select conv_id as key, turn as seq, timestamp '2024-01-01' + to_hours(cast(conv_id % 24 as int)) + to_minutes(cast(3 * turn * turn as int)) as ts,
case role when 'user' then 'question' else 'answer' end as kind, case when length(text) % 3 = 0 then length(text) || ' — ' || text else text end as text from conversations where role in ('user', 'assistant')),
n as (select *, lead({k: kind, s: seq, t: ts, x: text}) over w as nxt, lag({k: kind, s: seq, t: ts}) over w as prv from m window w as (partition by key order by ts, seq)),
g as (select *, epoch(nxt.t) - epoch(ts) as ahead, epoch(ts) - epoch(prv.t) as behind from n),
o as (select key, seq, text, nxt, ahead, kind, case when kind = 'answer' then 'unasked' when ahead <= 1200 then case nxt.k when 'answer' then 'answered' else 'superseded' end
  when epoch(timestamp '2024-01-02') - epoch(ts) <= 1200 then 'open' else 'expired' end as outcome from g where kind = 'question' or not coalesce(prv.k = 'question' and behind <= 1200, false)),
outcomes as (select key, case when kind = 'question' then seq end as question_seq, outcome, case when kind = 'answer' then seq when outcome = 'answered' then nxt.s end as answer_seq,
  case when kind = 'answer' then text when outcome = 'answered' then nxt.x end as answer, case when outcome = 'answered' then cast(ahead as bigint) end as waited from o)"""
_DECIDED = """d as (select event_id as seq, user_id as event_id, case event_type when 'purchase' then 'approve' when 'error' then 'reject' when 'click' then 'reassign' when 'signup' then 'postpone' end as decision,
case when event_type = 'click' then case when event_id % 5 = 0 then null when event_id % 7 = 0 then -1 else cast(floor(abs(value) * 10) as bigint) end end as activity_id, 'r' || (event_id % 4) as reviewer from events
where event_type in ('purchase', 'error', 'click', 'signup'))"""
_F = "[least(abs(value) / 1000, 1.0), (event_id % 10) / 10, case when status = 'ON_HOLD' then 1.0::double else 0.1::double end, (event_id % 4) / 4, 0.3::double, (event_id % 2)::double, (event_id % 5) / 5, (event_id % 3) / 4]"
_ACTIONS = "[" + ", ".join(f"'{a}'" for a in ACTIONS) + "]"
_START = ", ".join("[" + ", ".join(f"{x}::double" for x in w) + "]" for w in AGENT_WEIGHTS)

_TOKENS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{M}}\p{{N}}_]{{2,}}')"
_TERMS = "list_concat({w}, list_transform(range(1, greatest(len({w}), 1)), lambda i: {w}[i] || ' ' || {w}[i + 1]))"
_IDS = r"(?i)\b([A-Z]+-\d+|Line\s+\d+|Unit\s+\d+|Area\s+[A-Z])\b"
_MATCH = rf"""ev0 as (select doc_id as k, case when doc_id % 3 > 0 then upper(substr(regexp_replace(source, '([0-9])', '-\1'), 1, 5)) || ' ' || text else text end as event_text, case when doc_id % 5 > 0 then upper(lang) end as discipline,
  case when doc_id % 7 > 0 then source end as location, cast(o_orderdate as date) as day, case when doc_id % 2 = 0 then 'completed' else 'unknown' end as status_hint from documents left join orders on o_orderkey = doc_id),
ev as materialized (select *, regexp_extract_all(event_text, '{_IDS}', 1) as ids, len(list_filter(regexp_split_to_array(trim(event_text), '\s+'), lambda x: x <> '')) <= 6 as vague from (select * replace (coalesce(event_text, '') as event_text) from ev0)),
act as materialized (select item_id::bigint as id, case when item_id % 2 = 0 then text || ' SRC-' || (item_id % 10) else text end as name, ['en', 'de', 'fr', 'es'][(item_id % 4 + 1)::int] as discipline, 'Area src' || (item_id % 20) as location,
  case when item_id % 3 = 0 then 'SRC.1' else 'X.1' end as wbs, cast(o_orderdate as date) as start, cast(o_orderdate as date) + 30 as finish, case when item_id % 4 = 0 then [] else [item_id - 1, item_id + 1] end as preds, o_orderstatus = 'F' as done
  from benchmark left join orders on o_orderkey = item_id),
ready as (select a.id, case when len(a.preds) = 0 then 0.03::double when count(b.id) = len(a.preds) then 0.05::double when count(b.id) > 0 then 0.02::double else 0.0::double end as dep from act a left join act b on b.done and list_contains(a.preds, b.id) group by a.id, a.preds),
aw as (select id, {_TOKENS.format("concat_ws(' ', name, discipline, location, wbs)")} as w from act), ak as (select id, unnest({_TERMS.format(w='w')}) as token from aw),
atf as (select id, token, count(*) as tf from ak group by 1, 2), df as (select token, ln((1 + (select count(*) from act)) / (1 + count(*))) + 1 as idf from atf group by 1),
ax as (select id, token, tf * idf as w from atf join df using (token)), an as (select id, sqrt(sum(w * w)) as norm from ax group by 1), awt as materialized (select id, token, w / norm as w from ax join an using (id)),
ew as (select k, {_TOKENS.format('event_text')} as w from ev), ek as (select k, unnest({_TERMS.format(w='w')}) as token from ew), ex as (select k, token, count(*) * first(idf) as w from ek join df using (token) group by 1, 2),
en as (select k, sqrt(sum(w * w)) as norm from ex group by 1), sim as (select k, id, sum(ex.w / norm * awt.w) as s from ex join en using (k) join awt using (token) group by 1, 2),
st0 as materialized (select *, row_number() over (partition by k order by {_r('s', 8)} desc, id) as place from sim qualify place <= 10), held as (select ev.k, coalesce(list(st0.id) filter (where st0.id is not null), []) as held from ev left join st0 using (k) group by 1),
pool as (select list(id order by id)[1:20] as ids from act), fill as (select k, list_filter(ids, lambda x: not list_contains(held, x))[1 : 10 - len(held)] as more, len(held) as n from held, pool where len(held) < 10),
st as (select k, id, s, place from st0 union all select k, more[i], 0.0::double, n + i from (select k, more, n, unnest(range(1, len(more) + 1)) as i from fill)),
sc as materialized (select st.k, st.id, place, s, case when len(list_filter(ids, lambda x: contains(upper(name), upper(x)))) > 0 then 0.20::double else 0 end as b1, case when lower(ev.discipline) = lower(act.discipline) then 0.15::double else 0 end as b2,
  case when contains(lower(act.location), lower(ev.location)) then 0.10::double else 0 end as b3, case when len(list_filter(ids, lambda x: regexp_matches(x, '^[A-Za-z]+-\d+$') and starts_with(wbs, upper(substr(regexp_extract(x, '^([A-Za-z]+)', 1), 1, 3))))) > 0 then 0.05::double else 0 end as b4,
  case when day between start and finish then 0.05::double when least(abs(date_diff('day', start, day)), abs(date_diff('day', finish, day))) <= 7 then 0.02::double else 0 end as b5, dep as b6
  from st join ev using (k) join act using (id) join ready using (id)),
rk as (select *, least(1.0, s + b1 + b2 + b3 + b4 + b5 + b6) as score, row_number() over (partition by k order by {_r('least(1.0, s + b1 + b2 + b3 + b4 + b5 + b6)', 8)} desc, place) as rank from sc),
ma as (select k, max(score) as s, max(score) filter (where rank = 2) as second, string_agg(id || ':' || printf('%.3f', {_r('score', 3)}), ' ' order by rank) as candidates, min_by(id, rank) as best,
  min_by(concat_ws(',', 'semantic_similarity', case when b1 > 0 then 'identifier' end, case when b2 > 0 then 'discipline' end, case when b3 > 0 then 'location' end, case when b4 > 0 then 'wbs' end, case when b5 > 0 then 'temporal' end, case when b6 > 0 then 'dependency' end), rank) as signals
  from rk where rank <= 3 group by 1),
mt as (select ma.*, vague and len(ids) = 0 and coalesce(s - second < 0.08, false) as unclear, status_hint from ma join ev using (k)),
matches as (select k as event_id, case when not unclear then best end as activity_id, {_r('s', 3)} as confidence, case when unclear then 'clarification_needed' when s >= 0.85 then 'auto_linked' when s >= 0.65 then 'pending_review' else 'unmatched' end as decision,
  unclear as asked, candidates, signals, status_hint from mt)"""
_FULL = rf"""aw as (select item_id::bigint as id, {_TOKENS.format('text')} as w from benchmark), ak as (select id, unnest({_TERMS.format(w='w')}) as token from aw), atf as (select id, token, count(*) as tf from ak group by 1, 2),
df as (select token, ln((1 + (select count(*) from aw)) / (1 + count(*))) + 1 as idf from atf group by 1), ax as (select id, token, tf * idf as w from atf join df using (token)), an as (select id, sqrt(sum(w * w)) as norm from ax group by 1)"""
_ASKED = f"""q as (select event_id, case when event_id % 6 < 3 then 'asset' when event_id % 6 = 3 then 'discipline' when event_id % 6 = 4 then 'status' when event_id % 4 = 1 then 'location' end as field,
  case when event_id % 5 = 0 then null when event_id % 11 = 0 then 'nothing' else ['building', 'automobile', 'machinery'][(event_id % 3 + 1)::int] end as d, case when event_id % 7 < 3 then 'n' end as l, case when event_id % 13 = 0 then '1' end as t from events),
k as (select distinct d, l, t from q where field = 'asset'), f as (select k.d, k.l, k.t, list(activity_id order by activity_id)[1:5] as ids from k join activities a on (k.d is null or lower(a.discipline) = k.d) and (k.l is null or contains(lower(location), k.l)) and (k.t is null or contains('order ' || activity_id, k.t)) group by 1, 2, 3)"""
_RECORDS = """rec as (select vec_id as id, cast(embedding as double[]) as v, 'D' || (label % 5) as discipline, case when vec_id % 2 = 0 then 't0' else 't' || (vec_id % 40) end as activity_type, vec_id % 9 > 0 as verified,
  cast(22 + o_custkey % 20 as int) as actual_days, cast(o_custkey % 20 - 8 as int) as variance_days, o_custkey % 20 > 8 as delayed, case when o_custkey % 20 > 8 and vec_id % 11 > 0 then o_orderpriority end as cause from embeddings join orders on vec_id = o_orderkey),
ver as (select * from rec where verified)"""
_HITS = "(select *, cast(row_number() over (partition by {by} order by cast(round(cast(s as decimal(38,10)), 8) as double) desc, item_id) as int) as rank from {pairs})"
_RISKS = f"""act as (select id as activity_id, v, case when id % 35 = 0 then 'dx' else lower(discipline) end as d, case when id % 3 > 0 then activity_type end as t from rec where id % 7 = 0),
own as (select activity_id, d, count(r.id) as own from act left join ver r on lower(r.discipline) = act.d and (act.t is null or act.t = r.activity_type) group by 1, 2),
ex as (select activity_id, r.*, row_number() over (partition by activity_id order by r.id) as pos from act join ver r on lower(r.discipline) = act.d and (act.t is null or act.t = r.activity_type)),
pr as (select activity_id, r.id as item_id, list_cosine_similarity(act.v, r.v) as s from act join own using (activity_id) join ver r on own < 3),
se as (select h.activity_id, r.*, rank as pos from {_HITS.format(by="activity_id", pairs="pr")} h join ver r on r.id = h.item_id join own o on o.activity_id = h.activity_id where rank <= 20 and lower(r.discipline) = o.d),
path as (select activity_id, case when own >= 3 then 'exact' when activity_id in (select activity_id from se) then 'semantic' when own > 0 then 'few' else 'none' end as path from own),
got as (select ex.*, path from ex join path using (activity_id) where path in ('exact', 'few') and pos <= 20 union all select se.*, path from se join path using (activity_id) where path = 'semantic'),
st as (select activity_id, count(*) as n, {_r('count_if(delayed) / count(*)', 3)} as delay_frequency, {_r('avg(variance_days)', 2)} as mean_variance, 30.0::double as mean_planned, {_r('avg(actual_days)', 2)} as mean_actual from got group by 1),
ca as (select activity_id, cause, count(*) as k, min(pos) as first from got where cause is not null group by 1, 2), cs as (select activity_id, string_agg(cause || '=' || k, ',' order by k desc, first) as causes from ca group by 1),
risks as (select activity_id, path, coalesce(n, 0) as n, delay_frequency, mean_variance, mean_planned, mean_actual, case when n is null then 'UNKNOWN' when delay_frequency >= 0.60 then 'HIGH' when delay_frequency >= 0.35 then 'MEDIUM' else 'LOW' end as risk_level,
  case when n is null then 'none' when n >= 10 then 'high' when n >= 4 then 'medium' else 'low' end as confidence,
  cast(coalesce(greatest(0, case when delay_frequency >= 0.60 then greatest(ceil(mean_variance), ceil({_r('mean_variance * 1.2', 6)})) else ceil(mean_variance) end), 0) as bigint) as buffer, coalesce(causes, '') as causes
  from path left join st using (activity_id) left join cs using (activity_id))"""

ORACLE = {
    "hybrid_match": f"with {_MATCH} select * exclude (status_hint) from matches",
    "link_lookup": f"with {_MATCH} select activity_id, string_agg(event_id::varchar, ',' order by confidence desc, event_id) as events from matches where decision = 'auto_linked' group by 1",
    "match_links": f"with {_MATCH} select event_id, activity_id, confidence, status_hint from matches where decision = 'auto_linked'",
    "term_index_added": f"with {_FULL} select id, token, {_r('w / norm', 6)} as weight from ax join an using (id)",
    "clarification_options": f"""with {B.SQL}, {_ASKED}, o as (select q.*, coalesce(ids, (select list(activity_id order by activity_id)[1:5] from activities)) as ids from q left join f on q.d is not distinct from f.d and q.l is not distinct from f.l and q.t is not distinct from f.t)
select event_id, field, case field when 'asset' then array_to_string(list_transform(ids, lambda x: x || ' — order ' || x), '|') when 'discipline' then 'piping|electrical|civil|instrumentation|mechanical' when 'status' then 'started|in_progress|completed' end as options from o where field is not null""",
    "public_events": f"""with x as (select event_id, ['auto_linked', 'approved', 'rejected', 'superseded', 'pending_review'][(event_id % 5 + 1)::int] as link_state, case when event_id % 5 = 1 then user_id end as linked,
  case when event_id % 9 > 0 then cast(floor(abs(value) * 3) as bigint) end as proposed, {_r('least(abs(value) / 1000, 1.0)', 3)} as match_confidence from events), y as (select *, coalesce(linked, case when link_state not in ('rejected', 'superseded') then proposed end) as shown from x)
select event_id, link_state, proposed as proposed_activity_id, match_confidence, shown as matched_activity_id, p_name as matched_activity_name from y left join part on p_partkey = shown""",
    "wbs_nodes": """with leaf as (select n_regionkey as r, n_nationkey as n, s_suppkey as s, s_name, n_name from supplier join nation on s_nationkey = n_nationkey),
reg as (select distinct r, case when r = 1 then (select r_name from region where r_regionkey = 1) else r::varchar end as name, case when r = 1 then 'piping' end as disc from (select r from leaf union select n_regionkey from nation where n_nationkey % 4 > 0 union select 1)),
nat as (select distinct x.r, x.n, case when x.n % 4 > 0 then n_name else x.r || '.' || x.n end as name, case when x.n % 4 > 0 and x.n % 3 = 0 then 'civil' end as disc, case when x.n % 4 > 0 then n_name end as loc from (select r, n from leaf union select n_regionkey, n_nationkey from nation where n_nationkey % 4 > 0) x join nation on n_nationkey = x.n)
select r::varchar as code, null as parent, name, 1::int as level, name as path, disc as discipline, null as location, r <> 1 as made from reg
union all select r || '.' || n, r::varchar, nat.name, 2, reg.name || ' > ' || nat.name, coalesce(nat.disc, reg.disc), loc, n % 4 = 0 from nat join reg using (r)
union all select r || '.' || n || '.' || s, r || '.' || n, s_name, 3, reg.name || ' > ' || nat.name || ' > ' || s_name, coalesce(nat.disc, reg.disc), coalesce(case when s % 3 = 0 then s_name end, nat.loc), false from leaf join nat using (r, n) join reg using (r)""",
    "semantic_search": f"with {_RECORDS}, p as (select a.id as query_id, b.id as item_id, list_cosine_similarity(a.v, b.v) as s from rec a join ver b on a.id % 20 = 0) select query_id, rank, item_id, {_r('s', 6)} as score from {_HITS.format(by='query_id', pairs='p')} where rank <= 5",
    "risk_assess_full": f"with {_RECORDS}, {_RISKS} select * from risks",
    "risk_evidence": f"""with {_RECORDS}, {_RISKS}, p as (select activity_id, b.id as item_id, list_cosine_similarity(a.v, b.v) as s from act a join ver b on true),
h as (select activity_id, count(*) as n, string_agg(item_id || ':' || discipline || ':' || variance_days, ' ' order by rank) as records from {_HITS.format(by='activity_id', pairs='p')} join ver on id = item_id where rank <= 8 group by 1)
select activity_id, risk_level, path, cast(h.n as int) as n, records from risks join h using (activity_id)""",
    "clarification_outcomes": f"with {_MESSAGES} select * from outcomes",
    "clarification_rematch": f"""with {_MESSAGES} select key, question_seq, answer_seq, waited, cast(o_orderkey as varchar) as activity_id, case when o_orderkey is null then trim(answer) end as filled
from outcomes left join orders on cast(o_orderkey as varchar) = split_part(trim(answer), ' ', 1) where outcome = 'answered'""",
    "review_state": f"""with {_DECIDED}, c as (select d.*, case when c_custkey % 3 > 0 then c_custkey * 2 end as match, case when c_custkey is null or decision = 'postpone' then false when decision = 'approve' then c_custkey % 3 > 0
  when decision = 'reassign' then activity_id is not null and o_orderkey is not null else true end as good from d left join customer on c_custkey = event_id left join orders on o_orderkey = activity_id),
l as (select event_id, max_by({{d: decision, a: case decision when 'approve' then match when 'reassign' then activity_id end, r: reviewer}}, seq) filter (where good) as l, count_if(good) as decisions, count_if(not good) as refused from c group by 1)
select event_id, case when l.d in ('approve', 'reassign') then 'approved' when l.d = 'reject' then 'rejected' end as link_state, l.a as linked_activity_id, l.r as reviewer, decisions, refused from l""",
    "decision_chains": f"with {_DECIDED} select seq as id, max(seq) over (partition by event_id) as head, count(*) over (partition by event_id order by seq desc) - 1 as steps from d",
    "policy_trace": f"""with recursive {B.SQL}, s as materialized (select row_number() over (order by seq) as n, seq, cast((event_id // 3) % 3 as int) as a,
  case event_id % 3 when 0 then 2.0::double when 1 then -0.5::double else case when event_id % 2 = 0 then 0.8::double else -2.0::double end end as r, {_F} as f from claims where status is not null),
w(n, seq, a, f, before, w) as (select 0::bigint, null::bigint, 0, null::double[], null::double[][], [{_START}]
  union all select s.n, s.seq, s.a, s.f, w.w, list_transform([0, 1, 2], lambda i: case when i = s.a then list_transform(list_zip(w.w[i + 1], s.f), lambda z: greatest(-10.0::double, least(10.0::double, z[1] + 0.05::double * s.r * z[2]))) else w.w[i + 1] end)
  from w join s on s.n = w.n + 1),
q as (select *, list_transform(before, lambda v: {_r('list_sum(list_transform(list_zip(v, f), lambda z: z[1] * z[2]))', 6)}) as q, md5('policy:' || seq) as h from w where n > 0),
e as (select *, case when cast('0x' || substr(h, 1, 8) as bigint) / 4294967296.0::double < greatest(0.02::double, 0.10::double * pow(0.99::double, n - 1)) then cast('0x' || substr(h, 9, 8) as bigint) % 3 end as wild from q)
select seq, n - 1 as updates, {_ACTIONS}[coalesce(wild + 1, list_position(q, list_max(q)))] as chosen, wild is not null as explored, list_max(q) as best_q, {_ACTIONS}[a + 1] as action,
  {_r('list_sum(before[a + 1])', 6)} as before, {_r('list_sum(w[a + 1])', 6)} as after from e""",
}
