"""Extraction over turns of conversations and benchmark items, and its score against labelled truth read from files.

The tables' prose names no field work, so that a note in the words of reports stands behind each text; notes go through every
phrase, work word, keyword, tag, place, quantity and form of dates, and leave some out. The SQL reads the whole texts too.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from plumbline.functions import text as T
from plumbline.operators import evaluation as E
from plumbline.operators.scan import scratch_folder
from plumbline.plans import bindings as B
from plumbline.plans.history_queries import _r
from plumbline.sources import reports

NAMES = ["V-301B", "P-7 pump", "P-8", "K-12", "M-3 panel", "M-4", "CT-4B", "PC-9", "IC-2", "FT-101", "PG-101", "CV-5", "PS-6", "S-101", "F-11", "Line 24-XX", "line 9", "L-7", "24-XX"]
KEYWORDS = [w for table in (T.DISCIPLINE_WORDS, T.EQUIPMENT) for words in table.values() for w in words]
#: (list, divisor of the key, every how many keys the part is left out; 0: never)
PARTS = [
    (list(T.STATUS_PHRASES), 1, 5), (["not yet here", "unable to go", "went on"], 5, 0), (list(T.WORK_WORDS), 2, 7), (KEYWORDS, 3, 4), (NAMES, 2, 3),
    (["Unit 4", "Area B", "substation", "Fabrication Yard", "Pipe Rack C", "pipe rack", "there"], 1, 0), (["3 of 12", "40 metres", "2.5 m", "6 spools", "9 joints", "75 %", "80 percent", "Line 24 of 30", "some"], 2, 0),
    (["2024-03-05", "5-3-2024", "05/03/2024", "5 March 2024", "7 Mar 2024", "March 5, 2024", "Mar 7 2024", "31-13-2024", "then"], 3, 0),
]
KINDS = ["piping", "electrical", "civil", "instrumentation", "mechanical", "works"]
MARKS = ["exact identifier", "", "status is blocked", "asset by its line"]
FILES = 5


def _note(k):
    """The note of a key: one entry of each list."""
    parts = []
    for values, by, out in PARTS:
        at = F.pmod(F.floor(k / by).cast("long"), F.lit(len(values))).cast("int")
        one = F.get(F.array(*map(F.lit, values)), at)
        parts.append(F.when(k % out > 0, one) if out else F.when(k % 5 == 0, one) if by == 5 else one)
    return F.concat_ws(" ", *parts)


def _turns(s, d):
    k = F.col("conv_id") * 17 + F.col("turn")
    return B.table(s, d, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.concat_ws("\n", "text", _note(k)).alias("sentence"))


def _turn_extraction(s, d):
    out = reports.extracted(_turns(s, d))
    return out.select("conv_id", "turn", "status", "activity_type", "discipline", "asset", "location", "quantity", "unit", "event_date", "confidence", F.array_join("missing", ",").alias("missing"), "needs_clarification")


def _labelled(s, d):
    """Labels are written out as arrays in several files and read back; reports leave out the first word of what is labelled."""
    k = F.col("item_id").cast("long")
    b = B.table(s, d, "benchmark").withColumn("k", k)
    one = lambda values, by: F.get(F.array(*map(F.lit, values)), F.pmod(F.floor(k / by).cast("long"), F.lit(len(values))).cast("int"))
    entry = F.struct(
        k.cast("string").alias("event_id"), F.concat_ws("\n", "text", _note(k)).alias("input_text"), F.when(k % 10 == 0, "AMBIGUOUS").otherwise(F.concat(F.lit("A"), k)).alias("correct_activity_id"),
        F.concat(F.lit("More "), one(KINDS, 1)).alias("correct_activity_name"), one(MARKS, 2).alias("note"), F.lit("easy").alias("difficulty"),
    )
    path = f"{scratch_folder(s)}/truth-{uuid.uuid4().hex}"
    rows = b.select(F.pmod(k, F.lit(FILES)).alias("file"), k.alias("k"), F.to_json(entry).alias("line"))
    first = rows.groupBy("file").agg(F.min("k").alias("least"), F.max("k").alias("most"))
    lines = rows.join(first, "file").select("file", "k", F.concat(F.when(F.col("k") == F.col("least"), "[").otherwise(","), "line", F.when(F.col("k") == F.col("most"), "]").otherwise("")).alias("value"))
    lines.repartition("file").sortWithinPartitions("file", "k").select("file", "value").write.partitionBy("file").text(path)
    said = b.select(k.alias("id"), F.concat_ws("\n", F.regexp_replace("text", r"^\S+\s+", ""), _note(k)).alias("sentence"))
    return E.extraction_metrics(E.labelled(reports.labelled_truth(s, path), reports.extracted(said)))


QUERIES = {"turn_extraction": _turn_extraction, "labelled_extraction": _labelled}


# ---- SQL -------------------------------------------------------------------------------------------------------


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _list(values) -> str:
    return "[" + ", ".join(map(_q, values)) + "]"


def _sql_note(k: str) -> str:
    parts = []
    for values, by, out in PARTS:
        one = f"{_list(values)}[({k} // {by}) % {len(values)} + 1]"
        parts.append(f"case when {k} % {out} > 0 then {one} end" if out else f"case when {k} % 5 = 0 then {one} end" if by == 5 else one)
    return f"concat_ws(' ', {', '.join(parts)})"


def _had(words) -> str:
    return f"len(list_filter({_list(w.lower() for w in words)}, lambda w: contains(low, w))) > 0"


def _got(pattern: str) -> str:
    return f"nullif(regexp_extract(t, {_q(pattern)}, 1), '')"


def _sql_events(source: str) -> str:
    """CTEs up to `ev`, the events of source(id columns, t)."""
    phrases = sorted(T.STATUS_PHRASES, key=lambda p: -len(p))
    tags = " ".join(f"when contains(low, {_q(tag.lower())}){''.join(f' and ({_had(T.TAG_GUARDS[tag])})' for _ in T.TAG_GUARDS.get(tag, [])[:1])} then {_q(d)}" for tag, d in T.TAG_DISCIPLINES.items())
    equipment = " ".join(f"when {_had(words)} then {_q(d)}" for d, words in T.EQUIPMENT.items())
    score = lambda words: f"coalesce(list_sum(list_transform(list_filter({_list(w.lower() for w in words)}, lambda w: contains(low, w)), lambda w: case when length(w) > 4 then 2 else 1 end)), 0)"
    ranked = " ".join(f"when s{i} > 0 and s{i} = greatest(s0, s1, s2, s3, s4) then {_q(d)}" for i, d in enumerate(T.DISCIPLINE_WORDS))
    names = [f"'Line ' || {_got(p)}" for p in (r"(?i)\bline\s+(\d+(?:-[A-Z0-9]+)?)\b", r"(?i)\bL-?(\d+(?:-[A-Z0-9]+)?)\b", r"(?i)\b(\d+-XX)\b")]
    names[2] = f"'Line ' || {_got(r'(?i)\b(\d+)-XX\b')} || '-XX'"
    names += [f"upper({_got(rf'(?i)\b({tag}-' + (r'[A-Z0-9]+' if tag == 'CT' else r'\d+[A-Z]?') + r')\b')})" for tag in T.TAGS]
    days = [
        f"try_strptime({_got(p)}, {_q(f)})::date"
        for p, forms in (
            (r"\b(\d{4}-\d{1,2}-\d{1,2})\b", ["%Y-%m-%d"]), (r"\b(\d{1,2}[-/]\d{1,2}[-/]\d{4})\b", ["%d-%m-%Y", "%d/%m/%Y"]), (r"\b(\d{1,2} [A-Z][a-z]+ \d{4})\b", ["%d %B %Y", "%d %b %Y"]),
            (r"\b([A-Z][a-z]+ \d{1,2},? \d{4})\b", ["%B %d, %Y", "%b %d, %Y", "%B %d %Y", "%b %d %Y"]),
        )
        for f in forms
    ]
    amounts = [(r"\d+\s+of\s+\d+", r"(\d+)\s+of", r"'of ' || regexp_extract(t, '(?i)\d+\s+of\s+(\d+)', 1)::hugeint")]
    amounts += [(rf"\d+(?:\.\d+)?\s*{u}", rf"(\d+(?:\.\d+)?)\s*{u}", _q(name)) for u, name in ((r"(?:metres|meters|m)\b", "metres"), (r"spools?\b", "spools"), (r"joints?\b", "joints"), ("(?:percent|%)", "%"))]
    counted = [f"when regexp_matches(t, {_q('(?i)' + a)}) and not regexp_matches(regexp_extract(t, {_q('(?is)^(.*?)(?:' + a + ')')}, 1), '(?i)(?:line|l-?)\\s*$') then" for a, _, _ in amounts]
    fields = {"discipline": 0.15, "activity_type": 0.15, "asset": 0.20, "location": 0.10, "event_date": 0.10, "quantity": 0.05}
    return f"""src as ({source}), lo as (select *, lower(trim(t)) as low from src),
w0 as (select *, {', '.join(f'{score(words)} as s{i}' for i, words in enumerate(T.DISCIPLINE_WORDS.values()))},
  list_filter({_list(phrases)}, lambda p: contains(low, p))[1] as phrase,
  case when contains(low, 'loop check') then 'loop check' else list_filter(regexp_extract_all(low, '(\\w+)', 1), lambda w: list_contains({_list(T.WORK_WORDS)}, w))[1] end as word from lo),
w1 as (select *, coalesce({_list(T.STATUS_PHRASES.values())}[list_position({_list(T.STATUS_PHRASES)}, phrase)],
   case when regexp_matches(low, '\\b(?:still\\s+pending|not\\s+yet|awaiting|material\\s+not)\\b') then 'not_started' when regexp_matches(low, '\\b(?:could\\s+not|cannot|unable|faulty|failed)\\b') then 'blocked' else 'unknown' end) as status,
  {_list(T.WORK_WORDS.values())}[list_position({_list(T.WORK_WORDS)}, word)] as activity_type,
  coalesce(case {tags} end, case {equipment} end, case {ranked} end) as discipline,
  list_filter([{', '.join(names)}], lambda x: x is not null)[1] as asset,
  coalesce('Unit ' || {_got('[Uu]nit\\s+(\\d+)\\b')}, 'Area ' || {_got('\\b[Aa]rea\\s+([A-Z0-9]+)\\b')}, case when regexp_matches(t, '\\b[Ss]ubstation\\b') then 'Substation' when regexp_matches(t, '\\b[Ff]abrication\\s+[Yy]ard\\b') then 'Fabrication Yard' end,
    'Pipe Rack ' || {_got('\\b[Pp]ipe\\s+[Rr]ack\\s+([A-Z])\\b')}, case when regexp_matches(t, '\\b[Pp]ipe\\s+[Rr]ack\\b') then 'Pipe Rack' end) as location,
  case {' '.join(f"{c} regexp_extract(t, {_q('(?i)' + n)}, 1)::double" for c, (_, n, _) in zip(counted, amounts, strict=True))} end as quantity,
  case {' '.join(f"{c} {u}" for c, (_, _, u) in zip(counted, amounts, strict=True))} end as unit,
  coalesce({', '.join(days)}) as event_date from w0),
ev as (select *, least(0.05 + case when status <> 'unknown' then 0.15 else 0 end + case when length(concat_ws(' ', activity_type, asset, 'at ' || location)) > 10 then 0.10 else 0 end
   + {' + '.join(f'case when {f} is not null then {w:.2f} else 0 end' for f, w in fields.items())}, 0.99)::decimal(10, 2)::double as confidence,
  concat_ws(',', case when asset is null then 'asset' end, case when discipline is null then 'discipline' end, case when status = 'unknown' then 'status' end, case when location is null then 'location' end, case when activity_type is null then 'activity_type' end) as missing from w1)"""


_TURNS = f"select conv_id::bigint as conv_id, turn::bigint as turn, concat_ws(chr(10), text, {_sql_note('(conv_id * 17 + turn)')}) as t from conversations"
_SAID = rf"select item_id::bigint as id, concat_ws(chr(10), regexp_replace(text, '^\S+\s+', ''), {_sql_note('item_id')}) as t from benchmark"
_SHARE = lambda x, of=1: _r(f"({x}) / (count(*) * {of})", 3)
_FIELDS = ["discipline", "asset", "status", "event_date", "activity_type", "location"]

ORACLE = {
    "turn_extraction": f"""with {_sql_events(_TURNS)} select conv_id, turn, status, activity_type, discipline, asset, location, quantity, unit, event_date, confidence, missing,
confidence < 0.80 and (asset is null or discipline is null or status = 'unknown') as needs_clarification from ev""",
    "labelled_extraction": rf"""with {_sql_events(_SAID)},
tr as (select item_id::bigint as k, concat_ws(chr(10), text, {_sql_note('item_id')}) as x, nullif({_list(KINDS)}[item_id % 6 + 1], 'works') as wanted, {_list(MARKS)}[(item_id // 2) % 4 + 1] as note from benchmark where item_id % 10 <> 0),
a as (select k, unnest(list_distinct(regexp_split_to_array(lower(trim(x)), '\s+'))) as w from tr), b as (select id, unnest(list_distinct(regexp_split_to_array(lower(trim(t)), '\s+'))) as w from ev),
o as (select k, id, count(*) as n from a join b using (w) where w <> '' group by 1, 2 qualify row_number() over (partition by k order by n desc, id) = 1),
j as (select tr.*, o.id is not null as found, ev.* exclude (id) from tr left join o using (k) left join ev on ev.id = o.id),
f as (select found and (wanted is null or coalesce(discipline = wanted, false)) as d, found and asset is not null as a, found and status <> 'unknown' as s, found and event_date is not null as e, found and activity_type is not null as y, found and location is not null as l,
  asset is not null or not regexp_matches(note, 'asset|line|identifier') as okay from j)
select count(*) as total_events, {', '.join(f"{_SHARE(f'count_if({c})')} as {n}_accuracy" for c, n in zip('daseyl', _FIELDS, strict=True))},
{_SHARE(' + '.join(f'count_if({c})' for c in 'daseyl'), 6)} as overall_field_accuracy, {_SHARE('count_if(d and s and okay)')} as event_level_accuracy from f""",
}
