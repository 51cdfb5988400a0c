"""Chat formatting: tool calls and results meet by identifier, are ordered, validated and written as canonical JSON.

All steps are DataFrame operations over one row per message: no conversation is gathered, so that a conversation may
hold any share of the rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import stored

#: Argument types of a schema -> the type that schema_of_variant gives.
TYPES = {"string": "STRING", "integer": "BIGINT", "boolean": "BOOLEAN"}


def canonical_json(text: Column) -> Column:
    """JSON with sorted keys and no blanks; null where text is no JSON. Of a repeated key, text counts as no JSON."""
    return F.to_json(F.try_parse_json(text))


def argument_problem(tool: Column, arguments: Column, schemas: dict[str, dict[str, tuple]]) -> Column:
    """Null if arguments (JSON text) fit the tool's schema {argument: (type, required) or (type, required, characters at
    most)}, else what is wrong first."""
    parsed = F.try_parse_json(arguments)
    out = F.lit("unknown tool")
    for name, schema in schemas.items():
        keys = F.coalesce(F.json_object_keys(arguments), F.array().cast("array<string>"))
        checks = [F.when(F.json_object_keys(arguments).isNull(), "no object")]
        checks.append(F.when(F.size(F.array_except(keys, F.array(*map(F.lit, schema)))) > 0, "extra argument"))
        for arg, (kind, required, *most) in schema.items():
            have = F.schema_of_variant(F.variant_get(parsed, f"$.{arg}", "variant"))
            there = F.array_contains(keys, arg)
            if required:
                checks.append(F.when(~there, f"{arg} is missing"))
            checks.append(F.when(there & (F.coalesce(have, F.lit("VOID")) != TYPES[kind]), f"{arg} is no {kind}"))
            if most:
                checks.append(F.when(F.char_length(F.try_variant_get(parsed, f"$.{arg}", "string")) > most[0], f"{arg} is too long"))
        out = F.when(tool == name, F.coalesce(*checks)).otherwise(out)
    return out


def _keys(calls: DataFrame) -> list[str]:
    return [k for k in ("conv_id", "call_id") if k in calls.columns]


def dependency_levels(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """calls with level: 0 with nothing needed, else one more than the highest level needed (null in or after a cycle).

    Calls are known by (conv_id, call_id), or call_id alone if calls has no conv_id; needs has the same keys and needed.
    What is needed but no call counts as not needed. Where no call needs two others, distances are doubled, so that a
    chain takes as many rounds as its length has binary digits; otherwise there is one round a level.
    """
    keys = _keys(calls)
    at = calls.select(*keys).distinct()
    edges = needs.select(*keys, "needed").distinct().join(at, keys, "left_semi")
    edges = stored(edges.join(at.withColumnRenamed("call_id", "needed"), [*keys[:-1], "needed"], "left_semi").select(*keys, "needed"), "chat-edges")
    single = edges.groupBy(*keys).count().where("count > 1").isEmpty()
    depths = (_chained if single else _peeled)(edges, keys).withColumn("needing", F.lit(True))
    out = calls.drop("level").join(depths, keys, "left")
    return out.withColumn("level", F.when(F.col("needing"), F.col("level")).otherwise(F.lit(0).cast("long"))).drop("needing")


def _chained(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, level) of calls that need one other each: level counts the edges up to `needed`, null once that is the last."""
    up = edges.withColumn("level", F.lit(1).cast("long"))
    n, span = edges.count(), 1
    while span <= 2 * n and not up.where("needed is not null").isEmpty():
        on = up.select(*keys[:-1], F.col("call_id").alias("needed"), F.col("needed").alias("next"), F.col("level").alias("more"))
        longer = up.join(on, [*keys[:-1], "needed"], "left").select(*keys, F.col("next").alias("needed"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level"))
        up, span = stored(longer, "chat-chains"), 2 * span
    return up.select(*keys, F.when(F.col("needed").isNull(), F.col("level")).alias("level"))


def _peeled(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, level) of calls that need others, level by level; edges to a call whose level is found fall away."""
    left, level, none = edges, 1, F.lit(None).cast("long")
    done = None
    while not left.isEmpty():
        open_ = left.select(*keys).distinct()
        rest = stored(left.join(open_.withColumnRenamed("call_id", "needed"), [*keys[:-1], "needed"], "left_semi").select(*keys, "needed"), "chat-edges")
        free = stored(open_.join(rest.select(*keys).distinct(), keys, "left_anti").withColumn("level", F.lit(level).cast("long")), "chat-free")
        if free.isEmpty():  # what is left needs itself
            break
        done = free if done is None else done.unionByName(free)
        left, level = rest, level + 1
    cyclic = left.select(*keys).distinct().withColumn("level", none)
    return cyclic if done is None else done.unionByName(cyclic)


def link_tools(calls: DataFrame, results: DataFrame, schemas: dict, needs: DataFrame | None = None) -> DataFrame:
    """One row per call, and one per result that links to no call: conv_id, call_id, level, call_turn, result_turn, status, problem, json.

    calls: conv_id, call_id, turn, tool, arguments (JSON text). results: conv_id, call_id, turn, content. Both meet by
    (conv_id, call_id), nulls never; of several calls the first (by turn, then tool and arguments) is answered, by the
    first result after it (by turn, then content). So every row of calls and of results comes out once, equal rows too.
    status of a call: linked, unanswered (no result), early (its only results do not stand after it), repeated (not the
    first). status of a result: orphan (no call), repeated (after the linked one), premature (not after its call). json is
    the call, its canonical arguments and its result. Arguments that break the schema keep their row, with problem set
    and, if they are no JSON, null arguments. level is the depth of dependency if needs is given (dependency_levels),
    else the turn. Empty tables give empty results.
    """
    if needs is not None:
        calls = dependency_levels(calls, needs)
    elif "level" not in calls.columns:
        calls = calls.withColumn("level", F.col("turn").cast("long"))
    keys = ["conv_id", "call_id"]
    none = lambda kind: F.lit(None).cast(kind)
    c = calls.select(*keys, F.lit(0).alias("kind"), "turn", "level", "tool", "arguments", none("string").alias("content"))
    r = results.select(*keys, F.lit(1).alias("kind"), "turn", none("long").alias("level"), none("string").alias("tool"), none("string").alias("arguments"), "content")
    apart = F.col("conv_id").isNull() | F.col("call_id").isNull()  # these meet nobody, and are dealt out by what they hold
    m = c.unionByName(r).withColumn("apart", F.when(apart, F.xxhash64("conv_id", "call_id", "turn", "arguments", "content")))
    w = Window.partitionBy(*keys, "apart").orderBy("kind", F.asc_nulls_last("turn"), F.asc_nulls_last("tool"), F.asc_nulls_last("arguments"), F.asc_nulls_last("content"))
    sofar, all_ = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    m = m.withColumns({"nth": F.row_number().over(w), "asked": F.first("kind").over(sofar) == 0, "at": F.first("turn").over(sofar)})
    late = (F.col("kind") == 1) & F.col("asked") & F.coalesce(F.col("turn") > F.col("at"), F.lit(False))
    m = m.withColumn("late", late).withColumns({"nth_late": F.count_if("late").over(sofar), "answer": F.first(F.when(F.col("late"), F.struct("turn", "content")), ignorenulls=True).over(all_), "replies": F.sum("kind").over(all_)})
    call, answer = F.col("kind") == 0, F.col("answer")
    links = call & (F.col("nth") == 1) & answer.isNotNull() & ~apart
    status = F.when(apart, F.when(call, "unanswered").otherwise("orphan"))
    status = status.when(call, F.when(F.col("nth") > 1, "repeated").when(links, "linked").when(F.col("replies") > 0, "early").otherwise("unanswered"))
    status = status.when(~F.col("asked"), "orphan").when(F.col("late"), "repeated").otherwise("premature")
    both = m.where(apart | call | ~F.col("late") | (F.col("nth_late") > 1)).select(
        *keys, "level", F.when(call, F.col("turn")).alias("call_turn"), F.when(call, F.when(links, answer["turn"])).otherwise(F.col("turn")).alias("result_turn"), "tool", "arguments",
        F.when(call, F.when(links, answer["content"])).otherwise(F.col("content")).alias("content"), status.alias("status"),
    )
    canon = canonical_json(F.col("arguments"))
    body = F.concat(
        F.lit('{"arguments":'), F.coalesce(canon, F.lit("null")),
        F.lit(',"call_id":'), F.coalesce(_quoted("call_id"), F.lit("null")),
        F.lit(',"result":'), F.coalesce(_quoted("content"), F.lit("null")),
        F.lit(',"tool":'), F.coalesce(_quoted("tool"), F.lit("null")), F.lit("}"),
    )
    problem = F.when(F.col("tool").isNotNull(), argument_problem(F.col("tool"), F.col("arguments"), schemas))
    return both.select(*keys, "level", "call_turn", "result_turn", "status", problem.alias("problem"), body.alias("json"))


def _quoted(c: str) -> Column:
    """A JSON string; null of null."""
    whole = F.to_json(F.struct(F.col(c).alias("x")))
    return F.when(F.col(c).isNotNull(), F.expr(f"substring(to_json(struct({c} as x)), 6, length(to_json(struct({c} as x))) - 6)"))


# The one tool of the `conversations` table, whose user turns are calls and assistant turns results.
REPLY = {"reply": {"prompt": ("string", True, 300), "turn": ("integer", True)}}


def conversation_calls(conversations: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """calls, results and needs of plain conversations: a user turn t asks the tool `reply`, under the identifier t; an
    assistant turn t answers t-1; a call needs the call two turns before it. System turns are neither."""
    m = conversations.select("conv_id", "turn", "role", "text")
    calls = m.where("role = 'user'").select(
        "conv_id", F.col("turn").cast("string").alias("call_id"), "turn", F.lit("reply").alias("tool"),
        F.to_json(F.struct(F.col("turn").alias("turn"), F.col("text").alias("prompt"))).alias("arguments"),
    )
    results = m.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).cast("string").alias("call_id"), "turn", F.col("text").alias("content"))
    needs = m.where("role = 'user'").select("conv_id", F.col("turn").cast("string").alias("call_id"), (F.col("turn") - 2).cast("string").alias("needed")).distinct()
    return calls, results, needs


def chat_sql() -> str:
    """link_tools over conversation_calls as DuckDB SQL."""
    return """
with calls as (select conv_id, cast(turn as varchar) as call_id, turn, min(text) as text from conversations where role = 'user' group by conv_id, turn),
results as (select conv_id, cast(turn - 1 as varchar) as call_id, turn, text from conversations where role = 'assistant'),
dated as (select r.*, c.turn as at, r.turn > c.turn as late from results r left join calls c using (conv_id, call_id)),
first as (select conv_id, call_id, min(turn) as turn, min({t: turn, x: text}).x as content from dated where late group by 1, 2),
linked as (select c.conv_id, c.call_id, c.turn as level, c.turn as call_turn, f.turn as result_turn,
    case when f.turn is not null then 'linked' else 'unanswered' end as status,
    case when c.text is null then 'prompt is missing' when length(c.text) > 300 then 'prompt is too long' end as problem,
    '{"arguments":{' || coalesce('"prompt":' || cast(to_json(c.text) as varchar) || ',', '') || '"turn":' || c.turn || '},"call_id":"' || c.call_id || '","result":'
      || coalesce(cast(to_json(f.content) as varchar), 'null') || ',"tool":"reply"}' as json
    from calls c left join first f using (conv_id, call_id)),
over as (select d.conv_id, d.call_id, null::bigint as level, null::bigint as call_turn, d.turn as result_turn,
    case when d.at is null then 'orphan' else 'repeated' end as status, null::varchar as problem,
    '{"arguments":null,"call_id":' || coalesce('"' || d.call_id || '"', 'null') || ',"result":' || coalesce(cast(to_json(d.text) as varchar), 'null') || ',"tool":null}' as json
    from dated d left join first f using (conv_id, call_id) where d.at is null or (d.late and d.turn > f.turn))
select * from linked union all select * from over
"""


def levels_sql() -> str:
    """chat_sql with the depth of dependency as level: the place of a call in its unbroken run of every second turn."""
    return f"""
with plain as ({chat_sql()}),
asked as (select distinct conv_id, turn from conversations where role = 'user'),
placed as (select *, turn - 2 * row_number() over (partition by conv_id, turn % 2 order by turn) as run from asked),
deep as (select conv_id, turn as call_turn, row_number() over (partition by conv_id, turn % 2, run order by turn) - 1 as level from placed)
select p.conv_id, p.call_id, d.level, p.call_turn, p.result_turn, p.status, p.problem, p.json
from plain p left join deep d using (conv_id, call_turn)
"""
