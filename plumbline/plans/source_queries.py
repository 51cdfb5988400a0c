"""Readers as queries: orders are written out in every format, to several files that use the same inner numbers, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.operators.scan import scratch_folder
from plumbline.plans import bindings as B
from plumbline.sources import reports, schedules

FILES = 7


def _folder(lines: DataFrame, name: str) -> str:
    """Lines (file, n, line) written as text in a folder of the scratch folder, one folder a file.

    Rows are dealt by a hash of the file and to a given number of partitions: by the bare column Spark leaves the shuffle out
    where a join has dealt the rows so, and adaptive execution may then read that join's input where it lies."""
    spark = lines.sparkSession
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    lines.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), F.xxhash64("file")).sortWithinPartitions("file", "n").select("file", F.col("line").alias("value")).write.partitionBy("file").text(path)
    return path


def _plan(s, d) -> DataFrame:
    """Orders as planned work: k, file, inner (numbers that every file uses), dates, hours, status."""
    o, k = B.table(s, d, "orders"), F.col("o_orderkey")
    return o.select(
        k.alias("k"), F.pmod(k, F.lit(FILES)).alias("file"), F.floor(k / FILES).cast("long").alias("inner"), F.to_date("o_orderdate").alias("day"), F.date_add(F.to_date("o_orderdate"), (k % 9).cast("int")).alias("end"),
        ((k % 6 + 1) * 8).alias("hours"), F.substring("o_orderpriority", 1, 1).alias("node"), "o_orderstatus",
    )


def _line(*cells: Column | str, sep: str = "\t") -> Column:
    return F.concat_ws(sep, *[F.coalesce((F.lit(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in cells])


def _state(done: str, active: str, rest: str) -> Column:
    return F.when(F.col("o_orderstatus") == "F", done).when(F.col("o_orderstatus") == "P", active).otherwise(rest)


def _headed(rows: DataFrame, step: int, *heads: str) -> DataFrame:
    """Rows (file, n, line) of one table of each file, behind its head lines; step orders the tables."""
    files = rows.select("file").distinct()
    head = files.select("file", F.posexplode(F.array(*map(F.lit, heads))).alias("i", "line")).select("file", F.struct(F.lit(step).alias("s"), F.col("i").cast("long").alias("i")).alias("n"), "line")
    return head.unionByName(rows.select("file", F.struct(F.lit(step).alias("s"), (F.col("n") + 10).cast("long").alias("i")).alias("n"), "line"))


def _xer(s, d):
    p = _plan(s, d)
    node = p.select("file", "node").distinct().select("file", F.col("node").cast("long").alias("n"), _line("%R", F.col("node"), "1", "", F.concat(F.lit("W"), "node", F.lit("/"), F.col("file"))).alias("line"))
    task = p.select("file", F.col("k").alias("n"), _line("%R", F.col("inner"), F.col("node"), F.concat(F.lit("A"), "k"), F.concat(F.lit("Order "), "k"), _state("TK_Complete", "TK_Active", "TK_NotStart"), F.concat("day", F.lit(" 08:00")), F.concat("end", F.lit(" 17:00")), F.col("hours")).alias("line"))
    pred = p.where("inner > 0").select("file", F.col("k").alias("n"), _line("%R", F.col("k"), F.col("inner"), F.col("inner") - 1).alias("line"))
    lines = _headed(node, 1, "ERMHDR\t1.0", "%T\tPROJWBS", "%F\twbs_id\tproj_id\tparent_wbs_id\twbs_short_name").unionByName(
        _headed(task, 2, "%T\tTASK", "%F\ttask_id\twbs_id\ttask_code\ttask_name\tstatus_code\ttarget_start_date\ttarget_end_date\ttarget_drtn_hr_cnt")
    ).unionByName(_headed(pred, 3, "%T\tTASKPRED", "%F\ttask_pred_id\ttask_id\tpred_task_id"))
    return _shown(schedules.read_schedule(s, _folder(lines, "xer")))


def _shown(a: DataFrame) -> DataFrame:
    file = F.regexp_extract("source_file", r"file=(\d+)", 1).cast("long")
    return a.select(file.alias("file"), "activity_id", "activity_name", "wbs_id", "status", "planned_start", "planned_finish", "duration_days", F.array_join("predecessors", ",").alias("predecessors"))


def _documents(s, d, name: str, opening: str, closing: str, more: DataFrame | None, item: Column) -> DataFrame:
    p = _plan(s, d)
    rows = p.select("file", F.struct(F.lit(1).alias("s"), F.col("k").alias("i")).alias("n"), item.alias("line"))
    if more is not None:
        rows = rows.unionByName(more)
    files = p.select("file").distinct()
    for at, text in ((0, opening), (9, closing)):
        rows = rows.unionByName(files.select("file", F.struct(F.lit(at).alias("s"), F.lit(0).cast("long").alias("i")).alias("n"), F.lit(text).alias("line")))
    return _shown(schedules.read_schedule(s, _folder(rows, name)))


def _tags(**values: Column) -> Column:
    return F.concat(*[x for k, v in values.items() for x in (F.lit(f"<{k}>"), v.cast("string"), F.lit(f"</{k}>"))])


def _p6(s, d):
    a = F.concat(F.lit("<Activity>"), _tags(Id=F.concat(F.lit("A"), "k"), Name=F.concat(F.lit("Order "), "k"), WBSObjectId=F.col("node"), PlannedStartDate=F.concat("day", F.lit("T08:00:00")), PlannedFinishDate=F.concat("end", F.lit("T17:00:00")), PlannedDuration=F.col("hours"), Status=_state("Completed", "In Progress", "Not Started")), F.lit("</Activity>"))
    w = _plan(s, d).select("file", "node").distinct().select("file", F.struct(F.lit(0).alias("s"), F.col("node").cast("long").alias("i")).alias("n"), F.concat(F.lit("<WBS>"), _tags(ObjectId=F.col("node"), Code=F.concat(F.lit("W"), "node", F.lit("/"), F.col("file"))), F.lit("</WBS>")).alias("line"))
    return _documents(s, d, "p6", '<APIBusinessObjects xmlns="http://x"><Project>', "</Project></APIBusinessObjects>", w, a)


def _msp(s, d):
    link = F.when(F.col("inner") > 0, F.concat(F.lit("<PredecessorLink>"), _tags(PredecessorUID=F.col("inner") - 1), F.lit("</PredecessorLink>"))).otherwise("")
    t = F.concat(F.lit("<Task>"), _tags(UID=F.col("inner"), Name=F.concat(F.lit("A"), "k", F.lit(": Order "), "k"), WBS=F.concat(F.col("node"), F.lit("."), "k"), Summary=F.when(F.col("inner") % 10 == 9, "1").otherwise("0"), Start=F.concat("day", F.lit("T08:00:00")), Finish=F.concat("end", F.lit("T17:00:00")), Duration=F.concat(F.lit("PT"), "hours", F.lit("H0M0S"))), link, F.lit("</Task>"))
    return _documents(s, d, "msp", '<Project xmlns="http://schemas.microsoft.com/project"><Tasks>', "</Tasks></Project>", None, t)


def _json(s, d):
    p = _plan(s, d)
    item = F.to_json(F.struct(F.concat(F.lit("A"), "k").alias("id"), F.concat(F.lit("Order "), "k").alias("name"), F.concat(F.lit("W"), "node").alias("wbs"), F.col("day").alias("start"), F.col("end").alias("finish"), F.concat(F.lit("A"), F.col("k") - FILES, F.lit(", A"), F.col("k") + FILES).alias("predecessors")))
    first = p.groupBy("file").agg(F.min("k").alias("least"))
    rows = p.join(first, "file").select("file", F.struct(F.lit(1).alias("s"), F.col("k").alias("i")).alias("n"), F.concat(F.when(F.col("k") > F.col("least"), ",").otherwise(""), item).alias("line"))
    files = first.select("file")
    for at, text in ((0, '{"project_name": "p", "activities": ['), (9, "]}")):
        rows = rows.unionByName(files.select("file", F.struct(F.lit(at).alias("s"), F.lit(0).cast("long").alias("i")).alias("n"), F.lit(text).alias("line")))
    return _shown(schedules.read_schedule(s, _folder(rows, "json")))


def _csv(s, d):
    p = _plan(s, d)
    rows = p.select("file", F.col("k").alias("n"), _line(F.concat(F.lit("A"), "k"), F.concat(F.lit("Order "), "k"), F.concat(F.lit("W"), "node"), F.date_format("day", "dd/MM/yyyy"), F.concat("end", F.lit(" 17:00")), F.concat(F.lit("A"), F.col("k") - FILES, F.lit("; ")), _state("completed", "in progress", "planned"), sep=",").alias("line"))
    return _shown(schedules.read_schedule(s, _folder(_headed(rows, 1, "Task ID,Activity Name,WBS Code,Start Date,Finish,Preds,Activity Status"), "csv")))


def _sheet(s, d):
    """Every sixth row has no description, and is left out but counted."""
    p = _plan(s, d)
    k = F.col("k")
    row = _line(F.date_format("day", "yyyy-MM-dd"), F.when(k % 2 == 0, "Piping").otherwise("CIVIL"), F.when(k % 6 > 0, F.concat(F.lit("Weld spool "), "k")), F.when(k % 4 > 0, F.concat(F.lit("Unit "), k % 9)), _state("Completed", "In progress", "not-started"), F.when(k % 5 == 0, "many").when(k % 5 < 3, (k % 40).cast("string")), F.when(k % 3 == 0, "joints"), sep=",")
    rows = p.select("file", k.alias("n"), row.alias("line"))
    got = reports.sheet(s, _folder(_headed(rows, 1, "Date,Discipline,Activity Description,Location,Status,Quantity,Unit"), "sheet"))
    return got.withColumn("file", F.regexp_extract("source_file", r"file=(\d+)", 1).cast("long")).drop("source_file")


def _reports(s, d):
    """A day's report for every order of every thirteenth customer: two sections, one of them of delays."""
    o, k = B.table(s, d, "orders").where("o_custkey % 13 = 0"), F.col("o_orderkey")
    text = F.concat(
        F.lit("Daily report\nProject: P\nDate: "), F.date_format("o_orderdate", "d MMMM yyyy"), F.lit("\nPrepared by: x\n=== PIPING ===\nHydrotest of Line "), k % 60, F.lit(" completed. "), F.lit("Welding at Unit "), k % 9,
        F.lit(" is in progress.\nok.\n=== ISSUES / DELAYS ===\nCrane V-"), k % 300, F.lit(" could not be done!\n"),
    )
    said = reports.extracted(reports.daily_report(o.select(text.alias("value"), k.alias("k"))).withColumn("n", F.lit(1)))
    return said.groupBy("report_date", "section", "status", "discipline", "asset", "location").agg(F.count("*").alias("n"))


def _history(s, d):
    """Lines as history, with numbers and marks as people write them."""
    li, k = B.table(s, d, "lineitem"), F.col("l_orderkey")
    rows = li.where("l_linenumber = 1").select(
        F.pmod(k, F.lit(FILES)).alias("file"), F.struct(F.lit(1).alias("s"), F.monotonically_increasing_id().alias("i")).alias("n"),
        _line(F.concat(F.lit("p"), k % 3), F.lit("Piping"), F.when(k % 2 == 0, "weld").otherwise("lift"), F.when(k % 11 == 0, "ten").otherwise((k % 30).cast("string")), F.col("l_quantity").cast("int"), (F.col("l_quantity").cast("int") - k % 30), F.when(k % 4 == 0, "Yes").when(k % 4 == 1, "1").when(k % 4 == 2, "no").otherwise(" TRUE"), F.when(k % 4 == 0, "rain"), F.when(k % 5 == 0, "fast").otherwise(F.col("l_tax").cast("string")), F.when(k % 3 == 0, "verified"), sep=",").alias("line"),
    )
    head = "project_id,discipline,activity_type,planned_duration_days,actual_duration_days,variance_days,delayed,delay_cause,productivity_rate,record_quality"
    files = rows.select("file").distinct().select("file", F.struct(F.lit(0).alias("s"), F.lit(0).cast("long").alias("i")).alias("n"), F.lit(head).alias("line"))
    h = reports.history_csv(s, _folder(rows.unionByName(files), "history"))
    return h.groupBy("project_id", "activity_type", "delayed", "delay_cause", "record_quality").agg(F.count("*").alias("n"), F.sum("planned_days").alias("planned"), F.sum("actual_days").alias("actual"), F.count("productivity").alias("rates"))


QUERIES = {
    "read_xer": _xer,
    "read_p6_xml": _p6,
    "read_msproject_xml": _msp,
    "read_json_schedule": _json,
    "read_csv_schedule": _csv,
    "read_field_sheets": _sheet,
    "read_daily_reports": _reports,
    "read_history_csv": _history,
}

_P = f"""p as (select o_orderkey as k, o_orderkey % {FILES} as file, o_orderkey // {FILES} as i, cast(o_orderdate as date) as day, cast(o_orderdate as date) + cast(o_orderkey % 9 as int) as fin, substr(o_orderpriority, 1, 1) as node,
  o_orderstatus as st, cast(o_orderkey % 6 + 1 as int) as days from orders)"""
_STATE = "case st when 'F' then 'completed' when 'P' then 'in_progress' else 'planned' end"
_COLS = "file, 'A' || k as activity_id, 'Order ' || k as activity_name"

ORACLE = {
    "read_xer": f"with {_P} select {_COLS}, 'W' || node || '/' || file as wbs_id, {_STATE} as status, day as planned_start, fin as planned_finish, days as duration_days, case when i > 0 then case when b.k is not null then 'A' || b.k else (i - 1)::varchar end else '' end as predecessors from p left join (select k from p) b on b.k = p.k - {FILES}".replace("select file, 'A' || k as activity_id, 'Order ' || k as activity_name", "select file, 'A' || p.k as activity_id, 'Order ' || p.k as activity_name"),
    "read_p6_xml": f"with {_P} select {_COLS}, 'W' || node || '/' || file as wbs_id, {_STATE} as status, day as planned_start, fin as planned_finish, days as duration_days, '' as predecessors from p",
    "read_msproject_xml": f"with {_P} select file, 'A' || p.k as activity_id, 'Order ' || p.k as activity_name, node || '.' || p.k as wbs_id, 'planned' as status, day as planned_start, fin as planned_finish, days as duration_days, case when i > 0 then case when b.k is not null then 'A' || b.k else (i - 1)::varchar end else '' end as predecessors from p left join (select k from p) b on b.k = p.k - {FILES} where i % 10 <> 9",
    "read_json_schedule": f"with {_P} select {_COLS}, 'W' || node as wbs_id, 'planned' as status, day as planned_start, fin as planned_finish, cast(k % 9 + 1 as int) as duration_days, 'A' || (k - {FILES}) || ',A' || (k + {FILES}) as predecessors from p",
    "read_csv_schedule": f"with {_P} select {_COLS}, 'W' || node as wbs_id, {_STATE} as status, day as planned_start, fin as planned_finish, cast(k % 9 + 1 as int) as duration_days, 'A' || (k - {FILES}) as predecessors from p",
    "read_field_sheets": f"""with {_P}, r as (select *, row_number() over (partition by file order by k) as n, case when k % 4 > 0 then 'Unit ' || (k % 9) end as loc, case st when 'F' then 'Completed' when 'P' then 'In progress' else 'not-started' end as said from p)
select file, concat_ws(',', 'Weld spool ' || k, loc, said) as sentence, case when k % 2 = 0 then 'piping' else 'civil' end as discipline, loc as location, lower(said) as status_raw, regexp_replace(lower(said), '[ -]+', '_') as status,
case when k % 5 in (1, 2) then (k % 40)::double end as quantity, case when k % 3 = 0 then 'joints' end as unit, day as report_date, 'row_' || (n + 1) as source_reference from r where k % 6 > 0""",
    "read_daily_reports": """with o as (select o_orderkey as k, cast(o_orderdate as date) as day from orders where o_custkey % 13 = 0), x as (
select day as report_date, 'PIPING' as section, 'completed' as status, 'piping' as discipline, 'Line ' || (k % 60) as asset, null as location from o
union all select day, 'PIPING', 'in_progress', 'piping', null, 'Unit ' || (k % 9) from o union all select day, 'ISSUES / DELAYS', 'blocked', 'piping', 'V-' || (k % 300), null from o)
select report_date, section, status, discipline, asset, location, count(*) as n from x group by all""",
    "read_history_csv": f"""with r as (select distinct on (l) l, l_orderkey as k, l_quantity::int as q from (select *, row_number() over () as l from lineitem where l_linenumber = 1)),
h as (select 'p' || (k % 3) as project_id, case when k % 2 = 0 then 'weld' else 'lift' end as activity_type, k % 4 in (0, 1, 3) as delayed, case when k % 4 = 0 then 'rain' end as delay_cause, case when k % 3 = 0 then 'verified' else 'provisional' end as record_quality,
case when k % 11 = 0 then 0 else k % 30 end as p, q, k % 5 > 0 as rated from r)
select project_id, activity_type, delayed, delay_cause, record_quality, count(*) as n, cast(sum(p) as bigint) as planned, cast(sum(q) as bigint) as actual, count_if(rated) as rates from h group by all""",
}
