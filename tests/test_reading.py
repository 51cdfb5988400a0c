"""Readers and expressions on small inputs of our own."""

import datetime

import pytest
from pyspark.sql import functions as F

from plumbline.functions import progress as P
from plumbline.functions import text as T
from plumbline.operators import graph, quality, schedule
from plumbline.sources import reports, schedules

XER = "\n".join(
    [
        "ERMHDR\t1.0", "%T\tPROJWBS", "%F\twbs_id\tproj_id\tparent_wbs_id\twbs_short_name", "%R\t10\t1\t\tAREA", "%T\tTASK",
        "%F\ttask_id\twbs_id\ttask_code\ttask_name\tstatus_code\ttarget_start_date\ttarget_end_date\ttarget_drtn_hr_cnt",
        "%R\t1\t10\tA1\tDig\tTK_Complete\t2026-08-01 08:00\t2026-08-05 17:00\t40", "%R\t2\t10\tA2\tPour\tTK_Active\t2026-08-06 08:00\t2026-08-07 17:00\t12",
        "%T\tTASKPRED", "%F\ttask_pred_id\ttask_id\tpred_task_id", "%R\t5\t2\t1", "%E",
    ]
)
MSP = """<Project xmlns="http://schemas.microsoft.com/project"><Tasks><Task><UID>1</UID><Name>Phase</Name><Summary>1</Summary></Task>
<Task><UID>2</UID><Name>B-1: Weld</Name><WBS>1.1</WBS><OutlineLevel>5</OutlineLevel><Summary>0</Summary><Start>2026-08-01T08:00:00</Start><Finish>2026-08-05T17:00:00</Finish><Duration>PT40H0M0S</Duration></Task>
<Task><UID>3</UID><Name>B-2: Test</Name><Summary>0</Summary><Start>2026-08-06T08:00:00</Start><Finish>2026-08-07T17:00:00</Finish><Duration>P2D</Duration><PredecessorLink><PredecessorUID>2</PredecessorUID></PredecessorLink></Task></Tasks></Project>"""
P6 = """<APIBusinessObjects xmlns="http://x"><Project><WBS><ObjectId>7</ObjectId><Code>W7</Code></WBS><Activity><Id>C1</Id><Name>Lay</Name><WBSObjectId>7</WBSObjectId>
<PlannedStartDate>2026-08-01T00:00:00</PlannedStartDate><PlannedFinishDate>2026-08-03T00:00:00</PlannedFinishDate><PlannedDuration>24</PlannedDuration><Status>In Progress</Status></Activity></Project></APIBusinessObjects>"""


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def by_id(df):
    return {r.activity_id: r for r in df.collect()}


def test_xer(spark):
    r = by_id(schedules.read_schedule(spark, "x.xer", XER))
    assert set(r) == {"A1", "A2"} and r["A1"].wbs_id == "AREA" and r["A1"].duration_days == 5 and r["A2"].duration_days == 2
    assert r["A2"].predecessors == ["A1"] and r["A1"].successors == ["A2"] and r["A1"].status == "completed"
    assert r["A1"].planned_finish == datetime.date(2026, 8, 5)


def test_msproject(spark):
    r = by_id(schedules.read_schedule(spark, "x.xml", MSP))
    assert set(r) == {"B-1", "B-2"} and r["B-2"].predecessors == ["B-1"] and r["B-1"].duration_days == 5 and r["B-2"].duration_days == 2


def test_p6_xml(spark):
    r = by_id(schedules.read_schedule(spark, "x.xml", P6))
    assert r["C1"].wbs_id == "W7" and r["C1"].duration_days == 3 and r["C1"].status == "in_progress"


def test_json_and_csv(spark, tmp_path):
    r = by_id(schedules.read_schedule(spark, "x.json", '{"activities":[{"id":"D1","name":"Cut","start":"2026-08-01","finish":"2026-08-02","predecessors":["D0"]},{"id":"D2","predecessors":"D1, D0"}]}'))
    assert r["D1"].predecessors == ["D0"] and r["D2"].predecessors == ["D1", "D0"] and r["D1"].duration_days == 2
    p = tmp_path / "s.csv"
    p.write_text("Activity ID,Name,WBS,Level,Start,Finish,Duration,Predecessors\nE1,Dig,W,L6,2026-08-01,2026-08-03,24h,\"E0;E9\"\n")
    r = by_id(schedules.read_schedule(spark, str(p)))
    assert r["E1"].predecessors == ["E0", "E9"] and r["E1"].wbs_level == 6 and r["E1"].duration_days == 24
    assert schedules.detect("a.csv", "a,b") == "csv" and schedules.detect("a", "zz") == "unknown"


def test_quality_rules(spark):
    p = "id,name,wbs,start,finish,predecessors\n,a,w,2026-01-01,2026-01-02,\nF1,,w,2026-01-01,2026-01-02,F1\nF2,a,,no day,2026-01-02,\nF3,a,w,2026-01-05,2026-01-02,\nF3,a,w,2026-01-01,2026-01-02,\n"
    kept = schedules.read_schedule(spark, "x.csv", p)
    found = {r.issue_type for r in quality.issues(kept, None, kept.where("activity_id = 'F1'")).collect()}
    assert found == {"missing_id", "missing_name", "invalid_date", "finish_before_start", "missing_wbs", "circular_predecessor", "duplicate_id", "non_l5_l6"}


REPORT = """Daily report
Date: 28 August 2026
=== PIPING ===
Hydrotest of Line 24 completed at Unit 3. Welding of 12 of 40 joints is in progress.
=== ISSUES / DELAYS ===
Cable tray could not be done near Substation.
"""


def test_daily_report(spark):
    said = reports.extracted(reports.daily_report(spark.createDataFrame([(REPORT,)], "value string"))).orderBy("pos").collect()
    assert [r.status for r in said] == ["completed", "in_progress", "blocked"]
    assert said[0].asset == "Line 24" and said[0].location == "Unit 3" and said[0].activity_type == "hydrotest" and said[0].discipline == "piping"
    assert (said[1].quantity, said[1].unit) == (12.0, "of 40") and said[2].discipline == "electrical"
    assert {r.event_date for r in said} == {datetime.date(2026, 8, 28)}


@pytest.mark.parametrize(
    ("text", "want"), [("2026-08-10", "2026-08-10"), ("on 5-9-2026", "2026-09-05"), ("3 March 2026", "2026-03-03"), ("March 3, 2026", "2026-03-03"), ("yesterday", "2026-01-01"), ("some day", None)]
)
def test_dates(spark, text, want):
    got = one(spark, T.event_date(F.lit(text), F.lit("2026-01-02").cast("date")))
    assert (got and got.isoformat()) == want


def test_progress(spark):
    assert one(spark, P.schedule_status(F.lit("In Progress"))) == "IN_PROGRESS" and one(spark, P.schedule_status(F.lit("unknown"))) is None
    assert [one(spark, P.schedule_risk(F.lit(v), F.lit(p))) for v, p in ((8, 90), (4, 40), (4, 60), (0, 0))] == ["HIGH", "HIGH", "MEDIUM", "LOW"]
    assert one(spark, P.quantity_progress(F.lit(10.0), F.lit(25.0))) == 100.0 and one(spark, P.quantity_progress(F.lit(0.0), F.lit(1.0))) is None
    with pytest.raises(Exception, match="confidence"):
        one(spark, P.review_decision(F.lit(1.5)))
    assert [one(spark, P.review_decision(F.lit(c))) for c in (0.85, 0.65, 0.64)] == ["AUTO", "REVIEW", "REJECT"]


def test_fold_does_not_depend_on_row_order(spark):
    acts = spark.createDataFrame([(1, datetime.date(2026, 1, 1))], "activity_id long, planned_start date")
    rows = [(1, 1, 10, datetime.date(2026, 1, 3), "IN_PROGRESS"), (1, 2, 11, datetime.date(2026, 1, 5), "COMPLETED"), (1, 3, 12, datetime.date(2026, 1, 6), "ON_HOLD"), (1, 4, 13, None, None)]
    for order in (rows, rows[::-1]):
        s = schedule.fold_state(acts, spark.createDataFrame(order, "activity_id long, seq long, event_id long, event_date date, status string")).first()
        assert (s.status, s.actual_start, s.actual_finish, s.evidence) == ("COMPLETED", datetime.date(2026, 1, 3), datetime.date(2026, 1, 5), 4)


def test_cycles(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4)], "src long, dst long")
    got = {(r.node, r.depth) for r in graph.reached(e, spark.createDataFrame([(1,)], "root long")).collect()}
    assert got == {(2, 1), (3, 2), (1, 3), (4, 3)}
    t = spark.createDataFrame([("a", "b", None), ("b", "a", None), ("c", None, "z"), ("d", "c", None)], "node string, parent string, zone string")
    assert {r.node: r.value for r in graph.inherited(t, "zone").collect()} == {"a": None, "b": None, "c": "z", "d": "z"}


def test_question(spark):
    ask = lambda q: one(spark, reports.question_intent(F.lit(q)))
    assert ask("What usually delays piping?") == "delay_by_category" and ask("main causes of delay") == "top_delay_causes" and ask("hello") == "search"


def test_discipline_by_tag(spark):
    from plumbline.functions import text as T

    rows = [("V-301 installed", "piping"), ("K-201 done", "mechanical"), ("P-101 pump aligned", "mechanical"), ("M-12 MCC energised", "electrical"), ("FT-9 fixed", "instrumentation"), ("nothing here", None)]
    got = spark.createDataFrame(rows, "t string, want string").select("t", "want", T.discipline(F.col("t")).alias("got")).collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_task_id_before_id(spark):
    from plumbline.sources.schedules import from_columns

    got = from_columns(spark.createDataFrame([("7", "A-1", "Lay pipe", "mech")], "id string, `Task ID` string, name string, disc string")).first()
    assert (got.activity_id, got.activity_name, got.discipline) == ("A-1", "Lay pipe", "mech")
