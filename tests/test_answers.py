"""What questions ask for, and results of parsing."""

import pytest
from pyspark.sql import functions as F

from plumbline.operators import answers as A


@pytest.mark.parametrize(
    ("question", "want"),
    [
        ("Why so late?", "delay_causes"), ("what caused delay", "delay_causes"), ("What delays piping?", "generic_search"), ("How long does it take?", "duration_stats"), ("average time of welds", "duration_stats"),
        ("worst discipline", "discipline_risk"), ("discipline with delay", "discipline_risk"), ("find all historical welds", "similar_activities"), ("works like this", "similar_activities"), ("longer than planned", "baseline_exceedance"),
        ("risk of it", "risk_profile"), ("chance of a delay", "risk_profile"), ("spools per day", "productivity"), ("hello", "generic_search"), ("", "generic_search"),
    ],
)
def test_intents(spark, question, want):
    assert spark.range(1).select(A.intent(F.lit(question)).alias("x")).first().x == want


def test_questions_without_history(spark):
    h = spark.createDataFrame([], "discipline string, activity_type string, planned_days int, actual_days int, variance_days int, delayed boolean, delay_cause string, productivity double")
    q = spark.createDataFrame([(1, "why is piping late"), (2, "worst"), (3, "hello"), (4, None), (5, "risk of civil work")], "question_id long, question string")
    got = {r.question_id: (r.intent, r.discipline, r.activity_type, r.summary) for r in A.answered(q, h).collect()}
    none = "nothing is known of this"
    assert got == {1: ("delay_causes", "piping", None, none), 2: ("discipline_risk", None, None, none), 3: ("generic_search", None, None, "asks for a search"), 4: ("generic_search", None, None, "asks for a search"), 5: ("risk_profile", "civil", "erection", none)}


def test_marks_and_results(spark):
    h = spark.createDataFrame([(1, "verified"), (2, "provisional")], "record_id long, record_quality string")
    m = spark.createDataFrame([(2, "verified", 1), (2, "rejected", 5), (9, "verified", 2)], "record_id long, quality string, seq long")
    assert {tuple(r) for r in A.with_quality(h, m).select("record_id", "record_quality").collect()} == {(1, "verified"), (2, "rejected")}
    a = spark.createDataFrame([("x", 1), ("x", 2), ("y", 3)], "source_file string, activity_id long")
    i = spark.createDataFrame([("x", "ERROR"), ("x", "WARNING"), ("y", "WARNING")], "source_file string, severity string")
    assert {tuple(r) for r in A.parse_result(a, i).collect()} == {("x", 2, 1, 1, False), ("y", 1, 0, 1, True)}
