"""Duplicates by weighted fields, feedback and replayed policies against plain loops."""

import random
import re
from difflib import SequenceMatcher

from plumbline.operators.matching import replay_policy
from plumbline.operators.review import FIELD_WEIGHTS, TEXT_WEIGHT, feedback_boost, weighted_duplicates


def _similar(a, b):
    score, total = 0.0, TEXT_WEIGHT
    for f, w in FIELD_WEIGHTS.items():
        x, y = a[f], b[f]
        if x and y:
            total += w
            score += w * (x.strip().lower() == y.strip().lower())
    plain = [re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", t["text"].lower().strip())) for t in (a, b)]
    return (score + TEXT_WEIGHT * SequenceMatcher(None, *plain).ratio()) / total


def test_weighted_duplicates(spark):
    rng = random.Random(5)
    values = {"asset": ["V-1", "v-1", "P-2", None, ""], "activity_type": ["lift", "weld", None], "event_date": ["2024-01-01", "2024-01-02", None], "discipline": ["civil", "Civil", None], "status": ["done", "open", None]}
    rows = [{"id": i, "text": rng.choice(["Set V-1!", "set v-1", "weld of P-2, done", "lifted"]), **{f: rng.choice(v) for f, v in values.items()}} for i in range(120)]
    schema = "id long, text string, " + ", ".join(f"{f} string" for f in FIELD_WEIGHTS)
    got = {(r.a, r.b) for r in weighted_duplicates(spark.createDataFrame([tuple(r[c] for c in ["id", "text", *FIELD_WEIGHTS]) for r in rows], schema)).collect()}
    shares = lambda a, b: any(a[f] and b[f] for f in FIELD_WEIGHTS)
    want = {(a["id"], b["id"]) for i, a in enumerate(rows) for b in rows[i + 1 :] if shares(a, b) and _similar(a, b) >= 0.7995}
    near = {(a["id"], b["id"]) for i, a in enumerate(rows) for b in rows[i + 1 :] if abs(_similar(a, b) - 0.7995) < 1e-6}
    assert len(want) > 20 and got - near == want - near


def test_feedback(spark):
    c = spark.createDataFrame([(1, 7, "Pump set"), (2, 7, "nothing alike"), (3, 8, "Pump set")], "event_id long, activity_id long, text string")
    f = spark.createDataFrame([(7, "pump set", True), (7, "pump sets", True), (8, "pump set", False)], "activity_id long, text string, approved boolean")
    assert {r.event_id: r.boost for r in feedback_boost(c, f).collect()} == {1: 0.1, 2: 0.0, 3: 0.0}


def test_replay(spark):
    rng = random.Random(1)
    steps = [(i, rng.uniform(-9, 9), [rng.random(), rng.random()]) for i in range(400)]
    w = [0.4, 4.9]
    for _, r, f in steps:
        w = [max(0.01, min(5.0, x + 0.05 * r * y)) for x, y in zip(w, f, strict=True)]
    mixed = steps[:]
    rng.shuffle(mixed)
    got = replay_policy(spark.createDataFrame(mixed, "seq long, reward double, features array<double>").repartition(7), [0.4, 4.9])
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, w, strict=True))
    assert replay_policy(spark.createDataFrame([], "seq long, reward double, features array<double>"), [0.4]) == [0.4]


def test_pairs_meet_by_what_they_must_share(spark):
    """Events of one discipline and status do not all meet each other: what is joined stays few, and each pair meets once."""
    from pyspark.sql import functions as F

    from plumbline.operators.review import meeting

    n = 3000
    rows = spark.range(n).selectExpr("id", "concat('set ', id div 12) text", "if(id % 3 = 0, null, concat('v-', id div 6)) asset", "'lift' activity_type", "cast(id div 4 as string) event_date", "'civil' discipline", "if(id % 5 = 0, null, 'done') status")
    met = meeting(rows)
    a, b = met.groupBy("key", "has", "other").count(), met.groupBy("key", F.col("has").alias("other"), F.col("other").alias("has")).agg(F.count("*").alias("m"))
    assert a.join(b, ["key", "has", "other"]).agg(F.sum(F.col("count") * F.col("m"))).first()[0] < 10 * n
    got = [(r.a, r.b) for r in weighted_duplicates(rows).collect()]
    assert len(got) > 1000 and len(set(got)) == len(got) and weighted_duplicates(rows.limit(0)).count() == 0
