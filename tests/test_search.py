"""Search over records and risk from what it finds, against brute force."""

import random

import numpy as np
from pyspark.sql import functions as F

from plumbline.operators import search as Q
from plumbline.plans import registry

SF = "/root/testdata/sf0.01"


def test_inverted_file(spark, monkeypatch):
    monkeypatch.setattr(Q, "SLICE", 50)
    rnd = np.random.default_rng(2)
    centres = rnd.normal(size=(12, 16))
    x = np.concatenate([c + 0.35 * rnd.normal(size=(n, 16)) for c, n in zip(centres, [400, *[40] * 11], strict=True)])  # a cell with half of all rows
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, [0.0] * 16), (9001, None)]
    df = spark.createDataFrame(rows, "id long, v array<double>").repartition(4)
    index = Q.inverted_file(df, 12, sample=300)
    assert index.table.count() == len(x) + 1 and index.table.agg(F.max("slice")).first()[0] > 3
    queries = df.where("id % 10 = 0")
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {i: set(np.lexsort((np.arange(len(x)), -(unit @ unit[i]).round(8)))[:5].tolist()) for i in range(0, len(x), 10)}
    for probes, least in ((3, 0.9), (12, 1.0)):
        got = {}
        for r in Q.probed_search(queries, index, 5, probes).collect():
            got.setdefault(r.query_id, set()).add(r.item_id)
        assert sum(len(got[i] & want[i]) for i in want) / (5 * len(want)) >= least
    none = Q.inverted_file(df.limit(0), 12)
    assert Q.probed_search(queries, none, 5, 3).count() == 0 and Q.probed_search(queries.limit(0), index, 5, 3).count() == 0


def test_recall_of_the_registered_search(spark):
    exact, probed = ({(r.query_id, r.item_id) for r in registry.QUERIES[n](spark, SF).collect()} for n in ("semantic_search", "semantic_search_probed"))
    assert len(exact) == 125 and len(exact & probed) / len(exact) >= 0.9


def test_every_path_of_risk_is_taken(spark):
    got = {r.path for r in registry.QUERIES["risk_assess_full"](spark, SF).collect()}
    assert got == {"exact", "semantic", "none"}


def test_risk_from_records(spark):
    rnd = random.Random(3)
    vec = lambda k: [float(k % 5 + 1), float(k % 7), 1.0]
    rows = [(i, "Piping", "weld" if i < 30 else "lift" if i < 32 else "paint", vec(i), "verified" if i % 6 else "rejected", 10, 8 + i % 9, i % 9 - 2, i % 9 > 2, rnd.choice(["rain", "crane", None, ""])) for i in range(34)]
    h = spark.createDataFrame(rows, "id long, discipline string, activity_type string, v array<double>, record_quality string, planned_days int, actual_days int, variance_days int, delayed boolean, delay_cause string")
    asked = [(1, "PIPING", "Weld", vec(1)), (2, "piping", "lift", vec(2)), (3, "civil", "weld", vec(3)), (4, "piping", None, vec(4)), (5, None, "paint", [0.0, 0.0, 0.0]), (6, None, None, vec(6)), (7, "piping", "none such", [0.0, 0.0, 0.0])]
    got = {r.activity_id: r for r in Q.risk_from_records(spark.createDataFrame(asked, "activity_id long, discipline string, activity_type string, v array<double>"), h).collect()}
    good = [r for r in rows if r[4] == "verified"]
    assert {i: r.path for i, r in got.items()} == {1: "exact", 2: "semantic", 3: "none", 4: "exact", 5: "few", 6: "exact", 7: "none"}

    def holds(r, recs):
        late = [x for x in recs if x[8]]
        causes = {}
        for x in late:
            if x[9]:
                causes[x[9]] = causes.get(x[9], 0) + 1
        assert r.n == len(recs) and abs(r.delay_frequency - len(late) / len(recs)) < 6e-4 and abs(r.mean_variance - sum(x[7] for x in recs) / len(recs)) < 6e-3
        assert r.causes == ",".join(f"{c}={n}" for c, n in sorted(causes.items(), key=lambda x: -x[1]))

    holds(got[1], [x for x in good if x[2] == "weld"][:20])
    holds(got[4], good[:20])
    holds(got[6], good[:20])
    holds(got[5], [x for x in good if x[2] == "paint"])
    cos = lambda a, b: round(float(np.dot(a, b) / np.linalg.norm(a) / np.linalg.norm(b)), 8)
    holds(got[2], sorted(good, key=lambda x: (-cos(vec(2), x[3]), x[0]))[:20])
    assert (got[3].n, got[3].risk_level, got[3].confidence, got[3].buffer, got[3].causes) == (0, "UNKNOWN", "none", 0, "")
