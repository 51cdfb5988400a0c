"""Clarifications and decisions: streams, replays and broken runs against the batch forms and plain loops."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from plumbline.streaming import clarify, decisions

BEGIN = datetime(2024, 3, 1)


def plain(messages, patience, now=None):
    out, held = [], {}
    for key, seq, ts, kind, text in sorted(messages, key=lambda m: (repr(m[0]), m[2], m[1])):
        h = held.get(key)
        if h and (ts - h[1]).total_seconds() > patience:
            out.append((key, h[0], "expired", None, None, None))
            h = None
        if kind == "question":
            if h:
                out.append((key, h[0], "superseded", None, None, None))
            h = (seq, ts)
        elif h:
            out.append((key, h[0], "answered", seq, text, int((ts - h[1]).total_seconds())))
            h = None
        else:
            out.append((key, None, "unasked", seq, text, None))
        held[key] = h
    for key, h in held.items():
        if h:
            open_ = now is not None and (now - h[1]).total_seconds() <= patience
            out.append((key, h[0], "open" if open_ else "expired", None, None, None))
    return sorted(out, key=repr)


def made(n, keys, seed):
    rnd = random.Random(seed)
    return [(rnd.choice(keys), i, BEGIN + timedelta(seconds=i * 20), rnd.choice(["question", "answer"]), f"text {i}") for i in range(n)]


SCHEMA = "key string, seq long, ts timestamp, kind string, text string"


def test_clarifications(spark):
    rows = made(600, ["hot", "hot", "hot", "a", "b", None], 1)
    df = spark.createDataFrame(rows + [("a", 9999, BEGIN, "note", "left out")], SCHEMA).repartition(5)
    for now in (None, BEGIN + timedelta(seconds=600 * 20)):
        got = clarify.clarifications(df, 100, now)
        assert sorted(map(tuple, got.collect()), key=repr) == plain(rows, 100, now)
    assert {r[2] for r in plain(rows, 100, now)} == {"answered", "superseded", "expired", "unasked", "open"}
    assert clarify.clarifications(df.limit(0), 100).count() == 0


def test_clarifications_as_a_stream_that_restarts(spark, tmp_path):
    rows = made(240, ["x", "y", "z", "w"], 3) + [("end", 10_000, BEGIN + timedelta(days=2), "answer", "moves the watermark"), ("end", 10_001, BEGIN + timedelta(days=3), "answer", "again")]
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    parts = [rows[:80], rows[80:160], rows[160:-1], rows[-1:]]

    def drain():
        s = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = clarify.follow_clarifications(s, 100).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        assert q.awaitTermination(240)

    try:
        for k, part in enumerate(parts):  # the query stops and begins again from its checkpoint for every file
            spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
            if k in (1, 2, 3):
                drain()
    finally:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(map(tuple, got), key=repr) == plain(rows, 100)


def test_rematched(spark):
    o = spark.createDataFrame([("a", 1, "answered", 2, "PIP-1 — Erect", 5), ("b", 1, "answered", 2, " PIP-1", 5), ("c", 1, "answered", 2, "PIP-10", 5), ("d", 1, "expired", None, None, None), ("e", 1, "answered", 3, "", 1)], "key string, question_seq long, outcome string, answer_seq long, answer string, waited long")
    a = spark.createDataFrame([("PIP-1",), ("PIP-1",), ("PIP-2",)], "activity_id string")
    got = {r.key: (r.activity_id, r.filled) for r in clarify.rematched(o, a).collect()}
    assert got == {"a": ("PIP-1", None), "b": ("PIP-1", None), "c": (None, "PIP-10"), "e": (None, "")}


def test_review_state(spark):
    rows = [
        (1, 1, "approve", None, "ann"), (2, 1, "reject", None, "bob"), (3, 1, "Reassign ", 8, "cy"), (4, 1, "reassign", 99, "dan"), (5, 1, "reassign", None, "eve"),
        (6, 2, "approve", None, "ann"), (7, 2, "perhaps", None, "ann"), (8, 3, "reject", None, "bob"), (9, 77, "approve", None, "x"), (10, 3, None, None, "x"),
    ]
    d = spark.createDataFrame(rows, "seq long, event_id long, decision string, activity_id long, reviewer string")
    m = spark.createDataFrame([(1, 7), (2, None), (3, 5)], "event_id long, matched_activity_id long")
    a = spark.createDataFrame([(5,), (7,), (8,)], "activity_id long")
    got = {r.event_id: (r.link_state, r.linked_activity_id, r.reviewer, r.decisions, r.refused) for r in decisions.review_state(d, m, a).collect()}
    assert got == {1: ("approved", 8, "cy", 3, 2), 2: (None, None, None, 0, 2), 3: ("rejected", None, "bob", 1, 1), 77: (None, None, None, 0, 1)}
    bad = {r.seq: r.problem for r in decisions.checked(d, m, a).collect()}
    assert bad == {1: None, 2: None, 3: None, 4: "unknown activity", 5: "reassign without activity", 6: "nothing to approve", 7: "unknown decision", 8: None, 9: "unknown event", 10: "unknown decision"}


def test_log_is_applied_once(spark, tmp_path):
    rnd = random.Random(6)
    rows = [(i, rnd.randrange(40), f"d{i}") for i in range(300)]
    batches = [rows[a : a + 60] for a in range(0, 300, 60)]
    schema = "seq long, event_id long, decision string"
    t = decisions.MergedTable(spark, str(tmp_path / "log"), "event_id", buckets=5)
    assert t.read() is None
    for k, b in enumerate(batches):
        before = t.manifest()
        # a run that breaks off before its commit leaves files that nobody reads
        broken = decisions.MergedTable(spark, str(tmp_path / "log"), "event_id", buckets=5)
        broken._commit = lambda m: (_ for _ in ()).throw(RuntimeError("lost"))
        with pytest.raises(RuntimeError):
            broken.merge(spark.createDataFrame([(10_000, 1, "half written")], schema), k)
        assert t.manifest() == before
        assert t.merge(spark.createDataFrame(rnd.sample(b, len(b)), schema), k)
        assert not t.merge(spark.createDataFrame([(20_000, 2, "replayed")], schema), k)
        want = {}
        for r in rows[: 60 * (k + 1)]:
            want[r[1]] = r
        assert {tuple(r) for r in t.read().select("seq", "event_id", "decision").collect()} == set(want.values())
    # an older decision that comes late changes nothing; an empty batch is applied too
    t.merge(spark.createDataFrame([(-1, rows[-1][1], "late")], schema), 5)
    t.merge(spark.createDataFrame([], schema), 6)
    assert t.manifest()["applied"] == 6 and {tuple(r) for r in t.read().select("seq", "event_id", "decision").collect()} == set(want.values())


def test_log_as_a_sink(spark, tmp_path):
    schema = "seq long, event_id long, decision string"
    for k in range(4):
        spark.createDataFrame([(10 * k + i, i, f"d{k}") for i in range(k, 6)], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    t = decisions.MergedTable(spark, str(tmp_path / "log"), "event_id", buckets=3)
    for c in ("c1", "c2"):  # a second query begins anew, and its batches count as applied
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        q = s.writeStream.foreachBatch(lambda df, i: t.merge(df, i) and None).option("checkpointLocation", str(tmp_path / c)).trigger(availableNow=True).start()
        assert q.awaitTermination(120)
    assert {(r.event_id, r.seq) for r in t.read().collect()} == {(0, 0), (1, 11), (2, 22), (3, 33), (4, 34), (5, 35)}


def test_live_heads(spark):
    rows = [(i, i + 1 if i % 50 != 49 else None) for i in range(200)] + [(1000, 1001), (2000, 5), (2001, 5)]
    got = {r.id: (r.head, r.steps) for r in decisions.live_heads(spark.createDataFrame(rows, "id long, next long")).collect()}
    want = {i: (i // 50 * 50 + 49, 49 - i % 50) for i in range(200)} | {1000: (1000, 0), 2000: (49, 45), 2001: (49, 45)}
    assert got == want
    with pytest.raises(ValueError):
        decisions.live_heads(spark.createDataFrame([(1, 2), (2, 1)], "id long, next long"))
    assert decisions.live_heads(spark.createDataFrame([], "id long, next long")).count() == 0



def test_decisions_without_activity_are_dealt_out(spark):
    rows = [(i, i % 9, ("approve", "reject", "reassign", "reassign")[i % 4], (None, None, -1, i % 12)[i % 4], f"r{i % 5}") for i in range(4_000)]
    d = spark.createDataFrame(rows, "seq long, event_id long, decision string, activity_id long, reviewer string")
    a = spark.createDataFrame([(k,) for k in range(8)], "activity_id long")
    m = spark.createDataFrame([(k, k if k % 2 else None) for k in range(8)], "event_id long, matched_activity_id long")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for out in (decisions._named(d, a), decisions.checked(d, m, a)):
            sizes = [r[0] for r in out.groupBy(F.spark_partition_id()).count().select("count").collect()]
            assert sum(sizes) == 4_000 and max(sizes) < 1_300  # of four tasks
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    good = {e: [r for r in rows if r[1] == e and e < 8 and (r[2] == "reject" or (r[2] == "approve" and e % 2) or (r[2] == "reassign" and 0 <= r[3] < 8))] for e in range(9)}
    got = {r.event_id: (r.reviewer, r.decisions, r.refused) for r in decisions.review_state(d, m, a).collect()}
    assert got == {e: (max(g)[4] if g else None, len(g), sum(r[1] == e for r in rows) - len(g)) for e, g in good.items()}
