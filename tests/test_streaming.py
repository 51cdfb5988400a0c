"""Streaming forms give what their batch forms give."""

from pyspark.sql import functions as F

from plumbline.operators import schedule
from plumbline.plans import bindings
from plumbline.streaming import jobs

SF = "/root/testdata/sf0.001"


def drained(spark, df, name, mode="append", tmp=None):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", str(tmp)).start()
    q.awaitTermination(120)
    return spark.table(name)


def stream(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(2).write.parquet(str(tmp_path / "in"))
    return e, spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))


def test_windows(spark, tmp_path):
    e, s = stream(spark, tmp_path)
    got = drained(spark, jobs.window_counts(s, "1 day", watermark="40 days"), "w", "complete", tmp_path / "c")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, jobs.window_counts(e, "1 day").collect()))


def test_once(spark, tmp_path):
    e, s = stream(spark, tmp_path)
    assert drained(spark, jobs.once(s.unionByName(s), "40 days"), "o", tmp=tmp_path / "c").count() == e.count()


def test_state(spark, tmp_path):
    batch = bindings.claims(spark, SF).select("activity_id", "seq", "event_id", "event_date", "status")
    batch.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    got = {r.activity_id: r for r in drained(spark, jobs.follow_state(s), "f", "update", tmp_path / "c").collect()}
    acts = batch.select("activity_id").distinct().withColumn("planned_start", F.lit(None).cast("date"))
    want = schedule.fold_state(acts, batch).collect()
    assert len(want) == len(got)
    for r in want:
        g = got[r.activity_id]
        assert (g.status, g.evidence, g.actual_finish) == (r.status, r.evidence, r.actual_finish and r.actual_finish.isoformat())


def test_upsert(spark, tmp_path):
    p = str(tmp_path / "t")
    jobs.upsert_latest(spark.createDataFrame([(1, "a"), (2, "b")], "activity_id long, v string"), p)
    jobs.upsert_latest(spark.createDataFrame([(2, "c"), (3, "d")], "activity_id long, v string"), p)
    assert {(r.activity_id, r.v) for r in spark.read.parquet(f"{p}/v1").collect()} == {(1, "a"), (2, "c"), (3, "d")}
