"""Streaming forms: windows, late rows, state of activities, idempotent sinks. Each takes a batch or streaming DataFrame."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.operators.scan import running_max, scanned


def window_counts(events: DataFrame, size: str, slide: str | None = None, watermark: str = "1 hour") -> DataFrame:
    """Events by tumbling (or, with slide, overlapping) window and type."""
    if events.isStreaming:
        events = events.withWatermark("ts", watermark)
    w = F.window("ts", size, slide) if slide else F.window("ts", size)
    out = events.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "event_type", "n")


def session_counts(events: DataFrame, gap: str, watermark: str = "1 hour") -> DataFrame:
    """Sessions of each user: a pause of `gap` or more ends one."""
    if events.isStreaming:
        events = events.withWatermark("ts", watermark)
    out = events.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("session_start"), F.col("w.end").alias("session_end"), "n")


def late_rows(events: DataFrame, delay: str) -> DataFrame:
    """Rows of a batch that come, in the order of event_id, more than `delay` behind the latest time seen so far."""
    seen = scanned(events, ["event_id"], seen=running_max(F.col("ts")))
    return seen.where(F.col("ts") < F.col("seen") - F.expr(f"interval {delay}")).select("event_id")


def once(events: DataFrame, watermark: str = "1 hour") -> DataFrame:
    """Each event once, if its copies come within the watermark."""
    if events.isStreaming:
        return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark(["event_id"])
    return events.dropDuplicates(["event_id"])


def follow_state(claims: DataFrame) -> DataFrame:
    """State of each activity after every micro-batch of claims(activity_id, seq, event_id, event_date, status): the
    streaming form of fold_state without planned dates. Only the few numbers of a state are kept, no claims."""

    def fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, start, finish, n = state.get if state.exists else ("NOT_STARTED", None, None, 0)
        rows = pd.concat(list(frames)).sort_values("seq")
        for r in rows.itertuples():
            n += 1
            day = None if pd.isna(r.event_date) else pd.Timestamp(r.event_date).date().isoformat()
            if r.status == "COMPLETED":
                status, finish = "COMPLETED", day
                start = start or "planned"
            elif r.status in ("IN_PROGRESS", "ON_HOLD"):
                start = start or day
                status = status if status == "COMPLETED" else r.status
        state.update((status, start, finish, n))
        yield pd.DataFrame({"activity_id": [key[0]], "status": [status], "actual_start": [start], "actual_finish": [finish], "evidence": [n]})

    schema = "activity_id long, status string, actual_start string, actual_finish string, evidence long"
    keep = "status string, actual_start string, actual_finish string, n long"
    return claims.groupBy("activity_id").applyInPandasWithState(fold, schema, keep, "update", GroupStateTimeout.NoTimeout)


def upsert_latest(batch: DataFrame, path: str, key: str = "activity_id") -> None:
    """foreachBatch sink: rows of the batch replace those of their keys in a table kept as numbered, whole versions.

    A version that a broken run left without its success marker is not read and is written over. decisions.MergedTable
    rewrites only the buckets that a batch touches, orders rows by seq and knows batches that it has applied."""
    spark = batch.sparkSession
    path_of = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path_of(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(path_of(path))] if fs.exists(path_of(path)) else []
    versions = sorted(int(n[1:]) for n in names if fs.exists(path_of(f"{path}/{n}/_SUCCESS")))
    old = spark.read.parquet(f"{path}/v{versions[-1]}") if versions else None
    new = batch if old is None else batch.unionByName(old.join(batch.select(key), key, "left_anti"))
    new.write.mode("overwrite").parquet(f"{path}/v{versions[-1] + 1 if versions else 0}")
