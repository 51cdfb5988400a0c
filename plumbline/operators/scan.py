"""Prefix scans in a total order: running extremes and sums, ranks, neighbours, and weights that every step changes.

No window holds the table. Rows are dealt to ranges of the order and stored, ranges are folded where they lie, one row a
range is scanned, and what comes before a range is applied to its rows. There are as many ranges as shuffle partitions,
whatever the number of rows, and a range is a run of rows of even size, so that no key can make one of them hot. Orders
have to be total: where keys tie, neighbours and ranks are not defined.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; only on one machine, as in tests, a folder of our own."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("a cluster has to name a shared folder in spark.checkpoint.dir")
    return "/tmp/plumbline-checkpoints"


def scratch(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read back, so that sampled ranges are settled once and lineage ends."""
    path = f"{scratch_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@dataclass
class Running:
    """A column of the scan: what a range folds to, how folds combine, and what a row has within its range."""

    kind: str
    value: Column | None = None


def running_max(value: Column) -> Running:
    """The largest value up to and with the row."""
    return Running("max", value)


def running_sum(value: Column) -> Running:
    """The sum of values up to and with the row."""
    return Running("sum", value)


def row_number() -> Running:
    """The row's place in the order, from 1."""
    return Running("row")


def previous(value: Column) -> Running:
    """The value of the row before; null at the first."""
    return Running("lag", value)


def running_last(value: Column) -> Running:
    """The last value that is not null, up to and with the row."""
    return Running("last", value)


def following(value: Column) -> Running:
    """The value of the row after; null at the last."""
    return Running("lead", value)


def scanned(rows: DataFrame, order: list[str], **columns: Running) -> DataFrame:
    """rows with a column for each scan, in the order of the given columns, ascending with nulls first.

    Nulls are left out of extremes and sums. An empty table gives an empty result. `order` has to be total.
    """
    put = {f"__v_{n}": c.value for n, c in columns.items() if c.value is not None}
    dealt = rows.withColumns(put) if put else rows
    dealt = dealt.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
    dealt = scratch(dealt, "ranges")
    key = F.struct(*order)
    folds, before = [F.count("*").alias("__n")], []
    ahead, behind = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1), Window.orderBy("__range")
    for n, c in columns.items():
        v, t = f"__v_{n}", f"__t_{n}"
        if c.kind == "max":
            folds.append(F.max(v).alias(t))
            before.append(F.max(t).over(ahead).alias(f"__b_{n}"))
        elif c.kind == "sum":
            folds.append(F.sum(v).alias(t))
            before.append(F.sum(t).over(ahead).alias(f"__b_{n}"))
        elif c.kind == "row":
            before.append(F.sum("__n").over(ahead).alias(f"__b_{n}"))
        elif c.kind == "last":
            folds.append(F.max_by(v, F.when(F.col(v).isNotNull(), key)).alias(t))
            before.append(F.last(t, True).over(ahead).alias(f"__b_{n}"))
        elif c.kind == "lag":
            folds.append(F.max_by(F.struct(v), key).alias(t))
            before.append(F.lag(t).over(behind).alias(f"__b_{n}"))
        else:
            folds.append(F.min_by(F.struct(v), key).alias(t))
            before.append(F.lead(t).over(behind).alias(f"__b_{n}"))
    tops = dealt.groupBy("__range").agg(*folds)  # one row a range
    met = dealt.join(F.broadcast(tops.select("__range", *before)), "__range")
    inner = Window.partitionBy("__range").orderBy(*order)
    upto = inner.rowsBetween(Window.unboundedPreceding, 0)
    out = {}
    for n, c in columns.items():
        v, b = f"__v_{n}", F.col(f"__b_{n}")
        if c.kind == "max":
            out[n] = F.greatest(F.max(v).over(upto), b)
        elif c.kind == "sum":
            own = F.sum(v).over(upto)
            out[n] = F.when(own.isNull() & b.isNull(), None).otherwise(F.coalesce(own, F.lit(0)) + F.coalesce(b, F.lit(0)))
        elif c.kind == "last":
            out[n] = F.coalesce(F.last(v, True).over(upto), b)
        elif c.kind == "row":
            out[n] = F.row_number().over(inner).cast("long") + F.coalesce(b, F.lit(0))
        else:
            near = F.lag(F.struct(v)).over(inner) if c.kind == "lag" else F.lead(F.struct(v)).over(inner)
            out[n] = F.coalesce(near, b)[v]
    return met.withColumns(out).select(*rows.columns, *columns)


def weight_trace(steps: DataFrame, weights: list[list[float]], rate: float, low: float, high: float) -> DataFrame:
    """(seq, action, weights, before, after) of each step(seq, action, reward, features): all weights before it, action by
    action, and those of its action before and after.

    A step moves the weights of its action, w -> clip(w + rate * reward * features, low, high), and leaves the others. Runs
    of steps are themselves such a map, w -> min(top, max(least, w + shift)), and maps compose: ranges of seq are folded
    where they lie, the folds are composed in the order of ranges, and each range is then walked with the weights that it
    begins with. A null reward moves nothing. seq has to be unique.
    """
    k, n = len(weights), len(weights[0])
    kind = dict(steps.dtypes)["seq"]
    dealt = steps.select("seq", F.col("action").cast("int").alias("action"), F.coalesce(F.col("reward"), F.lit(0.0)).cast("double").alias("reward"), F.col("features").cast("array<double>").alias("features"))
    dealt = scratch(dealt.repartitionByRange("seq").withColumn("range", F.spark_partition_id()), "steps")

    def fold(batches):
        part, shift, least, top = None, np.zeros((k, n)), np.full((k, n), -np.inf), np.full((k, n), np.inf)
        out = lambda: pd.DataFrame({"range": [part], "shift": [shift.ravel()], "least": [least.ravel()], "top": [top.ravel()]})
        for b in batches:
            for r, a, reward, f in zip(b["range"], b["action"], b["reward"], b["features"], strict=True):
                if r != part:
                    if part is not None:
                        yield out()
                    part, shift, least, top = r, np.zeros((k, n)), np.full((k, n), -np.inf), np.full((k, n), np.inf)
                move = rate * reward * np.asarray(f, float)
                shift[a] += move
                least[a], top[a] = np.clip(least[a] + move, low, high), np.clip(top[a] + move, low, high)
        if part is not None:
            yield out()

    ordered = dealt.repartition("range").sortWithinPartitions("range", "seq")
    maps = ordered.mapInPandas(fold, "range int, shift array<double>, least array<double>, top array<double>").collect()  # one row a range
    at, begins = np.asarray(weights, float), {}
    for r in sorted(maps, key=lambda r: r.range):
        begins[r.range] = at
        moved = at + np.reshape(r["shift"], (k, n))
        at = np.minimum(np.reshape(r.top, (k, n)), np.maximum(np.reshape(r.least, (k, n)), moved))

    def walk(batches):
        part, w = None, None
        for b in batches:
            every, before, after = [], [], []
            for r, a, reward, f in zip(b["range"], b["action"], b["reward"], b["features"], strict=True):
                if r != part:
                    part, w = r, begins[r].copy()
                every.append(w.ravel().copy())
                before.append(w[a].copy())
                if reward:
                    w[a] = np.clip(w[a] + rate * reward * np.asarray(f, float), low, high)
                after.append(w[a].copy())
            yield pd.DataFrame({"seq": b["seq"], "action": b["action"], "weights": every, "before": before, "after": after})

    return ordered.mapInPandas(walk, f"seq {kind}, action int, weights array<double>, before array<double>, after array<double>")
