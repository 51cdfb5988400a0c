"""Scans over ranges against plain loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plumbline.operators.scan import following, previous, row_number, running_max, running_sum, scanned, weight_trace


def test_scans(spark):
    rnd = random.Random(4)
    rows = [(k, i, rnd.choice([None, rnd.randrange(100)]), f"v{i}") for i, k in enumerate(rnd.choice(["hot", "hot", "a", None]) for _ in range(3000))]
    df = spark.createDataFrame(rows, "k string, i long, x long, s string").repartition(6)
    got = scanned(df, ["k", "i"], top=running_max(F.col("x")), total=running_sum(F.col("x")), n=row_number(), before=previous(F.col("x")), after=following(F.col("s")))
    assert got.columns == ["k", "i", "x", "s", "top", "total", "n", "before", "after"]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1]))
    top, total, want = None, None, []
    for j, (k, i, x, s) in enumerate(order):
        if x is not None:
            top, total = max(x, top) if top is not None else x, (total or 0) + x
        want.append((k, i, x, s, top, total, j + 1, order[j - 1][2] if j else None, order[j + 1][3] if j + 1 < len(order) else None))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert scanned(df.limit(0), ["k", "i"], n=row_number(), top=running_max(F.col("x"))).count() == 0


@pytest.mark.parametrize("ranges", ["1", "7"])
def test_weight_trace(spark, ranges):
    rnd = random.Random(9)
    steps = [(i * 3, rnd.randrange(3), rnd.choice([None, 0.0, rnd.uniform(-40, 40)]), [rnd.random() for _ in range(4)]) for i in range(500)]
    w = np.array([[0.5, -1, 2, 9.9], [0, 0, 0, 0], [1, 2, 3, -9]], float)
    want, now = {}, w.copy()
    for seq, a, r, f in steps:
        before = now[a].copy()
        now[a] = np.clip(now[a] + 0.05 * (r or 0) * np.array(f), -10, 10)
        want[seq] = (a, before, now[a].copy())
    rnd.shuffle(steps)
    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", ranges)
    try:
        got = weight_trace(spark.createDataFrame(steps, "seq long, action int, reward double, features array<double>"), w.tolist(), 0.05, -10, 10).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert len(got) == 500
    for r in got:
        a, before, after = want[r.seq]
        assert r.action == a and np.allclose(r.before, before, atol=1e-9) and np.allclose(r.after, after, atol=1e-9)
    assert weight_trace(spark.createDataFrame([], "seq long, action int, reward double, features array<double>"), w.tolist(), 0.05, -10, 10).count() == 0
