"""Semantic search over records, exact or through an inverted file of cells, and what it is evidence for.

Exact search scores blocks of queries against blocks of records. The inverted file assigns every record to the nearest of
some centres, which are fitted on a bounded sample, and asks only the records of the cells nearest to a query; cells are cut
into slices of bounded size, so that a cell that holds a third of all records is many tasks. Scores are exact either way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.functions.numbers import ratio, rounded
from plumbline.operators.history import ENOUGH, buffer_days, positive_mean, risk_level
from plumbline.operators.matching import best_in_block, first_by_cosine, top_by_cosine
from plumbline.operators.scan import scratch

SAMPLE = 20_000  # records that centres are fitted on, at most
SLICE = 20_000  # records of a cell that one task scores, about
ASKED = 2_000  # queries that one task scores, about


def usable(records: DataFrame, quality: str | None) -> DataFrame:
    return records if quality is None else records.where(F.col("record_quality") == quality)


def semantic_search(queries: DataFrame, records: DataFrame, keep: int = 5, quality: str | None = "verified") -> DataFrame:
    """(query_id, item_id, score, rank) of queries(id, v) against records(id, v, record_quality) of a quality, exactly."""
    return top_by_cosine(queries, usable(records, quality).select("id", "v"), keep)


@dataclass
class InvertedFile:
    """centres: cells x dimensions, of length 1; table: (id, v, cell, slice); slices: how many a cell has."""

    centres: np.ndarray
    table: DataFrame
    slices: DataFrame


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n == 0, 1, n)


def fit_centres(sample: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Centres of unit length by spherical k-means, begun with sampled rows at even distances; empty cells keep their centre."""
    x = _unit(sample.astype(float))
    x = x[np.linalg.norm(x, axis=1) > 0]
    if not len(x):
        return np.zeros((0, sample.shape[1] if sample.ndim == 2 else 0))
    c = x[np.linspace(0, len(x) - 1, min(cells, len(x))).astype(int)].copy()
    for _ in range(rounds):
        at = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(np.linalg.norm(sums, axis=1, keepdims=True) > 0, _unit(sums), c)
    return c


def inverted_file(records: DataFrame, cells: int, sample: int = SAMPLE) -> InvertedFile:
    """An index of records(id, v): every row is in the table, in the cell of its nearest centre.

    Centres are fitted on at most `sample` rows, those of the smallest hashes; rows without a direction are in cell 0, rows
    with a null vector in none. Vectors have one length.
    """
    rows = records.select("id", F.col("v").cast("array<double>").alias("v")).where("v is not null")
    drawn = rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").collect()  # bounded by `sample`
    centres = fit_centres(np.array([r.v for r in drawn]) if drawn else np.zeros((0, 0)), cells)

    def assign(batches):
        for b in batches:
            x = np.vstack(b["v"]) if len(b) else np.zeros((0, centres.shape[1]))
            b["cell"] = (_unit(x) @ centres.T).argmax(1).astype(np.int32) if len(centres) else np.zeros(len(b), np.int32)
            yield b

    kind = dict(rows.dtypes)["id"]
    table = scratch(rows.mapInPandas(assign, f"id {kind}, v array<double>, cell int"), "cells")
    slices = table.groupBy("cell").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))  # one row a cell
    table = table.join(F.broadcast(slices), "cell").select("id", "v", "cell", F.pmod(F.xxhash64("id"), F.col("slices")).cast("int").alias("slice"))
    return InvertedFile(centres, scratch(table, "slices"), scratch(slices, "slice-counts"))


def probed_search(queries: DataFrame, index: InvertedFile, keep: int = 5, probes: int = 8) -> DataFrame:
    """(query_id, item_id, score, rank): the best records of the `probes` cells nearest to each query(id, v)."""
    centres, n = index.centres, -(-queries.count() // ASKED) or 1
    kind = dict(queries.dtypes)["id"]

    def nearest(batches):
        for b in batches:
            if not len(b) or not len(centres):
                continue
            near = np.argsort(-(_unit(np.vstack(b["v"]).astype(float)) @ centres.T), axis=1, kind="stable")[:, :probes]
            yield pd.DataFrame({"asking": b["id"], "w": b["v"], "cells": [list(map(int, r)) for r in near]})

    asked = queries.select("id", F.col("v").cast("array<double>").alias("v")).where("v is not null").mapInPandas(nearest, f"asking {kind}, w array<double>, cells array<int>")
    asked = asked.select("asking", "w", F.explode("cells").alias("cell"), F.pmod(F.xxhash64("asking"), F.lit(n)).cast("int").alias("qb")).join(F.broadcast(index.slices), "cell")
    asked = asked.select("asking", "w", "cell", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "qb")
    items = index.table.select(F.col("id").alias("item"), F.col("v").alias("u"), "cell", "slice", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("qb"))
    at = ["cell", "slice", "qb"]
    item_kind = dict(index.table.dtypes)["id"]
    near = asked.groupBy(*at).cogroup(items.groupBy(*at)).applyInPandas(best_in_block(keep), f"query_id {kind}, item_id {item_kind}, score double")
    return first_by_cosine(near, keep)


def evidence(hits: DataFrame, records: DataFrame, fields: list[str]) -> DataFrame:
    """(query_id, records): of each query the records that were found, best first, with their fields and similarity.

    A query has as many as the search kept. A record that is gone is left out."""
    met = hits.join(records.select(F.col("id").alias("item_id"), *fields), "item_id")
    row = F.struct("rank", F.col("item_id").alias("record_id"), *fields, rounded(F.col("score"), 4).alias("similarity"))
    return met.groupBy("query_id").agg(F.array_sort(F.collect_list(row)).alias("records"))


# ---- risk from retrieved records -------------------------------------------------------------------------------


def _profile(rows: DataFrame, *by: str) -> DataFrame:
    """Statistics of retrieved records (by, pos, variance_days, ...), with causes: most frequent first, then first seen."""
    stats = rows.groupBy(*by).agg(
        F.count("*").alias("n"), rounded(ratio(F.count_if("delayed"), F.count("*")), 3).alias("delay_frequency"), rounded(F.avg("variance_days"), 2).alias("mean_variance"),
        rounded(positive_mean("planned_days"), 2).alias("mean_planned"), rounded(positive_mean("actual_days"), 2).alias("mean_actual"),
    )
    c = rows.where(F.col("delayed") & F.col("delay_cause").isNotNull() & (F.col("delay_cause") != "")).groupBy(*by, "delay_cause").agg(F.count("*").alias("k"), F.min("pos").alias("first"))
    c = c.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct((-F.col("k")).alias("k"), "first", "delay_cause"))).alias("found"))  # no more than records were kept
    same = None
    for b in by:
        same = stats[b].eqNullSafe(c[b]) if same is None else same & stats[b].eqNullSafe(c[b])
    out = stats.join(c, same, "left").select(*[stats[x] for x in stats.columns], "found")
    said = F.transform(F.coalesce("found", F.array().cast("array<struct<k:bigint,first:bigint,delay_cause:string>>")), lambda x: F.struct(x["delay_cause"].alias("cause"), (-x["k"]).alias("n"), rounded(ratio(-x["k"], F.col("n")), 3).alias("frequency")))
    return out.withColumn("causes", said).drop("found")


def risk_from_records(activities: DataFrame, history: DataFrame, keep: int = 20, search=semantic_search) -> DataFrame:
    """Risk of activities(activity_id, discipline, activity_type, v) from history(id, discipline, activity_type, v,
    record_quality, planned_days, actual_days, variance_days, delayed, delay_cause), by verified records.

    An activity whose discipline and type (null: any) have ENOUGH records takes the first `keep` of them, by id: path
    exact, whose profile is made once for all activities that ask alike. Any other asks the `keep` records of nearest
    vectors and takes those of its discipline: path semantic; else the few of its own: path few; else none, and its risk is
    UNKNOWN. Names are compared regardless of case.
    """
    v = usable(history, "verified").withColumns({"d": F.lower("discipline"), "t": F.lower("activity_type")})
    a = activities.withColumns({"d": F.lower("discipline"), "t": F.lower("activity_type")})
    null = F.lit(None).cast("string")
    grains = F.array(*[F.struct(d.alias("d"), t.alias("t")) for d in (F.col("d"), null) for t in (F.col("t"), null)])
    wanted = a.select(F.struct("d", "t").alias("key")).distinct()
    keyed = v.withColumn("key", F.explode(F.array_distinct(grains))).join(wanted, "key", "left_semi")
    n = keyed.groupBy("key").agg(F.count("*").alias("own"))
    place = F.row_number().over(Window.partitionBy("key").orderBy("id"))
    firsts = keyed.withColumn("pos", place).where(F.col("pos") <= keep).withColumn("pos", F.col("pos").cast("long"))
    exact = scratch(_profile(firsts, "key").join(n, "key"), "risk-exact")
    a = a.withColumn("key", F.struct("d", "t"))
    met = a.join(exact.select("key", "own"), "key", "left")
    sparse = scratch(met.where(F.coalesce("own", F.lit(0)) < ENOUGH).select("activity_id", "d", "v"), "risk-sparse")
    hits = search(sparse.select(F.col("activity_id").alias("id"), "v"), history, keep)
    found = hits.join(v.withColumnRenamed("d", "of"), F.col("item_id") == F.col("id")).join(sparse.select(F.col("activity_id").alias("query_id"), "d"), "query_id")
    found = found.where(F.col("d").isNull() | (F.col("d") == F.col("of"))).withColumn("pos", F.col("rank").cast("long"))
    near = _profile(found, "query_id").withColumnRenamed("query_id", "activity_id")
    cols = ["n", "delay_frequency", "mean_variance", "mean_planned", "mean_actual", "causes"]
    e = exact.select("key", "own", *[F.col(c).alias(f"e_{c}") for c in cols])
    s = near.select("activity_id", *[F.col(c).alias(f"s_{c}") for c in cols])
    out = a.join(e, "key", "left").join(s, "activity_id", "left")
    path = F.when(F.col("own") >= ENOUGH, "exact").when(F.col("s_n").isNotNull(), "semantic").when(F.col("own").isNotNull(), "few").otherwise("none")
    out = out.withColumn("path", path).withColumns({c: F.when(F.col("path") == "semantic", F.col(f"s_{c}")).otherwise(F.col(f"e_{c}")) for c in cols})
    sure = F.when(F.col("n").isNull(), "none").when(F.col("n") >= 10, "high").when(F.col("n") >= 4, "medium").otherwise("low")
    said = F.array_join(F.transform("causes", lambda c: F.concat(c["cause"], F.lit("="), c["n"].cast("string"))), ",")
    return out.select(
        "activity_id", "path", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "delay_frequency", "mean_variance", "mean_planned", "mean_actual", risk_level(F.col("delay_frequency")).alias("risk_level"),
        sure.alias("confidence"), F.coalesce(buffer_days(F.col("mean_variance"), F.col("delay_frequency")), F.lit(0)).cast("long").alias("buffer"), F.coalesce(said, F.lit("")).alias("causes"),
    )

