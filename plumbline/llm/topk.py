"""Exact top-k inner products: vectors in blocks of descending length, rotated partial sums, Cauchy-Schwarz bounds.

Candidates are range-partitioned by length, longest first, and packed into blocks; queries are packed into blocks too,
and every query block meets every block of candidates that its bounds do not exclude. A first pass over the longest
block gives each query a threshold. Inside a block, the first coordinates of an orthogonal rotation (eigenvectors of
the second-moment matrix) give partial sums, and the lengths of what is left bound the rest; whatever may still reach
the threshold is scored exactly in whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import stored

BLOCK = 4096  # candidates in a block, at most
QUERY_BLOCK = 512
SLACK = 1e-9  # relative error that floating-point bounds are given
LONG = 2**63 - 1


def whole_numbers(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: int = 256) -> DataFrame:
    """(id, v array<bigint>, norm) with v = floor(scale * x); rows with a null id, a null vector or a null or non-finite component go."""
    x = F.col(vec_col)
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    v = F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long"))
    rows = vectors.where(x.isNotNull() & ~F.coalesce(bad, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, c: a + c.cast("double") * c.cast("double")))
    return rows.where("id is not null").withColumn("norm", norm)


def _matrix(col: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as a dense matrix; shorter vectors end in zeros."""
    arr = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    arr = arr.chunk(0) if isinstance(arr, pa.ChunkedArray) else arr
    flat, n = arr.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(arr.offsets.to_numpy())
    out = np.zeros((len(arr), dim), np.int64)
    if len(arr):
        out[np.repeat(np.arange(len(arr)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _rotation(rows: DataFrame, dim: int) -> np.ndarray:
    """Eigenvectors, largest first, of the sum of outer products: dim x dim numbers, whatever the number of rows."""

    def moments(batches):
        total = np.zeros((dim, dim))
        for b in batches:
            m = _matrix(b.column(0), dim).astype(float)
            total += m.T @ m
        yield pa.RecordBatch.from_pydict({"i": np.arange(dim), "m": list(total)}, schema=pa.schema([("i", pa.int64()), ("m", pa.list_(pa.float64()))]))

    parts = rows.select("v").mapInArrow(moments, "i long, m array<double>")
    cells = parts.select("i", F.posexplode("m").alias("j", "x")).groupBy("i", "j").agg(F.sum("x").alias("x")).collect()
    m = np.zeros((dim, dim))
    for r in cells:
        m[r.i, r.j] = r.x
    peak = np.abs(m).max() or 1.0
    return np.linalg.eigh(m / peak)[1][:, ::-1].copy() if np.isfinite(peak) else np.eye(dim)


def _packed(rows: DataFrame, dim: int, limit: int, chunked: bool) -> DataFrame:
    """Blocks of rows in the order they come: chunk, ids, vectors, longest norm."""

    def pack(batches):
        from pyspark import TaskContext

        chunk, ids, vs, ns, held = TaskContext.get().partitionId() if chunked else 0, [], [], [], 0
        schema = pa.schema([("chunk", pa.int32()), ("ids", pa.binary()), ("vs", pa.binary()), ("norm", pa.float64())])

        def out():
            i, v = np.concatenate(ids), np.concatenate(vs)
            for a in range(0, len(i), limit):
                yield pa.RecordBatch.from_pydict(
                    {"chunk": [chunk], "ids": [i[a : a + limit].tobytes()], "vs": [v[a : a + limit].tobytes()], "norm": [max(np.concatenate(ns)[a : a + limit])]}, schema=schema
                )

        for b in batches:
            ids.append(b.column("id").to_numpy())
            vs.append(_matrix(b.column("v"), dim))
            ns.append(b.column("norm").to_numpy())
            held += b.num_rows
            if held >= limit:
                yield from out()
                ids, vs, ns, held = [], [], [], 0
        if held:
            yield from out()

    return rows.mapInArrow(pack, "chunk int, ids binary, vs binary, norm double")


def _exact(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Inner products as int64: in floating point where that is exact, else in Python's integers, held to 64 bits."""
    top = float(np.abs(q).astype(float).max(initial=0)) * float(np.abs(c).astype(float).max(initial=0)) * q.shape[1]
    if top < 2**52:
        return (q.astype(float) @ c.astype(float).T).astype(np.int64)
    return np.clip(q.astype(object) @ c.astype(object).T, -LONG - 1, LONG).astype(np.int64)


def _scan(dim: int, k: int, rotation: np.ndarray, lead: int):
    """Task code: query block against candidate block, with thresholds where they are known."""

    def scan(batches):
        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])
        for b in batches:
            for r in b.to_pylist():
                qi, ci = np.frombuffer(r["q_ids"], np.int64), np.frombuffer(r["ids"], np.int64)
                q, c = np.frombuffer(r["q_vs"], np.int64).reshape(-1, dim), np.frombuffer(r["vs"], np.int64).reshape(-1, dim)
                floor = np.frombuffer(r["floors"], np.float64) if r["floors"] is not None else np.full(len(qi), -np.inf)
                qr, cr = q.astype(float) @ rotation, c.astype(float) @ rotation
                qn, cn = np.sqrt((q.astype(float) ** 2).sum(1)), np.sqrt((c.astype(float) ** 2).sum(1))
                bound = qr[:, :lead] @ cr[:, :lead].T
                bound += np.sqrt((qr[:, lead:] ** 2).sum(1))[:, None] * np.sqrt((cr[:, lead:] ** 2).sum(1))[None, :]
                bound += SLACK * (1 + qn[:, None] * cn[None, :])
                may = (bound >= floor[:, None]) & (qi[:, None] != ci[None, :])
                live = np.flatnonzero(may.any(1))
                some = np.flatnonzero(may[live].any(0)) if len(live) else live
                if not len(some):
                    continue
                score, may = _exact(q[live], c[some]), may[np.ix_(live, some)]
                out = {"query_id": [], "vec_id": [], "score": []}
                for row, (s, m) in enumerate(zip(score, may, strict=True)):
                    at = np.flatnonzero(m)
                    if len(at) > k:  # all that tie with the k-th stay until ids have decided
                        at = at[s[at] >= np.partition(s[at], len(at) - k)[len(at) - k]]
                    at = at[np.lexsort((ci[some[at]], -s[at].astype(object)))][:k] if len(at) else at
                    out["query_id"] += [qi[live[row]]] * len(at)
                    out["vec_id"] += list(ci[some[at]])
                    out["score"] += list(s[at])
                yield pa.RecordBatch.from_pydict(out, schema=schema)

    return scan


def exact_top_k(queries: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k highest inner products of each query, ties to the smaller vec_id.

    Both tables are of whole_numbers(). A candidate with the query's own id is left out. Vectors of different lengths
    meet in their common coordinates. Scores are exact; beyond 64 bits they are held at the ends. A query without
    candidates has no rows, and so has an empty table; rows that repeat an id count as candidates of their own.
    """
    top = candidates.agg(F.max(F.size("v")).alias("d"), F.count("*").alias("n")).first()
    dim, n = max(top.d or 1, queries.agg(F.max(F.size("v"))).first()[0] or 1), top.n
    lead = max(1, dim // 2)
    rotation = _rotation(candidates, dim)
    spread = F.col("norm").desc(), F.col("id")
    chunks = max(1, -(-n // BLOCK))
    blocks = stored(_packed(candidates.repartitionByRange(chunks, *spread).sortWithinPartitions(*spread), dim, BLOCK, True), "top-blocks")
    asked = stored(_packed(queries, dim, QUERY_BLOCK, False).drop("chunk").withColumn("block", F.monotonically_increasing_id()), "top-queries")
    asked = asked.select("block", F.col("ids").alias("q_ids"), F.col("vs").alias("q_vs"), F.col("norm").alias("q_norm"))
    scan, kind = _scan(dim, k, rotation, lead), "query_id long, vec_id long, score long"
    first = blocks.agg(F.min("chunk")).first()[0]
    if first is None:
        return blocks.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    # first pass: the longest candidates give each query its k-th best so far
    pairs = asked.withColumn("chunk", F.explode(F.array(F.lit(first)))).join(blocks, "chunk").withColumn("floors", F.lit(None).cast("binary"))
    begun = stored(pairs.mapInArrow(scan, kind), "top-first")
    at_k = begun.withColumn("r", F.row_number().over(best)).where(F.col("r") == k).select("query_id", F.col("score").alias("floor"))
    floors = _with_floors(asked, at_k)
    # every other block: lengths alone exclude a block whose longest vector can't reach any query's threshold; only blocks'
    # numbers and lengths meet for that, vectors follow where a pair is left
    floors, lengths = stored(floors, "top-floors"), blocks.groupBy("chunk").agg(F.max("norm").alias("norm"))
    rest = floors.select("block", "q_norm", "least", F.explode(F.sequence(F.lit(0), F.lit(blocks.agg(F.max("chunk")).first()[0]))).alias("chunk"))
    rest = rest.where(F.col("chunk") != first).join(lengths, "chunk")
    rest = rest.where((F.col("q_norm") * F.col("norm") * (1 + 1e-6) + 1 >= F.col("least")) | F.col("least").isNull())
    rest = rest.select("block", "chunk").join(floors, "block").join(blocks, "chunk")
    found = rest.mapInArrow(scan, kind).unionByName(begun)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _with_floors(asked: DataFrame, at_k: DataFrame) -> DataFrame:
    """Query blocks with their thresholds, in the order of their ids, and the least of them (null: one is unknown)."""

    def ids(batches):
        for b in batches:
            for r in b.to_pylist():
                i = np.frombuffer(r["q_ids"], np.int64)
                yield pa.RecordBatch.from_pydict({"block": np.full(len(i), r["block"]), "pos": np.arange(len(i)), "query_id": i})

    flat = asked.select("block", "q_ids").mapInArrow(ids, "block long, pos long, query_id long")
    known = flat.join(at_k, "query_id", "left").groupBy("block").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.col("floor").cast("double").alias("f")))).alias("fs"),
        F.when(F.count("floor") == F.count("*"), F.min("floor")).alias("least"),
    )

    def to_bytes(batches):
        for b in batches:
            fs = [np.array([-np.inf if x["f"] is None else np.nextafter(x["f"], -np.inf) for x in r]).tobytes() for r in b.column("fs").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("block"), pa.array(fs, pa.binary()), b.column("least")], names=["block", "floors", "least"])

    return asked.join(known.mapInArrow(to_bytes, "block long, floors binary, least long"), "block")
