"""Vector code compression: exact codebook rounds that skip most distances by norm-of-sum bounds.

Vectors are cut into equal parts and each part position has a codebook. A round assigns every part to its nearest entry
and replaces entries by the means of their parts, in whole numbers. What a part knows from earlier rounds is kept with it:
its entry, an upper bound (the distance to that entry) and lower bounds (the least distance to the other entries, by
groups of entries), each with the round it was measured in, its stamp. All codebooks so far are retained, so that a bound
is carried to the present round by the true net displacement of the entries since its stamp, the norm of the sum of their
moves, which is never more than the sum of the norms that a running drift would add up. Only parts whose bounds meet are
measured anew, and only against the groups that may hold a nearer entry; distances then are exact whole numbers.

A round is one pass over a stored table of vectors and bounds, whose tasks also leave the sums of their parts there; the
driver sees codebooks and sums of them alone, whatever the number of rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import discard, stored

GROUPS = 4  # of entries, each with a lower bound
SLACK = 1e-12  # relative error that floating-point bounds are given
LONG = 2**63 - 1
STATE = [("code", pa.binary()), ("upper", pa.binary()), ("upper_at", pa.binary()), ("lower", pa.binary()), ("lower_at", pa.binary())]
SUMS = [("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), ("scanned", pa.int64())]


@dataclass
class Codebooks:
    """What fitting leaves: the codebooks of every round, parts x entries x width, and the distances measured by round."""

    history: list[np.ndarray]
    dim: int
    scanned: list[int] = field(default_factory=list)

    @property
    def last(self) -> np.ndarray:
        return self.history[-1]

    def sha256(self) -> str:
        """Of the last codebooks' components by part, entry and position, in decimal, joined by commas."""
        return hashlib.sha256(",".join(str(int(x)) for x in self.last.ravel()).encode()).hexdigest()


def finite(vec: Column) -> Column:
    """Neither null nor holding a null or non-finite component."""
    return vec.isNotNull() & ~F.coalesce(F.exists(vec, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))), F.lit(False))


def _parts(col: pa.Array, parts: int, width: int) -> np.ndarray:
    """A list column as rows x parts x width; vectors that don't fill the last parts end in zeros."""
    n = len(col)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)
    out = np.zeros((n, parts * width), np.int64)
    out[:, : flat.shape[1]] = flat
    return out.reshape(n, parts, width)


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows x to rows c: in floating point where that is exact, else in Python's integers."""
    top = max(float(np.abs(x.astype(float)).max(initial=0)), float(np.abs(c.astype(float)).max(initial=0)))
    if 4 * max(x.shape[1], 1) * top * top < 2**52:
        x, c = x.astype(float), c.astype(float)
        return (x * x).sum(1)[:, None] - 2 * (x @ c.T) + (c * c).sum(1)[None, :]
    x, c = x.astype(object), c.astype(object)
    return np.stack([((x - e) ** 2).sum(1) for e in c], 1)


def _own(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows x to the same rows of c."""
    top = max(float(np.abs(x.astype(float)).max(initial=0)), float(np.abs(c.astype(float)).max(initial=0)))
    kind = np.int64 if 4 * max(x.shape[1], 1) * top * top < 2**52 else object
    return ((x.astype(kind) - c.astype(kind)) ** 2).sum(1)


def _root(d: np.ndarray) -> np.ndarray:
    return np.sqrt(d.astype(float))


class Assigner:
    """The assignment of round t = len(history) - 1, for batches of parts and their bounds."""

    def __init__(self, history: list[np.ndarray]):
        self.history, self.t, self.scanned = history, len(history) - 1, 0
        parts, k, _ = history[-1].shape
        self.groups = np.array_split(np.arange(k), min(GROUPS, k))
        self.of = np.concatenate([np.full(len(g), i) for i, g in enumerate(self.groups)])
        now = history[-1].astype(float)
        # net displacement of each entry since each stamp, and the largest of each group
        self.moved = np.stack([np.sqrt(((now - h.astype(float)) ** 2).sum(2)) for h in history], 1) * (1 + SLACK)  # part, stamp, entry
        self.drift = np.stack([self.moved[:, :, g].max(2) for g in self.groups], 2)  # part, stamp, group

    def first(self, x: np.ndarray, p: int):
        """Everything is measured."""
        d = distances(x, self.history[-1][p])
        self.scanned += d.size
        code, at = d.argmin(1), np.arange(len(x))
        upper = _root(d[at, code])
        d = d.astype(float)
        d[at, code] = np.inf
        lower = np.stack([np.sqrt(d[:, g].min(1)) for g in self.groups], 1)
        return code, upper, np.full(len(x), self.t), lower, np.full(lower.shape, self.t)

    def again(self, x: np.ndarray, p: int, code, upper, upper_at, lower, lower_at):
        """Bounds are carried here by net displacements; what they leave open is measured."""
        c, g, t = self.history[-1][p], np.arange(len(self.groups)), self.t
        held = lower - self.drift[p][lower_at, g[None, :]]
        may = lambda up, low: up[:, None] * (1 + SLACK) >= low * (1 - SLACK)
        rows = np.flatnonzero(may(upper + self.moved[p][upper_at, code], held).any(1))
        if not len(rows):
            return code, upper, upper_at, lower, lower_at
        code, upper, upper_at, lower, lower_at = code.copy(), upper.copy(), upper_at.copy(), lower.copy(), lower_at.copy()
        own = _own(x[rows], c[code[rows]])
        self.scanned += len(rows)
        upper[rows], upper_at[rows] = _root(own), t
        open_ = may(upper[rows], held[rows])
        some = open_.any(1)
        rows, own, open_ = rows[some], own[some].astype(object), open_[some]
        before, best, best_d = code[rows], code[rows].copy(), own.copy()
        found = {}
        for i, members in enumerate(self.groups):
            at = np.flatnonzero(open_[:, i])
            if not len(at):
                continue
            d = distances(x[rows[at]], c[members])
            self.scanned += d.size
            j, line = d.argmin(1), np.arange(len(at))
            low = d[line, j].astype(object)
            rest = d.astype(float)
            rest[line, j] = np.inf
            found[i] = (at, members[j], _root(d[line, j]), np.sqrt(rest.min(1)))
            nearer = (low < best_d[at]) | ((low == best_d[at]) & (members[j] < best[at]))
            best[at[nearer]], best_d[at[nearer]] = members[j][nearer], low[nearer]
        for i, (at, j, low, rest) in found.items():
            lower[rows[at], i] = np.where(best[at] == j, rest, low)
            lower_at[rows[at], i] = t
        # an entry that is given up counts among the others of its group from now on
        left = np.flatnonzero((best != before) & ~open_[np.arange(len(rows)), self.of[before]])
        r, i = rows[left], self.of[before[left]]
        lower[r, i] = np.minimum(held[r, i], _root(own[left]))
        lower_at[r, i] = t
        code[rows], upper[rows] = best, _root(best_d)
        return code, upper, upper_at, lower, lower_at


def _bytes(a: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in np.ascontiguousarray(a)], pa.binary())


def _read(col: pa.Array, kind, n: int, shape: tuple) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), kind).reshape(n, *shape)


def _round(history: list[np.ndarray], last: bool):
    """Task code of one round: rows come back with their bounds, and the sums of the task's parts after them."""

    def run(batches):
        at = Assigner(history)
        parts, k, width = history[-1].shape
        counts, sums = np.zeros((parts, k), np.int64), np.zeros((parts, k, width), object)
        names = ["id", "label", "v", *[n for n, _ in STATE], *[n for n, _ in SUMS]]
        for b in batches:
            n, x = b.num_rows, _parts(b.column("v"), parts, width)
            state = []
            if b.schema.get_field_index("code") >= 0 and n:
                g = len(at.groups)
                code, upper_at = (_read(b.column(c), np.uint8, n, (parts,)).astype(int) for c in ("code", "upper_at"))
                upper, lower = _read(b.column("upper"), np.float64, n, (parts,)), _read(b.column("lower"), np.float64, n, (parts, g))
                lower_at = _read(b.column("lower_at"), np.uint8, n, (parts, g)).astype(int)
                state = [at.again(x[:, p], p, code[:, p], upper[:, p], upper_at[:, p], lower[:, p], lower_at[:, p]) for p in range(parts)]
            elif n:
                state = [at.first(x[:, p], p) for p in range(parts)]
            if not state:
                continue
            code, upper, upper_at, lower, lower_at = (np.stack([s[i] for s in state], 1) for i in range(5))
            if last:
                error = np.zeros(n, object)
                for p in range(parts):
                    error += _own(x[:, p], history[-1][p][code[:, p]]).astype(object)
                error = [min(int(e), LONG) for e in error]
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array([bytes(r.astype(np.uint8)).hex() for r in code]), pa.array(error, pa.int64())], names=["id", "label", "code", "error"])
                continue
            small = float(np.abs(x.astype(float)).max(initial=0)) * n < 2**52
            for p in range(parts):
                counts[p] += np.bincount(code[:, p], minlength=k)
                for j in range(width):
                    if small:
                        sums[p, :, j] += np.bincount(code[:, p], weights=x[:, p, j].astype(float), minlength=k).astype(np.int64).astype(object)
                    else:
                        np.add.at(sums[p, :, j], code[:, p], x[:, p, j].astype(object))
            u8 = lambda a: _bytes(a.astype(np.uint8).reshape(n, -1))
            kept = [u8(code), _bytes(upper), u8(upper_at), _bytes(lower.reshape(n, -1)), u8(lower_at)]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), b.column("v"), *kept, *[pa.nulls(n, k) for _, k in SUMS]], names=names)
        if not last and counts.any():
            p, e = np.nonzero(counts)
            m = len(p)
            empty = [pa.nulls(m, b.schema.field(c).type) for c in ("id", "label", "v")] + [pa.nulls(m, k) for _, k in STATE]
            scanned = [at.scanned] + [0] * (m - 1)
            own = [pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array([[str(int(s)) for s in sums[i, j]] for i, j in zip(p, e, strict=True)], pa.list_(pa.string())), pa.array(scanned, pa.int64())]
            yield pa.RecordBatch.from_arrays([*empty, *own], names=names)

    return run


def _moved(history: list[np.ndarray], table: DataFrame) -> tuple[np.ndarray, int]:
    """Codebooks after a round, and the distances it measured: sums of parts by entry, of which there are parts x entries."""
    sums = table.where("part is not null").select("part", "entry", "n", "scanned", F.posexplode("sums").alias("pos", "s"))
    cells = sums.groupBy("part", "entry", "pos").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.sum("n").alias("n"), F.sum("scanned").alias("scanned")).collect()
    new = history[-1].copy()
    for r in cells:
        new[r.part, r.entry, r.pos] = int(r.s) // r.n
    return new, sum(r.scanned for r in cells if r.pos == 0)


def compress(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label", parts: int = 16, entries: int = 64, rounds: int = 2, scale: int = 256) -> tuple[DataFrame, Codebooks | None]:
    """(id, label, code, error) for every row with a finite vector, and the codebooks.

    Components become floor(scale * x), held at the ends of 64 bits. Codebooks begin as the parts of the rows of the
    smallest ids (at most 256 of them; nulls come last, equal ids by their components) and are refined in so many rounds;
    unused entries stay. code: indexes in part order, two hex digits each; error: squared distances summed over parts, at
    most 2^63 - 1. Ties go to the lower index, sums are exact, so that neither order nor partitioning of rows matters.

    Rows with a null vector, or a null or non-finite component, go. The table's dimension is its commonest length (of
    equally common ones the smaller): rows of another length stay, with null code and error, and take no part. A length
    that parts don't divide is filled up with zeros. Rows that repeat an id are rows of their own. A table without rows
    gives none and no codebooks. Other columns are ignored, whatever their names.
    """
    x = F.col(f"`{vec_col}`")
    v = F.transform(x, lambda c: F.floor(F.lit(scale) * c.cast("double")).cast("long"))
    label = F.col(f"`{label_col}`") if label_col else F.lit(None).cast("int")
    rows = stored(vectors.where(finite(x)).select(F.col(f"`{id_col}`").alias("id"), label.alias("label"), v.alias("v")), "codes-vectors")
    kinds = dict(rows.dtypes)
    common = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    named = f"id {kinds['id']}, label {kinds['label']}"
    if common is None:
        return vectors.sparkSession.createDataFrame([], f"{named}, code string, error long"), None
    dim = common.d
    fits = rows.where(F.size("v") == dim)
    width = max(1, -(-dim // parts))
    begin = fits.orderBy(F.col("id").asc_nulls_last(), "v").limit(min(entries, 256)).select("v").collect()
    history = [_parts(pa.array([r.v for r in begin], pa.list_(pa.int64())), parts, width).transpose(1, 0, 2).copy()]
    books, table = Codebooks(history, dim), fits
    kind = f"{named}, v array<long>, " + ", ".join(f"{n} binary" for n, _ in STATE) + ", part int, entry int, n long, sums array<string>, scanned long"
    held = ["id", "label", "v", *[n for n, _ in STATE]]
    whole = None
    for _ in range(rounds):
        before, whole = whole, stored(table.mapInArrow(_round(list(history), False), kind), "codes-bounds")
        new, scanned = _moved(history, whole)
        if before is not None:
            discard(before)
        table = whole.where("part is null").select(held)
        books.scanned.append(scanned)
        history.append(new)
    out = table.mapInArrow(_round(list(history), True), f"{named}, code string, error long")
    other = rows.where(F.size("v") != dim).select("id", "label", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    return out.unionByName(other), books


def label_errors(codes: DataFrame) -> DataFrame:
    """codes with label_error, the errors summed over equal labels, nulls together (null where no row has an error).

    Errors meet in partial sums; rows then meet the few sums of their labels, stored before, so that Spark can split or
    broadcast the join however many rows a label has.
    """
    codes = stored(codes, "codes-labelled")
    total = F.sum(F.col("error").cast("decimal(38,0)"))
    total = F.when(total > LONG, LONG).otherwise(total.cast("long"))
    sums = stored(codes.groupBy("label").agg(total.alias("label_error")).withColumnRenamed("label", "of"), "codes-labels")
    return codes.join(sums, codes["label"].eqNullSafe(sums["of"])).drop("of")
