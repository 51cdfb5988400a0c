"""Filter interaction audit: what each of five filters removes, in every order in which they may be applied.

A document fails a filter or not, whatever was removed before it; so the counts of the 32 sets of failed filters, by part,
hold all that the 120 orders need, and counts of parts add up. Four filters look at one text. The fifth fails copies of a
text that a smaller id has, table-wide, and a prepass spares unique texts the shuffle: tasks count hashed texts in small
counters, the counting sketches are merged, and a text one of whose counters stands at one is the only one of its kind.
Only texts that the merged sketch can't clear are shuffled whole, for the smallest id of each.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import UPPER, stored, text_or_empty

FILTERS = "ABCDE"
COUNTERS_PER_ROW = 8
MOST_COUNTERS = 2**28  # two bits each: the merged sketch never takes more than 64 MB
BLOCK = 2**14  # counters that cross the network together
PROBES = 3
BLANKS = r"[ \t-\r]+"


def failed(text: Column) -> Column:
    """Which of the filters A to D a text fails, as bits 1, 2, 4 and 8.

    A: under 200 words. B: of 100 words, fewer than 50 distinct. C: over 2 % of its characters are A-Z. D: it holds one
    of #$%&*|. A null text counts as empty and fails A alone.
    """
    t = text_or_empty(text)
    inner = F.btrim(t, F.lit(" \t\n\x0b\f\r"))
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BLANKS))
    capitals = F.char_length(t) - F.char_length(F.translate(t, UPPER, ""))
    bit = lambda c, n: F.when(c, n).otherwise(0)
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    return (bit(n < 200, 1) + bit(100 * distinct < 50 * n, 2) + bit(100 * capitals > 2 * F.char_length(t), 4) + bit(t.rlike(r"[#$%&*|]"), 8)).cast("int")


def _places(h: np.ndarray, size: int):
    """The counters of hashes: PROBES arrays of positions below size, a power of two."""
    h = h.view(np.uint64)
    low, step = h & np.uint64(0xFFFFFFFF), (h >> np.uint64(32)) | np.uint64(1)
    for i in range(PROBES):
        yield ((low + np.uint64(i) * step) & np.uint64(size - 1)).astype(np.int64)


def _pack(c: np.ndarray) -> bytes:
    return (c[0::4] | c[1::4] << 2 | c[2::4] << 4 | c[3::4] << 6).tobytes()


def _unpack(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    return np.stack([b & 3, b >> 2 & 3, b >> 4 & 3, b >> 6 & 3], 1).ravel()


def sketch_size(rows: int) -> int:
    """Counters for so many rows: eight each, a power of two, at least a block and at most MOST_COUNTERS."""
    return min(MOST_COUNTERS, max(BLOCK, 1 << max(COUNTERS_PER_ROW * rows - 1, 1).bit_length()))


def counting_sketch(hashes: DataFrame, size: int) -> np.ndarray:
    """The merged counting sketch of hashes(h), two bits a counter: how many rows met there, two meaning two or more.

    Tasks send the blocks of their sketches that are not zero; blocks meet by number and are added up as they stream in.
    """

    def build(batches):
        c = np.zeros(size, np.uint8)
        for b in batches:
            h = b.column("h").to_numpy()
            for at in _places(h, size):
                at, n = np.unique(at, return_counts=True)
                c[at] = np.minimum(c[at] + np.minimum(n, 2), 2)
        for i in np.flatnonzero(c.reshape(-1, BLOCK).any(1)):
            yield pa.RecordBatch.from_pydict({"block": pa.array([i], pa.int32()), "counters": [_pack(c[i * BLOCK : (i + 1) * BLOCK])]})

    def merge(batches):
        block, total = None, None
        out = lambda: pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "counters": [_pack(total)]})
        for b in batches:
            for i, data in zip(b.column("block").to_pylist(), b.column("counters").to_pylist(), strict=True):
                if i != block:
                    if block is not None:
                        yield out()
                    block, total = i, np.zeros(BLOCK, np.uint8)
                total = np.minimum(total + _unpack(data), 2)
        if block is not None:
            yield out()

    kind = "block int, counters binary"
    merged = hashes.select("h").mapInArrow(build, kind).repartition("block").sortWithinPartitions("block").mapInArrow(merge, kind)
    whole = np.zeros(size // 4, np.uint8)
    for r in merged.toLocalIterator():  # at most MOST_COUNTERS / 4 bytes in all
        whole[r.block * BLOCK // 4 : (r.block + 1) * BLOCK // 4] = np.frombuffer(r.counters, np.uint8)
    return whole


def may_repeat(spark, sketch: np.ndarray):
    """A column function of a hash: whether the sketch leaves it possible that several rows have it."""
    import pandas as pd

    sent, size = spark.sparkContext.broadcast(sketch), 4 * len(sketch)

    def judge(h):
        s, least = sent.value, np.full(len(h), 3, np.uint8)
        for at in _places(h.to_numpy(np.int64), size):
            least = np.minimum(least, s[at >> 2] >> (2 * (at & 3)).astype(np.uint8) & 3)
        return pd.Series(least > 1)

    judge.__annotations__ = {"h": pd.Series, "return": pd.Series}
    return F.pandas_udf(judge, "boolean")


def failed_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source", content_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """(id, part, mask) for every row of docs, mask having a bit for each failed filter, A first.

    E fails a row if a row of equal text has a smaller id; a null id is neither smaller nor larger than any, and rows that
    repeat an id don't fail each other. Texts are equal by all their bytes, whatever content_hash gives.
    """
    spark, t = docs.sparkSession, text_or_empty(F.col(f"`{text_col}`"))
    base = docs.select(F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), t.alias("t"))
    base = base.withColumn("h", content_hash("t").cast("long"))
    flags = stored(base.select("id", "part", failed("t").alias("mask"), "h"), "audit-flags")
    repeat = may_repeat(spark, counting_sketch(flags, sketch_size(flags.count())))
    clear = flags.where(~repeat("h")).select("id", "part", "mask")
    # possible repeats alone carry their texts on
    open_ = stored(base.where(repeat("h")).select("id", "part", failed("t").alias("mask"), "h", "t"), "audit-open")
    groups = stored(open_.groupBy("h", "t").agg(F.min("id").alias("least"), F.count("*").alias("n")).select("h", "least", "n"), "audit-groups")
    later = F.when(F.col("id") > F.col("least"), 16).otherwise(0)
    clash = stored(groups.groupBy("h").count().where("count > 1").select("h"), "audit-clashes")
    if clash.isEmpty():
        met = open_.join(groups.where("n > 1"), "h", "left")
        return clear.unionByName(met.select("id", "part", (F.col("mask") + later).alias("mask")))
    met = open_.join(clash, "h", "left_anti").join(groups.where("n > 1"), "h", "left")
    odd = open_.join(clash, "h", "left_semi")  # hashes that several texts share: whole texts decide
    odd = odd.join(odd.groupBy("h", "t").agg(F.min("id").alias("least")), ["h", "t"])
    return clear.unionByName(met.select("id", "part", (F.col("mask") + later).alias("mask"))).unionByName(odd.select("id", "part", (F.col("mask") + later).alias("mask")))


def set_counts(sets: DataFrame, labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(part, mask, n, good, toxic): rows, those that labels call of quality 1, and those they call toxic.

    labels may repeat an id: one that says 1 decides. Rows of one id, part and mask are counted before they meet labels, so
    that an id that many rows share is not a hot one.
    """
    said = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic")
    )
    rows = sets.groupBy("id", "part", "mask").agg(F.count("*").alias("n")).join(said, "id", "left")
    share = lambda c: F.sum(F.col("n") * F.coalesce(c, F.lit(0))).cast("long").alias(c)
    return rows.groupBy("part", "mask").agg(F.sum("n").alias("n"), share("good"), share("toxic"))


def audit(counts: DataFrame) -> DataFrame:
    """The rows of all orders and steps, by part, from the counts of failed sets.

    kept and removed: after and by this step; redundant: failing its filter, removed earlier; unique_fails: failing no other
    filter; good_lost, toxic_lost: of those removed here; shapley: what the filter removes, summed over all orders.
    """
    steps = []
    for order in permutations(range(len(FILTERS))):
        for i, f in enumerate(order):
            steps.append(("".join(FILTERS[x] for x in order), i + 1, 1 << f, sum(1 << x for x in order[:i])))
    table = F.array(*[F.struct(F.lit(o).alias("filter_order"), F.lit(s).alias("step"), F.lit(b).alias("bit"), F.lit(e).alias("earlier")) for o, s, b, e in steps])
    cells = counts.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))  # 32 at most
    rows = cells.select("part", "cells", F.explode(table).alias("s")).select("part", "cells", "s.*")

    def total(value: str, take) -> Column:
        bit, earlier = F.col("bit"), F.col("earlier")
        return F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(take(c["mask"], bit, earlier), c[value]).otherwise(0))

    here = lambda m, b, e: (m.bitwiseAND(b) != 0) & (m.bitwiseAND(e) == 0)
    # of the 120 orders, a filter comes first among the k that a row fails in 120 / k
    share = F.aggregate("cells", F.lit(0).cast("long"), lambda a, c: a + F.when(c["mask"].bitwiseAND(F.col("bit")) != 0, c["n"] * (F.lit(120) / F.bit_count(c["mask"])).cast("long")).otherwise(0))
    return rows.select(
        "part",
        "filter_order",
        "step",
        total("n", lambda m, b, e: m.bitwiseAND(b.bitwiseOR(e)) == 0).alias("kept"),
        total("n", here).alias("removed"),
        total("n", lambda m, b, e: (m.bitwiseAND(b) != 0) & (m.bitwiseAND(e) != 0)).alias("redundant"),
        total("n", lambda m, b, e: m == b).alias("unique_fails"),
        total("good", here).alias("good_lost"),
        total("toxic", here).alias("toxic_lost"),
        share.alias("shapley"),
    )
