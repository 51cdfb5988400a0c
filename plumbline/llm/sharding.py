"""Sharding by sampled splitters: sizes near equal, equal texts next to each other.

Records are ordered by a hash of their text (then by id), so that copies are neighbours. A size-weighted sample of
those keys gives quantile boundaries, records are dealt to the ranges between them, exact range sizes are counted,
overfull ranges are subdivided by a second sample of their own, and running sizes inside each range turn into shards.
No text is shuffled, only (id, size, key), and no range grows with the input beyond the sampled bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.shared import stored, text_or_empty

SAMPLES_PER_RANGE = 24  # size-weighted samples for each quantile boundary
MAX_RANGES = 4096  # splitters are literals of the plan: this bounds them
OVERFULL = 1.5  # a range of more than this many mean sizes is subdivided


def weighted_sample(keyed: DataFrame, count: float, total: float, seed: int = 11) -> DataFrame:
    """Rows (key, w) drawn with a probability in proportion to size; a row of over total/count is certain and weighs more.

    The draw hashes the key, so that a recomputed task draws the same rows.
    """
    share = F.col("size") * F.lit(count / max(total, 1.0))
    u = F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return keyed.where(u < share).select("key", F.greatest(share, F.lit(1.0)).alias("w"))


def quantile_splitters(sample: DataFrame, ranges: int) -> list:
    """Up to ranges-1 boundary keys of a bounded sample; a boundary is the first key of its range."""
    total = sample.agg(F.sum("w")).first()[0]
    if not total or ranges < 2:
        return []
    order = Window.orderBy("key")
    cut = F.floor((F.sum("w").over(order) - F.col("w") / 2) * F.lit(ranges / total))
    firsts = sample.withColumn("cut", cut).groupBy("cut").agg(F.min("key").alias("key")).where("cut > 0")
    return sorted({(r.key.h, r.key.id) for r in firsts.collect()})


def _literal_key(k: tuple) -> Column:
    return F.struct(F.lit(k[0]).cast("long").alias("h"), F.lit(k[1]).cast("long").alias("id"))


def range_of(key: Column, splitters: list) -> Column:
    """The number of splitters at or below key, found in two steps of about the square root of their count."""
    if not splitters:
        return F.lit(0)
    step = max(1, int(len(splitters) ** 0.5))
    blocks = [splitters[i : i + step] for i in range(0, len(splitters), step)]
    heads = F.array(*[_literal_key(b[0]) for b in blocks])
    block = F.size(F.filter(heads, lambda x: x <= key))
    inner = F.array(F.array().cast("array<struct<h:bigint,id:bigint>>"), *[F.array(*map(_literal_key, b)) for b in blocks])
    within = F.size(F.filter(F.element_at(inner, block + 1), lambda x: x <= key))
    return F.when(block == 0, 0).otherwise((block - 1) * step + within)


def _cumulated(sums: DataFrame) -> DataFrame:
    w = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    return sums.select(
        "range", "bytes", F.coalesce(F.sum("bytes").over(w), zero).alias("before"), F.coalesce(F.sum("rows").over(w), zero).alias("rows_before")
    )


def shard_by_size(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", overhead: int = 16) -> DataFrame:
    """One row per record: id, size (UTF-8 bytes of the text plus overhead), text_crc32, shard 0..shards-1, slot, range.

    Shard sizes differ from the mean by less than one record; slots count from 0 in each shard without gaps. A null
    text has no bytes; a null id orders first; repeated rows fill neighbouring slots; an empty table gives no rows;
    other columns of docs are ignored.
    """
    text = F.col(text_col)
    rows = docs.select(
        F.col(id_col).alias("doc"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(text_or_empty(text_col)).alias("crc"),
        F.struct(
            F.xxhash64(text_or_empty(text_col)).alias("h"),
            F.coalesce(F.col(id_col).cast("long"), F.lit(-(1 << 63))).alias("id"),
        ).alias("key"),
    )
    rows = stored(rows, "shard-keys")
    total, count = rows.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = int(min(MAX_RANGES, max(4 * shards, count // 250_000)))
    sample = weighted_sample(rows, ranges * SAMPLES_PER_RANGE, float(total))
    splitters = quantile_splitters(sample, ranges)
    dealt = rows.withColumn("range", range_of(F.col("key"), splitters))
    sums = dealt.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    full = [r.range for r in sums.where(F.col("bytes") > OVERFULL * total / ranges).collect()]
    if full:
        inside = dealt.where(F.col("range").isin(full))
        again = weighted_sample(inside, len(full) * 4 * SAMPLES_PER_RANGE, float(OVERFULL * total / ranges * len(full)), seed=12)
        splitters = sorted({*splitters, *quantile_splitters(again, 4 * len(full))})
        dealt = rows.withColumn("range", range_of(F.col("key"), splitters))
        sums = dealt.groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    starts = _cumulated(sums)
    w = Window.partitionBy("range").orderBy("key", "size")
    placed = (
        dealt.join(F.broadcast(starts), "range")  # at most MAX_RANGES + 4 * MAX_RANGES rows
        .withColumn("end", F.col("before") + F.sum("size").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("row", F.col("rows_before") + F.row_number().over(w) - 1)
        # the record's middle byte decides, in whole numbers
        .withColumn("shard", F.expr(f"cast(least({shards - 1}, (2 * end - size) * {shards} div (2 * {max(int(total), 1)})) as int)"))
    )
    # where a shard begins follows from the few shards that each range holds
    first = placed.groupBy("range", "shard").agg(F.min("row").alias("row")).groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(  # one row a shard
        F.col("doc").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("row") - F.col("first")).alias("slot"), "range"
    )
