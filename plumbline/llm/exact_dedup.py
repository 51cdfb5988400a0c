"""Exact de-duplication: rows meet by a 128-bit content hash, and bytes are compared inside each group.

Every step is a DataFrame operation. Text crosses the network once, and only rows of groups of two or more stay. A
group is never gathered: its row that stays is found by a partially aggregated minimum (or maximum), its other rows are
compared with that one row through a join that Spark may split, however many copies there are.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.shared import discard, fold_ascii, stored, text_or_empty


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    keep: str = "smallest",
    normalise: Callable[[Column], Column] | None = fold_ascii,
    content_hash: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256 (of the normalised text).

    keep names the id that stays of equal texts, "smallest" or "largest". A null text counts as empty. A null id ranks
    below every number. Of repeated rows (same id, same text) exactly one is kept. Texts whose hashes agree but whose
    bytes differ are told apart, whatever content_hash gives. An empty table gives an empty result; other columns of
    docs are ignored, whatever their names.
    """
    norm = text_or_empty(text_col)
    norm = normalise(norm) if normalise else norm
    sign = 1 if keep == "largest" else -1
    base = docs.select(F.col(id_col).alias("id"), norm.alias("t"))
    # rows are numbered once, in a stored table; uid only tells rows apart that repeat id and text
    keys = stored(base.select("id", F.monotonically_increasing_id().alias("uid"), content_hash("t").alias("h"), F.unhex(F.sha2("t", 256)).alias("sha")), "dedup-keys")
    # the largest (rank, -uid) of a group stays; a null id comes last either way
    rank = F.struct((F.lit(sign) * F.col("id")).alias("r"), (-F.col("uid")).alias("u"), F.col("id").alias("id"))
    top = [F.count("*").alias("n"), F.max(rank).alias("top")]
    named = ["n", F.col("top.id").alias("keep_id"), (-F.col("top.u")).alias("keep_uid")]
    # groups are stored before rows meet them, so that Spark can split the rows of a large one
    groups = stored(keys.groupBy("h").agg(*top).select("h", *named), "dedup-groups")
    texts = stored(base.select("id", content_hash("t").alias("h"), "t").join(groups.where("n > 1").select("h", "keep_id"), "h"), "dedup-texts")
    first = stored(texts.where("id <=> keep_id").groupBy("h").agg(F.min("t").alias("first")), "dedup-first")
    clash = stored(texts.join(first, "h").where("t <> first").select("h", F.unhex(F.sha2("t", 256)).alias("sha")).distinct(), "dedup-clashes")
    discard(texts, first)
    if clash.isEmpty():
        out = keys.join(groups, "h")
    else:  # hashes that agree over different bytes: these rows group by their text, known by its SHA-256
        keys = stored(keys.join(clash.withColumn("other", F.col("sha")), ["h", "sha"], "left"), "dedup-keys")
        groups = stored(keys.groupBy("h", "other").agg(*top).select("h", F.col("other").alias("of"), *named), "dedup-groups")
        out = keys.join(groups, "h").where("other <=> of")
    return out.select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("n").alias("group_size"),
        (F.col("uid") == F.col("keep_uid")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest") -> DataFrame:
    """docs without the rows that exact_dedup drops. Of rows that repeat both id and text, one stays."""
    found = exact_dedup(docs, id_col, text_col, keep).select(F.col(id_col).alias("__id"), F.col("text_sha256").alias("__sha"), "kept")
    gone, kept = found.where("not kept").select("__id", "__sha").distinct(), found.where("kept").select("__id", "__sha")
    same = lambda a, b: a["__id"].eqNullSafe(b["__id"]) & (a["__sha"] == b["__sha"])
    both = gone.join(kept, same(gone, kept), "left_semi")  # repeated rows, of which one stays
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), F.col(id_col).alias("__id"), F.sha2(fold_ascii(text_or_empty(text_col)), 256).alias("__sha"))
    out = packed.join(gone, same(packed, gone), "left_anti")
    if not both.isEmpty():
        out = out.unionByName(packed.join(both, same(packed, both), "left_semi").dropDuplicates(["__id", "__sha"]))
    return out.select("__row.*")
