"""What several operators of this subpackage need: text folding, scratch tables, components of a link graph."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_or_empty(text: Column | str) -> Column:
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def fold_ascii(text: Column) -> Column:
    """Lower-case A-Z and nothing else; texts of ASCII alone take the quicker built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir; only on one machine, as in tests, a folder of our own."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if found:
        return found
    if sc.master != "local" and not sc.master.startswith("local["):
        raise RuntimeError("a cluster has to name a shared folder in spark.checkpoint.dir")
    return "/tmp/plumbline-checkpoints"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, and lost executors cost a reread."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete stored tables that nothing reads any more."""
    for t in tables:
        sc = t.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(t.scratch_path)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """Connected components of undirected links by alternating large-star and small-star steps.

    Returns (node, component) for every node that has a link, component being the smallest node reachable. Each step
    groups by node and keeps a minimum, so that a hub costs no more than its own links, and each step's links are
    stored: nothing is gathered on the driver but two counts. Self-links and repeated links change nothing.
    """
    spark = links.sparkSession
    e = (
        links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where("u is not null and v is not null and u <> v")
        .distinct()
    )
    e = stored(e, "links")
    for _ in range(rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # a node's own minimum stays linked to it
        large = large.unionByName(low.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = stored(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "links")
        same = _digest(small) == _digest(e)
        discard(e)
        e = small
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    tops = e.select(F.col("v").alias("node")).distinct()
    out = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionByName(tops.withColumn("component", F.col("node")))


def _digest(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
