"""Session factory and table loading."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "plumbline", cores: str | int = "*", **conf: str) -> SparkSession:
    """A UTC session with adaptive execution; a cluster's own settings win where they are set outside."""
    b = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    if "spark.master" not in conf and not os.environ.get("SPARK_MASTER"):
        b = b.master(f"local[{cores}]")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; zone-less timestamps become instants, so that watermarks and windows accept them."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    ntz = [c for c, kind in df.dtypes if kind == "timestamp_ntz"]
    return df.withColumns({c: F.col(c).cast("timestamp") for c in ntz}) if ntz else df
