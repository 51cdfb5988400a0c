"""The corpus pipeline: reject toxic documents, drop exact copies, keep one of each group of near copies, pack the rest.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. What
a stage returns is written as Parquet and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from plumbline.llm import catalog, exact_dedup, jaccard, packing, toxicity
from plumbline.llm.shared import stored


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain, fitted on the labelled ones among them, does not flag."""
    return toxicity.reject_toxic(docs, catalog.toxicity_chain(docs, sf_dir))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts that are equal but for A-Z against a-z, the document of the smallest id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that links of a Jaccard similarity of 0.8 over five-word shingles join, that of the smallest id."""
    return jaccard.drop_near_copies(docs, width=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of training sequences of 1024 tokens."""
    return packing.pack(docs, catalog.vocabulary_file("byte_bpe_50k.json"), end_id=0, length=1024)


STAGES = [
    ("toxicity", reject_toxic),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("packing", pack),
]

#: A trained classifier decides the first stage, which SQL can't express; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STAGES applied to the table documents."""
    docs = catalog.read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
