"""The corpus pipeline: documents in, packed sequences out. Each stage calls one operator of navlytics.llm.

A stage takes (spark, docs, sf_dir) and returns the documents it keeps with all their columns; the last returns the pieces of
the packed sequences. run() writes each stage's rows to the shared folder and reads them again for the next one, so a lost executor
costs one stage's tasks at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from navlytics.llm import exact_index, langid, minhash, packing
from navlytics.llm.shared import keep


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a letter and those that lie too far from every language; learns from the rows' own labels.

    Documents without text go, as they have no language. With no labelled row at all nothing can be learned, and every document stays.
    """
    model = langid.fit(docs, F.col("lang").isNotNull())
    return langid.drop_rejected(docs, model) if model.languages else docs


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents with equal text, white space apart, the one with the smallest id stays."""
    return exact_index.drop_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at a similarity of 0.8 on shingles of five words, the one with the smallest id stays."""
    return minhash.drop_near_duplicates(docs, words=5, percent=80)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents with their ids, sequence and offset."""
    return packing.pack(docs)


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("packing", pack)]

#: The first stage's model and the tokenizer cannot be stated in SQL; tests/llm/test_pipeline.py compares with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
