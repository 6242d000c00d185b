"""Training corpus from documents: quality rules, near-dedup, repeated passages, mixing, packing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablescout.llm import mixture, packing, quality, simhash, suffixes
from tablescout.llm.common import table
from tablescout.session import shared_dir

MIX_SHARE = 0.9

# Packing and training on labels have no SQL; tests compare each stage with a plain version.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed rules and the trees; others go."""
    return quality.good_documents(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each SimHash group stays."""
    return simhash.one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 or more words that occur twice are cut out of all documents, word for word; ``n_chars`` follows the text.

    Null texts stay null, with a null count; a text that is nothing but repeated passages stays as an empty one.
    """
    return suffixes.without_passages(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents sampled so that source, language and topic come to their target shares."""
    return mixture.mixed(docs, share=MIX_SHARE).select(docs.columns)


def sequence_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 4096 tokens."""
    return packing.packed(docs, packing.WORD_BPE)


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_dedup),
    ("repeated passages", repeated_passages),
    ("source mixing", source_mixing),
    ("packing", sequence_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder and read again by the next stage."""
    rows = table(spark, sf_dir, "documents")
    place = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, rows, sf_dir).write.parquet(f"{place}/{k}")
        rows = spark.read.parquet(f"{place}/{k}")
    return rows
