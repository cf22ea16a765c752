"""The corpus pipeline: each stage takes (spark, docs, sf_dir) and returns a DataFrame that the next one gets as ``docs``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    from helixframe.llm.queries import toxic_filter

    return toxic_filter(spark, docs, sf_dir)


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays."""
    from helixframe.llm.exact_dedup import keep_one

    return keep_one(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts linked by five-word shingles at a similarity of 0.8 or more, one document stays."""
    from helixframe.llm.ngram_join import keep_one

    return keep_one(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed to tempered weights; a document comes as often as its source's blocks are drawn."""
    from helixframe.llm.queries import mixed_documents

    return mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left is packed into sequences of 1,024 tokens."""
    from helixframe.llm.packing import pack
    from helixframe.llm.queries import tokenizer_file

    return pack(docs, tokenizer_file())


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

#: The first stage is a trained classifier, which SQL cannot express; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
