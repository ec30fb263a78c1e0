"""Corpus pipeline: quality, toxicity, exact dedup, near dedup, packing. Part of the training-data operators.

Every stage takes documents with any further columns and nulls in any of them. A null text counts as empty: it is
scored like any text without words, all such texts are one group of exact copies, and they link with nothing in near
dedup. A null doc_id is a document of its own: exact copies of it go, near copies of it stay. Of rows that are copies
one stays, also of repeated rows; ties go to the smallest doc_id. An empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import exact_dedup, near_dedup, packing, quality, toxicity
from weftgraph.session import Scratch, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold."""
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score stays below the threshold."""
    return toxicity.keep(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    return exact_dedup.keep(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies."""
    return near_dedup.keep(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Length buckets and batches of what is left."""
    return packing.pack(docs)


STAGES = [("quality", keep_quality), ("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("packing", pack)]

#: SQL can express neither the classifiers nor MinHash verification; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each stage's rows are written to the shared folder and read again.

    A stage's table is deleted once the next one is written; the last one stays, for the result reads it.
    """
    scratch = Scratch(spark)
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = f"{scratch.folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            scratch.drop(before)
        before = path
    return docs
