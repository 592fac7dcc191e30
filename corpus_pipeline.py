"""The corpus pipeline: toxic documents go, one document of each near-duplicate group stays, documents that hold
benchmark passages go, and what is left is encoded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arbora.llm import decontaminate, jaccard_join, sentence_pieces, toxicity
from arbora.llm.store import drop, new_path, scratch, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.deduplicate(docs)


def remove_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentence_pieces.encode(docs)


STAGES = [("toxicity", reject_toxic), ("jaccard_join", keep_one_of_each), ("decontamination", remove_leaks), ("sentence_pieces", encode)]

#: The classifier chain and the tokenizer can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's result is written to the shared folder and read again.

    What a stage wrote on its way goes when its result stands, and that result when the next one does.
    """
    docs, old = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, name)
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if old:
            drop(spark, old)
        docs, old = spark.read.parquet(path), path
    return docs
