"""The queries of this subpackage: each applies its operator, as in production, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm import decontaminate, fingerprints, jaccard_join, licenses, sentence_pieces, sharding, token_counts, token_files, toxicity, urls
from arbora.llm.sql import ORACLES
from arbora.llm.store import table


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(table(spark, sf_dir, "documents"))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs.select("doc_id", "text"), toxicity.train(docs, table(spark, sf_dir, "labels"))).drop("text")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.maintain(table(spark, sf_dir, "documents"))


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similarity_links(table(spark, sf_dir, "documents")).withColumnRenamed("doc", "doc_id")


def op6_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"))
    both = sentence_pieces.encode(docs, decoded_col="decoded", path_col="best_path")
    decoded = F.sha2("decoded", 256)
    return both.select("doc_id", "ids", "best_path", F.size("ids").cast("long").alias("n_pieces"), decoded.alias("decoded_sha256"), (decoded == F.col("text_sha256")).alias("round_trip"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.token_digests(table(spark, sf_dir, "documents"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digests(table(spark, sf_dir, "documents"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.versions(table(spark, sf_dir, "documents")).drop("gone", "new")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("longest")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (op1_license_scan, op2_url_filter, op3_toxicity, op4_token_counts, op5_jaccard_join, op6_sentence_pieces, op7_token_files, op8_sharding, op9_fingerprints, op10_decontamination)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
