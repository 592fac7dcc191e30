"""The tables that this subpackage's queries read; see :mod:`arbora.store` for those it writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from arbora.store import drop, exists, names, new_path, saved, scratch, shared_dir, write_text

__all__ = ["drop", "exists", "names", "new_path", "saved", "scratch", "shared_dir", "table", "write_text"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
