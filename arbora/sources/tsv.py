"""Tab-separated imports and versioned snapshots."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora import schema as S
from arbora import store
from arbora.operators.mutate import numbered
from arbora.store import saved


def read_tsv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Rows with ``pos``, their place in the input: files in the order of their paths, rows as they stand in a file.

    Spark packs files into tasks by size, so a row's number within its task orders only the rows of one file split; the
    splits, one row each, are numbered by path and offset.
    """
    rows = spark.read.csv(path, sep="\t", schema=", ".join(f"{c} string" for c in columns), quote="")
    rows = rows.na.fill("").select("*", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__block"))
    splits = rows.select("__file", "__block").distinct()
    splits = splits.select("__file", "__block", F.row_number().over(Window.orderBy("__file", "__block")).cast("long").alias("__split"))
    placed = rows.withColumn("__row", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)).join(splits, ["__file", "__block"])
    return placed.select(*columns, (F.shiftleft("__split", 33) + F.col("__row")).alias("pos"))


def import_categories(rows: DataFrame) -> DataFrame:
    """(id, parent_id, name, slug, path) from (pos, path, parent_path, name, slug), under a seeded root ``Top``.

    A row counts if its path, name and slug aren't empty and its parent is ``Top`` or a counting row above it; of equal
    paths the first counts. Each pass settles another level and writes it to the shared folder.
    """
    spark = rows.sparkSession
    rows = rows.filter("path != '' and name != '' and slug != ''").withColumn("rn", F.row_number().over(Window.partitionBy("path").orderBy("pos"))).filter("rn = 1 and path != 'Top'").drop("rn")
    rows = saved(rows, "rows")
    seen = frontier = spark.createDataFrame([("Top", -1)], "path string, pos long")
    while True:
        parents = frontier.select(F.col("path").alias("parent_path"), F.col("pos").alias("parent_pos"))
        frontier = saved(rows.join(parents, "parent_path").filter("parent_pos < pos").select("path", "pos"), "level")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    kept = numbered(rows.join(seen.select("path"), "path", "left_semi"), after=1)
    top = spark.createDataFrame([(1, 0, "Top", "top", "Top")], "id long, parent_id long, name string, slug string, path string")
    ids = kept.select(F.col("path").alias("parent_path"), F.col("id").alias("pid")).unionByName(top.select(F.col("path").alias("parent_path"), F.col("id").alias("pid")))
    return top.unionByName(kept.join(ids, "parent_path").select("id", F.col("pid").alias("parent_id"), "name", "slug", "path"))


def import_links(rows: DataFrame, categories: DataFrame) -> DataFrame:
    """(id, category_id, url, title, description) from (pos, topic, url, title, description): known topics only, first of equal urls."""
    known = categories.select(F.col("path").alias("topic"), F.col("id").alias("category_id"))
    good = rows.filter("topic != '' and url != ''").join(known, "topic").withColumn("rn", F.row_number().over(Window.partitionBy("url").orderBy("pos"))).filter("rn = 1")
    return numbered(good).select("id", "category_id", "url", "title", "description")


def bootstrap(spark: SparkSession) -> DataFrame:
    """The categories of an empty directory."""
    return spark.createDataFrame([(1, 0, "Top", "top"), (2, 1, "Lost and Found", "lost-and-found")], "id long, parent_id long, name string, slug string")


def write_snapshot(table: DataFrame, path: str, version: int, key: str = "id") -> dict[str, int | str]:
    """Writes a version's folder, its rows in ranges of the key, so that files prune by it.

    Returns path, seq (the version) and duration_ms. While another snapshot of the folder is being written, and for a
    version that is there, the answer is already_in_progress. A writer that died leaves ``snapshot.lock`` behind.
    """
    spark, began = table.sparkSession, time.monotonic()
    to, lock = f"{path}/version={version}", f"{path}/snapshot.lock"
    if not store.create(spark, lock):
        raise S.DirectoryError("already_in_progress")
    try:
        if store.exists(spark, to):
            raise S.DirectoryError("already_in_progress", "the version is there")
        table.repartitionByRange(key).sortWithinPartitions(key).write.mode("errorifexists").parquet(to)
    finally:
        store.drop(spark, lock)
    return {"path": to, "seq": version, "duration_ms": round((time.monotonic() - began) * 1000)}
