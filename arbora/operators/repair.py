"""Repair of stored slug paths after renames and moves: a queue of tasks, worked off in chunks.

Paths that are derived on reading need no repair. This is for a stored (path, id) table, which a rename leaves behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora import schema as S
from arbora.operators import hierarchy as H
from arbora.operators.mutate import numbered

RENAMED, MOVED = 1, 2
CHUNK, TASKS_PER_TICK = 1000, 16


def enqueue(queue: DataFrame, category: int, op: int, old_path: str, now_ms: int) -> DataFrame:
    """The queue with one task more, under the next seq."""
    if op not in (RENAMED, MOVED):
        raise S.DirectoryError("invalid", "unknown repair")
    if len(old_path.encode()) > S.MAX_PATH_BYTES:
        raise S.DirectoryError("path_too_deep")
    last = queue.agg(F.coalesce(F.max("seq"), F.lit(0))).first()[0]
    return queue.unionByName(queue.sparkSession.createDataFrame([(last + 1, category, op, now_ms, old_path)], S.REPAIR_TASK))


def swaps(stored: DataFrame, categories: DataFrame, tree: DataFrame, task) -> DataFrame:  # noqa: ANN001
    """(id, old_path, new_path) of a task: what stands in ``stored`` under the old prefix and differs from what the
    categories give now. The old path of a descendant is the old prefix and the slugs below the renamed category."""
    slugs = categories.select("id", "slug")
    below = tree.filter(F.col("ancestor") == task.cat_id).select(F.col("descendant").alias("id"), F.col("depth").alias("levels")).filter(F.col("levels") < S.MAX_DEPTH)
    chain = tree.join(below, F.col("descendant") == F.col("id")).filter(F.col("depth") < F.col("levels")).select("id", "ancestor", "depth")
    parts = chain.join(slugs.select(F.col("id").alias("ancestor"), "slug"), "ancestor").filter("slug != ''").groupBy("id").agg(F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("k"), "slug"))).alias("parts"))
    old = below.join(parts, "id", "left").select("id", F.array_join(F.concat(F.array(F.lit(task.old_slug_prefix)), F.coalesce("parts.slug", F.array().cast("array<string>"))), "/").alias("old_path"))
    new = H.slug_paths(categories, tree).withColumnRenamed("path", "new_path")
    there = stored.select(F.col("path").alias("old_path"))
    return old.join(new, "id").filter("new_path is not null and old_path != new_path").join(there, "old_path", "left_semi").select("id", "old_path", "new_path")


def chunks(found: DataFrame, size: int = CHUNK) -> DataFrame:
    """Swaps with the number of the chunk that they are applied in."""
    return numbered(found, -1, "place", "id").select("id", "old_path", "new_path", F.floor(F.col("place") / size).cast("long").alias("chunk"))


def swapped(stored: DataFrame, part: DataFrame) -> DataFrame:
    """``stored`` (path, id) after some swaps; applied again, they change nothing."""
    kept = stored.join(part.select(F.col("old_path").alias("path")), "path", "left_anti").join(part.select(F.col("new_path").alias("path")), "path", "left_anti")
    return kept.unionByName(part.select(F.col("new_path").alias("path"), "id"))


def tick(stored: DataFrame, categories: DataFrame, queue: DataFrame, tree: DataFrame | None = None, most: int = TASKS_PER_TICK, size: int = CHUNK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(stored, queue, effects) after the first tasks by seq.

    A task whose category is gone is taken off without a change. effects: (seq, op, chunk, n), one row for each chunk of
    swaps (op 20) and one for each task that is done (op 21). All of a task's chunks are one plan here.
    """
    spark = stored.sparkSession
    tree = H.closure(categories) if tree is None else tree
    effects = spark.createDataFrame([], "seq long, op int, chunk long, n long")
    tasks = queue.orderBy("seq").limit(most).collect()
    for task in tasks:
        if not categories.filter(F.col("id") == task.cat_id).isEmpty():
            part = chunks(swaps(stored, categories, tree, task), size)
            effects = effects.unionByName(part.groupBy("chunk").agg(F.count("*").alias("n")).select(F.lit(task.seq).cast("long").alias("seq"), F.lit(20).alias("op"), "chunk", "n"))
            stored = swapped(stored, part)
    done = [(t.seq, 21, None, 0) for t in tasks]
    left = queue.filter(~F.col("seq").isin([t.seq for t in tasks])) if tasks else queue
    return stored, left, effects.unionByName(spark.createDataFrame(done, effects.schema)) if done else effects
