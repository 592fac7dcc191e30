"""The change log: replay in batch, and as a stream that keeps the same state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.streaming import deltas

KEY, LAST = "link_id", "last_seq"
STATE = f"{KEY} long, {LAST} long, last_op string, changes long"


def replay(log: DataFrame) -> DataFrame:
    """(link_id, last_seq, last_op, changes): per link its latest change and how many there were.

    The latest is a maximum over (seq, op), so partial results merge in any order and the hot link of a log costs one
    row for each task before the shuffle. A repeated change (equal seq) counts once, however late it comes. ``log`` may
    be a stream: then changes are told apart and summed in keyed state, and each batch gives the links that it changed.
    """
    once = log.dropDuplicates(["seq"])
    return once.groupBy(KEY).agg(F.max(F.struct("seq", "op")).alias("m"), F.count("*").alias("changes")).select(KEY, F.col("m.seq").alias(LAST), F.col("m.op").alias("last_op"), "changes")


class ChangeLogSink:
    """Keeps :func:`replay` of a growing log as a table in ``path``; a batch writes only the links that it changes."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.table = spark, deltas.DeltaTable(spark, path, STATE, KEY)

    def state(self, n: int) -> DataFrame:
        return self.table.rows(n)

    def run(self, log_dir: str, schema: str, checkpoint: str, files_per_batch: int = 1) -> int:
        """Reads all of a folder of Parquet log files that is new; returns the last version."""
        log = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(log_dir)
        return deltas.run(replay(log), self.table, checkpoint)
