"""The effect log: every change as an op code and the whole record it leaves; applied in batch or as a stream."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora import store
from arbora.operators.mutate import numbered
from arbora.streaming.deltas import DeltaTable, run

# Op codes of the log.
LINK_OPS = {"link_inserted": 1, "link_deleted": 2, "link_text_updated": 3, "link_recategorized": 4}
CATEGORY_OPS = {"category_inserted": 10, "category_deleted": 11, "category_text_updated": 12, "category_renamed": 13, "category_moved": 14}
REPAIR_OPS = {"slug_path_repair_chunk": 20, "slug_path_repair_complete": 21}
DELETED = (LINK_OPS["link_deleted"], CATEGORY_OPS["category_deleted"])


def _checked(op: str) -> Column:
    known = [*LINK_OPS.values(), *CATEGORY_OPS.values(), *REPAIR_OPS.values()]
    return F.when(F.col(op).isin(known), F.col(op)).otherwise(F.raise_error(F.concat(F.lit("unknown op "), F.coalesce(F.col(op).cast("string"), F.lit("null")))).cast("int"))


def of_kind(log: DataFrame, kind: str) -> DataFrame:
    """The log's effects on links or categories. An unknown op fails the job. Repair effects concern stored paths only;
    paths are derived from the categories here, so they change nothing."""
    ops = LINK_OPS if kind == "link" else CATEGORY_OPS
    return log.withColumn("op", _checked("op")).filter(F.col("op").isin(list(ops.values())))


def base_state(table: DataFrame) -> DataFrame:
    """(id, last_seq, deleted, record) of a table that no effect has reached yet."""
    return table.select("id", F.lit(-1).cast("long").alias("last_seq"), F.lit(False).alias("deleted"), F.struct(*table.columns).alias("record"))


def changes(log: DataFrame, kind: str) -> DataFrame:
    """(id, last_seq, deleted, record): the state of each record that the effects of ``log`` (seq, op, record) reach.

    A record's latest effect is its state, so partial results merge in any order, a repeated effect changes nothing, and
    the effects of a hot record are reduced to one for each task before the shuffle. Deletions stay as marks: an older
    effect that comes later doesn't bring the record back. ``log`` may be a stream.
    """
    new = of_kind(log, kind).select(F.col("record.id").alias("id"), F.col("seq").cast("long").alias("last_seq"), F.col("op").isin(*DELETED).alias("deleted"), "record")
    return _latest(new)


def _latest(states: DataFrame) -> DataFrame:
    best = states.groupBy("id").agg(F.max_by(F.struct("last_seq", "deleted", "record"), F.col("last_seq")).alias("m"))
    return best.select("id", "m.last_seq", "m.deleted", "m.record")


def advance(state: DataFrame, log: DataFrame, kind: str) -> DataFrame:
    """State after the effects of ``log``."""
    return _latest(state.unionByName(changes(log, kind)))


def rows(state: DataFrame) -> DataFrame:
    """The table of a state: records that aren't deleted."""
    return state.filter(~F.col("deleted")).select("record.*")


def apply_effects(table: DataFrame, log: DataFrame, kind: str) -> DataFrame:
    return rows(advance(base_state(table), log, kind)).select(*table.columns)


def deltas(links: tuple[DataFrame, DataFrame], categories: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(category_id, links, children) of what differs between two versions of the tables, for incremental counts.

    Only ids whose category or parent changed, or that came or went, give rows.
    """
    def moved(before: DataFrame, after: DataFrame, at: str, out: str) -> DataFrame:
        old, new = (t.select("id", F.col(at).alias(n)) for t, n in ((before, "old"), (after, "new")))
        changed = old.join(new, "id", "full").filter(~F.col("old").eqNullSafe(F.col("new")))
        both = changed.select(F.explode(F.array(F.struct(F.col("old").alias("category_id"), F.lit(-1).alias("n")), F.struct(F.col("new").alias("category_id"), F.lit(1).alias("n")))).alias("x"))
        other = "children" if out == "links" else "links"
        return both.filter("x.category_id is not null").groupBy("x.category_id").agg(F.sum("x.n").alias(out)).withColumn(other, F.lit(0).cast("long")).select("category_id", "links", "children")

    return reduce(DataFrame.unionByName, (moved(*links, "category_id", "links"), moved(*categories, "parent_id", "children"))).groupBy("category_id").agg(F.sum("links").alias("links"), F.sum("children").alias("children"))


def between(before: DataFrame, after: DataFrame, kind: str, after_seq: int = 0) -> DataFrame:
    """(seq, op, record): the effects that lead from one version of a table to the next, numbered on from ``after_seq``.

    A record that came or went gives one effect. One that changed gives one for each kind of change: its place in the
    tree, a category's slug, anything else. Each holds the record as it is in the end, a deletion as it was.
    """
    names = before.columns
    was, now = (t.select("id", F.struct(*names).alias(n)) for t, n in ((before, "was"), (after.select(*names), "now")))
    both = was.join(now, "id", "full")
    place = {"category_id": "link_recategorized"} if kind == "link" else {"parent_id": "category_moved", "slug": "category_renamed"}
    ops = LINK_OPS if kind == "link" else CATEGORY_OPS
    differs = lambda c: ~F.col(f"was.{c}").eqNullSafe(F.col(f"now.{c}"))
    rest = reduce(lambda a, b: a | b, (differs(c) for c in names if c != "id" and c not in place), F.lit(False))
    kinds = [*((differs(c), ops[op]) for c, op in place.items() if c in names), (rest, ops[f"{kind}_text_updated"])]
    changed = F.filter(F.array(*(F.when(test, F.lit(op)) for test, op in kinds)), lambda op: op.isNotNull())
    found = F.when(F.col("was").isNull(), F.array(F.lit(ops[f"{kind}_inserted"]))).when(F.col("now").isNull(), F.array(F.lit(ops[f"{kind}_deleted"]))).otherwise(changed)
    effects = both.select(F.explode(found).alias("op"), F.coalesce("now", "was").alias("record"), "id")
    return numbered(effects.withColumn("pos", F.col("id") * 32 + F.col("op")), after_seq, "seq").select("seq", "op", "record")


def append(log_dir: str, before: DataFrame, after: DataFrame, kind: str) -> int:
    """Adds what a mutation changed to a log folder, after its last effect; returns the log's last seq.

    One writer at a time: the numbers follow those that the folder holds.
    """
    spark, at = before.sparkSession, f"{log_dir}/{kind}"
    last = lambda: spark.read.parquet(at).agg(F.max("seq")).first()[0] if store.names(spark, at) else None
    between(before, after, kind, last() or 0).write.mode("append").parquet(at)
    return last() or 0


class EffectSink:
    """Keeps the state of a growing log as a table in ``path``, over a base table; a batch writes only the records that it
    changes. ``path`` must be in a store that all executors share."""

    def __init__(self, spark: SparkSession, path: str, base: DataFrame, kind: str) -> None:
        self.spark, self.base, self.kind = spark, base, kind
        self.table = DeltaTable(spark, path, base_state(base).schema, "id")

    def state(self, n: int) -> DataFrame:
        return base_state(self.base) if n < 0 else _latest(base_state(self.base).unionByName(self.table.rows(n)))

    def run(self, log_dir: str, schema: str, checkpoint: str, files_per_batch: int = 1) -> int:
        """Reads all of a folder of Parquet log files that is new; returns the last version."""
        log = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(log_dir)
        return run(changes(log, self.kind), self.table, checkpoint)
