"""A keyed table kept as deltas: what a micro-batch changes is written, not the table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora import store


class DeltaTable:
    """Rows by key in a folder that all executors share: ``batch=n`` holds the rows that batch n changed, whole.

    Once the deltas hold as many rows as the last fold, or are ``most`` in number, they are folded into ``fold=n``: a
    batch costs what it changes, and a folding is paid for by the batches before it. A batch counts from its marker on,
    which this class writes, so an attempt that broke off is overwritten, and a batch that comes again changes nothing.
    Versions before the last fold but one are deleted.
    """

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, key: str, most: int = 32) -> None:
        self.spark, self.path, self.key, self.most = spark, path, key, most
        self.schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _marked(self, kind: str) -> dict[int, int]:
        """Version -> rows of the batches or folds that count."""
        found = (name.split("-") for name in store.names(self.spark, f"{self.path}/marks") if name.startswith(f"{kind}-"))
        return {int(n): int(rows) for _, n, rows in found}

    def _write(self, kind: str, n: int, rows: DataFrame) -> int:
        at = f"{self.path}/{kind}={n}"
        rows.write.mode("overwrite").parquet(at)
        count = self.spark.read.schema(self.schema).parquet(at).count()
        store.write_text(self.spark, f"{self.path}/marks/{kind}-{n}-{count}", "")
        return count

    def last(self) -> int:
        """The last version; -1 if there is none."""
        return max(self._marked("batch").keys() | self._marked("fold").keys(), default=-1)

    def put(self, n: int, changed: DataFrame) -> None:
        if n <= self.last():
            return
        self._write("batch", n, changed)
        folds, batches = self._marked("fold"), self._marked("batch")
        base = max(folds, default=-1)
        since = {k: rows for k, rows in batches.items() if k > base}
        if len(since) >= self.most or (len(since) > 1 and sum(since.values()) >= max(1, folds.get(base, 0))):
            self._write("fold", n, self.rows(n))
            for kind, marked in (("fold", folds), ("batch", batches)):
                for k, count in marked.items():
                    if k < base or (kind == "batch" and k == base):
                        store.drop(self.spark, f"{self.path}/marks/{kind}-{k}-{count}")
                        store.drop(self.spark, f"{self.path}/{kind}={k}")

    def rows(self, n: int) -> DataFrame:
        """The table after batch n; before the first it is empty."""
        folds = [k for k in self._marked("fold") if k <= n]
        base = max(folds, default=-1)
        parts = [(k, f"batch={k}") for k in self._marked("batch") if base < k <= n] + [(base, f"fold={base}")] * bool(folds)
        read = [self.spark.read.schema(self.schema).parquet(f"{self.path}/{at}").withColumn("__batch", F.lit(k)) for k, at in parts]
        if len(read) < 2:
            return read[0].drop("__batch") if read else self.spark.createDataFrame([], self.schema)
        latest = reduce(DataFrame.unionByName, read).groupBy(self.key).agg(F.max_by(F.struct(*self.schema.names), "__batch").alias("row"))
        return latest.select("row.*")


def run(log: DataFrame, table: DeltaTable, checkpoint: str) -> int:
    """Feeds all that a stream's source holds by now, as changed rows, to a table; returns the table's last version.

    The checkpoint holds the stream's keyed state, so it and the table belong together.
    """
    if table.last() >= 0 and not store.exists(table.spark, f"{checkpoint}/metadata"):
        raise ValueError("the table has versions that this checkpoint doesn't know")
    query = log.writeStream.outputMode("update").foreachBatch(lambda rows, n: table.put(n, rows)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return table.last()
