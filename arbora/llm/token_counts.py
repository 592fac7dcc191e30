"""Token counts as delta-maintained rollups.

A change says that a document's count was inserted, deleted or revised; it becomes a signed delta of documents and
tokens. A batch of changes is summed by source, language and tokenizer version (partial sums before the shuffle, so a
hot source costs no more than others) and written under its batch id. Totals are the sums over the batches: additive, so
late and repeated changes need no recount. A batch id commits once: what is under a committed id stays. Old batches are
folded into one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora.llm.store import drop, names, new_path, saved, write_text
from arbora.llm.token_files import encoder, groups, public_tokenizer
from arbora.llm.words import hash_words, text_chunks

KEYS = ["source", "lang", "tokenizer"]
_DELTAS = "source string, lang string, tokenizer string, n_docs long, n_tokens long"


def deltas(changes: DataFrame) -> DataFrame:
    """Signed deltas of changes (op, source, lang, tokenizer, n_tokens, old_tokens).

    insert adds a document and its tokens, delete takes them away, revise adds n_tokens - old_tokens and no document. A
    null count is 0; a null key column is a key of its own; another or null op changes nothing.
    """
    n, old = (F.coalesce(F.col(c).cast("long"), F.lit(0)) for c in ("n_tokens", "old_tokens"))
    docs = F.when(F.col("op") == "insert", 1).when(F.col("op") == "delete", -1).otherwise(0)
    tokens = F.when(F.col("op") == "insert", n).when(F.col("op") == "delete", -n).when(F.col("op") == "revise", n - old).otherwise(0)
    return changes.groupBy(*KEYS).agg(F.sum(docs.cast("long")).alias("n_docs"), F.sum(tokens.cast("long")).alias("n_tokens"))


class TokenRollup:
    """Totals by source, language and tokenizer version in a folder, changed by idempotent batch commits.

    ``batch=n`` holds a batch's sums, ``marks/batch-n`` says that it counts. ``fold=k`` holds the sums of all batches that
    ``marks/fold-k`` names, so totals are the last fold and the batches since.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def _marks(self, kind: str) -> set[int]:
        return {int(name.removeprefix(f"{kind}-")) for name in names(self.spark, f"{self.path}/marks") if name.startswith(f"{kind}-") and name.removeprefix(f"{kind}-").isdigit()}

    def _folded(self) -> tuple[int, set[int]]:
        """The last fold (-1: none) and the batches in it."""
        last = max(self._marks("fold"), default=-1)
        found = self.spark.read.text(f"{self.path}/marks/fold-{last}").collect() if last >= 0 else []
        return last, {int(r.value) for r in found if r.value}

    def commit(self, batch: int, changes: DataFrame) -> bool:
        """Adds a batch of changes; False if its id was committed before, in which case nothing happens.

        A batch counts from its mark on, which is written last: an attempt that broke off is overwritten by the next.
        """
        batch = int(batch)
        if batch in self._marks("batch"):
            return False
        deltas(changes).write.mode("overwrite").parquet(f"{self.path}/batch={batch}")
        write_text(self.spark, f"{self.path}/marks/batch-{batch}", "")
        return True

    def compact(self) -> None:
        """Folds all batches into one; their marks stay, so that none counts again. The fold before last is deleted."""
        last, folded = self._folded()
        marked = self._marks("batch")
        if marked - folded:
            self._sums().write.mode("overwrite").parquet(f"{self.path}/fold={last + 1}")
            write_text(self.spark, f"{self.path}/marks/fold-{last + 1}", "\n".join(map(str, sorted(marked))))
            for batch in folded:
                drop(self.spark, f"{self.path}/batch={batch}")
            for old in ("fold=", "marks/fold-") * (last > 0):
                drop(self.spark, f"{self.path}/{old}{last - 1}")

    def _sums(self) -> DataFrame:
        last, folded = self._folded()
        paths = [f"{self.path}/batch={n}" for n in sorted(self._marks("batch") - folded)] + [f"{self.path}/fold={last}"] * (last >= 0)
        rows = self.spark.read.schema(_DELTAS).parquet(*paths) if paths else self.spark.createDataFrame([], _DELTAS)
        return rows.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))

    def totals(self) -> DataFrame:
        """source, lang, tokenizer, n_docs, n_tokens; keys whose documents have all been deleted are left out."""
        return self._sums().filter("n_docs != 0 or n_tokens != 0")


def _count(resolve: Callable[[], str]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            words: list[int] = []
            for _, _, data, offsets in text_chunks(column):
                _, places = hash_words(data, offsets)
                words += (places[1:] - places[:-1]).tolist()
            texts, tokens = column.fill_null("").to_pylist(), []
            for a, b in groups(texts):
                tokens += encoder(resolve()).encode(texts[a:b])[1].tolist()
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], names=[*batch.schema.names[:-1], "words", "tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, source, lang, words, tokens of every whole text; null texts have none. Missing columns are an error."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_count(public_tokenizer(tokenizer)), "doc_id long, source string, lang string, words long, tokens long")


def _changes(counts: DataFrame, op: str, tokenizer: str, n: str, old: str = "0L") -> DataFrame:
    return counts.select(F.lit(op).alias("op"), "source", "lang", F.lit(tokenizer).alias("tokenizer"), F.expr(n).alias("n_tokens"), F.expr(old).alias("old_tokens"))


def maintain(docs: DataFrame) -> DataFrame:
    """A rollup's life over a table of documents, and its totals in the end.

    1: all documents are inserted, counted in words and in BPE tokens. 2: the BPE counts are revised to include the end
    token. 3: documents without a word are deleted from both. 2 comes again, as from a retried job, before and after the
    batches are folded, and changes nothing.
    """
    spark = docs.sparkSession
    counts = saved(count_tokens(docs), "counts")
    rollup = TokenRollup(spark, new_path(spark, "rollup"))
    revised = _changes(counts, "revise", "byte_bpe_50k", "tokens + 1", "tokens")
    empty = counts.filter("words = 0")
    rollup.commit(1, _changes(counts, "insert", "words", "words").unionByName(_changes(counts, "insert", "byte_bpe_50k", "tokens")))
    rollup.commit(2, revised)
    rollup.commit(3, _changes(empty, "delete", "words", "words").unionByName(_changes(empty, "delete", "byte_bpe_50k", "tokens + 1")))
    rollup.commit(2, revised)
    rollup.compact()
    rollup.commit(2, revised)
    return rollup.totals()
