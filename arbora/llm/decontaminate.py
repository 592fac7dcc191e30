"""Benchmark decontamination with suffix arrays of the training text.

Training text is sharded as it is read: a shard is a run of whole documents of about two megabytes. Each shard gets a
suffix array over its words. It is sparse: a suffix counts only if the words that follow it, up to the shortest
benchmark window, all belong to the benchmark's vocabulary, since no other suffix can match a whole window. Every
benchmark suffix is binary-searched in every shard; the array interval that shares a whole window gives all verbatim
places of that window, and the neighbours of the insertion point give the suffix's longest verbatim match.

Words are maximal runs of characters outside ``\\x00-\\x2F \\x3A-\\x60 \\x7B-\\x7F`` after lower-casing A-Z; they are
compared by 64-bit hashes. A window is 13 consecutive words of an item; an item of fewer words, but not none, is one
window. Nothing is shuffled: a document's hits are complete within its own row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.llm.words import hash_words, text_chunks

WINDOW, LEAST_WINDOW, SHARE, BLOCK_BYTES = 13, 8, 20, 16_000_000


@dataclass
class Tests:
    """A block of benchmark items: vocabulary, word ids of all items in a row (each followed by a 0) and the suffixes."""

    names: list[str | None]
    vocabulary: np.ndarray
    words: np.ndarray
    suffix: np.ndarray  # where each suffix starts in words
    item: np.ndarray  # its item
    left: np.ndarray  # words to the item's end
    window: np.ndarray  # words of the window that starts here; 0 if none does

    @staticmethod
    def of(names: list[str | None], texts: list[str | None]) -> Tests:
        hashes = [hash_words(d, o) for _, _, d, o in text_chunks(pa.array(texts, pa.string()))]
        parts = [p for h, at in hashes for p in np.split(h, at[1:-1])]
        vocabulary = np.unique(np.concatenate([h for h, _ in hashes])) if hashes else np.zeros(0, np.uint64)
        words, suffix, item, left, window = [], [], [], [], []
        base = 0
        for k, part in enumerate(parts):
            n = len(part)
            words += [np.searchsorted(vocabulary, part) + 1, [0]]
            suffix.append(base + np.arange(n))
            item.append(np.full(n, k))
            left.append(n - np.arange(n))
            w = min(n, WINDOW)
            window.append(np.where(np.arange(n) <= n - w, w, 0))
            base += n + 1
        join = lambda x: np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64)
        return Tests(names, vocabulary, join(words), join(suffix), join(item), join(left), join(window))

    @property
    def shortest(self) -> int:
        return int(self.window[self.window > 0].min()) if (self.window > 0).any() else 0

    @property
    def longest(self) -> int:
        return int(self.left.max()) if len(self.left) else 0


def word_ids(words: np.ndarray, places: np.ndarray, vocabulary: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary number of each word (0: not in it), with a 0 after each document; and where each document starts."""
    ids = np.zeros(len(words), np.int64)
    if len(vocabulary):
        at = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
        ids = np.where(vocabulary[at] == words, at + 1, 0)
    return np.insert(ids, places[1:], 0), places[:-1] + np.arange(len(places) - 1)


def suffix_array(ids: np.ndarray, least: int, depth: int) -> np.ndarray:
    """Starts of the suffixes of ``ids`` that begin with ``least`` nonzero ids, in the order of their first ``depth`` ids.

    Prefix doubling over the places of vocabulary words: the rank by 2k ids joins the ranks by k ids at a place and k
    further on. A 0 ends every comparison.
    """
    run = np.zeros(len(ids) + 1, np.int64)  # nonzero ids in a row from here
    zero = np.flatnonzero(ids == 0)
    after = np.searchsorted(zero, np.arange(len(ids)))
    run[:-1] = np.append(zero, len(ids))[after] - np.arange(len(ids))
    long_run = run[:-1] >= least
    if not long_run.any():
        return np.zeros(0, np.int64)
    first = np.r_[0, zero + 1]
    first = first[first < len(ids)]  # where runs start; those with a long enough start take part, with all their words
    in_part = np.repeat(np.maximum.reduceat(long_run, first), np.diff(np.append(first, len(ids))))
    part = np.flatnonzero(in_part & (ids > 0))
    rank = np.zeros(len(ids) + 1, np.int64)
    rank[part] = ids[part]
    width = 1
    while width < depth:
        further = np.minimum(part + width, len(ids))
        pair = rank[part] * (int(rank.max()) + 1) + np.where(run[part] >= width, rank[further], 0)
        rank[part] = np.unique(pair, return_inverse=True)[1] + 1
        width *= 2
    part = part[long_run[part]]
    return part[np.argsort(rank[part], kind="stable")]


def _compare(ids: np.ndarray, at: np.ndarray, words: np.ndarray, start: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For pairs of a training and a test suffix: words in common up to ``limit``, and the sign of training minus test."""
    common, sign, live = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64), np.arange(len(at))
    k = 0
    while len(live):
        live = live[limit[live] > k]
        place = at[live] + k
        a = np.where(place < len(ids), ids[np.minimum(place, len(ids) - 1)], 0)
        b = words[start[live] + k]
        same = (a == b) & (a > 0)
        other = ~same
        sign[live[other]] = np.sign(a[other] - b[other])
        live = live[same]
        common[live] += 1
        k += 1
    return common, sign


def search(ids: np.ndarray, array: np.ndarray, tests: Tests, limit: np.ndarray, after: bool) -> np.ndarray:
    """Binary search of every test suffix, cut to ``limit`` words: its insertion point before or after its equals."""
    low, high = np.zeros(len(limit), np.int64), np.full(len(limit), len(array))
    while (open_ := np.flatnonzero(low < high)).size:
        mid = (low[open_] + high[open_]) // 2
        _, sign = _compare(ids, array[mid], tests.words, tests.suffix[open_], limit[open_])
        less = sign < 0 if not after else sign <= 0
        low[open_[less]] = mid[less] + 1
        high[open_[~less]] = mid[~less]
    return low


def shard_matches(ids: np.ndarray, tests: Tests) -> tuple[np.ndarray, ...]:
    """All places of whole windows in a shard: (place, words, item, place in the item, longest match from there)."""
    empty = np.zeros(0, np.int64)
    array = suffix_array(ids, tests.shortest, tests.longest) if tests.shortest else empty
    if not len(array):
        return (empty,) * 5
    has = tests.window > 0
    own = Tests(tests.names, tests.vocabulary, tests.words, tests.suffix[has], tests.item[has], tests.left[has], tests.window[has])
    low, high = search(ids, array, own, own.window, False), search(ids, array, own, own.window, True)
    n = high - low
    which = np.repeat(np.arange(len(n)), n)
    at = array[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[which]]
    common, _ = _compare(ids, at, own.words, own.suffix[which], own.left[which])
    return at, own.window[which], own.item[which], (own.suffix - own.suffix[np.searchsorted(own.item, own.item)])[which], common


_HITS = T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "words")]))
_LONGEST = T.StructType([T.StructField("item_id", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("item_word", "doc_word", "words"))])


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of intervals."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, reach = start[order], np.maximum.accumulate(end[order])
    new = np.r_[True, start[1:] > reach[:-1]]
    return start[new], reach[np.r_[np.flatnonzero(new)[1:] - 1, len(start) - 1]]


_RESULTS = (("__leak_words", T.LongType()), ("__leak_hits", _HITS), ("__leak_items", T.ArrayType(T.StringType())), ("__leak_longest", _LONGEST), ("__leak_window", T.LongType()))


def _add(found: list[list], first: int, places: np.ndarray, words: np.ndarray, tests: Tests) -> None:
    """Adds to ``found`` what one block of the benchmark gives for the texts from row ``first`` on."""
    ids, starts = word_ids(words, places, tests.vocabulary)
    at, n, item, item_at, common = shard_matches(ids, tests)
    row = np.searchsorted(starts, at, side="right") - 1
    order = np.argsort(row, kind="stable")
    for rows in np.split(order, np.flatnonzero(np.diff(row[order])) + 1) if len(order) else []:
        r = int(row[rows[0]])
        k = first + r
        old = found[1][k] or []
        begin = np.r_[[x["start"] for x in old], at[rows] - starts[r]].astype(np.int64)
        end = np.r_[[x["start"] + x["words"] for x in old], at[rows] - starts[r] + n[rows]].astype(np.int64)
        found[1][k] = [{"start": s, "words": e - s} for s, e in zip(*(x.tolist() for x in _merged(begin, end)), strict=True)]
        found[2][k] = sorted({*(found[2][k] or []), *(tests.names[j] for j in np.unique(item[rows]) if tests.names[j] is not None)})
        best = rows[np.lexsort((item_at[rows], item[rows], at[rows], -common[rows]))[0]]
        if not found[3][k] or found[3][k]["words"] < common[best]:
            found[3][k] = {"item_id": tests.names[item[best]], "item_word": int(item_at[best]), "doc_word": int(at[best] - starts[r]), "words": int(common[best])}
        found[4][k] = max(found[4][k] or 0, int(n[rows].max()))


def _once(block) -> Tests:  # noqa: ANN001
    """A broadcast block that this process doesn't keep."""
    tests = block.value
    block.__dict__.pop("_value", None)
    return tests


def _pass(blocks: list, schema: T.StructType, text_at: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Adds the results' columns: a batch's texts are hashed once and meet one block after the other."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        base = len(schema.fields) - len(_RESULTS)
        for batch in batches:
            found: list[list] = [[None] * batch.num_rows for _ in _RESULTS]
            hashed = ((a, b, *hash_words(data, offsets)) for a, b, data, offsets in text_chunks(batch.column(text_at)))
            hashed = list(hashed) if len(blocks) > 1 else hashed
            for block in blocks or [None]:
                tests = Tests.of([], []) if block is None else _once(block) if len(blocks) > 1 else block.value
                for a, b, words, places in hashed:
                    found[0][a:b] = np.diff(places).tolist()
                    _add(found, a, places, words, tests)
            yield pa.RecordBatch.from_arrays([*batch.columns[:base], *(pa.array(x, arrow.field(base + k).type) for k, x in enumerate(found))], schema=arrow)

    return run


def benchmark_blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int) -> Iterator[Tests]:
    """The benchmark in blocks of about ``block_bytes`` of text, streamed to the driver; an item is never cut."""
    names, texts, size = [], [], 0
    rows = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text")).filter("text is not null")
    for row in rows.toLocalIterator():
        if texts and size + len(row.text) > block_bytes:
            yield Tests.of(names, texts)
            names, texts, size = [], [], 0
        names.append(row.item)
        texts.append(row.text)
        size += len(row.text)
    if texts:
        yield Tests.of(names, texts)


def find_leaks(docs: DataFrame, benchmark: DataFrame, keep: list[str], text_col: str = "text", item_col: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The columns ``keep`` of docs and per row, in columns that start with ``__leak_``: words, hits (merged word spans),
    items, longest match, and the words of the longest window found.

    Null and empty texts have no words and no hits; equal rows each get the same result; an empty or null-only benchmark
    hits nothing; several rows of one item id count as one item; an item without an id has hits but counts as no item.
    The benchmark is cut into blocks of ``block_bytes`` of text, each a broadcast of its own: the driver holds one block
    at a time, a task one block and one batch of texts, and the documents are read once however many blocks there are.
    """
    spark = docs.sparkSession
    blocks = [spark.sparkContext.broadcast(tests) for tests in benchmark_blocks(benchmark, item_col, item_text, block_bytes)]
    results = [T.StructField(n, kind) for n, kind in _RESULTS]
    kept = docs.select(*keep)
    if text_col in keep and kept.schema[text_col].dataType == T.StringType():
        return kept.mapInArrow(_pass(blocks, schema := T.StructType([*kept.schema.fields, *results]), keep.index(text_col)), schema)
    schema = T.StructType([*kept.schema.fields, T.StructField("__leak_text", T.StringType()), *results])
    return docs.select(*keep, F.col(text_col).cast("string").alias("__leak_text")).mapInArrow(_pass(blocks, schema, len(keep)), schema).drop("__leak_text")


def n_hit() -> F.Column:
    return F.coalesce(F.aggregate("__leak_hits", F.lit(0).cast("long"), lambda s, x: s + x["words"]), F.lit(0).cast("long"))


def contaminated() -> F.Column:
    """Hit words are at least one in ``SHARE``."""
    return (n_hit() > 0) & (F.lit(SHARE) * n_hit() >= F.col("__leak_words"))


def affected() -> F.Column:
    """A whole window of ``LEAST_WINDOW`` words or more is in the text, however long the text is; or it is contaminated.

    A window has ``WINDOW`` words, but for shorter items, which are one window each: those of fewer than
    ``LEAST_WINDOW`` words are found in texts that never saw the benchmark, so they count by their share alone.
    """
    return (F.coalesce("__leak_window", F.lit(0)) >= LEAST_WINDOW) | contaminated()


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest match."""
    items = F.array_sort(F.coalesce("__leak_items", F.array().cast("array<string>")))
    return find_leaks(docs, benchmark, [id_col]).select(
        F.col(id_col).alias("doc_id"),
        F.col("__leak_words").alias("n_words"),
        n_hit().alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", items), 256).alias("items_sha256"),
        contaminated().alias("contaminated"),
        F.col("__leak_longest").alias("longest"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, without the affected ones: whoever holds a verbatim passage goes, long or short."""
    return find_leaks(docs, benchmark, docs.columns, text_col).filter(~affected()).select(*docs.columns)
