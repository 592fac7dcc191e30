"""Toxicity by a classifier chain.

Categories are predicted in order, each by a linear model over its own features of the text and the probabilities of the
categories before it. For training, those probabilities are out-of-fold predictions, so a later model sees them as it
will meet them on new texts. The categories are those of the labels table: ``low_quality`` (quality is 0), then
``toxic``, which decides.

Features are the presence of words, of the first 4, 5 and 6 bytes of longer words, of runs of symbols, and of a word that
follows itself, by 64-bit hashes. Texts are read whole. How often each feature stands in the texts of each fold and label
is counted by Spark; for each category the ``FEATURES`` that tell its labels apart best are kept, for each fold without
that fold's texts. The driver sees only the chosen features of the labelled texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arbora.llm import words as W
from arbora.llm.store import saved

#: At most so many labelled rows train the chain: those with the least hash of their id.
TRAIN_ROWS = 8000
FEATURES, FOLDS, RIDGE, LEAST_Z, LEAST_TEXTS = 256, 5, 1.0, 4.0, 3
PREFIXES = (4, 5, 6)
#: The chain: a category and the condition for it on a row of the labels table.
CHAIN = (("low_quality", "quality = 0"), ("toxic", "toxic = 1"))
NAMES = tuple(name for name, _ in CHAIN)

_IS_SYMBOL = np.zeros(256, dtype=bool)
_IS_SYMBOL[33:127] = True
_IS_SYMBOL &= ~W._IS_WORD
_TWICE = np.uint64(0x5E1F_0001_7A3C_9D11)


def _runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of ``inside`` start and end; no run goes over a text's end."""
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    bound = offsets[1:-1]
    heads = bound[bound < len(inside)]
    first[heads] = inside[heads]
    tails = bound[bound > 0] - 1
    last[tails] = inside[tails]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def text_features(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(hash, text number) of all words, of their prefixes of each length, of symbol runs, and of words that stand twice."""
    codes = W._CODE[data]
    up, down = W.powers(len(codes) + 1)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(codes * up[: len(codes)], dtype=np.uint64)])

    def hashed(s: np.ndarray, e: np.ndarray, salt: int) -> np.ndarray:
        return W.mix((total[e] - total[s]) * down[s] + (e - s).astype(np.uint64) + np.uint64(salt << 32))

    start, end = _runs(W._IS_WORD[data], offsets)
    text = np.searchsorted(offsets, start, side="right") - 1
    word = hashed(start, end, 0)
    yield word, text
    for n in PREFIXES:
        long_ = end - start > n
        yield hashed(start[long_], start[long_] + n, 1), text[long_]
    twice = np.flatnonzero((word[1:] == word[:-1]) & (text[1:] == text[:-1]))
    yield np.full(len(twice), _TWICE), text[twice]
    start, end = _runs(_IS_SYMBOL[data], offsets)
    yield hashed(start, end, 2), np.searchsorted(offsets, start, side="right") - 1


def _collect(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The other columns, and the distinct features of each text (the first column)."""
    for batch in batches:
        for a, b, data, offsets in W.text_chunks(batch.column(0)):
            parts = list(text_features(data, offsets))
            h, t = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(t, kind="stable")
            cut = np.searchsorted(t[order], np.arange(b - a + 1))
            sets = [np.unique(h[order[x:y]]).view(np.int64) for x, y in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *sets])))
            yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, b - a) for k in range(1, batch.num_columns)), lists], names=[*batch.schema.names[1:], "features"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_linear(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last weight is the bias. One class only: a constant."""
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 0.5) / (len(y) + 1) if len(y) else 0.0
        return np.append(np.zeros(x.shape[1]), np.log(share / (1 - share)) if 0 < share < 1 else -40.0)
    x = np.hstack([x, np.ones((len(x), 1))]).astype(np.float32)
    w, ridge = np.zeros(x.shape[1]), np.append(np.full(x.shape[1] - 1, RIDGE), 1e-6)
    for _ in range(12):
        p = _sigmoid(x @ w)
        grad = x.T @ (p - y) + ridge * w
        step = np.linalg.solve(((x * np.sqrt(p * (1 - p) + 1e-9).astype(np.float32)[:, None]).T @ (x * np.sqrt(p * (1 - p) + 1e-9).astype(np.float32)[:, None])).astype(np.float64) + np.diag(ridge), grad)
        w -= step
        if np.abs(step).max() < 1e-4:
            break
    return w


def predict(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return _sigmoid(x @ w[:-1] + w[-1])


@dataclass
class Chain:
    """All selected features (sorted hashes), which of them each category uses, its weights, and the rejecting
    probability of the last. The rest is kept for tests: ids, folds, labels and out-of-fold probabilities."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    columns: list[np.ndarray] = field(default_factory=list)
    weights: list[np.ndarray] = field(default_factory=list)
    threshold: float = 0.5
    ids: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    folds: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    labels: dict[str, np.ndarray] = field(default_factory=dict)
    held_out: dict[str, np.ndarray] = field(default_factory=dict)

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of all categories, one column each."""
        out = np.zeros((len(x), len(CHAIN)))
        for k, (at, w) in enumerate(zip(self.columns, self.weights, strict=True)):
            out[:, k] = predict(np.hstack([x[:, at], out[:, :k]]), w)
        return out


def _z(total: dict, counts: Callable[[str, int], F.Column], category: str, without: int) -> F.Column:
    """How far apart the shares of texts with a feature are between a category's and the other texts, in standard errors;
    null if they are too few or the distance too small. The fold ``without`` doesn't take part (-1: all do)."""
    folds = [f for f in range(FOLDS) if f != without]
    n1 = sum(total[category, f] for f in folds)
    n0 = sum(total["known_" + category, f] for f in folds) - n1
    c1, c = sum((counts(category, f) for f in folds), F.lit(0)), sum((counts("known_" + category, f) for f in folds), F.lit(0))
    share = c / (n1 + n0)
    z = F.abs(c1 / n1 - (c - c1) / n0) / F.sqrt(F.greatest(share * (1 - share), F.lit(1e-12)) * (1 / n1 + 1 / n0)) if n1 and n0 else F.lit(None).cast("double")
    return F.when((c >= LEAST_TEXTS) & (z >= LEAST_Z), z)


def select_features(rows: DataFrame) -> dict[tuple[int, int], np.ndarray]:
    """(category's number, fold left out or -1) -> sorted hashes of its ``FEATURES`` best features, of equals the lowest.

    ``rows``: fold, a flag for each category (null: unknown) and features. Counts are summed by feature before they
    shuffle; the best of each view are picked out by ranks that keep ``FEATURES`` rows for each task.
    """
    flags = {}
    for name in NAMES:
        flags |= {name: F.coalesce(F.col(name), F.lit(0)), "known_" + name: F.col(name).isNotNull().cast("int")}
    summed = {(k, f): F.sum(F.when(F.col("fold") == f, flag).otherwise(0)) for k, flag in flags.items() for f in range(FOLDS)}
    at = {key: f"c{i}" for i, key in enumerate(summed)}
    sums = [total.alias(at[key]) for key, total in summed.items()]
    totals = rows.agg(*sums).first()
    total = {key: totals[at[key]] or 0 for key in at}
    counts = rows.select("fold", *NAMES, F.explode("features").alias("feature")).groupBy("feature").agg(*sums)
    views = [(k, f) for k in range(len(NAMES)) for f in (-1, *range(FOLDS))]
    scored = F.array(*(F.struct(F.lit(v).alias("view"), _z(total, lambda k, f: F.col(at[k, f]), NAMES[k], f).alias("z")) for v, (k, f) in enumerate(views)))
    good = counts.select("feature", F.explode(F.filter(scored, lambda s: s["z"].isNotNull())).alias("s")).select("feature", "s.view", "s.z")
    best = good.withColumn("place", F.row_number().over(Window.partitionBy("view").orderBy(F.desc("z"), "feature"))).filter(F.col("place") <= FEATURES)
    found: dict[int, list[int]] = {}
    for r in best.select("view", "feature").collect():
        found.setdefault(r.view, []).append(r.feature)
    return {view: np.sort(np.array(found.get(v, []), np.int64).view(np.uint64)) for v, view in enumerate(views)}


def _present(keys: np.ndarray) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The other columns, and the places among ``keys`` of each row's features (the last column)."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            offsets = lists.offsets.to_numpy()
            flat = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            at = np.minimum(np.searchsorted(keys, flat), max(len(keys) - 1, 0))
            hit = np.flatnonzero(keys[at] == flat) if len(keys) else np.zeros(0, np.int64)
            ends = np.searchsorted(hit, offsets).astype(np.int32)
            made = pa.ListArray.from_arrays(pa.array(ends - ends[0]), pa.array(at[hit[ends[0] : ends[-1]]].astype(np.int32)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], made], names=[*batch.schema.names[:-1], "places"])

    return run


def fit_chain(ids: np.ndarray, folds: np.ndarray, labels: dict[str, np.ndarray], x: np.ndarray, keys: np.ndarray, views: dict[tuple[int, int], np.ndarray]) -> Chain:
    """Each category's model and its out-of-fold probabilities, which the next one is trained with.

    ``x`` has a column for each of ``keys``; ``views`` says which of them a category uses without a fold, so the held-out
    figures are honest. A row without a label of a category doesn't train its model, but gets its prediction. The
    threshold is the out-of-fold probability of the last category with the best F1 (of equals the highest), halfway to
    the next lower one.
    """
    out = Chain(keys=keys, ids=ids, folds=folds, labels=labels)
    before = np.zeros((len(x), 0))
    for k, name in enumerate(NAMES):
        y, known = np.nan_to_num(labels[name]), ~np.isnan(labels[name])
        held = np.zeros(len(x))
        for f in range(FOLDS):
            train, test = np.flatnonzero(known & (folds != f)), np.flatnonzero(folds == f)
            view = np.hstack([x[:, np.searchsorted(keys, views[k, f])], before])
            held[test] = predict(view[test], fit_linear(view[train], y[train]))
        out.columns.append(np.searchsorted(keys, views[k, -1]))
        out.weights.append(fit_linear(np.hstack([x[:, out.columns[k]], before])[known], y[known]))
        out.held_out[name] = held
        before = np.hstack([before, held[:, None]])
    last, known = labels[NAMES[-1]], ~np.isnan(labels[NAMES[-1]])
    order = np.flatnonzero(known)[np.argsort(-out.held_out[NAMES[-1]][known], kind="stable")]
    p, right = out.held_out[NAMES[-1]][order], np.cumsum(last[order])
    f1 = 2 * right / (np.arange(1, len(order) + 1) + last[order].sum())
    best = int(np.argmax(f1))
    out.threshold = float((p[best] + (p[best + 1] if best + 1 < len(p) else 0)) / 2)
    return out


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Chain:
    """A chain from the labelled rows of docs, ``TRAIN_ROWS`` at most.

    Labels without an id or without a flag of the last category are left out; of an id's labels the highest of each
    category counts; of rows with equal ids that with the least text hash is used. A row's fold is a hash of its id. No
    labels, none of the last category, or no feature that tells it apart give a chain that rejects nothing.
    """
    flags = [F.max(F.expr(f"cast({test} as int)")).alias(name) for name, test in CHAIN]
    rows = labels.withColumn("__doc", F.col("doc_id").cast("long")).filter("__doc is not null").groupBy(F.col("__doc").alias("doc")).agg(*flags).filter(F.col(NAMES[-1]).isNotNull())
    sample = rows.orderBy(F.xxhash64("doc"), "doc").limit(TRAIN_ROWS)
    text = F.col(text_col).cast("string")
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), text.alias("text"), F.xxhash64(text).alias("raw")).join(F.broadcast(sample), "doc")
    schema = T.StructType([T.StructField("doc", T.LongType()), T.StructField("raw", T.LongType()), *(T.StructField(n, T.IntegerType()) for n in NAMES), T.StructField("features", T.ArrayType(T.LongType()))])
    made = texts.select("text", "doc", "raw", *NAMES).mapInArrow(_collect, schema)
    made = made.groupBy("doc").agg(*(F.max(n).alias(n) for n in NAMES), F.min_by("features", "raw").alias("features"))
    table = saved(made.withColumn("fold", F.pmod(F.xxhash64("doc", F.lit(2)), F.lit(FOLDS)).cast("int")), "features")
    views = select_features(table)
    if not len(views[len(NAMES) - 1, -1]):
        return Chain()
    keys = np.unique(np.concatenate(list(views.values())))
    kept = T.StructType([T.StructField("doc", T.LongType()), T.StructField("fold", T.IntegerType()), *(T.StructField(n, T.IntegerType()) for n in NAMES), T.StructField("places", T.ArrayType(T.IntegerType()))])
    found = table.select("doc", "fold", *NAMES, "features").mapInArrow(_present(keys), kept).orderBy("doc").toArrow().combine_chunks()
    x = np.zeros((found.num_rows, len(keys)), np.float32)
    places = found["places"].combine_chunks()
    x[np.repeat(np.arange(found.num_rows), np.diff(places.offsets.to_numpy())), places.flatten().to_numpy()] = 1
    flagged = {n: found[n].combine_chunks().cast(pa.float64()).to_numpy(zero_copy_only=False) for n in NAMES}
    return fit_chain(found["doc"].to_numpy(), found["fold"].to_numpy(), flagged, x, keys, views)


def _score(chain: Chain, text_at: int, width: int, names: list[str]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in W.text_chunks(batch.column(text_at)):
                x = np.zeros((b - a, len(chain.keys)), np.float32)
                if len(chain.keys):
                    for h, t in text_features(data, offsets):
                        at = np.minimum(np.searchsorted(chain.keys, h), len(chain.keys) - 1)
                        hit = chain.keys[at] == h
                        x[t[hit], at[hit]] = 1
                p = chain.scores(x)
                cols = [batch.column(k).slice(a, b - a) for k in range(width)]
                yield pa.RecordBatch.from_arrays([*cols, *(pa.array(p[:, k]) for k in range(len(CHAIN)))], names=[*batch.schema.names[:width], *names])

    return run


def score(docs: DataFrame, chain: Chain, text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with p_low_quality, p_toxic and toxic (p_toxic reaches the threshold); such columns are replaced.

    ``prefix`` goes before the names. Null, empty and word-less texts are scored on the bias alone. Equal texts have
    equal scores. The chain in the task's closure is ``FEATURES`` hashes and weights for each category.
    """
    names = [f"{prefix}p_{c}" for c in NAMES]
    keep = [c for c in docs.columns if c not in (*names, f"{prefix}{NAMES[-1]}")]
    kept = docs.select(*keep)
    schema = T.StructType([*kept.schema.fields, *(T.StructField(n, T.DoubleType()) for n in names)])
    small = Chain(chain.keys[used := np.unique(np.concatenate([np.zeros(0, np.int64), *chain.columns])).astype(np.int64)], [np.searchsorted(used, c) for c in chain.columns], chain.weights, chain.threshold)
    if text_col in keep and kept.schema[text_col].dataType == T.StringType():
        out = kept.mapInArrow(_score(small, keep.index(text_col), len(keep), names), schema)
    else:
        out = docs.select(*keep, F.col(text_col).cast("string").alias("__tox_text")).mapInArrow(_score(small, len(keep), len(keep), names), schema)
    return out.withColumn(f"{prefix}{NAMES[-1]}", (F.col(names[-1]) >= chain.threshold) & F.lit(bool(len(chain.weights))))


def reject(docs: DataFrame, labels: DataFrame, all_docs: DataFrame | None = None) -> DataFrame:
    """The rows of docs, all columns, that a chain trained on the labels (of all_docs) doesn't find toxic.

    Columns of docs keep their names and values, whatever they are called. Null and empty texts stay.
    """
    scored = score(docs, train(docs if all_docs is None else all_docs, labels), prefix="__tox_")
    return scored.filter(~F.col("__tox_toxic")).select(*docs.columns)
