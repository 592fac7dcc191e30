"""N-gram Jaccard join with Bayesian candidate pruning.

1. One pass over the text gives each document its word shingles' MinHash values; documents with equal word sequences
   are one *text class*, and only its representative goes on.
2. Representatives that agree on any band of MinHash values meet in a bucket. Buckets over ``BUCKET`` members are dealt
   out as pairs of salted blocks. Within a bucket the one-byte MinHash values are compared 16 at a time; a pair is
   dropped as soon as the posterior probability that its similarity reaches the threshold, given the matches so far,
   falls below ``TOLERANCE`` (uniform prior; chance agreement of one-byte values is in the likelihood). Pairs that are
   already joined through others aren't compared again. A bucket gives at most one edge for each member, never pairs.
3. The edges' components are the candidate clusters: every pair that survives pruning lies in one. Within a cluster,
   all pairs are verified exactly on their shingle sets, by blocks: the block's shingles that occur twice make a 0/1
   matrix, and a product of two such matrices counts the common shingles of all pairs at once. What leaves a task is a
   link count and one edge for each document.

A link joins two different documents whose shingle sets have a Jaccard similarity of ``threshold`` or more. Bands of 4
in 24 miss a pair at exactly 0.8 with probability 3e-6, unless others join it to its cluster.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.store import drop, new_path, saved
from arbora.llm.words import hash_words, mix, text_chunks, window_hashes

SHINGLE, THRESHOLD, TOLERANCE = 5, 0.8, 1e-6
BANDS, ROWS, STEP = 24, 4, 16
BUCKET, BLOCK_SHINGLES, BLOCK_TEXTS, BROADCAST_ROWS = 4096, 1_500_000, 3000, 500_000
_SEEDS = np.random.default_rng(77).integers(0, 2**63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
NONE = -(2**63)


def shingles(words: np.ndarray, places: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of texts in a row and where each text starts; a text of fewer words, but not none, is one shingle."""
    counts = np.diff(places)
    n = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    at = np.concatenate([[0], np.cumsum(n)])
    full = window_hashes(words, width)
    out = np.zeros(at[-1], np.uint64)
    long_ = counts >= width
    if long_.any():
        m = n[long_]
        inner = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        out[inner + np.repeat(at[:-1][long_], m)] = full[inner + np.repeat(places[:-1][long_], m)]
    for k in np.flatnonzero((counts > 0) & ~long_):
        out[at[k]] = window_hashes(words[places[k] : places[k + 1]], int(counts[k]))[0] ^ np.uint64(counts[k])
    return out, at


def text_keys(words: np.ndarray, places: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each text's sequence of words."""
    n = np.diff(places)
    position = (np.arange(len(words)) - np.repeat(places[:-1], n)).astype(np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words * np.uint64(3) + mix(position + np.uint64(1))), dtype=np.uint64)])
    return mix(total[places[1:]] - total[places[:-1]] + n.astype(np.uint64))


def band_keys(minimum: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band; the band's number is hashed in."""
    h = np.repeat(mix(np.arange(1, BANDS + 1, dtype=np.uint64))[None, :], len(minimum), axis=0)
    for r in range(ROWS):
        h = mix(h + minimum[:, r::ROWS].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(r + 1))
    return h


def _signatures(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per row: its id, text hash, class key (null without words), band keys and one-byte MinHash values."""
    for batch in batches:
        for a, b, data, offsets in text_chunks(batch.column(1)):
            words, places = hash_words(data, offsets)
            empty = np.diff(places) == 0
            hashes, at = shingles(words, places, SHINGLE)
            starts = at[:-1][~empty]
            minimum = np.zeros((len(starts), len(_SEEDS)), np.uint32)
            for k, seed in enumerate(_SEEDS if len(starts) else ()):
                minimum[:, k] = np.minimum.reduceat((hashes * seed) >> np.uint64(32), starts)
            bands, values = iter(band_keys(minimum).view(np.int64)), iter(minimum.astype(np.uint8))
            yield pa.RecordBatch.from_pydict({
                "doc": batch.column(0).slice(a, b - a),
                "raw": batch.column(2).slice(a, b - a),
                "node": pa.array(text_keys(words, places).view(np.int64), mask=empty),
                "bands": pa.array([None if e else next(bands) for e in empty], pa.list_(pa.int64())),
                "minhash": pa.array([None if e else next(values).tobytes() for e in empty], pa.binary()),
            })


def least_matches(n: int, threshold: float = THRESHOLD, tolerance: float = TOLERANCE, values: int = 256) -> int:
    """Fewest matches among n values with which P(similarity >= threshold | matches) is ``tolerance`` or more.

    A value of ``values`` possible ones agrees with probability r = s + (1 - s) / values. With a uniform prior over r in
    [1 / values, 1] the posterior given m matches is a ratio of Beta(m + 1, n - m + 1) tails, which are binomial sums.
    """
    def tail(r: float, m: int) -> float:  # P(Beta(m + 1, n - m + 1) >= r)
        return sum(comb(n + 1, k) * r**k * (1 - r) ** (n + 1 - k) for k in range(m + 1))

    reach, chance = threshold + (1 - threshold) / values, 1 / values
    return next(m for m in range(n + 1) if tail(reach, m) / tail(chance, m) >= tolerance)


def _survivors(values: np.ndarray, one: np.ndarray, others: np.ndarray, least: list[int]) -> np.ndarray:
    """Of the pairs (one[i], others[i]), those that incremental comparison doesn't drop (as a mask)."""
    live, matches = np.arange(len(one)), np.zeros(len(one), np.int64)
    for k, need in enumerate(least):
        part = slice(k * STEP, (k + 1) * STEP)
        matches += (values[one[live], part] == values[others[live], part]).sum(axis=1)
        stay = matches >= need
        live, matches = live[stay], matches[stay]
        if not len(live):
            break
    mask = np.zeros(len(one), bool)
    mask[live] = True
    return mask


def _prune(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (member, least member of its component) of each bucket's surviving pairs."""
    least = [least_matches(n) for n in range(STEP, BANDS * ROWS + 1, STEP)]
    for batch in batches:
        lists = batch.column(0)
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten()
        ids = flat.field(0).to_numpy()
        values = np.frombuffer(b"".join(flat.field(1).to_pylist()), np.uint8).reshape(len(ids), -1)
        root = np.arange(len(ids))
        begin = np.cumsum(sizes) - sizes
        for size in np.unique(sizes[sizes <= 8]):  # small buckets: all pairs of all of them at once
            if size < 2:
                continue
            first = begin[sizes == size]
            one, two = (x.ravel() for x in (first[:, None] + np.triu_indices(size, 1)[0], first[:, None] + np.triu_indices(size, 1)[1]))
            ok = _survivors(values, one, two, least) & (ids[one] != ids[two])
            one, two = one[ok], two[ok]
            _join(root, one, two)
        for a, size in zip(begin[sizes > 8].tolist(), sizes[sizes > 8].tolist(), strict=True):
            members = np.arange(a, a + size)
            for i in members:
                rest = members[(members > i) & (root[members] != root[i])]
                hit = rest[_survivors(values, np.full(len(rest), i), rest, least)]
                if len(hit):
                    merged = np.r_[root[i], root[hit]]
                    inside = np.isin(root[members], merged)
                    root[members[inside]] = merged.min()
        head = np.full(len(ids), np.iinfo(np.int64).max)
        np.minimum.at(head, root, ids)
        label = head[root]
        keep = label != ids
        yield pa.RecordBatch.from_pydict({"u": pa.array(ids[keep]), "v": pa.array(label[keep])})


def _join(root: np.ndarray, one: np.ndarray, two: np.ndarray) -> None:
    """Spread the least root over the pairs until nothing changes."""
    while True:
        least = np.minimum(root[one], root[two])
        if (root[one] == least).all() and (root[two] == least).all():
            return
        np.minimum.at(root, one, least)
        np.minimum.at(root, two, least)
        root[:] = root[root]


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of each connected component of (u, v), by alternating large and small stars.

    Each round links every node's larger neighbours, then its smaller ones, to its least neighbour, and writes the
    edges to the shared folder in place of the round before; it ends when a round leaves them as they were. The centre
    of a star is a hot key: its least neighbour is found by partial aggregation, and the join that tells it to all
    neighbours has an exchange of its own on either side, so that the optimizer splits the centre's partition. Self
    loops and repeated edges do no harm; no edges give no rows.
    """
    spark = edges.sparkSession

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low")) if large else both.groupBy("u").agg(F.min("v").alias("low"))
        # an expression hides that the sums are dealt out by u already: a side without an exchange can't be split
        joined = both.join(low.select(F.bitwise_not(F.bitwise_not("u")).alias("u"), "low"), "u")
        if large:
            out = joined.filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        else:
            out = joined.select(F.col("v").alias("u"), F.col("low").alias("v")).union(low.select("u", F.col("low").alias("v")))
        return out.filter("u != v").distinct()

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.bit_xor(F.xxhash64("v", "u"))).first())

    def written(e: DataFrame) -> tuple[str, DataFrame]:
        path = new_path(spark, "edges")
        e.write.parquet(path)
        return path, spark.read.schema("u long, v long").parquet(path)

    path, now = written(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    seen = state(now)
    while seen[0]:
        old = path
        path, now = written(star(star(now, True), False))
        drop(spark, old)
        if (after := state(now)) == seen:
            break
        seen = after
    labels = now.select(F.col("u").alias("node"), F.col("v").alias("label"))
    return labels.union(labels.select(F.col("label").alias("node"), "label").distinct())


def _shingle_sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted shingle set of each text, as bytes, for rows whose text has the class key that the row names."""
    for batch in batches:
        node = batch.column(0).to_numpy()
        for a, b, data, offsets in text_chunks(batch.column(3)):
            words, places = hash_words(data, offsets)
            right = np.flatnonzero(text_keys(words, places).view(np.int64) == node[a:b])
            right = right[np.unique(node[a:b][right], return_index=True)[1]]  # of rows that repeat id and text one is enough
            hashes, at = shingles(words, places, SHINGLE)
            sets = [np.unique(hashes[at[k] : at[k + 1]]) for k in right]
            cols = [batch.column(k).take(pa.array(right + a)) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([len(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["node", "label", "copies", "n", "shingles"])


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each pair of blocks of a cluster: every member's links and the least member that it is joined to."""
    for batch in batches:
        for i, j, members in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
            rows = members.values
            _, once = np.unique(rows.field(0).to_numpy(), return_index=True)  # rows that repeat an id repeat a member
            rows = rows.take(pa.array(once))
            node, weight, block = (rows.field(k).to_numpy() for k in range(3))
            sets = [np.frombuffer(s.as_buffer(), np.uint64) for s in rows.field(3)]
            left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
            size = np.array([len(s) for s in sets], np.float64)
            hit = common_counts(sets, left, right) >= THRESHOLD / (1 + THRESHOLD) * (size[left][:, None] + size[right][None, :]) - 1e-6
            if i == j:
                np.fill_diagonal(hit, False)
            links, docs, root = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64), np.arange(len(sets))
            links[left] += hit.sum(axis=1)
            docs[left] += (hit @ weight[right].astype(np.float64)).astype(np.int64)
            if i != j:
                links[right] += hit.sum(axis=0)
                docs[right] += (weight[left].astype(np.float64) @ hit).astype(np.int64)
            x, y = np.nonzero(hit)
            _join(root, left[x], right[y])
            low = np.full(len(sets), np.iinfo(np.int64).max)
            np.minimum.at(low, root, node)
            yield pa.RecordBatch.from_pydict({"node": pa.array(node), "text_links": pa.array(links), "doc_links": pa.array(docs), "low": pa.array(low[root])})


def common_counts(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, rare: int = 12, cells: int = 8_000_000) -> np.ndarray:
    """How many elements each left set has in common with each right set.

    Elements of one set only count for nothing. Those of up to ``rare`` sets add one to each pair that has them; the
    others are columns of 0/1 matrices, whose products are added up over slices of columns.
    """
    n = len(sets)
    _, number, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])[np.argsort(number, kind="stable")]
    first = np.cumsum(count) - count
    out = np.zeros((len(left), len(right)), np.float32)
    row, col = np.full(n, -1), np.full(n, -1)
    row[left], col[right] = np.arange(len(left)), np.arange(len(right))
    for c in range(2, rare + 1):
        for at in np.array_split(first[count == c], 1 + (count == c).sum() * c * c // cells):
            own = owner[at[:, None] + np.arange(c)]
            x, y = (np.broadcast_to(v, (len(at), c, c)).ravel() for v in (row[own][:, :, None], col[own][:, None, :]))
            ok = (x >= 0) & (y >= 0)
            np.add.at(out, (x[ok], y[ok]), np.float32(1))
    often = np.flatnonzero(count > rare)
    for part in np.array_split(often, 1 + len(often) * n // cells):
        if len(part):
            flags = np.zeros((n, len(part)), np.float32)
            column = np.repeat(np.arange(len(part)), count[part])
            inner = np.arange(len(column)) - np.repeat(np.cumsum(count[part]) - count[part], count[part])
            flags[owner[first[part][column] + inner], column] = 1
            out += flags[left] @ flags[right].T
    return out


def _raw(text: F.Column) -> F.Column:
    """Hash of a text as it stands. With the id it names a row; rows alike in both are interchangeable."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def _key(id_: F.Column) -> F.Column:
    return F.coalesce(id_.cast("long"), F.lit(NONE))


def _classes(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(rows, texts): each row's doc, raw and node; and of every text class that has copies or links: node, its first
    row (rep, rep_raw), its near-duplicate class' first row (class_id, class_raw), text_links, doc_links.

    Rows are ordered by id, then by text hash.
    """
    rows = docs.select(_key(F.col(id_col)).alias("doc"), F.col(text_col).cast("string").alias("text"), _raw(F.col(text_col)).alias("raw"))
    signed = saved(rows.mapInArrow(_signatures, "doc long, raw long, node long, bands array<long>, minhash binary"), "signatures")
    reps = signed.filter("node is not null").groupBy("node").agg(F.min(F.struct("doc", "raw")).alias("rep"), F.count("*").alias("copies"), F.first("bands").alias("bands"), F.first("minhash").alias("minhash"))
    reps = saved(reps.select("node", F.col("rep.doc").alias("rep"), F.col("rep.raw").alias("rep_raw"), "copies", "bands", "minhash"), "classes")

    keyed = reps.select("node", F.explode("bands").alias("band"))
    sizes = keyed.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    met = keyed.join(sizes, "band").join(reps.select("node", "minhash"), "node")
    grouped = _blocks(met, F.ceil(F.col("size") / BUCKET), "band").agg(F.collect_list(F.struct("node", "minhash")).alias("members"))
    edges = grouped.select("members").mapInArrow(_prune, "u long, v long")

    named = reps.select("node", "rep", "rep_raw", "copies")
    wanted = saved(components(edges).join(named, "node"), "wanted")
    chosen = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted
    found = rows.join(chosen, (F.col("doc") == F.col("rep")) & (F.col("raw") == F.col("rep_raw"))).select("node", "label", "copies", "text")
    sets = saved(found.mapInArrow(_shingle_sets, "node long, label long, copies long, n long, shingles binary"), "shingles")
    mass = sets.groupBy("label").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_TEXTS)).alias("size"))
    mass = mass.select(F.bitwise_not(F.bitwise_not("label")).alias("label"), "size")
    grouped = _blocks(sets.join(mass, "label"), F.col("size"), "label").agg(F.collect_list(F.struct("node", "copies", "block", "shingles")).alias("members"))
    checked = saved(grouped.select("i", "j", "members").mapInArrow(_verify, "node long, text_links long, doc_links long, low long"), "checked")

    links = checked.groupBy("node").agg(F.sum("text_links").alias("text_links"), F.sum("doc_links").alias("doc_links"))
    joined = components(checked.select(F.col("node").alias("u"), F.col("low").alias("v")))
    labelled = named.join(joined, "node", "left").filter("label is not null or copies > 1").withColumn("label", F.coalesce("label", "node"))
    heads = labelled.groupBy("label").agg(F.min(F.struct("rep", "rep_raw")).alias("head"))
    texts = labelled.join(heads, "label").join(links, "node", "left")
    texts = texts.select("node", "rep", "rep_raw", F.col("head.rep").alias("class_id"), F.col("head.rep_raw").alias("class_raw"), F.coalesce("text_links", F.lit(0)).alias("text_links"), (F.coalesce("doc_links", F.lit(0)) + F.col("copies") - 1).alias("doc_links"))
    return signed.select("doc", "raw", "node"), saved(texts, "texts")  # files, not a join: so a hot text's rows can be split


def similarity_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc (its id), class_id, n_links, n_text_links, text_class.

    class_id: the least id of the documents joined to it through links (its own if none); n_links: other documents whose
    shingle set is as similar as the threshold; n_text_links: the same among text classes; text_class: the least id of
    the documents with the same sequence of words. Sequences of words and shingles are compared by 64-bit hashes.

    Null, empty and word-less texts have no links; their class_id and text_class are their own id. A text of fewer than
    five words is one shingle. A null id counts as the least 64-bit integer and comes back as null. Rows that repeat an
    id keep a row each. An empty table gives an empty result. Other columns of docs are ignored.
    """
    rows, texts = _classes(docs, id_col, text_col)
    out = rows.join(texts, "node", "left")
    shown = lambda c: F.when(c != NONE, c)
    return out.select(
        shown(F.col("doc")).alias("doc"),
        shown(F.coalesce("class_id", "doc")).alias("class_id"),
        F.coalesce("doc_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("text_links", F.lit(0)).cast("long").alias("n_text_links"),
        shown(F.coalesce("rep", "doc")).alias("text_class"),
    )


def _blocks(df: DataFrame, blocks: F.Column, group: str):  # noqa: ANN202
    """Group rows by ``group`` and pair of its salted blocks (i <= j), so that any two rows of a group meet in one.

    The group is part of a hash in the key: rows that are dealt out by the group already are dealt out again by block.
    """
    df = df.withColumn("blocks", blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    i, j = F.least("block", "other"), F.greatest("block", "other")
    return df.groupBy(F.xxhash64(group, i, j).alias("pair"), i.alias("i"), j.alias("j"))


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, of which one of each near-duplicate class stays: the first by id, then by text hash.

    What goes is decided by row, that is by id and text: other texts under the same id aren't touched. A null id counts
    as the least one. Texts without words stay. Of rows that repeat both id and text, and aren't without words, one
    stays, whatever their other columns hold.
    """
    rows, texts = _classes(docs, id_col, text_col)
    placed = rows.join(texts.select("node", "class_id", "class_raw"), "node")
    first = (F.col("doc") == F.col("class_id")) & (F.col("raw") == F.col("class_raw"))
    marked = placed.groupBy("doc", "raw").agg(F.first(first).alias("first"), F.count("*").alias("n")).filter("not first or n > 1")
    marked = marked.select(F.col("doc").alias("__join_doc"), F.col("raw").alias("__join_raw"), F.col("first").alias("__join_first"))
    same = (_key(F.col(id_col)) == F.col("__join_doc")) & (_raw(F.col(text_col)) == F.col("__join_raw"))
    kept = docs.join(marked, same, "left_anti")
    again = docs.join(marked.filter("__join_first"), same, "left_semi")  # the few rows that come again, one of each
    once = again.withColumns({"__join_doc": _key(F.col(id_col)), "__join_raw": _raw(F.col(text_col))}).dropDuplicates(["__join_doc", "__join_raw"])
    return kept.unionByName(once.drop("__join_doc", "__join_raw"))
