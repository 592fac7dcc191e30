"""Sharding by a hypergeometric communication matrix, natively.

The rows' partitions are cut into a uniform random permutation without a global sort: how many rows of each partition go
to each shard is drawn exactly (multivariate hypergeometric, partition by partition), each partition permutes its rows
and deals them out by those counts, one exchange brings them to their shards, and each shard permutes again. Shard sizes
are exact, at most one apart.

The matrix also says how many rows a shard gets from the partitions before, so each row knows its place in the shard
without counting. The shard's own permutation is a keyed bijection of its places (rounds that add a hash of one half to
the other, repeated while the place lies outside the shard): no window, no task that orders a shard. The exchange is by
shard and run of ``BIN_ROWS`` slots, so tasks stay small whatever the number of rows or partitions.
"""

from __future__ import annotations

from math import isqrt, log, log1p, sqrt

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.llm.store import saved

SHARDS, BIN_ROWS, SEED = 24, 512, 20_240_607
#: Numbers in the matrix at most: input partitions are put together until it fits. Broadcast, it takes 16 bytes for each.
CELLS = 1_200_000
ROUNDS, WALKS = 6, 64
_NUMPY_LIMIT = 10**9


def shard_sizes(rows: int, shards: int) -> list[int]:
    return [rows // shards + (s < rows % shards) for s in range(shards)]


def _log_factorials(a: int, b: int) -> float:
    """ln(b! / a!) of large numbers, by the difference of their Stirling series."""
    a, b = a + 1, b + 1
    series = lambda x: 1 / (12 * x) - 1 / (360 * x**3)
    return (b - 0.5) * log1p((b - a) / a) + (b - a) * (log(a) - 1) + series(b) - series(a)


def _hypergeometric(draw: np.random.Generator, good: int, bad: int, n: int) -> int:
    """How many good ones are among n drawn; beyond numpy's limit by ratio of uniforms."""
    if good + bad < _NUMPY_LIMIT:
        return int(draw.hypergeometric(good, bad, n)) if n else 0
    least, most, total = max(0, n - bad), min(good, n), good + bad
    if least == most:
        return least
    if 2 * n > total:
        return good - _hypergeometric(draw, good, bad, total - n)
    share = good / total
    mean, variance = n * share, n * share * (1 - share) * (total - n) / (total - 1)
    mode = min(most, max(least, (n + 1) * (good + 1) // (total + 2)))
    width = 2 * sqrt(2 / np.e) * sqrt(variance + 0.5) + 3 - 2 * sqrt(3 / np.e)
    while True:
        u, v = 1 - draw.random(), draw.random()
        k = int(np.floor(mean + 0.5 + width * (v - 0.5) / u))
        if least <= k <= most and 2 * log(u) <= -_log_factorials(mode, k) - _log_factorials(good - mode, good - k) - _log_factorials(n - mode, n - k) - _log_factorials(bad - n + mode, bad - n + k):
            return k


def communication_matrix(partition_rows: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """How many rows of each partition go to each shard: the law of a uniform permutation cut at the shards."""
    draw, left = np.random.default_rng(seed), np.array(sizes, np.int64)
    out = np.zeros((len(partition_rows), len(sizes)), np.int64)
    for p, n in enumerate(partition_rows):
        if left.sum() < _NUMPY_LIMIT:
            out[p] = draw.multivariate_hypergeometric(left, n, method="marginals")
        else:
            rest, wanted = int(left.sum()), n
            for s in range(len(sizes)):
                rest -= int(left[s])
                out[p, s] = _hypergeometric(draw, int(left[s]), rest, wanted)
                wanted -= int(out[p, s])
        left -= out[p]
    return out


def _partition_rows(docs: DataFrame) -> list[tuple[int, int]]:
    """(partition, rows) of the partitions that have rows."""
    return sorted((r.part, r["count"]) for r in docs.select(F.spark_partition_id().alias("part")).groupBy("part").count().collect())


def permuted(place: F.Column, shard: F.Column, sizes: list[int], seed: int) -> F.Column:
    """A bijection of a shard's places 0 to size - 1, another for each shard and seed.

    Places lie on a grid of a by b cells, of which fewer than a are no places; a path that ends on such a cell goes on
    from there. Up to 4096 places ``WALKS`` repetitions always suffice; beyond that a repetition fails for one place in
    64 at most.
    """
    pick = lambda values: F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), shard + 1)
    wide = [max(1, isqrt(max(n - 1, 0)) + 1) for n in sizes]
    size, a, b = pick(sizes), pick(wide), pick([max(1, -(-n // w)) for n, w in zip(sizes, wide, strict=True)])

    def step(s: F.Column, r: F.Column) -> F.Column:
        moved = lambda one, other, width: F.pmod(one + F.pmod(F.xxhash64(F.lit(seed), r, shard, other), width), width)
        even = r % 2 == 0
        return F.struct(F.when(even, moved(s["x"], s["y"], a)).otherwise(s["x"]).alias("x"), F.when(even, s["y"]).otherwise(moved(s["y"], s["x"], b)).alias("y"))

    def walk(s: F.Column) -> F.Column:
        start = F.struct(F.floor(s["v"] / b).cast("long").alias("x"), (s["v"] % b).alias("y"))
        return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), start, step, lambda e: F.struct((e["x"] * b + e["y"]).alias("v"), (e["x"] * b + e["y"] >= size).alias("go")))

    end = F.aggregate(F.sequence(F.lit(1), F.lit(WALKS)), F.struct(place.cast("long").alias("v"), F.lit(True).alias("go")), lambda s, _: F.when(s["go"], walk(s)).otherwise(s))
    return F.when(~end["go"], end["v"]).otherwise(F.raise_error(F.lit("a place left its shard")).cast("long"))


def shuffle_into_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", bin_rows: int = BIN_ROWS, cells: int = CELLS) -> DataFrame:
    """All rows and columns of docs, with ``shard`` and ``slot``; columns of those names are replaced.

    ``docs`` must give the same rows in the same partitions whenever it is computed, as a file scan or a checkpoint
    does; a plan that gives a partition more rows than it had is noticed and fails. The driver holds one count for each
    partition and a matrix of at most ``cells`` numbers, which is written as a table and broadcast. Rows are ordered by
    a hash of id and text: a lost task's retry deals out the same rows. Nulls hash like values; rows equal in id and
    text are interchangeable. An empty table gives no rows; with fewer rows than shards, some shards are empty.
    """
    spark = docs.sparkSession
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    counts = _partition_rows(docs)
    if len(counts) * shards > cells:
        docs = docs.coalesce(max(1, cells // shards))
        counts = _partition_rows(docs)
    sizes = shard_sizes(sum(n for _, n in counts), shards)
    matrix = communication_matrix([n for _, n in counts], sizes, seed)
    ends, before = np.cumsum(matrix, axis=1), np.cumsum(matrix, axis=0) - matrix
    listed = lambda row: ",".join(map(str, row.tolist()))
    deal = spark.createDataFrame([(p, listed(e), listed(b)) for (p, _), e, b in zip(counts, ends, before, strict=True)], "__part int, __ends string, __before string")
    deal = saved(deal.select("__part", *(F.split(c, ",").cast("array<long>").alias(c) for c in ("__ends", "__before"))), "deal")

    local = docs.select(*kept, F.spark_partition_id().alias("__part")).sortWithinPartitions(F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)), id_col, text_col)
    ranked = local.withColumn("__rank", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    shard = F.size(F.filter("__ends", lambda e: e <= F.col("__rank")))
    dealt = ranked.join(F.broadcast(deal), "__part", "left").withColumn("shard", F.when(shard < shards, shard).otherwise(F.raise_error(F.lit("the partitions changed while they were dealt out")).cast("int")))
    first = F.when(F.col("shard") > 0, F.get("__ends", F.col("shard") - 1)).otherwise(0)
    placed = dealt.withColumn("__place", F.get("__before", F.col("shard")) + F.col("__rank") - first).select(*kept, "shard", "__place")
    slotted = placed.withColumn("slot", permuted(F.col("__place"), F.col("shard"), sizes, seed)).drop("__place")
    return slotted.repartition("shard", F.floor(F.col("slot") / bin_rows)).sortWithinPartitions("shard", "slot")


def digests(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Per row, from the sharded rows: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return shuffle_into_shards(docs, shards).select(
        "doc_id",
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
