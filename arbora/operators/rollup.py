"""Direct and subtree counts: full, and by deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora import schema as S
from arbora.operators.hierarchy import closure

COUNTS = ("link_count", "child_count", "link_count_subtree", "child_count_subtree")


def direct_counts(categories: DataFrame, links: DataFrame) -> DataFrame:
    """(id, link_count, child_count). Rows that repeat a category count once."""
    categories = categories.select("id", "parent_id").distinct()
    own = links.groupBy(F.col("category_id").alias("id")).agg(F.count("*").alias("link_count"))
    kids = categories.groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("child_count"))
    return categories.select("id").join(own, "id", "left").join(kids, "id", "left").na.fill(0)


def subtree_counts(categories: DataFrame, links: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """(id, and the four counts). Links are counted by category before they meet the tree: the large table shuffles
    only partial counts."""
    tree = closure(categories) if tree is None else tree
    direct = direct_counts(categories, links)
    below = tree.join(direct.select(F.col("id").alias("descendant"), "link_count"), "descendant").groupBy(F.col("ancestor").alias("id")).agg(F.sum("link_count").alias("link_count_subtree"), F.count_if(F.col("depth") > 0).alias("child_count_subtree"))
    return direct.join(below, "id")


def changed_counts(categories: DataFrame, links: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """The rows whose stored counts are off, with the right ones."""
    fresh = subtree_counts(categories, links, tree)
    stored = categories.select("id", *(F.col(c).alias(f"stored_{c}") for c in COUNTS))
    off = F.lit(False)
    for c in COUNTS:
        off = off | ~F.col(c).eqNullSafe(F.col(f"stored_{c}"))
    return fresh.join(stored, "id").filter(off)


def apply_deltas(counts: DataFrame, deltas: DataFrame, tree: DataFrame) -> DataFrame:
    """Counts after (category_id, links, children) deltas: each change reaches its ancestors; no count falls below 0."""
    own = deltas.groupBy(F.col("category_id").alias("id")).agg(F.sum("links").alias("dl"), F.sum("children").alias("dc"))
    up = tree.filter(F.col("depth") < S.MAX_DEPTH).join(own.withColumnRenamed("id", "descendant"), "descendant").groupBy(F.col("ancestor").alias("id")).agg(F.sum("dl").alias("tl"), F.sum("dc").alias("tc"))
    joined = counts.join(own, "id", "left").join(up, "id", "left").na.fill(0)
    plus = lambda c, d: F.greatest(F.lit(0), F.col(c) + F.col(d)).alias(c)
    return joined.select("id", plus("link_count", "dl"), plus("child_count", "dc"), plus("link_count_subtree", "tl"), plus("child_count_subtree", "tc"))


def status_counts(links: DataFrame) -> DataFrame:
    return links.agg(*(F.count_if(F.col("status") == k).alias(n) for k, n in enumerate(("pending", "approved", "rejected"))))


def dashboard_counts(links: DataFrame, cap: int | None = None) -> DataFrame:
    """(status, n): exact, or each capped as the web dashboard shows it."""
    n = F.count("*")
    return links.filter(F.col("status").between(0, 2)).groupBy("status").agg((F.least(n, F.lit(cap)) if cap else n).alias("n"))


def latency(samples: DataFrame) -> DataFrame:
    """Per op of (op, us): percentiles, max, mean and samples; ops without samples don't appear."""
    p = lambda q: F.percentile_approx("us", q, 10000)
    return samples.groupBy("op").agg(p(0.5).alias("p50"), p(0.95).alias("p95"), p(0.99).alias("p99"), p(0.999).alias("p999"), F.max("us").alias("max"), F.avg("us").alias("mean"), F.count("*").alias("samples"))
