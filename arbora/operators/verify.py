"""Integrity checks and rebuilding of derived tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arbora.functions import text as X
from arbora.operators import hierarchy as H
from arbora.operators import rollup, search


def orphans(categories: DataFrame) -> DataFrame:
    known = categories.select(F.col("id").alias("parent_id"))
    return categories.filter("parent_id != 0").join(known, "parent_id", "left_anti").select("id", "parent_id")


def count_drift(categories: DataFrame, links: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """(id, stored, actual, drift) of stored subtree link counts, in ten-thousandths."""
    fresh = rollup.subtree_counts(categories, links, tree).select("id", F.col("link_count_subtree").alias("actual"))
    return categories.select("id", F.col("link_count_subtree").alias("stored")).join(fresh, "id").select("id", "stored", "actual", X.drift_bp(F.col("stored"), F.col("actual")).alias("drift"))


def _rows(counts: DataFrame, *named: tuple[str, Column, Column]) -> DataFrame:
    """(name, observed, expected, ok) from one row of counts."""
    made = F.array(*(F.struct(F.lit(name).alias("name"), o.cast("long").alias("observed"), e.cast("long").alias("expected")) for name, o, e in named))
    return counts.select(F.inline(made)).withColumn("ok", F.col("observed") == F.col("expected"))


def index_health(categories: DataFrame, links: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """Six rows (name, observed, expected, ok): how far the derived tables can cover the two base tables.

    Either base table is read once for all its counts; links are told apart by hashes of their urls.
    """
    of_cats = categories.agg(F.count("*").alias("n"), F.count_distinct("parent_id", "id").alias("pairs"), F.count_if(F.col("parent_id") == 0).alias("roots"))
    of_links = links.agg(F.count("*").alias("n"), F.count_distinct("category_id", "id").alias("pairs"), F.count_distinct(F.when(F.col("url").isNotNull(), X.url_hash(F.col("url")))).alias("urls"))
    n, pairs = F.col("n"), F.col("pairs")
    wrong = count_drift(categories, links, tree).agg(F.count_if(F.col("drift") > 0).alias("n"))
    parts = [
        _rows(of_cats, ("cat_by_parent", pairs, n), ("single_top", F.col("roots"), F.lit(1))),
        _rows(of_links, ("link_by_category", pairs, n), ("link_by_url_hash", F.col("urls"), n)),
        _rows(wrong, ("subtree_counts", n, F.lit(0))),
        _rows(orphans(categories).agg(F.count("*").alias("n")), ("no_orphans", n, F.lit(0))),
    ]
    return reduce(DataFrame.unionByName, parts)


def coverage(categories: DataFrame, links: DataFrame, paths: DataFrame, category_postings: DataFrame, link_postings: DataFrame) -> DataFrame:
    """Three rows (name, observed, expected, ok) of stored indexes: distinct slug paths against categories, and whether
    the token indexes hold anything at all where their tables do (1 or 0)."""
    some = lambda t: t.select(F.lit(1).alias("n")).limit(1).agg(F.count("*").alias("n"))
    side = lambda t, side_: t.select(F.lit(side_).alias("side"), "n")

    def row(name: str, observed: DataFrame, expected: DataFrame) -> DataFrame:
        both = side(observed, "o").union(side(expected, "e")).agg(*(F.coalesce(F.sum(F.when(F.col("side") == k, F.col("n"))), F.lit(0)).alias(k) for k in "oe"))
        return _rows(both, (name, F.col("o"), F.col("e")))

    count = lambda t: t.agg(F.count("*").alias("n"))
    found = paths.agg(F.count_distinct("path").alias("n"))
    return reduce(DataFrame.unionByName, (row("slug_paths", found, count(categories)), row("category_tokens", some(category_postings), some(categories)), row("link_tokens", some(link_postings), some(links))))


def rebuild(categories: DataFrame, links: DataFrame) -> dict[str, DataFrame]:
    """All derived tables, from the two base tables."""
    tree = H.closure(categories)
    paths = H.slug_paths(categories, tree)
    return {"closure": tree, "paths": paths, "slug_only": H.slug_only_index(paths), "counts": rollup.subtree_counts(categories, links, tree), "link_postings": search.postings(links, search.LINK_FIELDS), "category_postings": search.postings(categories, search.CATEGORY_FIELDS)}


def stats(categories: DataFrame, links: DataFrame) -> DataFrame:
    n = categories.agg(F.count("*").alias("n")).select(F.lit("categories").alias("what"), "n").union(links.agg(F.count("*").alias("n")).select(F.lit("links"), "n"))
    return n
