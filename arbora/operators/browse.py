"""Browsing: what a category's page shows, in one answer."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora import schema as S
from arbora.operators import hierarchy as H
from arbora.operators import listing as L


@dataclass(frozen=True)
class Browse:
    """The category, its ancestors from the root (with ``pos``), its first children, and one row ``total_links``."""

    id: int
    category: DataFrame
    ancestors: DataFrame
    children: DataFrame
    total: DataFrame

    def rows(self) -> DataFrame:
        """(part, pos, id, name) of all four; the total's id is the number of links in the subtree."""
        part = lambda name, df, pos: df.select(F.lit(name).alias("part"), pos.cast("long").alias("pos"), "id", "name")
        place = F.row_number().over(L.Window.orderBy("id")) - 1  # of at most a page of children
        total = self.total.select(F.col("total_links").alias("id"), F.lit("").alias("name"))
        parts = (part("ancestor", self.ancestors, F.col("pos")), part("self", self.category, F.lit(0)), part("child", self.children, place), part("total_links", total, F.lit(0)))
        return reduce(DataFrame.unionByName, parts)


def browse(categories: DataFrame, links: DataFrame, path: str, tree: DataFrame | None = None, paths: DataFrame | None = None) -> Browse:
    """The category that a slug path resolves to; not_found if there is none.

    ``tree`` and ``paths`` are the closure and the slug paths of the same categories, for callers that keep them.
    """
    tree = H.closure(categories) if tree is None else tree
    found = H.resolve(H.slug_paths(categories, tree) if paths is None else paths, path).first()
    if found is None:
        raise S.DirectoryError("not_found", path)
    up = H.ancestors(tree, found.id).join(categories, "id").orderBy("pos")
    total = L.subtree_links(links, tree, found.id).agg(F.count("*").alias("total_links"))
    return Browse(found.id, L.get(categories, found.id), up, L.children(categories, found.id), total)
