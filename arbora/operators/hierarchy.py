"""Traversal of the category tree: closure, paths, breadcrumbs, resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arbora import schema as S
from arbora.store import drop, new_path


def ancestry(categories: DataFrame) -> DataFrame:
    """(id, up): each category and its ancestors, from itself to its root, however deep the tree is.

    The known part of the paths doubles in each pass: a path that isn't at its end yet is continued by the path of its
    last category. So a tree of depth d takes log2(d) joins of one row for each category. Two passes are one plan; then
    the paths are written to the shared folder in place of the last ones, so no plan grows with the depth. A path ends
    at a category without a known parent, and before it would meet a category again; of several parents of one id the
    lowest counts.
    """
    spark = categories.sparkSession
    own = categories.filter("id is not null").groupBy("id").agg(F.min(F.when(F.col("parent_id") != 0, F.col("parent_id"))).alias("parent"))
    known = own.select(F.col("id").alias("parent"), F.lit(True).alias("known"))
    first = own.join(known, "parent", "left").select("id", F.array_distinct(F.when(F.col("known"), F.array("id", "parent")).otherwise(F.array("id"))).alias("up"))

    def longer(rows: DataFrame, full: int) -> DataFrame:
        more = rows.select(F.col("id").alias("last"), F.col("up").alias("more"))
        going = rows.filter(F.size("up") == full).join(more, F.element_at("up", -1) == F.col("last"))
        return rows.filter(F.size("up") < full).unionByName(going.select("id", F.array_distinct(F.concat("up", "more")).alias("up")))

    path, full = new_path(spark, "ancestry"), 2
    first.write.parquet(path)
    while True:
        rows, old = spark.read.schema(first.schema).parquet(path), path
        if rows.filter(F.size("up") == full).isEmpty():
            return rows
        path = new_path(spark, "ancestry")
        longer(longer(rows, full), 2 * full - 1).write.parquet(path)
        drop(spark, old)
        full = 4 * full - 3


def closure(categories: DataFrame) -> DataFrame:
    """(ancestor, descendant, depth) of all pairs, each category with itself at depth 0."""
    return ancestry(categories).select(F.posexplode("up").alias("depth", "ancestor"), F.col("id").alias("descendant")).select("ancestor", "descendant", "depth")


class TreeCache:
    """Closures by table version. One version is kept: any write makes a new one."""

    def __init__(self) -> None:
        self.version: object = None
        self.tree: DataFrame | None = None

    def get(self, version: object, categories: DataFrame) -> DataFrame:
        if self.tree is None or version != self.version:
            self.version, self.tree = version, closure(categories)
        return self.tree

    def clear(self) -> None:
        self.version = self.tree = None


def descendants(edges: DataFrame, root: int) -> DataFrame:
    """Ids of the root and all below it, from (parent_id, child_id) edges; cycles are followed once.

    What is found goes twice as deep in each pass: ``jump`` holds the pairs at a distance of 2^k, ``found`` what is
    nearer to the root than that. Both are written to the shared folder in place of the last ones.
    """
    spark = edges.sparkSession

    def written(rows: DataFrame, name: str) -> tuple[str, DataFrame]:
        path = new_path(spark, name)
        rows.write.parquet(path)
        return path, spark.read.schema(rows.schema).parquet(path)

    jump_at, jump = written(edges.select(F.col("parent_id").cast("long").alias("a"), F.col("child_id").cast("long").alias("b")).filter("a is not null and b is not null").distinct(), "jumps")
    found_at, found = written(spark.range(root, root + 1), "found")
    n = 1
    while True:
        old = (jump_at, found_at)
        found_at, found = written(found.union(found.join(jump, F.col("id") == F.col("a"), "inner").select("b")).distinct(), "found")
        if (now := found.count()) == n:
            drop(spark, jump_at)
            drop(spark, old[1])
            return found
        n = now
        jump_at, jump = written(jump.alias("x").join(jump.alias("y"), F.col("x.b") == F.col("y.a")).select("x.a", "y.b").distinct(), "jumps")
        for path in old:
            drop(spark, path)


def edges_of(categories: DataFrame) -> DataFrame:
    return categories.select("parent_id", F.col("id").alias("child_id"))


def breadcrumb_table(categories: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """(id, crumbs): crumbs are (depth, id, name, slug) from the root to the category itself."""
    tree = closure(categories) if tree is None else tree
    named = categories.select(F.col("id").alias("ancestor"), "name", "slug")
    crumbs = F.sort_array(F.collect_list(F.struct((-F.col("depth")).alias("depth"), F.col("ancestor").alias("id"), "name", "slug")))
    return tree.join(named, "ancestor").groupBy(F.col("descendant").alias("id")).agg(crumbs.alias("crumbs"))


def slug_paths(categories: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """(id, path): non-empty slugs from the root, joined by "/"; null if empty or over the byte limit."""
    path = F.array_join(F.filter(F.col("crumbs.slug"), lambda s: s != ""), "/")
    out = breadcrumb_table(categories, tree).select("id", path.alias("path"))
    return out.select("id", F.when((F.col("path") != "") & (F.octet_length("path") <= S.MAX_PATH_BYTES), F.col("path")).alias("path"))


def slug_only_index(paths: DataFrame) -> DataFrame:
    """(slug, id): the shallowest category of each leaf slug, of equals the lowest id."""
    depth = F.size(F.split("path", "/"))
    leaf = F.element_at(F.split("path", "/"), -1)
    return paths.filter("path is not null").groupBy(leaf.alias("slug")).agg(F.min(F.struct(depth, "id"))["id"].alias("id"))


def resolve(paths: DataFrame, path: str) -> DataFrame:
    """(id) of a slug path: as it is, else under ``top/``, else as a leaf slug alone; no row if none fits."""
    tries = [F.when(F.col("path") == path, 0)]
    if not path.startswith("top/"):
        tries.append(F.when(F.col("path") == f"top/{path}", 1))
    depth = F.size(F.split("path", "/"))
    if path and "/" not in path:
        tries.append(F.when(F.element_at(F.split("path", "/"), -1) == path, 2))
    hit = paths.select("id", F.coalesce(*tries).alias("way"), depth.alias("depth")).filter("way is not null")
    return hit.orderBy("way", "depth", "id").limit(1).select("id") if path else hit.limit(0).select("id")


def category_path(tree: DataFrame, category: int) -> DataFrame:
    """(pos, id) from the root to the category; a missing category gives itself. Over 64 ids is an error."""
    rows = tree.filter(F.col("descendant") == category).select(F.col("ancestor").alias("id"), "depth")
    if not rows.filter(F.col("depth") >= S.MAX_DEPTH).isEmpty():
        raise S.DirectoryError("path_too_deep")
    own = tree.sparkSession.range(category, category + 1).select("id", F.lit(0).alias("depth"))
    both = rows.unionByName(own).groupBy("id").agg(F.min("depth").alias("depth"))
    return both.select((F.row_number().over(Window.orderBy(F.desc("depth"))) - 1).cast("long").alias("pos"), "id")


def ancestors(tree: DataFrame, category: int) -> DataFrame:
    """(pos, id) from the root to the parent; of deeper chains the nearest 64."""
    rows = tree.filter((F.col("descendant") == category) & F.col("depth").between(1, S.MAX_DEPTH))
    return rows.select((F.row_number().over(Window.orderBy(F.desc("depth"))) - 1).cast("long").alias("pos"), F.col("ancestor").alias("id"))


def check_batch(ids: list[int]) -> None:
    if len(ids) > S.BATCH_CAP:
        raise S.DirectoryError("invalid", f"more than {S.BATCH_CAP} ids")


def wanted(spark, ids: list[int]) -> DataFrame:  # noqa: ANN001
    """(pos, id) of a request."""
    check_batch(ids)
    return spark.range(1).select(F.posexplode(F.array(*(F.lit(int(i)).cast("long") for i in ids)) if ids else F.array().cast("array<long>")).alias("pos", "id"))


def breadcrumbs(categories: DataFrame, ids: list[int], tree: DataFrame | None = None) -> DataFrame:
    """(pos, id, crumbs) in request order; an unknown id has no crumbs."""
    return wanted(categories.sparkSession, ids).join(breadcrumb_table(categories, tree), "id", "left").orderBy("pos")


def is_cycle(tree: DataFrame, category: int, parent: int) -> bool:
    """Moving the category under the parent would make it its own ancestor."""
    return not tree.filter((F.col("ancestor") == category) & (F.col("descendant") == parent)).isEmpty()


def check_move(tree: DataFrame, category: int, parent: int) -> None:
    """The way up from the new parent must end within ``MAX_HOPS`` categories and not meet the moved one."""
    up = {r.ancestor: r.depth for r in tree.filter((F.col("descendant") == parent) & ((F.col("ancestor") == category) | (F.col("depth") == S.MAX_HOPS))).collect()}
    if up.get(category, S.MAX_HOPS) < S.MAX_HOPS or category == parent:
        raise S.DirectoryError("circular_reference")
    if up:
        raise S.DirectoryError("path_too_deep")


def renamed_paths(paths: DataFrame, old_prefix: str, new_prefix: str) -> DataFrame:
    """(id, path) with the prefix swapped in the renamed category and all below it, in one pass."""
    below = (F.col("path") == old_prefix) | F.col("path").startswith(old_prefix + "/")
    return paths.select("id", F.when(below, F.concat(F.lit(new_prefix), F.expr(f"substring(path, {len(old_prefix) + 1})"))).otherwise(F.col("path")).alias("path"))
