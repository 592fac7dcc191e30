"""Lookups, listings and paging. Every listing is in ascending id order unless it says otherwise."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora import schema as S
from arbora.operators import hierarchy as H


def get(table: DataFrame, key: int) -> DataFrame:
    return table.filter(F.col("id") == key)


def get_many(categories: DataFrame, ids: list[int]) -> DataFrame:
    """(pos, category) in request order; unknown ids are dropped, repeated ones repeat."""
    return H.wanted(categories.sparkSession, ids).join(categories, "id").orderBy("pos")


def scan(table: DataFrame) -> DataFrame:
    return table.orderBy("id")


def children(categories: DataFrame, parent: int, offset: int = 0, limit: int = S.PAGE_CAP) -> DataFrame:
    return categories.filter(F.col("parent_id") == parent).orderBy("id").offset(offset).limit(min(limit, S.PAGE_CAP))


def roots(categories: DataFrame) -> DataFrame:
    return children(categories, 0)


def home(categories: DataFrame) -> DataFrame:
    """The roots; of a single root its children."""
    top = [r.id for r in roots(categories).select("id").limit(2).collect()]
    return children(categories, top[0]) if len(top) == 1 else roots(categories)


def with_status(links: DataFrame, status: int | None) -> DataFrame:
    if status is None:
        return links
    if status not in (S.PENDING, S.APPROVED, S.REJECTED):
        raise S.DirectoryError("invalid", "unknown status")
    return links.filter(F.col("status") == status)


def page(links: DataFrame, offset: int = 0, limit: int = S.DEFAULT_PAGE, after_id: int = 0) -> DataFrame:
    """A page by id with ``next_after_id``: its last id if another row follows, else 0.

    A cursor seeks past ``after_id`` and makes the offset void. One row more than the page is read to see whether
    another follows.
    """
    limit = min(limit or S.DEFAULT_PAGE, S.PAGE_CAP)
    rows = links.filter(F.col("id") > after_id) if after_id else links
    rows = rows.orderBy("id").offset(0 if after_id else offset).limit(limit + 1)
    whole = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    numbered = rows.withColumn("_rn", F.row_number().over(Window.orderBy("id"))).withColumn("_n", F.count("*").over(whole))
    last = F.max(F.when(F.col("_rn") == limit, F.col("id"))).over(whole)
    return numbered.withColumn("next_after_id", F.when(F.col("_n") > limit, last).otherwise(0).cast("long")).filter(F.col("_rn") <= limit).drop("_rn", "_n")


def links_of(links: DataFrame, category: int, status: int | None = None) -> DataFrame:
    return with_status(links.filter(F.col("category_id") == category), status)


def links_by_submitter(links: DataFrame, submitter: int) -> DataFrame:
    """Submitter 0 means none and has no rows."""
    return links.filter((F.col("submitter_id") == submitter) & (F.col("submitter_id") != 0))


def subtree_links(links: DataFrame, tree: DataFrame, root: int, status: int | None = None) -> DataFrame:
    """Links of the root and all below it. The optimizer broadcasts the ids or shuffles, by their size."""
    ids = tree.filter(F.col("ancestor") == root).select(F.col("descendant").alias("category_id"))
    return with_status(links.join(ids, "category_id", "left_semi"), status)


def subtree_page(links: DataFrame, tree: DataFrame, root: int, offset: int = 0, limit: int = 0, status: int | None = None, after_id: int = 0, order: int = 0, probe: int = 0) -> DataFrame:
    """A page in (category, id) order, and ``probe`` rows more. The cursor is the place of the row with ``after_id``; an unknown one ends the list."""
    if order:
        raise S.DirectoryError("unsupported_order")
    if offset > S.MAX_OFFSET:
        raise S.DirectoryError("offset_too_large")
    limit = min(limit or S.DEFAULT_PAGE, S.PAGE_CAP)
    rows = subtree_links(links, tree, root, status)
    if after_id:
        at = rows.filter(F.col("id") == after_id).select("category_id", "id").first()
        rows = rows.filter(F.struct("category_id", "id") > F.struct(F.lit(at.category_id).cast("long"), F.lit(at.id).cast("long"))) if at else rows.limit(0)
        offset = 0
    return rows.orderBy("category_id", "id").offset(offset).limit(limit + probe)


@dataclass(frozen=True)
class SubtreePage:
    """rows: a page; summary: one row (total, returned, next_after_id) over the whole listing."""

    rows: DataFrame
    summary: DataFrame


def subtree_answer(links: DataFrame, tree: DataFrame, root: int, offset: int = 0, limit: int = 0, status: int | None = None, after_id: int = 0, order: int = 0) -> SubtreePage:
    """:func:`subtree_page` with the exact number of rows that the status leaves in the subtree, and the cursor of the next
    page: the page's last id if another row follows, else 0. An unknown root has an empty page and a total of 0."""
    size = min(limit or S.DEFAULT_PAGE, S.PAGE_CAP)
    rows = subtree_page(links, tree, root, offset, limit, status, after_id, order)
    ahead = subtree_page(links, tree, root, offset, size, status, after_id, order, probe=1).select("category_id", "id")
    places = F.array_sort(F.collect_list(F.struct("category_id", "id")))  # of a page and one row more at most
    page_ = ahead.agg(places.alias("p")).select(F.least(F.size("p"), F.lit(size)).cast("long").alias("returned"), F.when(F.size("p") > size, F.get("p", F.lit(size - 1))["id"]).otherwise(0).cast("long").alias("next_after_id"))
    total = subtree_links(links, tree, root, status).agg(F.count("*").alias("total"))
    both = page_.select(F.lit(0).cast("long").alias("total"), "returned", "next_after_id").union(total.select("total", F.lit(0).cast("long"), F.lit(0).cast("long")))
    return SubtreePage(rows, both.agg(*(F.max(c).alias(c) for c in ("total", "returned", "next_after_id"))))


def parse_extras(tail: bytes) -> tuple[int | None, int]:
    """(status, after_id) of a request's optional tail: nothing, a status, or a status (0xFF: any) and a cursor."""
    if len(tail) not in (0, 1, 9) or (tail and tail[0] > S.REJECTED and not (len(tail) == 9 and tail[0] == 0xFF)):
        raise S.DirectoryError("invalid")
    return (tail[0] if tail and tail[0] != 0xFF else None), int.from_bytes(tail[1:], "little")


def web_page(number: int) -> tuple[int, bool]:
    """(offset, beyond) of a numbered page of the website: pages that start after ``MAX_OFFSET`` aren't fetched."""
    offset = (max(number, 1) - 1) * S.DEFAULT_PAGE
    return offset, offset > S.MAX_OFFSET


def faceted(links: DataFrame, category: int | None = None, year: int | None = None) -> DataFrame:
    """Links of exactly this category and of this year of creation (UTC); rows without a date are of no year."""
    rows = links if category is None else links.filter(F.col("category_id") == category)
    return rows if year is None else rows.filter(F.year("created_at") == year)


def dashboard(links: DataFrame, submitter: int) -> DataFrame:
    """A submitter's links, newest ids first: the first ``DEFAULT_PAGE`` of each status in one list."""
    own = links_by_submitter(links, submitter)
    pages = [with_status(own, status).orderBy("id").limit(S.DEFAULT_PAGE) for status in (S.PENDING, S.APPROVED, S.REJECTED)]
    return pages[0].unionByName(pages[1]).unionByName(pages[2]).orderBy(F.desc("id"))


def adjacent(links: DataFrame, link: int, category: int, n: int = 3) -> DataFrame:
    """The first links of the same category without the link itself."""
    return links_of(links, category).orderBy("id").limit(n + 1).filter(F.col("id") != link).limit(n)


def direct_or_subtree(links: DataFrame, tree: DataFrame, category: int) -> DataFrame:
    direct = links_of(links, category)
    return subtree_links(links, tree, category) if direct.isEmpty() else direct


@dataclass(frozen=True)
class Links:
    """Fluent listing: ``Links(links, tree).subtree(10).where(status=1).after(7).take(20).page()``."""

    links: DataFrame
    tree: DataFrame
    category: int | None = None
    root: int | None = None
    submitter: int | None = None
    status: int | None = None
    skip: int = 0
    cursor: int = 0
    size: int = S.DEFAULT_PAGE

    def of(self, category: int) -> Links:
        return replace(self, category=category)

    def subtree(self, root: int) -> Links:
        return replace(self, root=root)

    def by(self, submitter: int) -> Links:
        return replace(self, submitter=submitter)

    def where(self, status: int) -> Links:
        return replace(self, status=status)

    def offset(self, n: int) -> Links:
        return replace(self, skip=n)

    def after(self, link: int) -> Links:
        return replace(self, cursor=link)

    def take(self, n: int) -> Links:
        return replace(self, size=n)

    def page(self) -> DataFrame:
        if self.root is not None:
            return subtree_page(self.links, self.tree, self.root, self.skip, self.size, self.status, self.cursor)
        rows = self.links if self.category is None else links_of(self.links, self.category)
        rows = rows if self.submitter is None else links_by_submitter(rows, self.submitter)
        return page(with_status(rows, self.status), self.skip, self.size, self.cursor)


def enrich(links: DataFrame, categories: DataFrame) -> DataFrame:
    """Links with their category's name and subtree count; of an unknown category: empty and 0."""
    named = categories.select(F.col("id").alias("category_id"), F.col("name").alias("category_name"), F.col("link_count_subtree").alias("category_links"))
    return links.join(named, "category_id", "left").na.fill({"category_name": "", "category_links": 0})


def recent_first() -> list[Column]:
    return [F.desc("created_at"), F.asc("id")]


def by_title() -> list[Column]:
    return [F.lower("title"), F.asc("id")]
