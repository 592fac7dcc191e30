"""Batch mutations. Each takes tables and a request and returns the next version of the tables and a result per item."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arbora import schema as S
from arbora.functions import text as X
from arbora.operators import hierarchy as H


BEFORE = -(2**63)


@dataclass(frozen=True)
class Result:
    """The changed table and (pos, id, status) of the request's items."""

    table: DataFrame
    items: DataFrame


def _too_long(kind: str) -> Column:
    bad = F.lit(False)
    for field, limit in S.LIMITS[kind].items():
        bad = bad | ~X.fits(F.col(field), limit)
    return bad


def numbered(rows: DataFrame, after: int = 0, out: str = "id", pos: str = "pos") -> DataFrame:
    """``out``: after + 1, after + 2, ... in order of ``pos``.

    Rows are numbered in blocks of 2**20 positions; only the blocks' counts are summed up in one task.
    """
    blocked = rows.withColumn("_block", F.shiftright(F.col(pos).cast("long"), 20))
    counts = blocked.groupBy("_block").agg(F.count("*").alias("_n"))
    earlier = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_block", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_block").orderBy(pos))
    return blocked.join(counts, "_block").withColumn(out, (F.lit(after) + F.col("_before") + rank).cast("long")).drop("_block", "_before")


def _numbered(items: DataFrame, table: DataFrame) -> DataFrame:
    """Ids for the items whose status is ok, after the table's highest, in input order."""
    top = table.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top")).first().top
    ok = numbered(items.filter("status = 'ok'"), top)
    return ok.unionByName(items.filter("status != 'ok'").withColumn("id", F.lit(0).cast("long")))


def create_links(links: DataFrame, categories: DataFrame, items: DataFrame, status: int = S.APPROVED) -> Result:
    """items: (pos, category_id, url, title, description[, submitter_id]). Checked in order: lengths, category (0 is none
    and allowed), url among links, url earlier in the batch (first wins)."""
    if "submitter_id" not in items.columns:
        items = items.withColumn("submitter_id", F.lit(0).cast("long"))
    known = categories.select(F.col("id").alias("category_id"), F.lit(True).alias("known"))
    bad = F.when(_too_long("link"), "field_too_long").when((F.col("category_id") != 0) & F.col("known").isNull(), "category_not_found")
    checked = items.join(known, "category_id", "left").withColumn("status", bad).drop("known")
    # where each url stands first, links before all items: a minimum that merges, so a url may be a third of the batch
    stands = links.select("url", F.lit(BEFORE).alias("pos")).unionByName(checked.filter("status is null").select("url", F.col("pos").cast("long").alias("pos")))
    first = stands.groupBy(F.col("url").alias("__url")).agg(F.min("pos").alias("__first"))
    checked = checked.join(first, F.col("url").eqNullSafe(F.col("__url")), "left")
    checked = checked.withColumn("status", F.coalesce("status", F.when(F.col("__first") < F.col("pos"), "duplicate_url").otherwise("ok"))).drop("__url", "__first")
    done = _numbered(checked, links)
    blank = {c: F.lit(None).cast(links.schema[c].dataType) for c in links.columns if c not in ("id", "category_id", "url", "title", "description", "status", "submitter_id")}
    new = done.filter("status = 'ok'").select("id", "category_id", "url", "title", "description", "submitter_id").withColumn("status", F.lit(status)).withColumns(blank)
    return Result(links.unionByName(new.select(*links.columns)), done.select("pos", "id", "status"))


def create_categories(categories: DataFrame, items: DataFrame) -> Result:
    """items: (pos, parent_id, name, slug, description). The parent must exist unless it is 0, and its path must not have
    more than ``MAX_DEPTH`` categories; slugs may repeat."""
    known = H.ancestry(categories).select(F.col("id").alias("parent_id"), F.size("up").alias("known"))
    bad = F.when(_too_long("category"), "field_too_long").when((F.col("parent_id") != 0) & F.col("known").isNull(), "parent_not_found").when(F.col("known") > S.MAX_DEPTH, "path_too_deep").otherwise("ok")
    done = _numbered(items.join(known, "parent_id", "left").withColumn("status", bad).drop("known"), categories)
    blank = {c: F.lit(None).cast(categories.schema[c].dataType) for c in categories.columns if c not in ("id", "parent_id", "name", "slug", "description")}
    new = done.filter("status = 'ok'").select("id", "parent_id", "name", "slug", "description").withColumns(blank)
    return Result(categories.unionByName(new.select(*categories.columns)), done.select("pos", "id", "status"))


def bulk_tally(result: Result) -> DataFrame:
    """inserted, duplicates, errors, first_id, last_id."""
    ok = F.col("status") == "ok"
    dup = F.col("status") == "duplicate_url"
    ids = F.when(ok, F.col("id"))
    return result.items.agg(F.count_if(ok).alias("inserted"), F.count_if(dup).alias("duplicates"), F.count_if(~ok & ~dup).alias("errors"), F.coalesce(F.min(ids), F.lit(0)).alias("first_id"), F.coalesce(F.max(ids), F.lit(0)).alias("last_id"))


def update_text(table: DataFrame, key: int, kind: str, **fields: str) -> Result:
    """Sets the given fields of one row; other rows' urls aren't looked at."""
    bad = any(len(v.encode()) > S.LIMITS[kind][f] for f, v in fields.items())
    hit = F.col("id") == key
    found = table.filter(hit).select(F.lit(0).alias("pos"), "id", F.lit("field_too_long" if bad else "ok").alias("status"))
    out = table if bad else table.withColumns({f: F.when(hit, F.lit(v)).otherwise(F.col(f)) for f, v in fields.items()})
    return Result(out, found)


def set_status(links: DataFrame, ids: list[int], status: int) -> Result:
    """Per id: ok, not_found, or already_in_state."""
    if status not in (0, 1, 2):
        raise S.DirectoryError("unsupported_order", "unknown status")
    asked = H.wanted(links.sparkSession, ids)
    codes = asked.join(links.select("id", F.col("status").alias("old")), "id", "left").select("pos", "id", F.when(F.col("old").isNull(), "not_found").when(F.col("old") == status, "already_in_state").otherwise("ok").alias("status"))
    return Result(links.withColumn("status", F.when(F.col("id").isin(ids), F.lit(status)).otherwise(F.col("status"))), codes)


def delete_links(links: DataFrame, ids: list[int]) -> Result:
    """Per id: ok, or not_found, as is an id's second appearance."""
    asked = H.wanted(links.sparkSession, ids).withColumn("rn", F.row_number().over(Window.partitionBy("id").orderBy("pos")))
    codes = asked.join(links.select("id", F.lit(True).alias("known")), "id", "left").select("pos", "id", F.when(F.col("known") & (F.col("rn") == 1), "ok").otherwise("not_found").alias("status"))
    return Result(links.join(H.wanted(links.sparkSession, ids).select("id"), "id", "left_anti"), codes)


def move_links(links: DataFrame, categories: DataFrame, ids: list[int], target: int) -> Result:
    """Category 0 or an unknown one is category_not_found for all; a link already there stays."""
    known = target != 0 and not categories.filter(F.col("id") == target).isEmpty()
    asked = H.wanted(links.sparkSession, ids).join(links.select("id", "category_id"), "id", "left")
    code = F.when(F.lit(not known), "category_not_found").when(F.col("category_id").isNull(), "not_found").otherwise("ok")
    moved = links.withColumn("category_id", F.when(F.col("id").isin(ids), F.lit(target).cast("long")).otherwise(F.col("category_id"))) if known else links
    return Result(moved, asked.select("pos", "id", code.alias("status")))


def move_category(categories: DataFrame, category: int, parent: int, tree: DataFrame | None = None) -> DataFrame:
    """The same parent changes nothing; a category can't go under itself or what is below it."""
    if categories.filter(F.col("id") == category).isEmpty():
        raise S.DirectoryError("category_not_found")
    if parent and categories.filter(F.col("id") == parent).isEmpty():
        raise S.DirectoryError("parent_not_found")
    if parent:
        H.check_move(H.closure(categories) if tree is None else tree, category, parent)
    return categories.withColumn("parent_id", F.when(F.col("id") == category, F.lit(parent).cast("long")).otherwise(F.col("parent_id")))


def update_category(categories: DataFrame, category: int, name: str | None = None, slug: str | None = None, description: str | None = None) -> Result:
    """Sets the given fields of one category, a new slug among them: its path and those below are derived, so they follow.

    The one item's status is ok, field_too_long or category_not_found; only ok changes the table.
    """
    fields = {k: v for k, v in (("name", name), ("slug", slug), ("description", description)) if v is not None}
    if any(len(v.encode()) > S.LIMITS["category"][k] for k, v in fields.items()):
        status = "field_too_long"
    else:
        status = "category_not_found" if categories.filter(F.col("id") == category).isEmpty() else "ok"
    item = categories.sparkSession.range(category, category + 1).select(F.lit(0).alias("pos"), "id", F.lit(status).alias("status"))
    hit = F.col("id") == category
    return Result(categories.withColumns({k: F.when(hit, F.lit(v)).otherwise(F.col(k)) for k, v in fields.items()}) if status == "ok" else categories, item)


def rename_category(categories: DataFrame, category: int, slug: str) -> DataFrame:
    if len(slug.encode()) > S.LIMITS["category"]["slug"]:
        raise S.DirectoryError("field_too_long")
    return categories.withColumn("slug", F.when(F.col("id") == category, F.lit(slug)).otherwise(F.col("slug")))


def delete_category(categories: DataFrame, links: DataFrame, category: int) -> tuple[DataFrame, DataFrame]:
    """(categories, links) without the category and its links; one with children is kept."""
    if categories.filter(F.col("id") == category).isEmpty():
        raise S.DirectoryError("not_found")
    if not categories.filter(F.col("parent_id") == category).isEmpty():
        raise S.DirectoryError("has_children")
    return categories.filter(F.col("id") != category), links.filter(F.col("category_id") != category)


def delete_categories(categories: DataFrame, links: DataFrame, ids: list[int]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(categories, links, codes): the ids one after the other; per id ok, not_found or has_children.

    A category goes if all its children went earlier in the request. The children within the request, at most its size,
    are the only rows that the driver sees.
    """
    spark, asked = categories.sparkSession, H.wanted(categories.sparkSession, ids)
    known = {r.id for r in categories.filter(F.col("id").isin(ids)).select("id").collect()}
    kids = categories.filter(F.col("parent_id").isin(ids)).groupBy("parent_id").agg(F.count_if(~F.col("id").isin(ids)).alias("outside"), F.collect_list(F.when(F.col("id").isin(ids), F.col("id"))).alias("inside"))
    held = {r.parent_id: (r.outside, set(r.inside)) for r in kids.collect()}
    codes = []
    for pos, key in enumerate(ids):
        outside, inside = held.get(key, (0, set()))
        code = "not_found" if key not in known else "has_children" if outside or inside & known else "ok"
        codes.append((pos, key, code))
        known -= {key} if code == "ok" else set()
    gone = [key for _, key, code in codes if code == "ok"]
    named = F.element_at(F.array(*(F.lit(code) for _, _, code in codes)), F.col("pos") + 1) if codes else F.lit("ok")
    items = asked.select("pos", "id", named.alias("status"))
    return categories.filter(~F.col("id").isin(gone)), links.filter(~F.coalesce(F.col("category_id").isin(gone), F.lit(False))), items


def with_codes(items: DataFrame) -> DataFrame:
    """items with ``code`` and ``sub_code``, the wire numbers of their status."""
    pick = lambda k: F.create_map(*(F.lit(x) for name, pair in S.CODES.items() for x in (name, pair[k])))[F.col("status")]
    return items.withColumn("code", pick(0)).withColumn("sub_code", pick(1))


def create_submissions(links: DataFrame, categories: DataFrame, items: DataFrame) -> Result:
    """Links that wait for approval; items carry ``submitter_id``."""
    return create_links(links, categories, items, S.PENDING)


def collapse_roots(categories: DataFrame, root: int) -> DataFrame:
    """All other roots become children of ``root``."""
    return categories.withColumn("parent_id", F.when((F.col("parent_id") == 0) & (F.col("id") != root), F.lit(root).cast("long")).otherwise(F.col("parent_id")))
