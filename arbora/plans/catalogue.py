"""Queries over the lenses, each with DuckDB SQL for the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora import schema as S
from arbora.functions import text as X
from arbora.operators import browse as B
from arbora.operators import hierarchy as H
from arbora.operators import listing as L
from arbora.operators import mutate as M
from arbora.operators import repair
from arbora.operators import rollup as R
from arbora.operators import search as Q
from arbora.operators import verify as V
from arbora.sources import lenses
from arbora.store import new_path
from arbora.streaming import changelog, effects

Query = Callable[[SparkSession, str], DataFrame]

GEO_SQL = """
WITH RECURSIVE seg AS (SELECT c_mktsegment AS name, row_number() OVER (ORDER BY c_mktsegment) - 1 AS seg FROM (SELECT DISTINCT c_mktsegment FROM customer)),
named AS (
  SELECT 1::BIGINT AS id, 0::BIGINT AS parent_id, 'Top' AS name UNION ALL SELECT 10 + r_regionkey, 1, r_name FROM region
  UNION ALL SELECT 100 + n_nationkey, 10 + n_regionkey, n_name FROM nation
  UNION ALL SELECT DISTINCT 1000 + 10 * c_nationkey + seg, 100 + c_nationkey, c_mktsegment FROM customer JOIN seg ON name = c_mktsegment),
cats AS (SELECT id, parent_id, name, lower(replace(name, ' ', '-')) AS slug FROM named),
links AS (
  SELECT (o_orderkey + 1)::BIGINT AS id, (1000 + 10 * c_nationkey + seg)::BIGINT AS category_id, 'https://o' || o_orderkey || '.example' AS url, o_orderpriority AS title, '' AS description,
    CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'F' THEN 1 ELSE 2 END AS status, (o_custkey + 1)::BIGINT AS submitter_id, o_orderdate AS created_at
  FROM orders JOIN customer ON c_custkey = o_custkey JOIN seg ON seg.name = c_mktsegment),
up AS (SELECT id AS descendant, id AS ancestor, 0 AS depth FROM cats UNION ALL SELECT u.descendant, c.parent_id, u.depth + 1 FROM up u JOIN cats c ON c.id = u.ancestor WHERE c.parent_id != 0),
paths AS (SELECT descendant AS id, string_agg(slug, '/' ORDER BY depth DESC) AS path FROM up JOIN cats ON cats.id = ancestor GROUP BY descendant),
direct AS (SELECT c.id, (SELECT count(*) FROM links WHERE category_id = c.id) AS link_count, (SELECT count(*) FROM cats k WHERE k.parent_id = c.id) AS child_count FROM cats c),
counts AS (
  SELECT d.id, d.link_count, d.child_count, s.link_count_subtree, s.child_count_subtree FROM direct d JOIN (
    SELECT ancestor AS id, sum(link_count)::BIGINT AS link_count_subtree, count(*) FILTER (depth > 0) AS child_count_subtree FROM up JOIN direct ON direct.id = descendant GROUP BY ancestor) s USING (id))
"""
CATALOG_SQL = """
WITH types AS (SELECT p_type, dense_rank() OVER (ORDER BY p_type) AS t FROM (SELECT DISTINCT p_type FROM part)),
brands AS (SELECT p_type, p_brand, t, dense_rank() OVER (PARTITION BY p_type ORDER BY p_brand) AS b FROM (SELECT DISTINCT p_type, p_brand FROM part) JOIN types USING (p_type)),
links AS (SELECT (p_partkey + 1)::BIGINT AS id, (1000 * t + b)::BIGINT AS category_id, 'https://p' || p_partkey || '.example' AS url, p_name AS title, p_type || ',' || p_brand AS tags FROM part JOIN brands USING (p_type, p_brand)),
posts AS (SELECT DISTINCT id, unnest(regexp_extract_all(translate(title || ' ' || url || ' ', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9]+')) AS token FROM links),
postings AS (SELECT token, id FROM posts WHERE length(token) BETWEEN 2 AND 64)
"""

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


class Geo:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.tables = spark, lenses.Tables(spark, sf_dir)

    @cached_property
    def cats(self) -> DataFrame:
        return lenses.geo_categories(self.tables)

    @cached_property
    def links(self) -> DataFrame:
        return lenses.geo_links(self.tables)

    @cached_property
    def tree(self) -> DataFrame:
        return H.closure(self.cats)


class Catalog:
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.tables = spark, lenses.Tables(spark, sf_dir)

    @cached_property
    def cats(self) -> DataFrame:
        return lenses.catalog_categories(self.tables)

    @cached_property
    def links(self) -> DataFrame:
        return lenses.catalog_links(self.tables)


def _query(lens: type, base: str, sql: str | None) -> Callable[[Callable], Callable]:
    def register(f: Callable) -> Callable:
        _QUERIES[f.__name__] = lambda spark, sf_dir: f(lens(spark, sf_dir))
        if sql is not None:
            _SQL[f.__name__] = base + sql
        return f

    return register


def geo(sql: str | None) -> Callable[[Callable], Callable]:
    return _query(Geo, GEO_SQL, sql)


def catalog(sql: str | None) -> Callable[[Callable], Callable]:
    return _query(Catalog, CATALOG_SQL, sql)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


@geo("""SELECT id, category_id, url, title, status, submitter_id FROM links WHERE id = 42""")
def get_link(d: Geo) -> DataFrame:
    return L.get(d.links, 42).select("id", "category_id", "url", "title", "status", "submitter_id")

@geo("""SELECT id, category_id, url, title, status, submitter_id FROM links WHERE id = -1""")
def get_link_missing(d: Geo) -> DataFrame:
    return L.get(d.links, -1).select("id", "category_id", "url", "title", "status", "submitter_id")

@geo("""SELECT id, parent_id, name, slug FROM cats WHERE id = 101""")
def get_category(d: Geo) -> DataFrame:
    return L.get(d.cats, 101).select("id", "parent_id", "name", "slug")

@geo("""SELECT pos, id, name FROM (VALUES (0, 101), (1, 10), (2, 999999), (3, 101), (4, 1)) v(pos, id) JOIN cats USING (id)""")
def get_categories_batch(d: Geo) -> DataFrame:
    return L.get_many(d.cats, [101, 10, 999999, 101, 1]).select("pos", "id", "name")

@geo("""SELECT id, category_id, url, title, status, submitter_id FROM links ORDER BY id""")
def full_scan(d: Geo) -> DataFrame:
    return L.scan(d.links).select("id", "category_id", "url", "title", "status", "submitter_id")

@geo("""SELECT id, name FROM cats WHERE parent_id = 0""")
def list_roots(d: Geo) -> DataFrame:
    return L.roots(d.cats).select("id", "name")

@geo("""SELECT id, name FROM cats WHERE parent_id = 1""")
def home_list(d: Geo) -> DataFrame:
    return L.home(d.cats).select("id", "name")

@geo("""SELECT id, name FROM cats WHERE parent_id = 1 ORDER BY id LIMIT 3 OFFSET 1""")
def list_children_page(d: Geo) -> DataFrame:
    return L.children(d.cats, 1, 1, 3).select("id", "name")

@geo(""", p AS (SELECT * FROM links WHERE category_id = 1000 ORDER BY id LIMIT 6 OFFSET 2) SELECT id, category_id, url, title, status, submitter_id, CASE WHEN (SELECT count(*) FROM p) > 5 THEN (SELECT max(id) FROM (SELECT id FROM p ORDER BY id LIMIT 5)) ELSE 0 END::BIGINT AS next_after_id FROM (SELECT * FROM p ORDER BY id LIMIT 5)""")
def list_links_offset(d: Geo) -> DataFrame:
    return L.page(L.links_of(d.links, 1000), offset=2, limit=5).select("id", "category_id", "url", "title", "status", "submitter_id", "next_after_id")

@geo(""", p AS (SELECT * FROM links WHERE category_id = 1000 AND id > 3 ORDER BY id LIMIT 6 OFFSET 0) SELECT id, category_id, url, title, status, submitter_id, CASE WHEN (SELECT count(*) FROM p) > 5 THEN (SELECT max(id) FROM (SELECT id FROM p ORDER BY id LIMIT 5)) ELSE 0 END::BIGINT AS next_after_id FROM (SELECT * FROM p ORDER BY id LIMIT 5)""")
def list_links_keyset(d: Geo) -> DataFrame:
    return L.page(L.links_of(d.links, 1000), offset=99, limit=5, after_id=3).select("id", "category_id", "url", "title", "status", "submitter_id", "next_after_id")

@geo(""", p AS (SELECT * FROM links WHERE category_id = 1001 AND status = 1 ORDER BY id LIMIT 101 OFFSET 0) SELECT id, category_id, url, title, status, submitter_id, CASE WHEN (SELECT count(*) FROM p) > 100 THEN (SELECT max(id) FROM (SELECT id FROM p ORDER BY id LIMIT 100)) ELSE 0 END::BIGINT AS next_after_id FROM (SELECT * FROM p ORDER BY id LIMIT 100)""")
def list_links_status(d: Geo) -> DataFrame:
    return L.page(L.links_of(d.links, 1001, status=1), limit=100).select("id", "category_id", "url", "title", "status", "submitter_id", "next_after_id")

@geo(""", p AS (SELECT * FROM links WHERE submitter_id = 8 ORDER BY id LIMIT 11 OFFSET 0) SELECT id, category_id, url, title, status, submitter_id, CASE WHEN (SELECT count(*) FROM p) > 10 THEN (SELECT max(id) FROM (SELECT id FROM p ORDER BY id LIMIT 10)) ELSE 0 END::BIGINT AS next_after_id FROM (SELECT * FROM p ORDER BY id LIMIT 10)""")
def list_by_submitter(d: Geo) -> DataFrame:
    return L.page(L.links_by_submitter(d.links, 8), limit=10).select("id", "category_id", "url", "title", "status", "submitter_id", "next_after_id")

@geo(""", p AS (SELECT * FROM links WHERE id > 500 ORDER BY id LIMIT 51 OFFSET 0) SELECT id, category_id, url, title, status, submitter_id, CASE WHEN (SELECT count(*) FROM p) > 50 THEN (SELECT max(id) FROM (SELECT id FROM p ORDER BY id LIMIT 50)) ELSE 0 END::BIGINT AS next_after_id FROM (SELECT * FROM p ORDER BY id LIMIT 50)""")
def list_all_keyset(d: Geo) -> DataFrame:
    return L.Links(d.links, d.cats).after(500).take(50).page().select("id", "category_id", "url", "title", "status", "submitter_id", "next_after_id")

@geo("""SELECT id, category_id, url, title, status, submitter_id FROM links WHERE category_id IN (SELECT descendant FROM up WHERE ancestor = 10) ORDER BY category_id, id LIMIT 40 OFFSET 7""")
def subtree_links_page(d: Geo) -> DataFrame:
    return L.subtree_page(d.links, d.tree, 10, offset=7, limit=40).select("id", "category_id", "url", "title", "status", "submitter_id")

@geo("""SELECT id, category_id, url, title, status, submitter_id FROM links WHERE (category_id, id) > (SELECT (category_id, id) FROM links WHERE id = 9) ORDER BY category_id, id LIMIT 40""")
def subtree_links_cursor(d: Geo) -> DataFrame:
    return L.subtree_page(d.links, d.tree, 1, limit=40, after_id=9).select("id", "category_id", "url", "title", "status", "submitter_id")

@geo("""SELECT id, category_id, url, title, status, submitter_id FROM links WHERE category_id IN (SELECT descendant FROM up WHERE ancestor = 11)""")
def subtree_links_all(d: Geo) -> DataFrame:
    return L.subtree_links(d.links, d.tree, 11).select("id", "category_id", "url", "title", "status", "submitter_id")

@geo("""SELECT count(*) AS total FROM links WHERE status = 2""")
def subtree_links_status_total(d: Geo) -> DataFrame:
    return L.subtree_links(d.links, d.tree, 1, status=2).agg(F.count("*").alias("total"))

@geo("""SELECT row_number() OVER (ORDER BY depth DESC) - 1 AS pos, ancestor AS id FROM up WHERE descendant = 1000""")
def category_path(d: Geo) -> DataFrame:
    return H.category_path(d.tree, 1000)

@geo("""SELECT row_number() OVER (ORDER BY depth DESC) - 1 AS pos, ancestor AS id FROM up WHERE descendant = 1000 AND depth > 0""")
def ancestors(d: Geo) -> DataFrame:
    return H.ancestors(d.tree, 1000)

@geo("""SELECT pos, v.id, coalesce((SELECT string_agg(name, '/' ORDER BY depth DESC) FROM up JOIN cats ON cats.id = ancestor WHERE descendant = v.id), '') AS crumbs FROM (VALUES (0, 1000), (1, 999999), (2, 10)) v(pos, id)""")
def breadcrumbs_batch(d: Geo) -> DataFrame:
    return H.breadcrumbs(d.cats, [1000, 999999, 10]).select("pos", "id", F.coalesce(F.array_join("crumbs.name", "/"), F.lit("")).alias("crumbs"))

@geo("""SELECT descendant AS id FROM up WHERE ancestor = 12""")
def descendants(d: Geo) -> DataFrame:
    return H.descendants(H.edges_of(d.cats), 12)

@geo("""SELECT ancestor, descendant, depth FROM up""")
def closure(d: Geo) -> DataFrame:
    return d.tree.select("ancestor", "descendant", "depth")

@geo("""SELECT id, path FROM paths""")
def slug_paths(d: Geo) -> DataFrame:
    return H.slug_paths(d.cats)

@geo("""SELECT split_part(path, '/', -1) AS slug, arg_min(id, (len(string_split(path, '/')), id)) AS id FROM paths GROUP BY 1""")
def slug_only_index(d: Geo) -> DataFrame:
    return H.slug_only_index(H.slug_paths(d.cats))

@geo("""SELECT id FROM (SELECT id, len(string_split(path, '/')) AS depth, CASE WHEN path = 'top/asia' THEN 0 WHEN path = 'top/top/asia' THEN 1 WHEN split_part(path, '/', -1) = 'top/asia' THEN 2 END AS way FROM paths) WHERE way IS NOT NULL ORDER BY way, depth, id LIMIT 1""")
def resolve_full(d: Geo) -> DataFrame:
    return H.resolve(H.slug_paths(d.cats), "top/asia")

@geo("""SELECT id FROM (SELECT id, len(string_split(path, '/')) AS depth, CASE WHEN path = 'asia' THEN 0 WHEN path = 'top/asia' THEN 1 WHEN split_part(path, '/', -1) = 'asia' THEN 2 END AS way FROM paths) WHERE way IS NOT NULL ORDER BY way, depth, id LIMIT 1""")
def resolve_top_prefix(d: Geo) -> DataFrame:
    return H.resolve(H.slug_paths(d.cats), "asia")

@geo("""SELECT id FROM (SELECT id, len(string_split(path, '/')) AS depth, CASE WHEN path = 'building' THEN 0 WHEN path = 'top/building' THEN 1 WHEN split_part(path, '/', -1) = 'building' THEN 2 END AS way FROM paths) WHERE way IS NOT NULL ORDER BY way, depth, id LIMIT 1""")
def resolve_leaf(d: Geo) -> DataFrame:
    return H.resolve(H.slug_paths(d.cats), "building")

@geo("""SELECT id FROM (SELECT id, len(string_split(path, '/')) AS depth, CASE WHEN path = 'asia/nowhere' THEN 0 WHEN path = 'top/asia/nowhere' THEN 1 WHEN split_part(path, '/', -1) = 'asia/nowhere' THEN 2 END AS way FROM paths) WHERE way IS NOT NULL ORDER BY way, depth, id LIMIT 1""")
def resolve_missing(d: Geo) -> DataFrame:
    return H.resolve(H.slug_paths(d.cats), "asia/nowhere")


@geo("""SELECT 'ancestor' AS part, row_number() OVER (ORDER BY depth DESC) - 1 AS pos, ancestor AS id, name FROM up JOIN cats ON cats.id = ancestor WHERE descendant = 12 AND depth > 0 UNION ALL SELECT 'self', 0, id, name FROM cats WHERE id = 12
UNION ALL SELECT 'child', row_number() OVER (ORDER BY id) - 1, id, name FROM cats WHERE parent_id = 12 UNION ALL SELECT 'total_links', 0, link_count_subtree, '' FROM counts WHERE id = 12""")
def browse_path(d: Geo) -> DataFrame:
    return B.browse(d.cats, d.links, "asia", d.tree).rows()

@geo(""", hit AS (SELECT id, category_id FROM links WHERE category_id IN (SELECT descendant FROM up WHERE ancestor = 12) AND status = 1),
  p AS (SELECT *, row_number() OVER (ORDER BY category_id, id) AS rn FROM hit)
  SELECT (SELECT count(*) FROM hit)::BIGINT AS total, (SELECT count(*) FROM p WHERE rn BETWEEN 8 AND 47)::BIGINT AS returned, coalesce((SELECT max(id) FROM p WHERE rn = 47 AND (SELECT count(*) FROM hit) > 47), 0)::BIGINT AS next_after_id""")
def subtree_links_answer(d: Geo) -> DataFrame:
    return L.subtree_answer(d.links, d.tree, 12, offset=7, limit=40, status=1).summary

@geo(""", hit AS (SELECT id, row_number() OVER (ORDER BY category_id, id) AS rn FROM links WHERE category_id IN (SELECT descendant FROM up WHERE ancestor = 1)), c AS (SELECT rn FROM hit WHERE id = 9)
  SELECT (SELECT count(*) FROM hit)::BIGINT AS total, (SELECT count(*) FROM hit WHERE rn > (SELECT rn FROM c) AND rn <= (SELECT rn FROM c) + 50)::BIGINT AS returned,
    coalesce((SELECT max(id) FROM hit WHERE rn = (SELECT rn FROM c) + 50 AND (SELECT max(rn) FROM hit) > (SELECT rn FROM c) + 50), 0)::BIGINT AS next_after_id""")
def subtree_links_answer_cursor(d: Geo) -> DataFrame:
    return L.subtree_answer(d.links, d.tree, 1, after_id=9).summary

@geo("""SELECT id, status FROM (SELECT id, status, row_number() OVER (PARTITION BY status ORDER BY id) AS rn FROM links WHERE submitter_id = 8) WHERE rn <= 50""")
def dashboard_all(d: Geo) -> DataFrame:
    return L.dashboard(d.links, 8).select("id", "status")

@geo("""SELECT id, url FROM links WHERE category_id = 1002 AND year(created_at) = 1996""")
def category_year_filter(d: Geo) -> DataFrame:
    return L.faceted(d.links, 1002, 1996).select("id", "url")

@geo("""SELECT id, name, slug, parent_id, breadcrumb FROM (SELECT * FROM cats WHERE name = 'BUILDING' ORDER BY id LIMIT 20) JOIN (SELECT descendant AS parent_id, string_agg(name, ' / ' ORDER BY depth DESC) AS breadcrumb FROM up JOIN (SELECT id AS ancestor, name FROM cats) USING (ancestor) GROUP BY 1) USING (parent_id)""")
def search_with_parents(d: Geo) -> DataFrame:
    return Q.search_with_parents(d.cats, "building", tree=d.tree)

@geo("""SELECT id, status FROM (SELECT * FROM links WHERE title LIKE '%URGENT%' ORDER BY id LIMIT 50) WHERE status = 2""")
def search_with_status(d: Geo) -> DataFrame:
    return Q.search_with_status(d.links, "urgent", 2).select("id", "status")

@geo("""SELECT id, strftime(created_at, '%b %d, %Y') AS added, strftime(created_at, '%b %Y') AS month, lpad(id::VARCHAR, 7, '0') AS number, CASE WHEN length(title) > 6 THEN rtrim(substr(title, 1, 6)) || '…' ELSE title END AS short FROM links""")
def formatted_links(d: Geo) -> DataFrame:
    return d.links.select("id", X.long_date(F.col("created_at")).alias("added"), X.month_year(F.col("created_at")).alias("month"), X.pad(F.col("id"), 7).alias("number"), X.truncate(F.col("title"), 6).alias("short"))

@catalog("""SELECT id, string_agg(token, ' ' ORDER BY token) AS tokens FROM postings GROUP BY id""")
def tokenize_links(d: Catalog) -> DataFrame:
    return d.links.select("id", F.array_join(F.array_sort(X.tokens(F.col("title"), F.col("url"))), " ").alias("tokens"))

@catalog("""SELECT token, id FROM postings""")
def postings(d: Catalog) -> DataFrame:
    return Q.postings(d.links, ("title", "url"))

@catalog("""SELECT id, title FROM links WHERE id IN (SELECT id FROM postings WHERE token IN ('example') GROUP BY id HAVING count(DISTINCT token) = 1) ORDER BY id""")
def search_one(d: Catalog) -> DataFrame:
    return Q.search_links(d.links, "Example", None).select("id", "title")


def _words(d: Catalog) -> str:
    return d.links.filter("id = 1").first().title


@catalog("""SELECT l.id, l.title FROM links l WHERE (SELECT count(*) FROM postings p WHERE p.id = l.id AND p.token IN (SELECT token FROM postings WHERE id = 1 AND token NOT IN ('https', 'example', 'p0'))) =
  (SELECT count(*) FROM postings WHERE id = 1 AND token NOT IN ('https', 'example', 'p0'))""")
def search_and(d: Catalog) -> DataFrame:
    return Q.search_links(d.links, _words(d), None).select("id", "title")


@catalog("""SELECT l.id FROM links l WHERE (SELECT count(*) FROM postings p WHERE p.id = l.id AND p.token IN (SELECT token FROM postings WHERE id = 1 AND token NOT IN ('https', 'example', 'p0'))) =
  (SELECT count(*) FROM postings WHERE id = 1 AND token NOT IN ('https', 'example', 'p0'))""")
def search_postings(d: Catalog) -> DataFrame:
    return Q.search_postings(Q.postings(d.links, Q.LINK_FIELDS), _words(d))


@catalog("""SELECT l.id FROM links l WHERE (SELECT count(*) FROM postings p WHERE p.id = l.id AND p.token IN (SELECT token FROM postings WHERE id = 1 AND token NOT IN ('https', 'example', 'p0'))) =
  (SELECT count(*) FROM postings WHERE id = 1 AND token NOT IN ('https', 'example', 'p0'))""")
def search_stored(d: Catalog) -> DataFrame:
    path = Q.write_postings(Q.postings(d.links, Q.LINK_FIELDS), new_path(d.spark, "postings"))
    return Q.search_stored(d.spark, path, _words(d))


@geo("""SELECT title, count(*) AS n FROM links WHERE title LIKE '%URGENT%' GROUP BY title""")
def search_urgent(d: Geo) -> DataFrame:
    return Q.search(d.links, "urgent", Q.LINK_FIELDS, None).groupBy("title").agg(F.count("*").alias("n"))


@catalog("""SELECT id, 0::INT AS match_field FROM links WHERE id IN (SELECT id FROM postings WHERE token = 'p7') AND title LIKE '%p7%' UNION ALL
  SELECT id, 1 FROM links WHERE id IN (SELECT id FROM postings WHERE token = 'p7') AND title NOT LIKE '%p7%'""")
def search_match_field(d: Catalog) -> DataFrame:
    return Q.search_links(d.links, "P7").select("id", "match_field")

@catalog("""SELECT id FROM links WHERE false""")
def search_miss(d: Catalog) -> DataFrame:
    return Q.search_links(d.links, "nonexistent").select("id")

@geo("""SELECT id, name FROM cats WHERE name = 'Top'""")
def search_categories(d: Geo) -> DataFrame:
    return Q.search_categories(d.cats, "top", None).select("id", "name")

@geo("""SELECT * FROM direct""")
def direct_counts(d: Geo) -> DataFrame:
    return R.direct_counts(d.cats, d.links)

@geo("""SELECT * FROM counts""")
def subtree_counts(d: Geo) -> DataFrame:
    return R.subtree_counts(d.cats, d.links, d.tree)

@geo("""SELECT count(*) FILTER (status = 0) AS pending, count(*) FILTER (status = 1) AS approved, count(*) FILTER (status = 2) AS rejected FROM links""")
def status_counts(d: Geo) -> DataFrame:
    return R.status_counts(d.links)

@geo("""SELECT status, count(*) AS n FROM links GROUP BY status""")
def dashboard_counts(d: Geo) -> DataFrame:
    return R.dashboard_counts(d.links)

@geo("""SELECT status, least(count(*), 100) AS n FROM links GROUP BY status""")
def dashboard_capped(d: Geo) -> DataFrame:
    return R.dashboard_counts(d.links, 100)

@geo("""SELECT category_id, n, label FROM (SELECT category_id, count(*) AS n FROM links GROUP BY 1) JOIN (SELECT descendant AS category_id, string_agg(replace(name, '_', ' '), ' › ' ORDER BY depth DESC) AS label FROM up JOIN cats ON cats.id = ancestor WHERE name != 'Top' GROUP BY 1) USING (category_id) ORDER BY n DESC, label, category_id LIMIT 100""")
def category_facet(d: Geo) -> DataFrame:
    return Q.category_facet(d.links, d.cats)

@geo("""SELECT year(created_at)::INT AS year, count(*) AS n FROM links GROUP BY 1""")
def year_facet(d: Geo) -> DataFrame:
    return Q.year_facet(d.links)

@catalog("""SELECT tag, count(*) AS n FROM (SELECT trim(unnest(string_split(tags, ','))) AS tag FROM links) GROUP BY tag ORDER BY n DESC, tag LIMIT 12""")
def tag_chips(d: Catalog) -> DataFrame:
    return Q.tag_chips(d.links)


@catalog("""SELECT id, tags FROM links WHERE list_contains(string_split(lower(tags), ','), (SELECT lower(min(p_brand)) FROM part))""")
def tag_filter(d: Catalog) -> DataFrame:
    brand = d.links.agg(F.min(F.element_at(X.parse_tags(F.col("tags")), -1)).alias("b")).first().b
    return d.links.filter(X.has_tag(F.col("tags"), brand.upper())).select("id", "tags")

@geo("""SELECT id, category_id FROM links WHERE year(created_at) = 1996""")
def year_filter(d: Geo) -> DataFrame:
    return d.links.filter(F.year("created_at") == 1996).select("id", "category_id")

@geo("""SELECT row_number() OVER (ORDER BY created_at DESC, id) AS rank, id FROM links WHERE category_id = 1002""")
def sort_recent(d: Geo) -> DataFrame:
    return L.links_of(d.links, 1002).orderBy(*L.recent_first()).withColumn("rank", F.row_number().over(Window.orderBy(*L.recent_first())).cast("long")).select("rank", "id")

@catalog("""SELECT category_id, row_number() OVER (PARTITION BY category_id ORDER BY lower(title), id) AS rank, id FROM links""")
def sort_az(d: Catalog) -> DataFrame:
    return d.links.withColumn("rank", F.row_number().over(Window.partitionBy("category_id").orderBy(*L.by_title())).cast("long")).select("category_id", "rank", "id")

@geo("""SELECT l.id, name AS category_name, link_count_subtree AS category_links FROM links l JOIN cats c ON c.id = l.category_id JOIN counts n ON n.id = c.id""")
def enrich_links(d: Geo) -> DataFrame:
    return L.enrich(d.links, lenses.counted(d.cats, d.links)).select("id", "category_name", "category_links")

@geo("""SELECT l.id, path FROM links l LEFT JOIN paths p ON p.id = l.category_id""")
def enrich_breadcrumbs(d: Geo) -> DataFrame:
    return d.links.join(H.slug_paths(d.cats).withColumnRenamed("id", "category_id"), "category_id", "left").select("id", "path")

@geo("""SELECT id FROM links WHERE category_id = 1003 AND id != (SELECT min(id) FROM links WHERE category_id = 1003) ORDER BY id LIMIT 3""")
def adjacent_links(d: Geo) -> DataFrame:
    return L.adjacent(d.links, d.links.filter("category_id = 1003").agg(F.min("id").alias("m")).first().m or 0, 1003).select("id")

@geo("""SELECT id, category_id FROM links WHERE category_id IN (SELECT descendant FROM up WHERE ancestor = 100)""")
def direct_or_subtree(d: Geo) -> DataFrame:
    return L.direct_or_subtree(d.links, d.tree, 100).select("id", "category_id")


def dup_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lenses.text_links(lenses.Tables(spark, sf_dir))
    return rows.groupBy("url").agg(F.count("*").alias("n"), F.min("id").alias("first_id")).filter("n > 1")


_QUERIES["dup_urls"] = dup_urls
_SQL["dup_urls"] = "SELECT sha256(text) AS url, count(*) AS n, min(doc_id + 1)::BIGINT AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1"


def host_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet").groupBy(X.safe_hostname(F.col("url")).alias("host")).agg(F.count("*").alias("n"))


_QUERIES["host_counts"] = host_counts
_SQL["host_counts"] = "SELECT regexp_extract(url, '://([^/?#]*)', 1) AS host, count(*) AS n FROM pages GROUP BY 1"


def _bulk_items(d: Geo) -> DataFrame:
    """Every link again under a new url for odd ids, under its own for even ones, and an unknown category for multiples of 10."""
    odd = F.col("id") % 2 == 1
    category = F.when(F.col("id") % 10 == 0, F.lit(999999)).otherwise(F.col("category_id")).cast("long")
    return d.links.select(F.col("id").alias("pos"), category.alias("category_id"), F.when(odd, F.concat(F.lit("https://n"), F.col("id").cast("string"))).otherwise(F.col("url")).alias("url"), "title", "description")


@geo("""SELECT count(*) FILTER (id % 2 = 1) AS inserted, count(*) FILTER (id % 2 = 0 AND id % 10 != 0) AS duplicates, count(*) FILTER (id % 10 = 0) AS errors,
  (max(id) + 1)::BIGINT AS first_id, (max(id) + count(*) FILTER (id % 2 = 1))::BIGINT AS last_id FROM links""")
def bulk_import_tally(d: Geo) -> DataFrame:
    return M.bulk_tally(M.create_links(d.links, d.cats, _bulk_items(d)))


@geo("""SELECT CASE WHEN id % 10 = 0 THEN 'category_not_found' WHEN id % 2 = 1 THEN 'ok' ELSE 'duplicate_url' END AS status, count(*) AS n FROM links GROUP BY 1""")
def create_link_codes(d: Geo) -> DataFrame:
    return M.create_links(d.links, d.cats, _bulk_items(d), status=0).items.groupBy("status").agg(F.count("*").alias("n"))


@geo("""SELECT CASE WHEN id % 2 = 0 THEN 'parent_not_found' ELSE 'ok' END AS status, count(*) AS n FROM cats GROUP BY 1""")
def create_category_codes(d: Geo) -> DataFrame:
    parent = F.when(F.col("id") % 2 == 0, F.lit(999999)).otherwise(F.col("id")).cast("long")
    items = d.cats.select(F.col("id").alias("pos"), parent.alias("parent_id"), "name", "slug", "description")
    return M.create_categories(d.cats, items).items.groupBy("status").agg(F.count("*").alias("n"))


@geo("""SELECT pos, v.id, CASE WHEN l.id IS NULL THEN 'not_found' WHEN status = 1 THEN 'already_in_state' ELSE 'ok' END AS status
  FROM (SELECT unnest(range(0, 60)) AS pos, unnest(range(1, 61)) AS id UNION ALL SELECT 60, 99999999) v LEFT JOIN links l ON l.id = v.id""")
def bulk_status_codes(d: Geo) -> DataFrame:
    return M.set_status(d.links, [*range(1, 61), 99999999], 1).items.select(F.col("pos").cast("long").alias("pos"), "id", "status")


@geo("""SELECT pos, v.id, CASE WHEN l.id IS NULL OR rn > 1 THEN 'not_found' ELSE 'ok' END AS status
  FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS rn FROM (VALUES (0, 5), (1, 6), (2, 5), (3, 99999999)) t(pos, id)) v LEFT JOIN links l ON l.id = v.id""")
def bulk_delete_codes(d: Geo) -> DataFrame:
    return M.delete_links(d.links, [5, 6, 5, 99999999]).items


@geo("""SELECT status, count(*) AS n FROM links WHERE id NOT IN (5, 6) GROUP BY status""")
def delete_links(d: Geo) -> DataFrame:
    return M.delete_links(d.links, [5, 6, 5, 99999999]).table.groupBy("status").agg(F.count("*").alias("n"))


@geo("""SELECT CASE WHEN id IN (5, 6) THEN 1004 ELSE category_id END::BIGINT AS category_id, count(*) AS n FROM links GROUP BY 1""")
def move_links(d: Geo) -> DataFrame:
    return M.move_links(d.links, d.cats, [5, 6], 1004).table.groupBy("category_id").agg(F.count("*").alias("n"))


@geo("""SELECT id, CASE WHEN id = 7 THEN 'New title' ELSE title END AS title FROM links""")
def update_link(d: Geo) -> DataFrame:
    return M.update_text(d.links, 7, "link", title="New title").table.select("id", "title")


@geo(""", moved AS (SELECT id, CASE WHEN id = 100 THEN 14 ELSE parent_id END AS parent_id FROM cats),
  up2 AS (SELECT id AS descendant, id AS ancestor FROM moved UNION ALL SELECT u.descendant, c.parent_id FROM up2 u JOIN moved c ON c.id = u.ancestor WHERE c.parent_id != 0)
  SELECT ancestor AS id, sum(link_count)::BIGINT AS link_count_subtree FROM up2 JOIN direct ON direct.id = descendant GROUP BY ancestor""")
def move_category_counts(d: Geo) -> DataFrame:
    return R.subtree_counts(M.move_category(d.cats, 100, 14), d.links).select("id", "link_count_subtree")


@geo("""SELECT id, CASE WHEN path = 'top/asia' OR path LIKE 'top/asia/%' THEN 'top/east' || substr(path, 9) ELSE path END AS path FROM paths""")
def rename_paths(d: Geo) -> DataFrame:
    return H.renamed_paths(H.slug_paths(d.cats), "top/asia", "top/east")


@geo("""SELECT id, CASE WHEN path = 'top/asia' OR path LIKE 'top/asia/%' THEN 'top/east' || substr(path, 9) ELSE path END AS path FROM paths""")
def repair_queue(d: Geo) -> DataFrame:
    """Asia is renamed, and a category that is gone is in the queue too; the stored paths are repaired in chunks of seven."""
    queue = repair.enqueue(d.spark.createDataFrame([], S.REPAIR_TASK), 12, repair.RENAMED, "top/asia", 0)
    queue = repair.enqueue(queue, 999999, repair.MOVED, "top/gone", 0)
    renamed = M.update_category(d.cats, 12, slug="east").table
    return repair.tick(H.slug_paths(d.cats, d.tree), renamed, queue, d.tree, size=7)[0]


@geo("""SELECT seq::BIGINT AS seq, op, chunk, n FROM (SELECT 1 AS seq, 20 AS op, (rn // 7)::BIGINT AS chunk, count(*) AS n FROM (SELECT row_number() OVER (ORDER BY descendant) - 1 AS rn FROM up WHERE ancestor = 12) GROUP BY 3 UNION ALL SELECT 1, 21, NULL, 0)""")
def repair_effects(d: Geo) -> DataFrame:
    queue = repair.enqueue(d.spark.createDataFrame([], S.REPAIR_TASK), 12, repair.RENAMED, "top/asia", 0)
    return repair.tick(H.slug_paths(d.cats, d.tree), M.update_category(d.cats, 12, slug="east").table, queue, d.tree, size=7)[2]


@geo("""SELECT id, CASE WHEN id = 100 THEN 'Renamed' ELSE name END AS name, CASE WHEN id = 100 OR path LIKE (SELECT path FROM paths WHERE id = 100) || '/%' THEN replace(path, '/' || (SELECT slug FROM cats WHERE id = 100), '/renamed') ELSE path END AS path FROM cats JOIN paths USING (id)""")
def update_category(d: Geo) -> DataFrame:
    changed = M.update_category(d.cats, 100, name="Renamed", slug="renamed").table
    return changed.select("id", "name").join(H.slug_paths(changed, d.tree), "id")


@geo("""SELECT descendant AS parent_id, ancestor = 10 AS is_cycle FROM up WHERE ancestor = 10 UNION SELECT id, false FROM cats WHERE id NOT IN (SELECT descendant FROM up WHERE ancestor = 10)""")
def move_cycle_check(d: Geo) -> DataFrame:
    below = d.tree.filter("ancestor = 10").select(F.col("descendant").alias("id"), F.lit(True).alias("below"))
    return d.cats.join(below, "id", "left").select(F.col("id").alias("parent_id"), F.coalesce("below", F.lit(False)).alias("is_cycle"))


@geo("""SELECT 'categories' AS what, count(*) AS n FROM cats WHERE id != 1000 UNION ALL SELECT 'links', count(*) FROM links WHERE category_id != 1000""")
def delete_category(d: Geo) -> DataFrame:
    return V.stats(*M.delete_category(d.cats, d.links, 1000))


@geo("""SELECT id, parent_id FROM cats WHERE parent_id = 12""")
def orphans(d: Geo) -> DataFrame:
    return V.orphans(d.cats.filter("id != 12"))


@geo("""SELECT count(*) AS roots, count(*) = 1 AS ok FROM cats WHERE parent_id = 0""")
def single_top(d: Geo) -> DataFrame:
    return d.cats.filter("parent_id = 0").agg(F.count("*").alias("roots")).withColumn("ok", F.col("roots") == 1)


@geo("""SELECT 'cat_by_parent' AS name, count(*) AS observed, count(*) AS expected, true AS ok FROM cats UNION ALL SELECT 'link_by_category', count(*), count(*), true FROM links
  UNION ALL SELECT 'link_by_url_hash', count(DISTINCT url), count(*), count(DISTINCT url) = count(*) FROM links UNION ALL SELECT 'subtree_counts', 0, 0, true
  UNION ALL SELECT 'no_orphans', 0, 0, true UNION ALL SELECT 'single_top', count(*), 1, count(*) = 1 FROM cats WHERE parent_id = 0""")
def index_health(d: Geo) -> DataFrame:
    tree = d.tree
    return V.index_health(lenses.counted(d.cats, d.links, tree), d.links, tree)


def _broken(d: Geo) -> tuple[DataFrame, DataFrame]:
    """Categories without 12, of which 100 is a second root and 10 stands there twice; links of which a hundredth share a
    url and a fiftieth have no category; counts as they were before."""
    cats = lenses.counted(d.cats, d.links, d.tree).filter("id != 12").withColumn("parent_id", F.when(F.col("id") == 100, 0).otherwise(F.col("parent_id")).cast("long"))
    lost = d.links.withColumns({"url": F.when(F.col("id") % 100 == 0, "https://same").otherwise(F.col("url")), "category_id": F.when(F.col("id") % 50 == 1, None).otherwise(F.col("category_id"))})
    return cats.union(cats.filter("id = 10")), lost


@geo(""", kept AS (SELECT id, CASE WHEN id = 100 THEN 0 ELSE parent_id END AS parent_id FROM cats WHERE id != 12),
  lost AS (SELECT id, CASE WHEN id % 100 = 0 THEN 'https://same' ELSE url END AS url, CASE WHEN id % 50 = 1 THEN NULL ELSE category_id END AS category_id FROM links),
  up2 AS (SELECT id AS descendant, id AS ancestor FROM kept UNION ALL SELECT u.descendant, c.parent_id FROM up2 u JOIN kept c ON c.id = u.ancestor WHERE c.parent_id NOT IN (0, 12)),
  fresh AS (SELECT ancestor AS id, sum(n) AS actual FROM up2 JOIN (SELECT k.id, count(l.id) AS n FROM kept k LEFT JOIN lost l ON l.category_id = k.id GROUP BY k.id) o ON o.id = descendant GROUP BY ancestor),
  off AS (SELECT count(*) AS n FROM (SELECT id FROM kept UNION ALL SELECT 10) k JOIN fresh USING (id) JOIN counts c USING (id) WHERE CASE WHEN actual = 0 THEN link_count_subtree != 0 ELSE abs(link_count_subtree - actual) * 10000 // actual > 0 END)
  SELECT *, observed = expected AS ok FROM (SELECT 'cat_by_parent' AS name, count(*)::BIGINT AS observed, (count(*) + 1)::BIGINT AS expected FROM kept UNION ALL SELECT 'single_top', count(*), 1 FROM kept WHERE parent_id = 0
    UNION ALL SELECT 'link_by_category', count(category_id), count(*) FROM lost UNION ALL SELECT 'link_by_url_hash', count(DISTINCT url), count(*) FROM lost
    UNION ALL SELECT 'subtree_counts', n, 0 FROM off UNION ALL SELECT 'no_orphans', count(*), 0 FROM kept WHERE parent_id = 12)""")
def index_health_broken(d: Geo) -> DataFrame:
    cats, lost = _broken(d)
    return V.index_health(cats, lost)


@geo("""SELECT 'slug_paths' AS name, (count(*) - 5)::BIGINT AS observed, count(*) AS expected, false AS ok FROM cats UNION ALL SELECT 'category_tokens', 0, 1, false UNION ALL SELECT 'link_tokens', 1, 1, true""")
def index_coverage(d: Geo) -> DataFrame:
    """Stored paths without the regions', category tokens lost, link tokens there."""
    paths = H.slug_paths(d.cats, d.tree).filter("id not between 10 and 14")
    return V.coverage(d.cats, d.links, paths, Q.postings(d.cats, Q.CATEGORY_FIELDS).limit(0), Q.postings(d.links, Q.LINK_FIELDS))


@geo("""SELECT id, (link_count_subtree + id % 3)::BIGINT AS stored, link_count_subtree AS actual,
  CASE WHEN link_count_subtree = 0 THEN CASE WHEN id % 3 = 0 THEN 0 ELSE 4294967295 END ELSE (id % 3) * 10000 // link_count_subtree END::BIGINT AS drift FROM counts""")
def count_drift(d: Geo) -> DataFrame:
    tree = d.tree
    off = lenses.counted(d.cats, d.links, tree).withColumn("link_count_subtree", F.col("link_count_subtree") + F.col("id") % 3)
    return V.count_drift(off, d.links, tree)


@geo("""SELECT id, link_count, child_count, link_count_subtree, child_count_subtree FROM counts WHERE id % 2 = 1""")
def recount(d: Geo) -> DataFrame:
    tree = d.tree
    off = lenses.counted(d.cats, d.links, tree).withColumn("link_count", F.col("link_count") + F.col("id") % 2)
    return R.changed_counts(off, d.links, tree).select("id", *R.COUNTS)


@geo("""SELECT id, link_count, child_count, link_count_subtree, child_count_subtree FROM counts""")
def incremental_counts(d: Geo) -> DataFrame:
    """Counts without the rejected links, then those as deltas: the full counts again."""
    tree = d.tree
    before = R.subtree_counts(d.cats, d.links.filter("status != 2"), tree)
    deltas = d.links.filter("status = 2").groupBy("category_id").agg(F.count("*").alias("links")).withColumn("children", F.lit(0))
    return R.apply_deltas(before, deltas, tree)


@geo("""SELECT 'categories' AS what, count(*) AS n FROM cats UNION ALL SELECT 'links', count(*) FROM links""")
def stats(d: Geo) -> DataFrame:
    return V.stats(d.cats, d.links)


@geo("""SELECT 'closure' AS name, count(*) AS n FROM up UNION ALL SELECT 'paths', count(*) FROM paths UNION ALL SELECT 'slug_only', count(DISTINCT slug) FROM cats UNION ALL SELECT 'counts', count(*) FROM counts
  UNION ALL SELECT 'link_postings', sum(n)::BIGINT FROM (SELECT len(list_distinct(list_filter(regexp_extract_all(lower(title || ' ' || url), '[a-z0-9]+'), lambda t: length(t) BETWEEN 2 AND 64))) AS n FROM links)
  UNION ALL SELECT 'category_postings', sum(n)::BIGINT FROM (SELECT len(list_distinct(list_filter(regexp_extract_all(lower(name || ' ' || slug), '[a-z0-9]+'), lambda t: length(t) BETWEEN 2 AND 64))) AS n FROM cats)""")
def rebuild_index(d: Geo) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in V.rebuild(d.cats, d.links).items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


def _link_effects(d: Geo) -> DataFrame:
    """Every link inserted; of multiples of 3 the title changed, of 5 the category, of 7 deleted; each effect twice."""
    links = d.links.select("id", "category_id", "url", "title", "status")
    titled = F.when(F.col("id") % 3 == 0, F.lower("title")).otherwise(F.col("title"))
    steps = [("link_inserted", links), ("link_text_updated", links.filter("id % 3 = 0").withColumn("title", F.lower("title"))), ("link_recategorized", links.filter("id % 5 = 0").withColumns({"title": titled, "category_id": F.lit(1004).cast("long")})), ("link_deleted", links.filter("id % 7 = 0"))]
    parts = [rows.select((F.col("id") * 4 + k).alias("seq"), F.lit(effects.LINK_OPS[op]).alias("op"), F.struct(*links.columns).alias("record")) for k, (op, rows) in enumerate(steps)]
    log = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    return log.unionByName(log)


_LINK_EFFECTS_SQL = """SELECT id, CASE WHEN id % 5 = 0 THEN 1004 ELSE category_id END::BIGINT AS category_id, url, CASE WHEN id % 3 = 0 THEN lower(title) ELSE title END AS title, status FROM links WHERE id % 7 != 0"""


@geo(_LINK_EFFECTS_SQL)
def effects_links(d: Geo) -> DataFrame:
    return effects.apply_effects(d.links.select("id", "category_id", "url", "title", "status").limit(0), _link_effects(d), "link")


def _category_effects(d: Geo) -> DataFrame:
    """Regions renamed, nation 100 moved to region 14, every fourth leaf deleted."""
    steps = [("category_renamed", d.cats.filter("id between 10 and 99").withColumn("slug", F.concat("slug", F.lit("-x")))), ("category_moved", d.cats.filter("id = 100").withColumn("parent_id", F.lit(14).cast("long"))), ("category_deleted", d.cats.filter("id >= 1000 and id % 4 = 0"))]
    parts = [rows.select((F.col("id") * 4 + k).alias("seq"), F.lit(effects.CATEGORY_OPS[op]).alias("op"), F.struct(*d.cats.columns).alias("record")) for k, (op, rows) in enumerate(steps)]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_AFTER_SQL = """, after AS (SELECT id, CASE WHEN id = 100 THEN 14 ELSE parent_id END::BIGINT AS parent_id, CASE WHEN id BETWEEN 10 AND 99 THEN slug || '-x' ELSE slug END AS slug FROM cats WHERE NOT (id >= 1000 AND id % 4 = 0)),
  up2 AS (SELECT id AS descendant, id AS ancestor, 0 AS depth FROM after UNION ALL SELECT u.descendant, c.parent_id, u.depth + 1 FROM up2 u JOIN after c ON c.id = u.ancestor WHERE c.parent_id != 0)
"""


@geo(_AFTER_SQL + """SELECT descendant AS id, string_agg(slug, '/' ORDER BY depth DESC) AS path FROM up2 JOIN after ON after.id = ancestor GROUP BY descendant""")
def effects_category_paths(d: Geo) -> DataFrame:
    return H.slug_paths(effects.apply_effects(d.cats, _category_effects(d), "category"))


@geo(f""", later AS ({_LINK_EFFECTS_SQL}), own AS (SELECT c.id, (SELECT count(*) FROM later WHERE category_id = c.id) AS n FROM cats c)
  SELECT ancestor AS id, sum(n)::BIGINT AS link_count_subtree FROM up JOIN own ON own.id = descendant GROUP BY ancestor""")
def effects_counts(d: Geo) -> DataFrame:
    """The counts before the log, and what differs after it as deltas."""
    tree, before = d.tree, d.links.select("id", "category_id", "url", "title", "status")
    after = effects.apply_effects(before, _link_effects(d), "link")
    return R.apply_deltas(R.subtree_counts(d.cats, d.links, tree), effects.deltas((before, after), (d.cats, d.cats)), tree).select("id", "link_count_subtree")


@geo("""SELECT pos::INT AS pos, id::BIGINT AS id, status, code, sub_code FROM (VALUES (0, 100, 'has_children', 6, 0), (1, 1000, 'ok', 0, 0), (2, 999999, 'not_found', 1, 0), (3, 1000, 'not_found', 1, 0)) t(pos, id, status, code, sub_code)""")
def bulk_delete_category_codes(d: Geo) -> DataFrame:
    return M.with_codes(M.delete_categories(d.cats, d.links, [100, 1000, 999999, 1000])[2])


@geo("""SELECT status AS status, count(*) AS n FROM (SELECT status FROM links UNION ALL SELECT 0 FROM links WHERE id % 2 = 1 AND id % 10 != 0) GROUP BY 1""")
def create_submissions(d: Geo) -> DataFrame:
    items = _bulk_items(d).withColumn("submitter_id", F.lit(7).cast("long"))
    return M.create_submissions(d.links, d.cats, items).table.groupBy("status").agg(F.count("*").alias("n"))


def _mutated(d: Geo) -> tuple[DataFrame, DataFrame]:
    """Links before and after some mutations: rejected ones deleted, a category's moved, one renamed and moved."""
    before = d.links.select("id", "category_id", "url", "title", "status")
    after = before.filter("status != 2").withColumn("category_id", F.when(F.col("category_id") == 1000, F.lit(1004).cast("long")).otherwise(F.col("category_id")))
    return before, after.withColumn("title", F.when(F.col("category_id") == 1004, "moved").otherwise(F.col("title")))


_MUTATED_SQL = """, before AS (SELECT id, category_id, url, title, status FROM links),
  after AS (SELECT id, CASE WHEN category_id = 1000 THEN 1004 ELSE category_id END::BIGINT AS category_id, url, CASE WHEN category_id IN (1000, 1004) THEN 'moved' ELSE title END AS title, status FROM before WHERE status != 2)"""


@geo(_MUTATED_SQL + """ SELECT op::INT AS op, count(*) AS n, count(*) AS seqs FROM (SELECT 2 AS op FROM before WHERE status = 2 UNION ALL SELECT 4 FROM before JOIN after USING (id) WHERE before.category_id != after.category_id
  UNION ALL SELECT 3 FROM before JOIN after USING (id) WHERE before.title != after.title) GROUP BY op""")
def mutation_effects(d: Geo) -> DataFrame:
    return effects.between(*_mutated(d), "link").groupBy("op").agg(F.count("*").alias("n"), F.count_distinct("seq").alias("seqs"))


@geo(_MUTATED_SQL + " SELECT * FROM after")
def mutation_replay(d: Geo) -> DataFrame:
    before, after = _mutated(d)
    return effects.apply_effects(before, effects.between(before, after, "link"), "link")


def changelog_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    return changelog.replay(lenses.change_log(lenses.Tables(spark, sf_dir)))


_QUERIES["changelog_replay"] = changelog_replay
_SQL["changelog_replay"] = """SELECT (user_id + 1)::BIGINT AS link_id, max(event_id)::BIGINT AS last_seq,
  arg_max(CASE event_type WHEN 'signup' THEN 'insert' WHEN 'view' THEN 'text_update' WHEN 'click' THEN 'recategorize' WHEN 'purchase' THEN 'approve' WHEN 'error' THEN 'delete' END, event_id) AS last_op, count(*) AS changes FROM events GROUP BY 1"""


def op_latency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' values as latencies: exact maximum, mean and samples; percentiles are approximate."""
    samples = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("op"), F.col("value").alias("us"))
    return R.latency(samples)


_QUERIES["op_latency"] = op_latency
