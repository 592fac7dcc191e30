"""Token search and facets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arbora import schema as S
from arbora.functions import text as X
from arbora.operators.hierarchy import breadcrumb_table

LINK_FIELDS, CATEGORY_FIELDS = ("title", "url", "description"), ("name", "slug", "description")


def postings(table: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """(token, id), each pair once: a row's tokens are made distinct before they are exploded, so nothing shuffles."""
    return table.select(F.explode(X.tokens(*map(F.col, fields))).alias("token"), "id")


def search(table: DataFrame, query: str, fields: tuple[str, ...], limit: int | None = S.SEARCH_CAP) -> DataFrame:
    """Rows that have all tokens of the query, by id; none for a query without tokens. Exact tokens, no ranking.

    The tokens are tested in the scan, so a search is one pass without a shuffle up to the page's top-k.
    """
    wanted = X.query_tokens(query)
    if not wanted:
        return table.limit(0)
    have = X.tokens(*map(F.col, fields))
    rows = table.filter(F.size(F.array_except(F.array(*map(F.lit, wanted)), have)) == 0).orderBy("id")
    return rows if limit is None else rows.limit(min(limit, S.SEARCH_CAP))


def search_postings(index: DataFrame, query: str) -> DataFrame:
    """Ids by a prebuilt (token, id) table: one equality for each token, pushed to the scan."""
    wanted = X.query_tokens(query)
    if not wanted:
        return index.select("id").limit(0)
    return index.filter(F.col("token").isin(wanted)).groupBy("id").agg(F.count_distinct("token").alias("n")).filter(F.col("n") == len(wanted)).select("id")


def search_links(links: DataFrame, query: str, limit: int | None = S.SEARCH_CAP) -> DataFrame:
    """Found links with ``match_field``: the first field that holds a token, 0 title, 1 url, 2 description."""
    hits = search(links, query, LINK_FIELDS, limit)
    tests = [F.when(F.contains(X.ascii_lower(F.col(f)), F.lit(t)), k) for t in X.query_tokens(query) for k, f in enumerate(LINK_FIELDS)]
    return hits.withColumn("match_field", F.coalesce(*tests, F.lit(0)))


def search_categories(categories: DataFrame, query: str, limit: int | None = S.SEARCH_CAP) -> DataFrame:
    return search(categories, query, CATEGORY_FIELDS, limit)


def search_both(links: DataFrame, categories: DataFrame, query: str, scope: int = 0, limit: int = S.SEARCH_CAP) -> dict[str, DataFrame]:
    """Scope 0 both, 1 links, 2 categories."""
    if len(query.encode()) < S.QUERY_MIN or scope not in (0, 1, 2):
        raise S.DirectoryError("invalid")
    out = {"links": search_links(links, query, limit)} if scope != 2 else {}
    return out | ({"categories": search_categories(categories, query, limit)} if scope != 1 else {})


def search_with_status(links: DataFrame, query: str, status: int | None = None, limit: int = S.SEARCH_CAP) -> DataFrame:
    """The first hits, of which those with the status are shown: the cap comes first, so fewer than ``limit`` may be left."""
    hits = search_links(links, query, limit)
    return hits if status is None else hits.filter(F.col("status") == status)


def search_with_parents(categories: DataFrame, query: str, limit: int = 20, tree: DataFrame | None = None) -> DataFrame:
    """(id, name, slug, parent_id, breadcrumb) of found categories; the breadcrumb is their parent's way from the root."""
    hits = search_categories(categories, query, limit) if len(query.strip()) >= S.QUERY_MIN else categories.limit(0)
    crumbs = breadcrumb_table(categories, tree).select(F.col("id").alias("parent_id"), F.array_join("crumbs.name", " / ").alias("breadcrumb"))
    return hits.select("id", "name", "slug", "parent_id").join(crumbs, "parent_id", "left").select("id", "name", "slug", "parent_id", F.coalesce("breadcrumb", F.lit("")).alias("breadcrumb"))


def write_postings(index: DataFrame, path: str, buckets: int = 64) -> str:
    """Stores (token, id) in folders by token hash, sorted by token: a search opens one folder for each of its tokens, and
    row groups by their bounds. A folder's rows are dealt out over tasks by token and id, so a frequent token has several files."""
    bucket = F.pmod(F.xxhash64("token"), F.lit(buckets)).cast("int")
    spread = index.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64("id"), F.lit(8)))
    spread.sortWithinPartitions("bucket", "token", "id").write.partitionBy("bucket").parquet(path)
    return path


def search_stored(spark: SparkSession, path: str, query: str, buckets: int = 64) -> DataFrame:
    """Ids by stored postings."""
    wanted = X.query_tokens(query)
    hashes = spark.range(1).select(*(F.pmod(F.xxhash64(F.lit(t)), F.lit(buckets)).cast("int") for t in wanted)).first() if wanted else []
    index = spark.read.schema("token string, id long, bucket int").parquet(path)
    return search_postings(index.filter(F.col("bucket").isin(sorted(set(hashes)))) if wanted else index, query)


def category_facet(hits: DataFrame, categories: DataFrame, cap: int = 100) -> DataFrame:
    """Hits for each category with its path label: count falling, label rising; unknown categories are left out."""
    counts = hits.groupBy("category_id").agg(F.count("*").alias("n"))
    labels = breadcrumb_table(categories).select(F.col("id").alias("category_id"), X.path_label(F.transform(F.col("crumbs.name"), X.display_name)).alias("label"))
    return counts.join(labels, "category_id").orderBy(F.desc("n"), "label", "category_id").limit(cap)


def year_facet(hits: DataFrame) -> DataFrame:
    return hits.filter("created_at is not null").groupBy(F.year("created_at").alias("year")).agg(F.count("*").alias("n")).orderBy(F.desc("year"))


def tag_chips(hits: DataFrame, cap: int = 12) -> DataFrame:
    """Counts of tags, case kept: count falling, tag rising."""
    return hits.select(F.explode(X.parse_tags(F.col("tags"))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(cap)
