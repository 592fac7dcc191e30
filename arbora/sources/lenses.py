"""Views of star-schema and document tables as a directory. Source keys start at 0, which means "none" here: 1 is added."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from arbora.operators import rollup


class Tables:
    """The tables of a folder. Each is opened once, since opening one reads its schema in a job of its own."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark = spark
        self.open = cache(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def _category(rows: DataFrame, key: str, parent: str, name: str) -> DataFrame:
    return rows.select(F.expr(key).cast("long").alias("id"), F.expr(parent).cast("long").alias("parent_id"), F.expr(name).alias("name"))


def _slugged(rows: DataFrame) -> DataFrame:
    return rows.select("*", F.lower(F.replace("name", F.lit(" "), F.lit("-"))).alias("slug"), F.lit("").alias("description"))


def _segments(tables: Tables) -> DataFrame:
    names = tables.open("customer").select("c_mktsegment").distinct()
    return names.select("c_mktsegment", (F.dense_rank().over(Window.orderBy("c_mktsegment")) - 1).alias("seg"))


def geo_categories(tables: Tables) -> DataFrame:
    """Top, regions, nations, market segments."""
    top = _category(tables.spark.range(1), "1", "0", "'Top'")
    regions = _category(tables.open("region"), "10 + r_regionkey", "1", "r_name")
    nations = _category(tables.open("nation"), "100 + n_nationkey", "10 + n_regionkey", "n_name")
    leaves = tables.open("customer").select("c_nationkey", "c_mktsegment").distinct().join(_segments(tables), "c_mktsegment")
    return _slugged(top.union(regions).union(nations).union(_category(leaves, "1000 + 10 * c_nationkey + seg", "100 + c_nationkey", "c_mktsegment")))


def geo_links(tables: Tables) -> DataFrame:
    """Orders as links of their customer's nation and segment."""
    customers = tables.open("customer").select("c_custkey", "c_nationkey", "c_mktsegment").join(_segments(tables), "c_mktsegment")
    rows = tables.open("orders").join(customers, F.col("o_custkey") == F.col("c_custkey"))
    status = F.when(F.col("o_orderstatus") == "P", 0).when(F.col("o_orderstatus") == "F", 1).otherwise(2)
    return rows.select((F.col("o_orderkey") + 1).cast("long").alias("id"), F.expr("1000 + 10 * c_nationkey + seg").cast("long").alias("category_id"), F.concat(F.lit("https://o"), F.col("o_orderkey").cast("string"), F.lit(".example")).alias("url"), F.col("o_orderpriority").alias("title"), F.lit("").alias("description"), status.alias("status"), (F.col("o_custkey") + 1).cast("long").alias("submitter_id"), F.col("o_orderdate").alias("created_at"))


def catalog_categories(tables: Tables) -> DataFrame:
    """Top, part types, brands within a type."""
    parts = tables.open("part")
    types = parts.select("p_type").distinct().select("p_type", F.dense_rank().over(Window.orderBy("p_type")).alias("t"))
    brands = parts.select("p_type", "p_brand").distinct().join(types, "p_type").select("*", F.dense_rank().over(Window.partitionBy("p_type").orderBy("p_brand")).alias("b"))
    top = _category(tables.spark.range(1), "1", "0", "'Top'")
    return _slugged(top.union(_category(types, "10 + t", "1", "p_type")).union(_category(brands, "1000 * t + b", "10 + t", "p_brand")))


def catalog_links(tables: Tables) -> DataFrame:
    """Parts as links of their brand; tags are type and brand."""
    parts = tables.open("part")
    named = catalog_categories(tables)
    types = named.filter("parent_id = 1").select(F.col("id").alias("tid"), F.col("name").alias("p_type"))
    brands = named.filter("parent_id > 1").select(F.col("id").alias("category_id"), F.col("parent_id").alias("tid"), F.col("name").alias("p_brand"))
    rows = parts.join(types, "p_type").join(brands, ["tid", "p_brand"])
    return rows.select((F.col("p_partkey") + 1).cast("long").alias("id"), "category_id", F.concat(F.lit("https://p"), F.col("p_partkey").cast("string"), F.lit(".example")).alias("url"), F.col("p_name").alias("title"), F.lit("").alias("description"), F.concat_ws(",", "p_type", "p_brand").alias("tags"))


def text_links(tables: Tables) -> DataFrame:
    """Documents as links; equal texts have equal urls."""
    return tables.open("documents").select((F.col("doc_id") + 1).cast("long").alias("id"), F.sha2("text", 256).alias("url"), F.concat_ws("/", "lang", "source").alias("title"), F.col("text").alias("description"))


def counted(categories: DataFrame, links: DataFrame, tree: DataFrame | None = None) -> DataFrame:
    """Categories with their four counts."""
    return categories.join(rollup.subtree_counts(categories, links, tree), "id")


OPS = {"signup": "insert", "view": "text_update", "click": "recategorize", "purchase": "approve", "error": "delete"}


def change_log(tables: Tables) -> DataFrame:
    """Events as changes of the link of their user: (seq, op, link_id, ts, value)."""
    op = F.create_map(*(F.lit(x) for pair in OPS.items() for x in pair))[F.col("event_type")]
    return tables.open("events").select(F.col("event_id").cast("long").alias("seq"), op.alias("op"), (F.col("user_id") + 1).cast("long").alias("link_id"), "ts", "value")
