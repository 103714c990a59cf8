"""The baskets and objects that the registered queries run over."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.sources.transactions import baskets


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _order_parts(spark: SparkSession, sf_dir: str, column: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col(column).alias("item"))
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("tid"), "item")


def order_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's part types."""
    return baskets(_order_parts(spark, sf_dir, "p_type"))


def order_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's part brands."""
    return baskets(_order_parts(spark, sf_dir, "p_brand"))


def cust_attr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's nation, region and market segment: nations determine regions."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    met = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    tag = lambda name, column: F.concat(F.lit(f"{name}="), F.regexp_replace(column, " ", "_"))
    items = F.array_sort(F.array(tag("nation", "n_name"), tag("region", "r_name"), tag("seg", "c_mktsegment")))
    return met.select(F.col("c_custkey").alias("tid"), items.alias("items"))


def blank_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's region and segment: as two items, as one item with a blank, or with the nation beside them."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey")
    r = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    met = c.join(n, c["c_nationkey"] == n["n_nationkey"]).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    both, kind = F.concat_ws(" ", "c_mktsegment", "r_name"), F.pmod("c_custkey", F.lit(3))
    items = F.when(kind == 0, F.array("r_name", "c_mktsegment")).when(kind == 1, F.array(both)).otherwise(F.array(both, F.concat(F.lit("of "), "n_name")))
    return met.select(F.col("c_custkey").alias("tid"), F.array_sort(items).alias("items"))


def user_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's event types."""
    return baskets(table(spark, sf_dir, "events").select(F.col("user_id").alias("tid"), F.col("event_type").alias("item")))


def cust_brand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's part brands over all orders: long, dense baskets."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    met = _order_parts(spark, sf_dir, "p_brand").join(orders, F.col("tid") == F.col("o_orderkey"))
    return baskets(met.select(F.col("o_custkey").alias("tid"), "item"))


def objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as points (total price, the customer's balance) with their parts' brands as keywords."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    words = order_brand(spark, sf_dir).withColumnRenamed("items", "kw")
    met = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(words, F.col("o_orderkey") == F.col("tid"), "left")
    kw = F.coalesce("kw", F.array().cast("array<string>"))
    return met.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("x"), F.col("c_acctbal").alias("y"), kw.alias("kw"))


#: (qid, x0, y0, x1, y1, keywords)
BOXES = [
    (1, 50_000.0, 0.0, 150_000.0, 5_000.0, ["Brand#1", "Brand#2"]),
    (2, 0.0, -1_000.0, 90_000.0, 2_000.0, ["Brand#3"]),
    (3, 200_000.0, 2_500.0, 450_000.0, 9_000.0, ["Brand#4", "Brand#5"]),
]
GRID = (25_000.0, 1_000.0)
#: Of the layout by place: the plane, cells a side as a power of two, objects a leaf.
BOUNDS, DEPTH, CAPACITY = (0.0, -1_000.0, 500_000.0, 10_000.0), 6, 200


def box_queries(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BOXES, "qid long, x0 double, y0 double, x1 double, y1 double, kw array<string>")
