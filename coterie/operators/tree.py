"""The prefix tree as a table: one row a node, named by its path; conditional bases and trees; single paths.

Paths are arrays of items; their text (prefix) is for reading alone. The operators for a
tree that is one path raise where a level has two nodes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coterie.functions.itemsets import prefixes, subsets, text
from coterie.operators.counting import by_support, ranked


def prefix_tree(rows: DataFrame, items: str = "items", weight: str | None = None) -> DataFrame:
    """(path, prefix, level, count): nodes of the tree of the ordered arrays, each with its baskets' number (or weight)."""
    path = F.explode(prefixes(F.col(items).cast("array<string>"))).alias("path")
    nodes = rows.select(path, (F.col(weight) if weight else F.lit(1)).cast("long").alias("w"))
    return nodes.groupBy("path").agg(F.sum("w").alias("count")).select("path", text(F.col("path")).alias("prefix"), F.size("path").alias("level"), "count")


def tree_levels(tree: DataFrame) -> DataFrame:
    """(level, nodes, baskets)."""
    return tree.groupBy("level").agg(F.count(F.lit(1)).alias("nodes"), F.sum("count").alias("baskets"))


def upper_quarter(tree: DataFrame) -> DataFrame:
    """(nodes, upper_nodes, percent): the share of nodes in the first quarter of the levels, rounded down."""
    levels = tree_levels(tree).withColumn("deepest", F.max("level").over(Window.partitionBy()))
    upper = F.coalesce(F.sum(F.when(F.col("level") <= F.floor(F.col("deepest") * 0.25), F.col("nodes"))), F.lit(0))
    return levels.agg(F.coalesce(F.sum("nodes"), F.lit(0)).alias("nodes"), upper.alias("upper_nodes")).withColumn("percent", F.when(F.col("nodes") > 0, 100.0 * F.col("upper_nodes") / F.col("nodes")).otherwise(F.lit(0.0)))


def single_path(tree: DataFrame) -> DataFrame:
    """(single_path): whether no level has two nodes; an empty tree is one."""
    return tree_levels(tree).agg((F.coalesce(F.max("nodes"), F.lit(0)) <= 1).alias("single_path"))


def _path(tree: DataFrame) -> DataFrame:
    """(items, counts) of a tree that is one path, in one row; another tree raises.

    Nodes are counted level by level first: what meets in one row is one entry a level.
    """
    levels = tree.groupBy("level").agg(F.count(F.lit(1)).alias("nodes"), F.max(F.element_at("path", -1)).alias("item"), F.max("count").alias("count"))
    path = levels.agg(F.max("nodes").alias("nodes"), F.array_sort(F.collect_list(F.struct("level", "item", "count"))).alias("path"))
    one = F.when(F.col("nodes") > 1, F.raise_error(F.lit("the tree is not one path")).cast("array<struct<level:int,item:string,count:bigint>>")).otherwise(F.col("path"))
    return path.select(one.alias("path")).select(F.col("path.item").alias("items"), F.col("path.count").alias("counts"))


def single_path_closed(tree: DataFrame) -> DataFrame:
    """Closed sets of a tree that is one path: its prefixes where the count falls behind them, and the whole."""
    falls = lambda k: (k == F.size("counts")) | (F.get("counts", k - 1) > F.get("counts", k))
    path = _path(tree).where(F.size("items") > 0)
    rows = path.select("items", "counts", F.explode(F.filter(F.sequence(F.lit(1), F.size("items")), falls)).alias("len"))
    return rows.select(text(F.array_sort(F.slice("items", 1, F.col("len")))).alias("itemset"), "len", F.element_at("counts", F.col("len")).alias("support"))


def path_power_set(tree: DataFrame, most: int = 20) -> DataFrame:
    """All itemsets of a tree that is one path: every subset has its deepest item's count."""
    sets = _path(tree).select("items", "counts", F.explode(subsets(F.col("items"), most)).alias("own"))
    deepest = F.array_max(F.transform("own", lambda x: F.array_position("items", x)))
    return sets.select(text(F.array_sort("own")).alias("itemset"), F.size("own").alias("len"), F.element_at("counts", deepest.cast("int")).alias("support"))


def conditional_base(coded: DataFrame, item: str) -> DataFrame:
    """(path, items, weight): what stands before the item in the ordered baskets that have it, and how often."""
    has = coded.where(F.array_contains("items", item))
    before = F.slice("items", 1, (F.array_position("items", item) - 1).cast("int"))
    return has.select(before.alias("items")).groupBy("items").agg(F.count(F.lit(1)).alias("weight")).select(text(F.col("items")).alias("path"), "items", "weight")


def conditional_support(base: DataFrame, count: int) -> DataFrame:
    """(item, support): supports together with the base's item, of those that reach the count."""
    rows = base.select(F.explode("items").alias("item"), "weight")
    return rows.groupBy("item").agg(F.sum("weight").alias("support")).where(F.col("support") >= count)


def conditional_rank(base: DataFrame, count: int) -> DataFrame:
    """(item, support, rank) by conditional support, ties by item."""
    return ranked(conditional_support(base, count), *by_support())


def conditional_tree(base: DataFrame, count: int) -> DataFrame:
    """The prefix tree of the base's rows, cut to what reaches the count and ordered by conditional rank."""
    ranks = conditional_rank(base, count)
    rows = base.select("items", "weight", F.explode("items").alias("item")).join(ranks.select("item", "rank"), "item")
    ordered = rows.groupBy("items", "weight").agg(F.array_sort(F.collect_list(F.struct("rank", "item"))).alias("r")).select("weight", F.col("r.item").alias("items"))
    return prefix_tree(ordered, weight="weight")
