"""Frequent, closed and maximal itemsets.

All frequent sets come from Spark's parallel FP-growth. Closed and maximal sets
follow with one equi-join on the sets' immediate subsets: a set is not maximal iff
it lacks one item of a frequent set, and not closed iff it does so at equal support
(support only falls as sets grow, so what holds for some superset holds for one
with a single item more). Sets meet by their sorted arrays of items, never by their
text, so items may hold any character.

Where baskets are dense, all frequent sets can be too many; `dense` finds closed
and maximal sets without them.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from coterie.functions.itemsets import text, without_one
from coterie.functions.session import shared_folder
from coterie.operators.counting import checked

MODES = ("frequent", "closed", "maximal")
EMPTY = "items array<string>, itemset string, len int, support bigint"


def frequent_itemsets(bk: DataFrame, count: int, partitions: int | None = None) -> DataFrame:
    """(items, itemset, len, support) of all sets in `count` baskets or more; none if no item is.

    The sets are mined once and written to the checkpoint folder, as closed and maximal
    sets read them twice; the baskets' cache is given back then.
    """
    spark = bk.sparkSession
    shared_folder(spark)
    held = bk.select(F.transform("items", lambda x: x.cast("string")).alias("items")).persist(StorageLevel.MEMORY_AND_DISK)
    n = held.count()
    if n == 0 or checked(count) > n:
        held.unpersist()
        return spark.createDataFrame([], EMPTY)
    # half a basket less: a share that no rounding turns into another count
    miner = FPGrowth(itemsCol="items", minSupport=(count - 0.5) / n, numPartitions=partitions or max(1, held.rdd.getNumPartitions()))
    found = miner.fit(held).freqItemsets
    sets = found.select(F.array_sort("items").alias("items"), F.col("freq").alias("support")).checkpoint()
    held.unpersist()
    return sets.select("items", text(F.col("items")).alias("itemset"), F.size("items").alias("len"), "support")


def subset_support(fi: DataFrame) -> DataFrame:
    """(items, above): for each immediate subset of a frequent set, the largest support of such a set."""
    larger = fi.where(F.col("len") > 1).select(F.explode(without_one(F.col("items"))).alias("items"), "support")
    return larger.groupBy("items").agg(F.max("support").alias("above"))


def closed(fi: DataFrame) -> DataFrame:
    met = fi.join(subset_support(fi), "items", "left")
    return met.where(F.col("above").isNull() | (F.col("above") < F.col("support"))).select("items", "itemset", "len", "support")


def maximal(fi: DataFrame) -> DataFrame:
    return fi.join(subset_support(fi).select("items"), "items", "left_anti").select("items", "itemset", "len", "support")


def empty_set(fi: DataFrame, n: int, mode: str) -> DataFrame:
    """The empty set's row: for frequent sets if there are any; for closed ones if no item is in every basket."""
    top = fi.agg(F.max("support").alias("top")).where(F.col("top").isNotNull())
    if mode == "closed":
        top = top.where(F.col("top") != n)
    elif mode == "maximal":
        top = top.where(F.lit(False))
    return top.select(F.array().cast("array<string>").alias("items"), F.lit("").alias("itemset"), F.lit(0).alias("len"), F.lit(n).cast("long").alias("support"))


def mine(bk: DataFrame, count: int, mode: str = "frequent", with_empty: bool = False) -> DataFrame:
    """(items, itemset, len, support) of the mode's sets."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}")
    fi = frequent_itemsets(bk, count)
    out = {"frequent": lambda x: x, "closed": closed, "maximal": maximal}[mode](fi)
    return out.unionByName(empty_set(fi, bk.count(), mode)) if with_empty else out


def subsumed(sets: DataFrame, by: DataFrame, same_support: bool = False) -> DataFrame:
    """Rows of sets that are a subset of some row of `by` (with at least their support, if asked).

    An equi-join on each set's rarest item in `by`, so that only sets that share it are
    compared. The empty set is a subset of anything.
    """
    spread = by.select(F.explode("items").alias("item"), F.col("items").alias("larger"), F.col("support").alias("larger_support"))
    often = spread.groupBy("item").agg(F.count(F.lit(1)).alias("often"))
    rare = sets.select("items", F.explode("items").alias("item")).join(often, "item", "left")
    pick = rare.groupBy("items").agg(F.min(F.struct(F.coalesce("often", F.lit(0)).alias("often"), "item")).alias("p")).select("items", F.col("p.item").alias("item"))
    inside = (F.size(F.array_except("items", "larger")) == 0) & (F.lit(not same_support) | (F.col("larger_support") >= F.col("support")))
    hit = sets.join(pick, "items").join(spread, "item").where(inside).select("items").distinct()
    return sets.where(F.size("items") > 0).join(hit, "items", "left_semi").select(*sets.columns).unionByName(sets.where(F.size("items") == 0))


def rows_of(sets: DataFrame) -> DataFrame:
    return sets.select("itemset", "len", "support")


__all__ = ["MODES", "closed", "empty_set", "frequent_itemsets", "maximal", "mine", "rows_of", "subset_support", "subsumed"]
