"""Counts over baskets: transactions, items, pairs; the item order; encoding by rank."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coterie.functions.session import shared_folder


def transaction_count(bk: DataFrame) -> DataFrame:
    """N, empty baskets included."""
    return bk.agg(F.count(F.lit(1)).alias("n"))


def min_count(n: int, p: int, q: int) -> int:
    """The smallest count that is at least p / q of n, and 1 at least: exact in whole numbers."""
    return max(1, (p * n + q - 1) // q)


def checked(count: int) -> int:
    if count < 1:
        raise ValueError("the minimum count must be 1 or more")
    return count


def items_of(bk: DataFrame) -> DataFrame:
    return bk.select("tid", F.explode("items").alias("item"))


def item_support(bk: DataFrame) -> DataFrame:
    """(item, support); baskets have no repeats, so counting rows is counting baskets."""
    return bk.select(F.explode("items").alias("item")).groupBy("item").agg(F.count(F.lit(1)).alias("support"))


def frequent_items(bk: DataFrame, count: int) -> DataFrame:
    return item_support(bk).where(F.col("support") >= checked(count))


def ranked(rows: DataFrame, *order: Column) -> DataFrame:
    """Adds rank, from 1, in the given order, by a distributed sort.

    Partitions are ranges of the order, written once so that they stay what they are; a
    row's rank is its place in its partition after the rows of the partitions before. The
    only window that runs in one task is over one count a partition.
    """
    shared_folder(rows.sparkSession)
    place = F.monotonically_increasing_id()  # the partition in the upper bits, the place in it in the lower 33
    placed = rows.orderBy(*order).select(*rows.columns, F.shiftright(place, 33).alias("_part"), place.bitwiseAND((1 << 33) - 1).alias("_place")).checkpoint()
    sizes = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_before"))
    # two numbers a partition: bounded by the number of partitions, whatever the rows are
    met = placed.join(F.broadcast(offsets), "_part")
    return met.select(*rows.columns, (F.col("_before") + F.col("_place") + 1).cast("int").alias("rank"))


def by_support() -> tuple[Column, Column]:
    return F.col("support").desc(), F.col("item").asc()


def item_rank(bk: DataFrame, count: int) -> DataFrame:
    """(item, support, rank): rank 1 is the most frequent, ties by item."""
    return ranked(frequent_items(bk, count), *by_support())


def encoded(bk: DataFrame, ranks: DataFrame) -> DataFrame:
    """(tid, ranks, items): each basket's frequent items by rank. Baskets without one are left out."""
    met = items_of(bk).join(ranks.select("item", "rank"), "item")
    rows = met.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("rank", "item"))).alias("r"))
    return rows.select("tid", F.col("r.rank").alias("ranks"), F.col("r.item").alias("items"))


def decoded(coded: DataFrame, ranks: DataFrame) -> DataFrame:
    """(tid, items) from ranks, in their order."""
    rows = coded.select("tid", F.posexplode("ranks").alias("at", "rank")).join(ranks.select("item", "rank"), "rank")
    return rows.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("at", "item"))).alias("r")).select("tid", F.col("r.item").alias("items"))


def pairs_of(items: Column) -> Column:
    """All pairs of an array's items, the earlier first: pairs come from each basket alone, without a join."""
    later = lambda x, i: F.transform(F.slice(items, i + 2, F.greatest(F.size(items) - i - 1, F.lit(0))), lambda y: F.struct(x.alias("item_a"), y.alias("item_b")))
    return F.flatten(F.transform(items, later))


def pair_support(bk: DataFrame) -> DataFrame:
    """(item_a, item_b, support) with item_a < item_b, counted with a partial sum in each task."""
    return bk.select(F.explode(pairs_of(F.col("items"))).alias("p")).groupBy("p.item_a", "p.item_b").agg(F.count(F.lit(1)).alias("support"))


def conditional_support_by_pairs(pairs: DataFrame, ranks: DataFrame, item: str, count: int) -> DataFrame:
    """(item, support) of the items ranked before `item` that reach the count together with it.

    A lookup in the table of pair supports: no basket is read again. pairs: as from
    pair_support; ranks: as from item_rank. Gives what a walk over the baskets gives.
    """
    a, b = F.col("item_a").cast("string"), F.col("item_b").cast("string")
    other = F.when(a == item, F.col("item_b")).otherwise(F.col("item_a"))
    met = pairs.where(((a == item) | (b == item)) & (F.col("support") >= checked(count))).select(other.alias("item"), F.when(a == item, a).otherwise(b).alias("_own"), "support")
    own = ranks.select(F.col("item").cast("string").alias("_own"), F.col("rank").alias("_own_rank"))
    return met.join(ranks.select("item", "rank"), "item").join(own, "_own").where(F.col("rank") < F.col("_own_rank")).select("item", "support")
