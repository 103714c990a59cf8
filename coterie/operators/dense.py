"""Closed and maximal itemsets without all frequent ones, for dense baskets.

The search walks closed sets only: from a closed set, a child adds an item after the
last one added and everything that then comes with it, and counts only if that
brings nothing from before the item, so that each closed set is met once (prefix-
preserving closure extension). A set is maximal if no further item is frequent with it.

It is spread by first items: the task of an item has all baskets with it, once each
with their number, so all its supports are exact and nothing has to be compared
across tasks. Tasks of up to `task_rows` distinct baskets are searched in one place;
larger ones take one step of the search as aggregations and split by the next item,
as often as needed, so that an item of most baskets doesn't meet in one task. Each
step is written to the checkpoint folder, which also keeps the plans short.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.functions.itemsets import text
from coterie.functions.session import shared_folder
from coterie.operators.counting import checked, item_rank

FOUND = "items array<int>, support bigint, maximal boolean"
#: Sets in a batch of what a task sends.
OUT_ROWS = 10_000


def search(rows: list[np.ndarray], weights: np.ndarray, count: int, parent: list[int], item: int) -> Iterator[tuple[list[int], int, bool]]:
    """(items, support, maximal) of the closed sets of a task: those from the child `item` of the closed set `parent` on.

    rows: baskets that hold parent and item, as arrays of positions.
    """
    names = np.unique(np.concatenate(rows))
    table = np.zeros((len(rows), len(names)), bool)
    for i, r in enumerate(rows):
        table[i, np.searchsorted(names, r)] = True
    todo = [(np.arange(len(rows)), np.isin(names, parent), int(np.searchsorted(names, item)))]
    while todo:
        own, above, at = todo.pop()
        sub = table[own]
        have = weights[own] @ sub
        support = int(weights[own].sum())
        shut = have == support
        if (shut[:at] != above[:at]).any():
            continue
        frequent = (have >= count) & ~shut
        yield names[shut].tolist(), support, not frequent.any()
        for j in np.flatnonzero(frequent)[::-1].tolist():
            if j > at:
                todo.append((own[sub[:, j]], shut, j))


def closed_sets(bk: DataFrame, count: int, task_rows: int = 20_000) -> DataFrame:
    """(items, itemset, len, support, maximal) of all closed sets in `count` baskets or more."""
    checked(count)
    spark = bk.sparkSession
    shared_folder(spark)
    # position 0 is the rarest frequent item: its task is the smallest
    ranks = item_rank(bk, count)
    order = ranks.agg(F.max("rank").alias("m")).first()["m"]
    if order is None:
        return spark.createDataFrame([], "items array<string>, itemset string, len int, support bigint, maximal boolean")
    places = ranks.select("item", (F.lit(order) - F.col("rank")).cast("int").alias("p"))
    coded = bk.select("tid", F.explode("items").alias("item")).join(places, "item").groupBy("tid").agg(F.array_sort(F.collect_list("p")).alias("b"))
    weighted = coded.groupBy("b").agg(F.count(F.lit(1)).alias("w"))
    tasks = weighted.select(F.array().cast("array<int>").alias("parent"), F.explode("b").alias("j"), "b", "w").withColumn("task", F.col("j").cast("string")).checkpoint()

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))  # task_rows baskets at most
        found = search(t.column("b").to_numpy(), t.column("w").to_numpy(), count, t.column("parent")[0].as_py(), t.column("j")[0].as_py())
        while some := list(itertools.islice(found, OUT_ROWS)):  # what is found has no bound, so it leaves as it comes
            items, support, maximal = zip(*some)
            yield pa.RecordBatch.from_arrays([pa.array(items, pa.list_(pa.int32())), pa.array(support, pa.int64()), pa.array(maximal, pa.bool_())], ["items", "support", "maximal"])

    out = []
    while True:
        sizes = tasks.groupBy("task").agg(F.count(F.lit(1)).alias("rows"), F.sum("w").alias("total")).where(F.col("total") >= count)
        out.append(tasks.join(sizes.where(F.col("rows") <= task_rows).select("task"), "task").groupBy("task").applyInArrow(local, FOUND))
        large = tasks.join(sizes.where(F.col("rows") > task_rows).select("task", "total"), "task").checkpoint()
        if large.isEmpty():
            break
        have = large.select("task", "parent", "j", "total", "w", F.explode("b").alias("x")).groupBy("task", "parent", "j", "total", "x").agg(F.sum("w").alias("n"))
        step = have.groupBy("task", "parent", "j", "total").agg(
            F.array_sort(F.collect_list(F.when(F.col("n") == F.col("total"), F.col("x")))).alias("shut"),
            F.array_sort(F.collect_list(F.when((F.col("n") >= count) & (F.col("n") < F.col("total")), F.col("x")))).alias("more"),
        )
        early = lambda c: F.filter(c, lambda x: x < F.col("j"))
        step = step.where(early("shut") == early("parent")).checkpoint()
        out.append(step.select(F.col("shut").alias("items"), F.col("total").alias("support"), (F.size("more") == 0).alias("maximal")))
        grown = step.select("task", F.col("shut").alias("parent"), F.explode(F.filter("more", lambda x: x > F.col("j"))).alias("j"))
        tasks = large.select("task", "b", "w").join(grown, "task").where(F.array_contains("b", F.col("j"))).withColumn("task", F.concat_ws(",", "task", F.col("j").cast("string"))).checkpoint()
    found = out[0]
    for part in out[1:]:
        found = found.unionByName(part)
    named = found.withColumn("set", F.monotonically_increasing_id())
    rows = named.select("set", "support", "maximal", F.explode("items").alias("p")).join(places, "p").groupBy("set", "support", "maximal").agg(F.array_sort(F.collect_list(F.col("item").cast("string"))).alias("items"))
    return rows.select("items", text(F.col("items")).alias("itemset"), F.size("items").alias("len"), "support", "maximal")
