"""Box, keyword and combined queries over point objects with keywords, and their indexes.

Objects are (id, x, y, kw), queries (qid, x0, y0, x1, y1, kw). Boxes include their
borders. A query without keywords matches all objects in `all` mode, none in `any`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.functions.itemsets import SEPARATOR

#: Shares of the objects that meet a query without keywords one by one.
SLOTS = 64


def cells(objects: DataFrame, width: float, height: float) -> DataFrame:
    """Objects with their grid cell: what an index by location is to an equi-join or a partitioned table."""
    return objects.withColumn("cx", F.floor(F.col("x") / width)).withColumn("cy", F.floor(F.col("y") / height))


def box_query(objects: DataFrame, queries: DataFrame, width: float, height: float) -> DataFrame:
    """(qid, id, kw, wanted): objects in each query's box, by an equi-join on grid cells, then the exact test.

    width and height are the grid's; a box covers its size divided by them in rows.
    """
    steps = lambda lo, hi, by: F.sequence(F.floor(F.col(lo) / by), F.floor(F.col(hi) / by))
    good = queries.where((F.col("x0") <= F.col("x1")) & (F.col("y0") <= F.col("y1")))
    asked = good.withColumn("cx", F.explode(steps("x0", "x1", width))).withColumn("cy", F.explode(steps("y0", "y1", height))).withColumnRenamed("kw", "wanted")
    met = cells(objects, width, height).join(asked, ["cx", "cy"])
    return met.where(F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))).select("qid", "id", "kw", "wanted")


def inverted_index(objects: DataFrame, block: int = 4096) -> DataFrame:
    """(kw, block, n, ids): postings in blocks of id ranges, so that a keyword of most objects is many rows."""
    rows = objects.select(F.explode(F.array_distinct("kw")).alias("kw"), F.floor(F.col("id") / block).alias("block"), "id")
    lists = rows.groupBy("kw", "block").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("id")).alias("list"))
    return lists.select("kw", "block", "n", F.array_join(F.col("list").cast("array<string>"), SEPARATOR).alias("ids"))


def keyword_query(objects: DataFrame, queries: DataFrame, mode: str = "all") -> DataFrame:
    """(qid, id): objects with all, or any, of each query's keywords, by an equi-join on keywords and a count.

    In `all` mode a query without keywords has every object in its answer; those rows
    come share by share of the objects, by an equi-join on the share.
    """
    if mode not in ("all", "any"):
        raise ValueError("mode must be all or any")
    asked = queries.select("qid", F.array_distinct(F.coalesce("kw", F.array().cast("array<string>"))).alias("kw"))
    words = asked.select("qid", F.size("kw").alias("need"), F.explode("kw").alias("word"))
    met = objects.select("id", F.explode(F.array_distinct("kw")).alias("word")).join(words, "word").groupBy("qid", "need", "id").agg(F.count(F.lit(1)).alias("have"))
    if mode == "any":
        return met.select("qid", "id")
    every = asked.where(F.size("kw") == 0).select("qid", F.explode(F.sequence(F.lit(0), F.lit(SLOTS - 1))).alias("slot"))
    free = objects.select("id", F.pmod(F.xxhash64("id"), F.lit(SLOTS)).cast("int").alias("slot")).join(every, "slot").select("qid", "id")
    return met.where(F.col("have") == F.col("need")).select("qid", "id").unionByName(free)


def spatial_keyword_query(objects: DataFrame, queries: DataFrame, width: float, height: float, mode: str = "all") -> DataFrame:
    """(qid, id): objects in the box that have all, or any, of the keywords; the box is tested first."""
    inside = box_query(objects, queries, width, height)
    has = F.size(F.array_except("wanted", "kw")) == 0 if mode == "all" else F.arrays_overlap("wanted", "kw")
    return inside.where(has).select("qid", "id")


def frequent_sets_index(objects: DataFrame, fi: DataFrame, block: int = 4096) -> DataFrame:
    """(items, itemset, len, block, n, ids): postings of the frequent keyword sets of two or more, ready for queries that name all of one.

    An equi-join on each set's rarest keyword, then the exact test, so that a set meets
    only objects that have that keyword; ids come in blocks, as in inverted_index.
    """
    wanted = fi.where(F.col("len") >= 2)
    often = fi.where(F.col("len") == 1).select(F.element_at("items", 1).alias("word"), F.col("support").alias("often"))
    spread = wanted.select("items", F.explode("items").alias("word")).join(often, "word")
    rare = spread.groupBy("items").agg(F.min(F.struct("often", "word")).alias("p")).select("items", F.col("p.word").alias("word"))
    have = objects.select("id", F.array_distinct("kw").alias("kw")).select("id", "kw", F.explode("kw").alias("word"))
    met = have.join(rare, "word").where(F.size(F.array_except("items", "kw")) == 0).select("items", F.floor(F.col("id") / block).alias("block"), "id")
    lists = met.groupBy("items", "block").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("id")).alias("list"))
    return lists.select("items", F.array_join("items", SEPARATOR).alias("itemset"), F.size("items").alias("len"), "block", "n", F.array_join(F.col("list").cast("array<string>"), SEPARATOR).alias("ids"))
