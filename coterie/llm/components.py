"""Connected components over a table of links, by alternating large and small stars.

Links never leave the executors. Each round is two aggregations by node with
map-side combining and two joins. What is joined is written to the checkpoint folder
first: then both sides are dealt for the join alone, so Spark may split the partition
of a node with very many links, and a lost executor costs half a round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.llm.common import shared_folder


def components(links: DataFrame, a: str = "a", b: str = "b", most_rounds: int = 60) -> DataFrame:
    """Rows (node, root) for every node of a link; root is the smallest node reachable.

    Links of a node with itself and links with a null are ignored; repeated links
    count once; no links give no rows.
    """
    shared_folder(links.sparkSession)
    x, y = F.col(a), F.col(b)
    edges = links.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct().checkpoint()
    mark = None
    for _ in range(most_rounds):
        # large star: a node's larger neighbours move to its smallest neighbour or itself
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")).checkpoint()
        # every edge is (u > v): seen from v, its larger neighbour u moves to the smallest around v
        edges = edges.join(low.withColumnRenamed("u", "v"), "v").select("u", F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct().checkpoint()
        # small star: the smaller neighbours and the node itself move to the smallest of them
        low = edges.groupBy("u").agg(F.min("v").alias("m")).checkpoint()
        met = edges.join(low, "u")
        edges = met.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).where(F.col("u") != F.col("v")).distinct().checkpoint()
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select("node", F.col("node").alias("root")))
