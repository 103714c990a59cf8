"""An index of point objects by place: Hilbert keys, a quadtree split by load, a table laid out by its leaves.

The plane within fixed bounds is a grid of 2^depth x 2^depth cells, numbered along a
Hilbert curve. The curve is hierarchical: the upper 2d bits of a cell's number name
its quadrant at depth d. A quadrant is a leaf if it has at most `capacity` objects
and its parent has more, or if it is a single cell. Counts per cell decide all of it,
so objects are read once and what is rolled up grows with the occupied cells.

`write_layout` stores objects by leaf, each leaf a folder sorted along the curve, and
the leaves' boxes beside them; `box_query_layout` reads the folders of the leaves that
meet a box and no others.

Edge cases: objects beyond the bounds count in the nearest cell at the border (so every
object has a leaf, and boxes are widened there); objects with a null or NaN coordinate
are in no leaf; no objects give no leaves; a box whose sides are the wrong way round has
no answers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Bounds = tuple[float, float, float, float]


def hilbert(cx: Column, cy: Column, depth: int) -> Column:
    """The place of a cell of a 2^depth x 2^depth grid on the Hilbert curve."""
    side = 1 << depth
    x, y, d = cx.cast("long"), cy.cast("long"), F.lit(0).cast("long")
    start = F.struct(x.alias("x"), y.alias("y"), d.alias("d"))

    def step(state: Column, s: Column) -> Column:
        rx = (state["x"].bitwiseAND(s) > 0).cast("long")
        ry = (state["y"].bitwiseAND(s) > 0).cast("long")
        turned = ry == 0
        flip = turned & (rx == 1)
        fx = F.when(flip, side - 1 - state["x"]).otherwise(state["x"])
        fy = F.when(flip, side - 1 - state["y"]).otherwise(state["y"])
        return F.struct(F.when(turned, fy).otherwise(fx).alias("x"), F.when(turned, fx).otherwise(fy).alias("y"), (state["d"] + s * s * (3 * rx).bitwiseXOR(ry)).alias("d"))

    return F.aggregate(F.array(*(F.lit(1 << k).cast("long") for k in range(depth - 1, -1, -1))), start, step)["d"]


def cell_of(value: str | Column, low: float, high: float, depth: int) -> Column:
    """The cell of a coordinate; beyond the bounds it is the one at the border."""
    side = 1 << depth
    at = F.floor(((F.col(value) if isinstance(value, str) else value) - F.lit(low)) / F.lit((high - low) / side))
    return F.greatest(F.lit(0), F.least(F.lit(side - 1), at)).cast("long")


def keyed(objects: DataFrame, bounds: Bounds, depth: int) -> DataFrame:
    """Adds cx, cy and h (place on the curve) to the objects that have a place."""
    x0, y0, x1, y1 = bounds
    known = objects.where(F.col("x").isNotNull() & F.col("y").isNotNull() & ~F.isnan("x") & ~F.isnan("y"))
    cells = known.withColumn("cx", cell_of("x", x0, x1, depth)).withColumn("cy", cell_of("y", y0, y1, depth))
    return cells.withColumn("h", hilbert(F.col("cx"), F.col("cy"), depth))


def leaves(objects: DataFrame, bounds: Bounds, capacity: int, depth: int) -> DataFrame:
    """(level, quad, n): the quadtree's leaves that have objects; quad is the upper 2 * level bits of h."""
    cells = keyed(objects, bounds, depth).groupBy("h").agg(F.count(F.lit(1)).alias("c"))
    levels = F.sequence(F.lit(0), F.lit(depth))
    above = cells.select("c", F.explode(F.transform(levels, lambda d: F.struct(d.alias("level"), F.expr("h").alias("h")))).alias("a")).select("c", F.col("a.level").alias("level"), F.col("a.h").alias("h"))
    nodes = above.groupBy("level", F.expr(f"shiftright(h, 2 * ({depth} - level))").alias("quad")).agg(F.sum("c").alias("n"))
    parents = nodes.select((F.col("level") + 1).alias("level"), F.col("quad").alias("parent"), F.col("n").alias("parent_n"))
    met = nodes.withColumn("parent", F.shiftright("quad", 2)).join(parents, ["level", "parent"], "left")
    small = (F.col("n") <= capacity) | (F.col("level") == depth)
    return met.where(small & (F.col("parent_n").isNull() | (F.col("parent_n") > capacity))).select("level", "quad", "n")


def assigned(objects: DataFrame, tree: DataFrame, bounds: Bounds, depth: int) -> DataFrame:
    """Objects with h and their leaf (level, quad): an equi-join with the leaves on (level, quadrant at that level)."""
    rows = keyed(objects, bounds, depth)
    of_cell = rows.select("h").distinct().select("h", F.explode(F.sequence(F.lit(0), F.lit(depth))).alias("level"))
    of_cell = of_cell.withColumn("quad", F.expr(f"shiftright(h, 2 * ({depth} - level))")).join(tree.select("level", "quad"), ["level", "quad"])
    return rows.join(of_cell, "h")


def write_layout(objects: DataFrame, path: str, bounds: Bounds, capacity: int = 1_000_000, depth: int = 12) -> None:
    """Writes path/objects, a folder for each leaf with its rows along the curve, and path/leaves with (leaf, x0, y0, x1, y1, n)."""
    tree = leaves(objects, bounds, capacity, depth)
    rows = assigned(objects, tree, bounds, depth).withColumn("leaf", F.concat_ws("-", "level", "quad"))
    # ranges of the curve, not hashes of leaves: a leaf of very many rows may be cut, small ones share a task
    laid = rows.repartitionByRange("h", "id").sortWithinPartitions("leaf", "h")
    laid.drop("level", "quad").write.mode("overwrite").partitionBy("leaf").parquet(f"{path}/objects")
    stored = objects.sparkSession.read.parquet(f"{path}/objects")
    # boxes of the rows themselves: as tight as can be, also at the border
    boxes = stored.groupBy("leaf").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"), F.count(F.lit(1)).alias("n"))
    boxes.write.mode("overwrite").parquet(f"{path}/leaves")


def touched(spark: SparkSession, path: str, box: Bounds) -> list[str]:
    """Names of the leaves whose boxes meet a box."""
    x0, y0, x1, y1 = box
    met = spark.read.parquet(f"{path}/leaves").where((F.col("x0") <= x1) & (F.col("x1") >= x0) & (F.col("y0") <= y1) & (F.col("y1") >= y0))
    return sorted(r["leaf"] for r in met.select("leaf").collect())  # leaves are folders: one name for each


def box_query_layout(spark: SparkSession, path: str, queries: list[tuple]) -> DataFrame:
    """(qid, id, kw, wanted) for queries (qid, x0, y0, x1, y1, keywords): each reads its own leaves' folders alone."""
    out = None
    for qid, x0, y0, x1, y1, wanted in queries:
        rows = spark.read.parquet(f"{path}/objects")
        rows = rows.where(F.col("leaf").isin(touched(spark, path, (x0, y0, x1, y1))) & F.col("x").between(x0, x1) & F.col("y").between(y0, y1))
        own = rows.select(F.lit(qid).cast("long").alias("qid"), "id", "kw", F.array(*map(F.lit, wanted)).cast("array<string>").alias("wanted"))
        out = own if out is None else out.unionByName(own)
    return out if out is not None else spark.createDataFrame([], "qid long, id long, kw array<string>, wanted array<string>")
