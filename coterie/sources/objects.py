"""Point objects with keywords, and box queries, from delimited text with a tail of keywords of any length."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fields():
    return F.transform(F.split("value", ","), lambda x: F.trim(x))


def read_objects(spark: SparkSession, path: str) -> DataFrame:
    """Lines `id, x, y, kw1, kw2, ...` as (id, x, y, kw); blank lines are skipped."""
    p = spark.read.text(path).where(F.trim("value") != "").select(_fields().alias("p"))
    return p.select(F.get("p", F.lit(0)).try_cast("bigint").alias("id"), F.get("p", F.lit(1)).try_cast("double").alias("x"), F.get("p", F.lit(2)).try_cast("double").alias("y"), F.array_distinct(F.slice("p", 4, F.greatest(F.size("p") - 3, F.lit(0)))).alias("kw"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """Lines `id, xmin, ymin, xmax, ymax, kw1, ...` as (qid, x0, y0, x1, y1, kw)."""
    p = spark.read.text(path).where(F.trim("value") != "").select(_fields().alias("p"))
    box = [F.get("p", F.lit(i + 1)).try_cast("double").alias(c) for i, c in enumerate(("x0", "y0", "x1", "y1"))]
    return p.select(F.get("p", F.lit(0)).try_cast("bigint").alias("qid"), *box, F.array_distinct(F.slice("p", 6, F.greatest(F.size("p") - 5, F.lit(0)))).alias("kw"))


def _line(*columns: str):
    rest = F.when(F.size("kw") > 0, F.concat(F.lit(", "), F.array_join("kw", ", "))).otherwise(F.lit(""))
    return F.concat(F.concat_ws(", ", *(F.col(c).cast("string") for c in columns)), rest).alias("value")


def write_objects(objects: DataFrame, path: str) -> None:
    """Writes (id, x, y, kw) as lines that read_objects reads; keywords must not hold commas."""
    objects.select(_line("id", "x", "y")).write.mode("overwrite").text(path)


def write_queries(queries: DataFrame, path: str) -> None:
    """Writes (qid, x0, y0, x1, y1, kw) as lines that read_queries reads."""
    queries.select(_line("qid", "x0", "y0", "x1", "y1")).write.mode("overwrite").text(path)
