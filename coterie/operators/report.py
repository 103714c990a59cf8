"""What leaves the miner: length histograms, itemset lines, files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def length_histogram(sets: DataFrame) -> DataFrame:
    """(len, n) for every length from 1 to the longest, zeros included; the empty set doesn't count."""
    found = sets.where(F.col("len") > 0).groupBy("len").agg(F.count(F.lit(1)).alias("n"))
    every = found.agg(F.max("len").alias("m")).where(F.col("m") >= 1).select(F.explode(F.sequence(F.lit(1), F.col("m"))).alias("len"))
    return every.join(found, "len", "left").select("len", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def itemset_lines(sets: DataFrame) -> DataFrame:
    """(line): each item and a blank, then the support in brackets; the empty set is (N)."""
    items = F.array_join(F.transform("items", lambda x: F.concat(x.cast("string"), F.lit(" "))), "")
    return sets.select(F.concat(items, F.lit("("), F.col("support").cast("string"), F.lit(")")).alias("line"))


def write_lines(sets: DataFrame, path: str) -> None:
    itemset_lines(sets).write.mode("overwrite").text(path)


def read_lines(spark, path: str) -> DataFrame:
    """Itemsets back from such lines (CR LF ends are fine)."""
    line = F.regexp_replace("value", r"\r$", "")
    head, support = F.regexp_extract(line, r"^(.*)\((\d+)\)$", 1), F.regexp_extract(line, r"^(.*)\((\d+)\)$", 2)
    rows = spark.read.text(path).where(F.col("value").rlike(r"\(\d+\)\r?$")).select(F.array_sort(F.filter(F.split(head, " "), lambda x: x != "")).alias("items"), support.cast("long").alias("support"))
    return rows.select("items", F.array_join("items", " ").alias("itemset"), F.size("items").alias("len"), "support")
