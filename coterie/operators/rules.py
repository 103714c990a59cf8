"""Association rules with one item on the right."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.functions.itemsets import text


def association_rules(fi: DataFrame, n: int, min_confidence: float = 0.0) -> DataFrame:
    """(antecedent, consequent, support, confidence, lift) for each frequent set and each of its items.

    Every subset of a frequent set is frequent, so both joins find their row.
    """
    cut = fi.where(F.col("len") > 1).select(F.explode("items").alias("consequent"), "items", "support")
    cut = cut.select(F.filter("items", lambda x: x != F.col("consequent")).alias("rest"), "consequent", "support")
    left = fi.select(F.col("items").alias("rest"), F.col("support").alias("left_support"))
    right = fi.where(F.col("len") == 1).select(F.element_at("items", 1).alias("consequent"), F.col("support").alias("right_support"))
    met = cut.join(left, "rest").join(right, "consequent").withColumn("confidence", F.col("support") / F.col("left_support"))
    lift = F.col("confidence") / (F.col("right_support") / F.lit(float(n)))
    return met.where(F.col("confidence") >= min_confidence).select(text(F.col("rest")).alias("antecedent"), "consequent", "support", "confidence", lift.alias("lift"))
