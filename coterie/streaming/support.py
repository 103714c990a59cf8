"""Supports kept up to date over a stream of (tid-free) items."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.functions.session import fresh_path, settled


def item_counts(stream: DataFrame, item: str) -> DataFrame:
    """(item, support) so far: a streaming aggregation, whose state is one count an item."""
    return stream.where(F.col(item).isNotNull()).groupBy(F.col(item).alias("item")).agg(F.count(F.lit(1)).alias("support"))


def windowed_counts(stream: DataFrame, time: str, item: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, item, support) by window of event time; in append mode windows close once the watermark has passed them.

    Rows without a time or an item are in no window.
    """
    known = stream.where(F.col(time).isNotNull() & F.col(item).isNotNull()).withWatermark(time, late)
    return known.groupBy(F.window(time, window).alias("w"), F.col(item).alias("item")).agg(F.count(F.lit(1)).alias("support")).select(F.col("w.start").alias("start"), "item", "support")


def stream_of_files(spark: SparkSession, path: str) -> DataFrame:
    """The files that are there as a stream; a single file can be a source as well as a folder."""
    return spark.readStream.schema(spark.read.parquet(path).schema).format("parquet").load(f"{path[:-1]}[{path[-1]}]")


def final_table(spark: SparkSession, counts: DataFrame) -> DataFrame:
    """Runs a streaming aggregation over all there is and returns the table it ends with.

    Progress, state and result are in the shared folder, so a lost executor costs no more than
    a batch, and no result passes through the driver; progress and state go when the run has ended.
    """
    folder = fresh_path(spark, "stream")

    def store(batch: DataFrame, nth: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/result")

    query = counts.writeStream.outputMode("complete").option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).foreachBatch(store).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return settled(spark.read.schema(counts.schema).parquet(f"{folder}/result"), folder)


def item_support_of_files(spark: SparkSession, path: str, item: str) -> DataFrame:
    """item_counts over the files that are there."""
    return final_table(spark, item_counts(stream_of_files(spark, path), item))
