"""Reading baskets: text lines of numbers, length-prefixed binary records, tables; and the item parser.

A basket is a row (tid, items): items is a sorted array without repeats, never null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def parse_items(line: Column) -> Column:
    """Numbers of a line in order: every byte that isn't a digit separates; a number beyond BIGINT is dropped. A null line has none."""
    digits = F.regexp_extract_all(F.coalesce(line, F.lit("")), F.lit("([0-9]+)"), F.lit(1))
    return F.filter(F.transform(digits, lambda x: x.try_cast("bigint")), lambda x: x.isNotNull())


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One basket a line, blank lines included. A last line without a line end counts, too."""
    lines = spark.read.text(path)
    return lines.select(F.monotonically_increasing_id().alias("tid"), F.array_sort(F.array_distinct(parse_items(F.col("value")))).alias("items"))


def parse_records(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Baskets of files of records: two int32 that are skipped, an int32 count, that many int32 items (native order)."""
    for frame in frames:
        for path, content in zip(frame["path"], frame["content"]):
            data, at, nth, rows = np.frombuffer(bytes(content), np.int32), 0, 0, []
            while at + 3 <= len(data):
                n = int(data[at + 2])
                if n < 0 or at + 3 + n > len(data):
                    raise ValueError(f"{path}: record {nth} is cut short")
                rows.append((path, nth, sorted(set(data[at + 3 : at + 3 + n].astype(int).tolist()))))
                at, nth = at + 3 + n, nth + 1
            yield pd.DataFrame(rows, columns=["path", "nth", "items"])


def read_binary(spark: SparkSession, path: str) -> DataFrame:
    """Baskets (path, nth, items) of binary files.

    Where a record begins is known from the one before alone, so a file is one task and
    one row of at most 2 GB (a larger one raises); large inputs come in many files.
    """
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parse_records, "path string, nth long, items array<bigint>")


def _int32(value: Column) -> Column:
    """The four bytes of an int, the lowest first."""
    digits = F.lpad(F.hex(value.cast("long")), 8, "0")
    digits = F.substring(digits, -8, 8)
    return F.unhex(F.concat(*(F.substring(digits, i, 2) for i in (7, 5, 3, 1))))


def write_binary(bk: DataFrame, path: str) -> None:
    """Writes baskets (items: arrays of ints from 0 to 2^31 - 1) as files that read_binary reads.

    The text writer is what Spark has for bytes as they are; the byte that ends a line is the last of
    a record. It is zero, as the smallest item goes last and must be below 2^24.
    """
    order = F.sort_array("items", asc=False)
    fits = F.assert_true(F.coalesce(F.array_min("items"), F.lit(0)) < 1 << 24, F.lit("a basket needs an item below 2^24 or none"))
    ints = F.concat(F.array(F.lit(0), F.lit(0), F.size("items")), order.cast("array<int>"))
    # aggregate keeps the bytes in order without a function of Python
    record = F.aggregate(ints, F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, _int32(x)))
    cut = F.substring(record, 1, F.length(record) - 1)
    bk.select(F.when(fits.isNull(), cut).cast("string").alias("value")).write.mode("overwrite").option("lineSep", "\0").text(path)


def write_text(bk: DataFrame, path: str) -> None:
    """Writes baskets as lines of items with blanks between them."""
    bk.select(F.array_join(F.col("items").cast("array<string>"), " ").alias("value")).write.mode("overwrite").text(path)


def baskets(pairs: DataFrame, tid: str = "tid", item: str = "item") -> DataFrame:
    """Baskets of a table of (tid, item): repeats and null items count once and not at all; a null tid is no basket."""
    known = pairs.where(F.col(tid).isNotNull())
    return known.groupBy(F.col(tid).alias("tid")).agg(F.array_sort(F.collect_set(item)).alias("items"))


def from_arrays(rows: DataFrame, tid: str = "tid", items: str = "items") -> DataFrame:
    """Baskets of a table with an array column; a null array is an empty basket, null items are dropped."""
    empty = F.array().cast(rows.schema[items].dataType)
    clean = F.array_sort(F.array_distinct(F.filter(F.coalesce(F.col(items), empty), lambda x: x.isNotNull())))
    return rows.select(F.col(tid).alias("tid"), clean.alias("items"))
