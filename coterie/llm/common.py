"""What the training-data operators share: tables, word splitting, Arrow helpers."""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.functions.session import shared_folder

__all__ = ["BATCH_ROWS", "CHUNK_BYTES", "WORD", "bytes_list", "documents", "held_out", "shared_folder", "small_batches", "sub_batches", "table", "tidied", "word_count", "words_of"]

#: A word is a run of anything but the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"
#: Text handled at once inside a Python worker.
CHUNK_BYTES = 4 << 20
#: Rows in an Arrow batch: whole texts travel in it, and it is held on both sides of the pipe.
BATCH_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Bounds the Arrow batches of the session's Python stages, unless it has a smaller bound."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return table(spark, sf_dir, "documents")


def words_of(text: str | Column) -> Column:
    """Words of a text column in order; a null text has none."""
    return F.regexp_extract_all(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), F.lit(f"({WORD})"), F.lit(1))


def word_count(text: str | Column) -> Column:
    return F.size(words_of(text)).cast("long")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fifth of the rows that no model learns from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def tidied(run):
    """The function for mapInArrow that gives memory back when its task ends: workers are used again, and what they keep adds up."""

    def wrapped(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):
            pass  # another C library: nothing to trim

    return wrapped


def sub_batches(batch: pa.RecordBatch, column: str, limit: int = CHUNK_BYTES):
    """Slices of a batch whose texts have about `limit` bytes together (one row at least)."""
    n = batch.num_rows
    if n == 0:
        return
    i = batch.schema.get_field_index(column)
    sizes = pc.fill_null(pc.binary_length(batch.column(i)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < n:
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def bytes_list(column) -> list[bytes]:
    """UTF-8 bytes of a string column; null counts as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]
