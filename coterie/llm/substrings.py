"""Substring deduplication: words covered by a window of words found elsewhere too.

`windows` has the method: a count-min prefilter over all documents, then exact
grouping of the windows that it could not rule out. A window's key has 128 bits: two
hashes of its words in order, each over a word hash of its own, with a full mix at every
step. Words are not compared again: among 10^14 windows the chance that any two different
ones share a key is below 10^-10.

Edge cases: a null text has no words; documents shorter than the window lose
nothing; a window found twice in one document counts; equal rows remove each
other's windows, as they are two documents; columns but doc_id and text are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coterie.llm.common import documents, tidied
from coterie.llm.windows import NO_ID, PLACES, RECORD, Chunk, Sender, by_document, chunks, covered, flagged_windows, found_anchors, keyed, owners, partitions_for, places_of, text_bytes, window_keys, with_marks, word_lanes, word_units

WINDOW, GRAM = 35, 10


def marked_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """MARKS rows: starts of windows (in words) whose words also start elsewhere. docs: as from keyed()."""
    n = partitions_for(docs, text_bytes(docs))
    flagged = docs.join(places_of(found_anchors(docs, word_units, window, gram, n), n), "th")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sender(n)
        for texts, (ids, ths, places) in chunks(batches, ["doc_id", "th", "places"]):
            lanes, sizes = word_lanes(texts)
            chunk = Chunk(lanes[:, 0].copy(), sizes, window, gram)
            hit = flagged_windows(chunk, places.to_pylist())
            if not len(hit):
                continue
            lo, owner = chunk.starts[hit], chunk.owner[hit]
            key, key2 = (window_keys(lanes[:, k], window)[lo] for k in (0, 1))
            yield from out.add(key, key2, ids.to_numpy()[owner], ths.to_numpy()[owner], (lo - chunk.begins[owner]).astype(np.int32))
        yield from out.flush()

    sent = flagged.select("doc_id", "th", "text", "places").mapInArrow(tidied(send), RECORD)
    return by_document(sent.repartitionById(n, "part").mapInArrow(tidied(owners(n)), PLACES), n)


def substring_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): kept has the words left, joined by blanks."""
    own = keyed(docs)
    marked = with_marks(own, marked_windows(own, window, gram))
    out = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, (ids, starts, lens) in chunks(batches, ["doc_id", "starts", "lens"]):
            words, removed, kept = [], [], []
            for text, s, n in zip(texts, starts.to_pylist(), lens.to_pylist()):
                own_words = text.split()
                gone = 0
                if s:
                    hit = covered(len(own_words), s, n, window)
                    gone = int(hit.sum())
                    own_words = [w for w, h in zip(own_words, hit.tolist()) if not h]
                words.append(len(own_words) + gone)
                removed.append(gone)
                kept.append(b" ".join(own_words))
            yield pa.RecordBatch.from_arrays([ids, pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    return marked.select("doc_id", "text", "starts", "lens").mapInArrow(tidied(cut), out).withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def op4_substrings(spark, sf_dir: str) -> DataFrame:
    return substring_dedup(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


ORACLE_OP4 = f"""
WITH d AS (SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'), lambda x: true) AS w FROM documents),
win AS (SELECT doc_id, i, array_to_string(w[i:i + {WINDOW - 1}], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - {WINDOW - 2})) AS i FROM d)),
hit AS (SELECT doc_id, i, s FROM win QUALIFY count(*) OVER (PARTITION BY s) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {WINDOW})) AS k FROM hit),
word AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS x FROM d),
kept AS (SELECT word.doc_id, count(gone.k) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY word.k) FILTER (gone.k IS NULL), '') AS t FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.k = gone.k GROUP BY word.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
