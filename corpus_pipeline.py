"""From raw documents to tokens: five stages, each over all that the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which run() writes
as Parquet into the cluster's shared folder and reads again for the next stage.
All but the last return the columns of documents.

1. Quality rules: documents go that fail the base test or that a learned rule
   rejects. Without labels only the base test rejects. Null texts have no words and go.
2. SimHash near-dedup: of documents at a similarity of 0.8 or more in five-word
   shingles, one stays: the one with the smallest doc_id.
3. Suffix-array dedup: bytes of 100-byte strings that an earlier document has, too,
   go; what is left without a word goes with its row.
4. Mixing: sources get their target weights; a document is there once for each
   epoch it is taken in, with the words taken then, so doc_id can repeat from here on.
5. Byte-level BPE: doc_id, source, ids, n_tokens, and digests of the ids and of the
   bytes they decode to.

Tables may be empty, columns null, rows repeated and other columns be there; each
stage's operator states what it does then. A stage that fails is started again from
the files of the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie.functions.session import fresh_path, remove
from coterie.llm import byte_bpe, mixing, quality, simhash, suffix_dedup
from coterie.llm.common import documents, small_batches, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    rules = quality.fit(docs, table(spark, sf_dir, "labels"))
    extra = [c for c in docs.columns if c not in quality.COUNTS and c not in ("base_failed", "kept")]
    clash = [c for c in docs.columns if c not in extra]
    safe = docs.withColumnsRenamed({c: f"_own_{c}" for c in clash})
    judged = quality.judge(safe, rules).where("kept").drop(*quality.COUNTS, "base_failed", "kept")
    return judged.withColumnsRenamed({f"_own_{c}": c for c in clash}).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return simhash.keep_one(docs, similarity=0.8, width=5)


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return suffix_dedup.deduplicated(docs)


def mixed_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return mixing.mixed_texts(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    small_batches(spark)
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    both = byte_bpe.round_trip(docs.select("doc_id", "source", "text"), path, pattern)
    return both.select("doc_id", "source", "ids", F.size("ids").cast("long").alias("n_tokens"), byte_bpe.digest().alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("suffix-array dedup", repeated_strings),
    ("mixing", mixed_sources),
    ("byte-level BPE", tokens),
]

#: Byte-level BPE, SimHash and learned rules have no SQL form; tests/llm/test_pipeline.py holds every stage of run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the files of the stages before are removed when it has been written."""
    docs = documents(spark, sf_dir)
    folder, paths = fresh_path(spark, "pipeline"), []
    for i, (_, stage) in enumerate(STAGES):
        paths.append(f"{folder}/{i}")
        stage(spark, docs, sf_dir).write.parquet(paths[-1])
        docs = spark.read.parquet(paths[-1])
    for path in paths[:-1]:
        remove(spark, path)
    return docs
