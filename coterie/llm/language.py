"""Language identification with n-gram filters that answer for all languages at once.

A Bloom filter is kept bit-sliced: each cell is a mask with one bit per language,
and looking an n-gram up ANDs the masks of its cells into the set of languages
that contain it. A text's n-grams give a popcount per language; from each count
the hits its filter gives by chance (fill to the power of the number of hashes)
are taken off, and the largest corrected count decides.

A language contains an n-gram if a sufficient share of its learned texts has it,
compared with the language where that share is largest; with texts enough for it, one
text alone does not put an n-gram in. Fitting uses about `texts_per_language` different
texts of each language, taken by hash of id and text, of the `most_languages` most frequent
languages, and of their n-grams the more frequent ones, `most_grams` in all: that is what
the driver holds at most, and the filters come from it. Predicting covers all rows.

Edge cases: a null text, or one without a letter, is `und` with score 0; a text
without a known n-gram gets the commonest language, with that language's share
of the learned texts; without learned languages all is `und`; ties go to the
language that sorts first; a language of one learned text is learned from it; repeated
rows are learned once. Texts are never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coterie.llm.common import documents, held_out, shared_folder, sub_batches

SIZES = (2, 3, 4)
HASHES = 3
ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64)
_LETTER: list[np.ndarray] = []


def letters() -> np.ndarray:
    """By code point: is it a letter?"""
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-grams of the lower-cased texts, and the text each is from; what isn't a letter is a blank."""
    lowered = [f" {x.lower()} " for x in texts]
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in lowered])
    letter = letters()[points]
    blank = ~letter
    keep = letter.copy()  # a run of blanks counts once
    keep[1:] |= blank[1:] & letter[:-1]
    keep[:1] = True
    keep[1:] |= owner[1:] != owner[:-1]
    code, owner = np.where(letter, points, 32)[keep].astype(np.uint64), owner[keep]
    found, whose = [], []
    for n in SIZES:
        if len(code) < n:
            continue
        m = len(code) - n + 1
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = (h ^ code[k : k + m]) * ODD[k]
            h ^= h >> np.uint64(29)
        same = owner[:m] == owner[n - 1 :]
        found.append(h[same] * ODD[0])
        whose.append(owner[:m][same])
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(whose)


@dataclass
class Filters:
    """Bit-sliced filters: cells[c, w] has bits of the languages 64w .. 64w+63."""

    languages: list[str]
    prior: np.ndarray
    cells: np.ndarray
    chance: np.ndarray

    @staticmethod
    def build(languages: list[str], prior, grams: list[np.ndarray]) -> Filters:
        need = 16 * max([1, *(len(g) for g in grams)])
        size = 1 << max(10, int(np.ceil(np.log2(need))))
        cells = np.zeros((size, (len(languages) + 63) // 64 or 1), np.uint64)
        fill = np.zeros(len(languages))
        for k, g in enumerate(grams):
            w, bit = divmod(k, 64)
            for at in places(g, size):
                cells[at, w] |= np.uint64(1 << bit)
            fill[k] = np.count_nonzero(cells[:, w] & np.uint64(1 << bit)) / size
        return Filters(languages, np.asarray(prior, float), cells, fill**HASHES)

    def containing(self, hashes: np.ndarray) -> np.ndarray:
        """Masks of the languages that contain each n-gram (or seem to)."""
        first, *rest = places(hashes, len(self.cells))
        out = self.cells[first]
        for at in rest:
            out &= self.cells[at]
        return out

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        hashes, owner = ngrams([x or "" for x in texts])
        masks, n = self.containing(hashes), len(texts)
        total = np.bincount(owner, minlength=n).astype(float)
        hits = np.zeros((n, len(self.languages)))
        for k in range(len(self.languages)):
            w, bit = divmod(k, 64)
            hits[:, k] = np.bincount(owner, weights=(masks[:, w] >> np.uint64(bit)) & np.uint64(1), minlength=n)
        true = np.maximum(0.0, (hits - total[:, None] * self.chance) / (1 - self.chance))
        whole = true.sum(axis=1)
        true[whole <= 0] = self.prior
        best = true.argmax(axis=1)
        score = true[np.arange(n), best] / true.sum(axis=1)
        none = np.fromiter((not x or not any(map(str.isalpha, x)) for x in texts), bool, n)
        return ["und" if none[i] else self.languages[best[i]] for i in range(n)], np.where(none, 0.0, score)


def places(hashes: np.ndarray, size: int) -> list[np.ndarray]:
    mask, step = np.uint64(size - 1), np.uint64(max(1, (64 - int(size).bit_length()) // (HASHES - 1)))
    return [((hashes >> (step * np.uint64(k))) & mask).astype(np.int64) for k in range(HASHES)]


def fit(docs: DataFrame, texts_per_language: int = 3000, least_share: float = 0.01, against_best: float = 0.25, most_languages: int = 1024, most_grams: int = 4_000_000) -> Filters:
    """Learns from the columns doc_id, text and lang; rows with a null in text or lang are not used."""
    known = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", "lang", F.xxhash64("doc_id", "text").alias("h"))
    per_language = known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "lang").limit(most_languages)
    counts = {r["lang"]: r["n"] for r in per_language.collect()}
    languages = sorted(counts)
    if not languages:
        return Filters([], np.zeros(0), np.zeros((1024, 1), np.uint64), np.zeros(0))
    shares = F.create_map(*(F.lit(x) for name in languages for x in (name, int(min(1.0, texts_per_language / counts[name]) * (1 << 30)))))
    part = F.coalesce(shares[F.col("lang")], F.lit(0))  # the share of each language's texts, by hash
    sample = known.where(F.pmod("h", F.lit(1 << 30)) < part)
    # rows that repeat each other are one, first within each task
    sample = sample.groupBy("lang", "h").agg(F.first("text").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in sub_batches(batch, "text"):
                hashes, owner = ngrams(rows.column(0).to_pylist())
                lang = np.array([languages.index(x) for x in rows.column(1).to_pylist()])
                _, once = np.unique(hashes + owner.astype(np.uint64) * ODD[1], return_index=True)  # each n-gram once a text
                h, which = hashes[once], lang[owner[once]]
                for k in np.unique(which):
                    g, n = np.unique(h[which == k], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g), k, np.int32)), pa.array(g.view(np.int64)), pa.array(n.astype(np.int64))], ["k", "gram", "n"])
                used = np.bincount(lang, minlength=len(languages))
                # texts of language k count under -1 - k: a null would make pandas round the hashes to floats
                yield pa.RecordBatch.from_arrays([pa.array(-1 - np.arange(len(languages), dtype=np.int32)), pa.array(np.zeros(len(languages), np.int64)), pa.array(used.astype(np.int64))], ["k", "gram", "n"])

    shared_folder(docs.sparkSession)
    counted = sample.select("text", "lang").mapInArrow(count, "k int, gram long, n long").groupBy("k", "gram").agg(F.sum("n").alias("n")).checkpoint()
    need = 2 / least_share  # texts from which two are no more than the least share
    least = [2 if counts[name] >= need else 1 for name in languages]
    room = max(1000, most_grams // len(languages))
    # how many n-grams have each count: at most as many rows a language as texts were taken
    levels = counted.where(F.col("k") >= 0).groupBy("k", "n").agg(F.count(F.lit(1)).alias("grams")).toPandas().sort_values("n", ascending=False)
    for k, own in levels.groupby("k"):
        over = own["n"][own["grams"].cumsum() > room]
        least[k] = max(least[k], int(over.max()) + 1 if len(over) else 0)
    enough = F.col("n") >= F.element_at(F.array(*map(F.lit, least)), F.col("k") + 1)
    found = counted.where(F.when(F.col("k") < 0, F.lit(True)).otherwise(enough)).toPandas()
    used = found[found.k < 0].set_index("k")["n"].reindex(-1 - np.arange(len(languages)), fill_value=0).to_numpy()
    found = found[found.k >= 0]
    k, gram = found["k"].to_numpy(), found["gram"].to_numpy(np.int64)
    share = found["n"].to_numpy() / np.maximum(used[k], 1)
    order = np.argsort(gram, kind="stable")
    k, gram, share = k[order], gram[order], share[order]
    starts = np.concatenate([[0], np.flatnonzero(np.diff(gram)) + 1]) if len(gram) else np.zeros(0, int)
    best = np.repeat(np.maximum.reduceat(share, starts), np.diff([*starts, len(gram)])) if len(gram) else share
    holds = (share >= least_share) & (share >= against_best * best)
    grams = [gram[holds & (k == i)].view(np.uint64) for i in range(len(languages))]
    return Filters.build(languages, np.array([counts[x] for x in languages]) / sum(counts.values()), grams)


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """Adds lang_pred and score, from the column text alone."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    out = T.StructType([*(docs.schema[c] for c in kept), T.StructField("lang_pred", T.StringType(), False), T.StructField("score", T.DoubleType(), False)])
    sent = docs.sparkSession.sparkContext.broadcast(filters)  # some MB at most: its sample has a bound

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        for batch in batches:
            for rows in sub_batches(batch, "text", 1 << 20):
                texts = rows.column(rows.schema.get_field_index("text")).to_pylist()
                names, score = own.predict(texts) if own.languages else (["und"] * len(texts), np.zeros(len(texts)))
                yield pa.RecordBatch.from_arrays([*(rows.column(rows.schema.get_field_index(c)) for c in kept), pa.array(names, pa.string()), pa.array(score)], [*kept, "lang_pred", "score"])

    return docs.select(*kept).mapInArrow(run, out)


def op5_language(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    filters = fit(docs.where(~held_out()))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), filters).select("doc_id", "held_out", "lang_pred", "score")
