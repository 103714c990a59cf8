"""Quality rules: statistics of a text, and an ordered list of rules learned from labels.

Learning is sequential covering. On a growing set, one rule at a time takes the
threshold that gains most about the rejected class until it covers no kept row or
nothing gains; on a pruning set, its last conditions go while that raises its
worth. A rule that is precise and wide enough enters the list, and the rows it covers
leave both sets. A rule that is not precise may become so by an exception, a rule for
keeping that is grown and pruned inside it in the same way and stands before it: the
first rule of the list that fits a row decides, so their order counts. Where that fails
too, the rejected rows it covers are set aside and covering goes on with the others. The
list becomes one Spark `when` chain over the statistics, so that judging needs no Python.

Only the fit uses a sample, of about `max_labelled` labelled rows taken by hash
(twice as many at most); the statistics and the verdicts cover every row.

Edge cases: a null or empty text has no words, so the base test fails it; without
labelled rows, or with labels of one class, the list is empty and only the base
test rejects; a null label is not learned from; repeated rows are judged alike.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coterie.llm.common import bytes_list, documents, sub_batches, table, tidied

BLANK = b" \t\n\v\f\r"
SYMBOLS = b"#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_marks"]
UPPER, LOWER = bytes(range(65, 91)), bytes(range(97, 123))
DIGITS, MARKS = b"0123456789", b"!?;:_=+~^@\\/{}[]()\""


def text_counts(data: bytes) -> tuple[int, ...]:
    """The values of COUNTS for the UTF-8 bytes of a text."""
    words = data.split()
    solid = data.translate(None, BLANK)
    chars = len(solid) - (0 if solid.isascii() else int(np.count_nonzero((np.frombuffer(solid, np.uint8) & 0xC0) == 0x80)))
    lines = [x for x in data.split(b"\n") if x.strip()]
    n, repeated = len(words), 0
    if n > 3:
        windows = list(zip(words, words[1:], words[2:]))
        if len(set(windows)) < len(windows):
            times = Counter(windows)
            hit = np.fromiter((times[w] > 1 for w in windows), bool, len(windows))
            cover = np.zeros(n, bool)
            for shift in range(3):
                cover[shift : shift + len(hit)] |= hit
            repeated = int(cover.sum())
    count = lambda those: len(solid) - len(solid.translate(None, those))
    return n, chars, count(SYMBOLS), len(lines) - len(set(lines)), repeated, len(lines), count(UPPER), count(LOWER), count(DIGITS), count(MARKS)


def with_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the columns COUNTS (long); columns of those names are replaced."""
    kept = [c for c in df.columns if c not in COUNTS]
    out = T.StructType([*(df.schema[c] for c in kept), *(T.StructField(c, T.LongType(), False) for c in COUNTS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sub_batches(batch, text):
                found = np.array([text_counts(x) for x in bytes_list(part.column(part.schema.get_field_index(text)))], np.int64).reshape(-1, len(COUNTS))
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), *(pa.array(found[:, i].copy()) for i in range(len(COUNTS)))], [*kept, *COUNTS])

    return df.select(*kept).mapInArrow(tidied(run), out)


def features() -> dict[str, Column]:
    """What rules may compare; ratios of the counts, 0 where the lower part is 0."""
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(F.lit(0.0))
    return {
        "n_words": F.col("n_words").cast("double"), "word_len": share("word_chars", "n_words"), "symbols_per_char": share("n_symbols", "word_chars"),
        "dup_lines": share("n_dup_lines", "n_lines"), "repeat_words": share("n_repeat_words", "n_words"), "upper": F.when(F.col("n_upper") + F.col("n_lower") > 0, F.col("n_upper") / (F.col("n_upper") + F.col("n_lower"))).otherwise(F.lit(0.0)),
        "digits_per_char": share("n_digits", "word_chars"), "marks_per_word": share("n_marks", "n_words"), "words_per_line": share("n_words", "n_lines"),
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool  # value >= threshold, else value <= threshold
    threshold: float

    def column(self, by_name: dict[str, Column]) -> Column:
        return by_name[self.feature] >= self.threshold if self.above else by_name[self.feature] <= self.threshold


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]
    kept: bool
    covered: int
    precision: float


def learn(values: np.ndarray, rejected: np.ndarray, names: list[str], min_precision: float = 0.9, min_covered: int = 4, cuts: int = 64, longest: int = 3, seed: int = 7) -> list[Rule]:
    """An ordered list of rules; the first that fits decides, and what no rule covers is kept."""
    order = np.random.default_rng(seed).permutation(len(rejected))
    pruning = np.zeros(len(rejected), bool)
    pruning[order[::3]] = True
    left, rules = np.ones(len(rejected), bool), []
    grid = [np.unique(np.quantile(values[:, k], np.linspace(0, 1, cuts + 1))) if len(values) else [] for k in range(len(names))]
    if rejected.any():  # the rejected class is often rare: its own quantiles are cuts as well
        grid = [np.unique(np.concatenate([g, np.quantile(values[rejected, k], np.linspace(0, 1, cuts + 1))])) for k, g in enumerate(grid)]

    def covers(conditions) -> np.ndarray:
        hit = np.ones(len(rejected), bool)
        for k, above, cut in conditions:
            hit &= values[:, k] >= cut if above else values[:, k] <= cut
        return hit

    def grown(rows: np.ndarray, target: np.ndarray) -> list[tuple[int, bool, float]]:
        """Conditions that single out the target among the rows, the one that gains most first."""
        conditions: list[tuple[int, bool, float]] = []
        while len(conditions) < longest:
            now = rows & covers(conditions)
            p, n = (now & target).sum(), (now & ~target).sum()
            if n == 0 or p == 0:
                break
            best = (0.0, None)
            for k in range(len(names)):
                v, y = values[now, k], target[now]
                at = np.argsort(v, kind="stable")
                v, below = v[at], np.concatenate([[0], np.cumsum(y[at])])
                for above, side in ((True, "left"), (False, "right")):
                    i = np.searchsorted(v, grid[k], side)
                    tp = below[-1] - below[i] if above else below[i]
                    total = len(v) - i if above else i
                    with np.errstate(divide="ignore", invalid="ignore"):
                        gain = np.where(tp > 0, tp * (np.log2(tp / np.maximum(total, 1)) - np.log2(p / (p + n))), 0.0)
                    j = int(gain.argmax()) if len(gain) else 0
                    if len(gain) and gain[j] > best[0] + 1e-9:
                        best = (float(gain[j]), (k, above, float(grid[k][j])))
            if best[1] is None:
                break
            conditions.append(best[1])
        return conditions

    def counted(hit: np.ndarray, target: np.ndarray) -> tuple[int, int]:
        return int((hit & target).sum()), int((hit & ~target).sum())

    def worth(hit: np.ndarray, target: np.ndarray) -> float:
        p, n = counted(hit & pruning, target)
        return (p - n) / (p + n) if p + n else -1.0

    def good(hit: np.ndarray, target: np.ndarray) -> bool:
        p, n = counted(hit, target)
        return p >= min_covered and p / (p + n) >= min_precision and worth(hit, target) >= 2 * min_precision - 1

    def pruned(conditions, rows: np.ndarray, target: np.ndarray):
        return max((conditions[:i] for i in range(len(conditions), 0, -1)), key=lambda c: worth(rows & covers(c), target))

    def rule(conditions, kept: bool, hit: np.ndarray) -> Rule:
        tightest: dict[tuple[int, bool], float] = {}
        for k, above, cut in conditions:
            tightest[k, above] = (max if above else min)(cut, tightest.get((k, above), cut))
        p, n = counted(hit, ~rejected if kept else rejected)
        return Rule(tuple(Condition(names[k], above, cut) for (k, above), cut in tightest.items()), kept, p + n, p / (p + n))

    def with_exception(conditions):
        """(conditions of the exception, of the rule) for the first prefix of the conditions that one exception makes good."""
        for i in range(len(conditions), 0, -1):
            inside = left & covers(conditions[:i])
            found = grown(inside & ~pruning, ~rejected)
            if found:
                found = pruned(found, inside, ~rejected)
                out = inside & covers(found)
                if good(out, ~rejected) and good(inside & ~out, rejected):
                    return conditions[:i] + found, conditions[:i]
        return None

    aside = np.zeros(len(rejected), bool)
    while (left & ~pruning & ~aside & rejected).sum() >= min_covered:
        conditions = grown(left & ~pruning & ~aside, rejected)
        if not conditions:
            break
        best = pruned(conditions, left, rejected)
        hit = left & covers(best)
        if good(hit, rejected):
            rules.append(rule(best, False, hit))
            left &= ~hit
        elif (pair := with_exception(conditions)) is not None:
            out = left & covers(pair[0])
            hit = left & covers(pair[1]) & ~out
            rules += [rule(pair[0], True, out), rule(pair[1], False, hit)]
            left &= ~(out | hit)
        else:
            more = left & covers(conditions) & rejected & ~aside
            if not more.any():
                break
            aside |= more
    return rules


def verdict(rules: list[Rule]) -> Column:
    """The list as one expression over COUNTS: true for kept."""
    chain, by_name = None, features()
    for rule in rules:
        test = None
        for c in rule.conditions:
            test = c.column(by_name) if test is None else test & c.column(by_name)
        chain = F.when(test, F.lit(rule.kept)) if chain is None else chain.when(test, F.lit(rule.kept))
    return F.lit(True) if chain is None else chain.otherwise(F.lit(True))


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", max_labelled: int = 20_000, **how) -> list[Rule]:
    """Learns the list from the documents that have a label (0: reject)."""
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(label).cast("int").alias("_label"))
    total = known.count()
    if not total:
        return []
    if total > max_labelled:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * max_labelled / total))
    # at most about max_labelled ids of 8 bytes: small whatever the corpus is
    counted = with_counts(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id"))
    names = list(features())
    counted = counted.where(~base_failed())  # the list is only asked about the others
    # the limit only binds where some doc_id is on very many rows
    rows = counted.select("doc_id", "_label", *(v.alias(f"f_{k}") for k, v in features().items())).limit(2 * max_labelled).toPandas()
    rows = rows.sort_values(["doc_id", *(f"f_{k}" for k in names)], kind="stable")
    if rows["_label"].nunique() < 2:
        return []
    return learn(rows[[f"f_{k}" for k in names]].to_numpy(np.float64), rows["_label"].to_numpy() == 0, names, **how)


def judge(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Adds COUNTS, base_failed and kept."""
    return with_counts(docs).withColumn("base_failed", base_failed()).withColumn("kept", F.when(F.col("base_failed"), F.lit(False)).otherwise(verdict(rules)))


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rules = fit(docs, table(spark, sf_dir, "labels"))
    return judge(docs, rules).select("doc_id", *COUNTS[:5], "base_failed", "kept")
