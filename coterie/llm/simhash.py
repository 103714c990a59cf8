"""SimHash near-duplicates with bit-sliced comparison.

A fingerprint has a bit set where more than half of the text's shingle hashes have
it. Two fingerprints link if they differ in at most `radius` bits; the classes are
the components of the links.

Candidates meet in the buckets of tables, each keyed by some of the bits:

* With a radius of a few bits, by the pigeonhole: the bits are cut into radius + r
  blocks and each choice of r blocks is a table. Fingerprints within the radius
  agree on some r blocks, so every link is found. r grows with the number of
  fingerprints, so that buckets stay small.
* With a similarity (share of common distinct shingles), fingerprints have 256 bits, the
  radius follows from the angle that belongs to the similarity, and tables draw
  their bits at random: as many tables as find a pair of just that similarity with
  probability `recall`; nearer pairs are found more surely, and a class needs only
  some of its pairs. Within the classes so found, fingerprints of 2048 bits pass over
  pairs far below the similarity, and every other pair is decided by the Jaccard
  similarity of its two sets of shingles (by their 64-bit hashes), unless other links
  join it already.

Inside a bucket, fingerprints are stored as bit planes, 64 of them in a machine
word. A chunk of queries is compared with a whole block at once: planes of
differing bits go eight at a time through carry-save adders into vertical counters,
and a query leaves the block once all its lanes are known to exceed the radius.
What is left is counted exactly. Every pair of a bucket is compared, whatever its
size: a bucket above `bucket_rows` is cut into parts, and each pair of parts is a
group of its own in another task.

Equal fingerprints are one node, so copies cost nothing beyond their hash, and a
group sends on only the links that connect something new within it.

Edge cases: a null text is an empty one; a text without words has fingerprint 0,
which links like any other; fewer words than a shingle has make one shingle of
all; repeated rows stay; where every doc_id of a component is null its id is null.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coterie.llm.common import bytes_list, documents, shared_folder, sub_batches, tidied
from coterie.llm.components import components

SEED = 42
BITS = np.arange(64, dtype=np.uint64)
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


def shingle_hashes(words: list[bytes], width: int) -> list[int]:
    if not words:
        return []
    hashed, line = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= width:
        return [hashed(line, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = [0, *(ends[:-width] + 1).tolist()]
    return [hashed(line[i:j], SEED) for i, j in zip(starts, ends[width - 1 :].tolist())]


def spread(hashes: np.ndarray, words: int) -> np.ndarray:
    """Each hash followed by words - 1 others derived from it: (n, words)."""
    out = np.empty((len(hashes), words), np.uint64)
    out[:, 0] = hashes
    for k in range(1, words):
        x = hashes + np.uint64(k * 0x9E3779B97F4A7C15 % (1 << 64))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        out[:, k] = x ^ (x >> np.uint64(31))
    return out


def fingerprints_of(texts: list[bytes], width: int, words: int = 1, once: bool = False) -> np.ndarray:
    """(texts, words) of uint64; once: a shingle found again in its text doesn't count again."""
    hashes, counts = [], np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        found = shingle_hashes(text.lower().split(), width)  # bytes.lower() changes A-Z only
        found = list(set(found)) if once else found
        hashes += found
        counts[i] = len(found)
    hashed, ends = np.array(hashes, np.uint64), np.cumsum(counts)
    out = np.zeros((len(texts), words), np.uint64)
    at, lot = 0, 200_000 // words  # shingles whose bits are held at once
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + lot, "right")))
        lo, hi = (int(ends[at - 1]) if at else 0), int(ends[to - 1])
        some = at + np.flatnonzero(counts[at:to])
        if len(some):
            sums = 0
            begins = (ends - counts)[some]
            if hi - lo <= 2 * lot:
                bits = np.unpackbits(spread(hashed[lo:hi], words).view(np.uint8).reshape(hi - lo, -1), axis=1, bitorder="little")
                sums = np.add.reduceat(bits, begins - lo, axis=0, dtype=np.int64)
            else:  # one very long text, in parts
                for i in range(lo, hi, lot):
                    part = spread(hashed[i : min(hi, i + lot)], words)
                    sums = sums + np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)[None]
            over = (2 * sums > counts[some, None]).reshape(len(some), words, 64)
            out[some] = (over.astype(np.uint64) << BITS).sum(axis=2, dtype=np.uint64)
        at = to
    return out


class Shingles:
    """The sets of distinct shingle hashes of a group's texts, each made when it is first asked for."""

    def __init__(self, texts: list[bytes], width: int, similarity: float):
        self.texts, self.width, self.least, self.sets = texts, width, Fraction(str(similarity)), {}

    def of(self, i: int) -> np.ndarray:
        if i not in self.sets:
            self.sets[i] = np.unique(np.array(shingle_hashes(self.texts[i].lower().split(), self.width), np.uint64))
        return self.sets[i]

    def similar(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whether each pair's common shingles are at least the given share of all of the two; two empty sets are equal."""
        out = np.zeros(len(i), bool)
        for k, (x, y) in enumerate(zip(i.tolist(), j.tolist())):
            a, b = self.of(x), self.of(y)
            if min(len(a), len(b)) * self.least.denominator < max(len(a), len(b)) * self.least.numerator:
                continue
            both = np.sort(np.concatenate([a, b]))
            common = int((both[1:] == both[:-1]).sum())
            out[k] = common * self.least.denominator >= (len(both) - common) * self.least.numerator
        return out


def to_binary(fps: np.ndarray) -> pa.Array:
    """Fingerprints as big-endian bytes."""
    n, words = fps.shape
    data = fps.astype(">u8").tobytes()
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * 8 * words, 8 * words, dtype=np.int32)), pa.py_buffer(data)]) if n else pa.array([], pa.binary())


def from_binary(column, words: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), ">u8").astype(np.uint64).reshape(-1, words)


def fingerprints(df: DataFrame, width: int = 5, words: int = 1, once: bool = False, text: str = "text", name: str = "fp") -> DataFrame:
    """Adds the column `name` (binary, 8 bytes a word)."""
    kept = [c for c in df.columns if c != name]
    out = T.StructType([*(df.schema[c] for c in kept), T.StructField(name, T.BinaryType(), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sub_batches(batch, text, 1 << 20):
                found = fingerprints_of(bytes_list(part.column(part.schema.get_field_index(text))), width, words, once)
                yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), to_binary(found)], [*kept, name])

    return df.select(*kept).mapInArrow(tidied(run), out)


def bits_of(fps: np.ndarray) -> np.ndarray:
    """(n, 64 * words) of 0 and 1; bit b of word k is column 64k + b."""
    return np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")


def planes(bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bit planes of a block, bits x words of 64 lanes, and the lanes of the last word that hold nothing."""
    n = len(bits)
    room = -(-n // 64) * 64
    wide = np.zeros((bits.shape[1], room), np.uint8)
    wide[:, :n] = bits.T
    empty = np.zeros(room, np.uint8)
    empty[n:] = 1
    pack = lambda x: np.packbits(x, axis=-1, bitorder="little").view(np.uint64)
    return pack(wide), pack(empty)


def near(queries: np.ndarray, stored: tuple[np.ndarray, np.ndarray], radius: int, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, lane) that may differ in at most radius bits; queries: their bits, a multiple of 8."""
    flat, empty = stored
    live = np.arange(len(queries))
    ask = np.where(queries.astype(bool), FULL, np.uint64(0))
    shape = (len(queries), flat.shape[1])
    low = [np.zeros(shape, np.uint64) for _ in range(3)]  # ones, twos, fours
    most = radius // 8
    start = (1 << most.bit_length()) - 1 - most  # eights begin there, so that they overflow beyond `most`
    high = [np.full(shape, FULL if start >> k & 1 else 0, np.uint64) for k in range(most.bit_length())]
    over = np.repeat(empty[None, :], len(queries), axis=0)

    def add(a, b, c):
        u = a ^ b
        return u ^ c, (a & b) | (u & c)

    for at in range(0, len(order), 8):
        d = [flat[b][None, :] ^ ask[:, b, None] for b in order[at : at + 8]]
        ones, twos, fours = low
        ones, ta = add(ones, d[0], d[1])
        ones, tb = add(ones, d[2], d[3])
        twos, fa = add(twos, ta, tb)
        ones, ta = add(ones, d[4], d[5])
        ones, tb = add(ones, d[6], d[7])
        twos, fb = add(twos, ta, tb)
        fours, carry = add(fours, fa, fb)
        low = [ones, twos, fours]
        for k, h in enumerate(high):
            high[k], carry = h ^ carry, h & carry
        over |= carry
        going = ~(over == FULL).all(axis=1)
        if not going.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if going.mean() < 0.8:
            live, ask, over = live[going], ask[going], over[going]
            low, high = [x[going] for x in low], [x[going] for x in high]
    q, lane = np.nonzero(np.unpackbits((~over).view(np.uint8), axis=1, bitorder="little"))
    return live[q], lane


class Forest:
    """Labels of a group's members; tells which links connect something new.

    known: names of classes that members are known to be in (one of each class has to be met only).
    """

    def __init__(self, n: int, known: list[bytes] | None = None):
        self.label = np.arange(n)
        if known is not None:
            first: dict[bytes, int] = {}
            self.label = np.array([first.setdefault(x, i) for i, x in enumerate(known)], np.int64)

    def add(self, i: np.ndarray, j: np.ndarray) -> tuple[list[int], list[int]]:
        a, b = self.label[i], self.label[j]
        new = np.flatnonzero(a != b)
        if not len(new):
            return [], []
        _, first = np.unique(np.minimum(a, b)[new] * len(self.label) + np.maximum(a, b)[new], return_index=True)
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while x in root:
                x = root[x]
            return x

        left, right = [], []
        for k in new[first].tolist():
            x, y = find(int(a[k])), find(int(b[k]))
            if x != y:
                root[max(x, y)] = min(x, y)
                left.append(int(i[k]))
                right.append(int(j[k]))
        moved = np.array(sorted(root))
        to = np.arange(len(self.label))
        to[moved] = [find(int(x)) for x in moved]
        self.label = to[self.label]
        return left, right


def links_within(members: np.ndarray, radius: int, order: np.ndarray, block: int = 1024, chunk: int = 128, similar=None, lot: int = 256, known: list[bytes] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """A spanning set of the links among fingerprints (rows of members), as row numbers; compares all pairs.

    similar(i, j), if given, decides the pairs within the radius that nothing links yet, up to `lot` at a time.
    """
    forest, left, right = Forest(len(members), known), [], []
    for lo in range(0, len(members), block):
        stored = planes(bits_of(members[lo : lo + block]))
        for q in range(0, min(len(members), lo + block), chunk):
            i, lane = near(bits_of(members[q : q + chunk]), stored, radius, order)
            i, j = i + q, lane + lo
            keep = i < j
            i, j = i[keep], j[keep]
            if known is not None:
                apart = forest.label[i] != forest.label[j]
                i, j = i[apart], j[apart]
            keep = np.bitwise_count(members[i] ^ members[j]).sum(axis=1) <= radius
            i, j = i[keep], j[keep]
            while len(i):
                n = len(i) if similar is None else lot
                now, then = i[:n], j[:n]
                if similar is not None:
                    sure = similar(now, then)
                    now, then = now[sure], then[sure]
                a, b = forest.add(now, then)
                left += a
                right += b
                i, j = i[n:], j[n:]
                apart = forest.label[i] != forest.label[j]
                i, j = i[apart], j[apart]
    return np.array(left, np.int64), np.array(right, np.int64)


def pigeonhole_tables(n: int, radius: int) -> list[np.ndarray]:
    """Bits of each table: fingerprints of 64 bits within the radius agree on all bits of one."""
    r = 1
    while r < 5 and n > 64 << (64 * r // (radius + r)):
        r += 1
    cuts = np.linspace(0, 64, radius + r + 1).astype(int)
    return [np.concatenate([np.arange(cuts[i], cuts[i + 1]) for i in chosen]) for chosen in combinations(range(radius + r), r)]


def differing(similarity: float) -> float:
    """The expected share of differing bits at a Jaccard similarity of shingle sets of one size."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def random_tables(n: int, similarity: float, words: int, recall: float, seed: int = 11) -> list[np.ndarray]:
    """Bits of each table: enough tables to find a pair of the similarity with the given probability."""
    k = int(np.clip(math.ceil(math.log2(max(n, 1) / 64 + 1)), 10, 48))
    count = math.ceil(math.log(1 - recall) / math.log(1 - (1 - differing(similarity)) ** k))
    rng, out, order = np.random.default_rng(seed), [], []
    while len(out) < count:
        if len(order) < k:
            order = rng.permutation(64 * words).tolist()
        out.append(np.sort([order.pop() for _ in range(k)]))
    return out


def keys_of(bits: np.ndarray, table: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bits), np.int64)
    for b in table:
        out = (out << 1) | bits[:, b]
    return out


def linked(fps: DataFrame, tables: list[np.ndarray], words: int, radius: int, rows: int, bucket_rows: int = 4096) -> DataFrame:
    """Links (a, b) that span every class among the distinct values of the column fp (binary)."""

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                column = batch.slice(at, 4096).column(0)
                bits = bits_of(from_binary(column, words))
                for t, table in enumerate(tables):
                    yield pa.RecordBatch.from_arrays([column, pa.array(np.full(len(bits), t, np.int32)), pa.array(keys_of(bits, table))], ["fp", "t", "key"])

    keyed = fps.select("fp").mapInArrow(tidied(key), "fp binary, t int, key long")
    outside = [np.concatenate([np.setdiff1d(np.arange(64 * words), t), t]) for t in tables]  # bits in which a bucket can differ come first
    return within_buckets(keyed, outside, words, radius, rows * len(tables), bucket_rows)


def within_buckets(keyed: DataFrame, orders: list[np.ndarray], words: int, radius: int, rows: int, bucket_rows: int = 4096, similarity: float = 0.0, width: int = 0, across: bool = True) -> DataFrame:
    """Links (a, b) that span every class within each bucket (t, key) of keyed, or without `across` within each part of one.

    keyed: as for grouped_links, without x and y. A bucket above bucket_rows is cut into
    parts by the hash of fp, and a member meets each part in a group of its own.
    """
    large = keyed.groupBy("t", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows)
    parts = F.coalesce(F.ceil(F.col("n") / bucket_rows), F.lit(1)).cast("int")
    cut = keyed.join(large, ["t", "key"], "left").withColumn("parts", parts).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).drop("n")
    if across:  # a member of part x meets each part y in the group {x, y}
        cut = cut.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    else:
        cut = cut.withColumn("other", F.col("own"))
    groups = cut.select(*keyed.columns, F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"))
    return grouped_links(groups, orders, words, radius, rows, similarity, width)


def grouped_links(groups: DataFrame, orders: list[np.ndarray], words: int, radius: int, rows: int, similarity: float = 0.0, width: int = 0) -> DataFrame:
    """Links (a, b) that span every class within each group (t, key, x, y); without labels b is one and the same for all of a class there.

    groups has the columns fp (binary, the fingerprint's name), t, key, x, y and, if that is
    not fp itself, print (binary, what is compared). orders: for each t the order in
    which bits are compared. With a column text, pairs within the radius link only if
    the texts' shingles of `width` words have the similarity. With a column label (binary),
    members of one label are linked already, and what links them is not looked for.
    """
    more = [c for c in ("print", "text", "label") if c in groups.columns]
    exact = "text" in more
    groups = groups.select("fp", *more, "t", "key", "x", "y")
    parts_n = max(int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // 400_000)
    dealt = groups.repartition(parts_n, "t", "key", "x", "y").sortWithinPartitions("t", "key", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(members: list[tuple[np.ndarray, list[bytes], list[bytes], list[bytes]]], t: int):
            prints = np.concatenate([p for p, _, _, _ in members])
            names = [x for _, own, _, _ in members for x in own]
            sets = Shingles([x for _, _, own, _ in members for x in own], width, similarity) if exact else None
            known = [x for _, _, _, own in members for x in own] if "label" in more else None
            a, b = links_within(prints, radius, orders[t], similar=sets.similar if exact else None, known=known)
            if known is None and len(a):  # as stars: each member with the first of its class, which names the class
                forest = Forest(len(prints))
                forest.add(a, b)
                a = np.flatnonzero(forest.label != np.arange(len(prints)))
                b = forest.label[a]
            apart = [(names[i], names[j]) for i, j in zip(a.tolist(), b.tolist()) if names[i] != names[j]]
            if apart:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in apart], pa.binary()), pa.array([y for _, y in apart], pa.binary())], ["a", "b"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                if sum(x.num_rows for x in held) >= 1 << 15 or sum(x.nbytes for x in held) >= 32 << 20:
                    held = yield from cut_runs(held, emit, False)
        if held:
            yield from cut_runs(held, emit, True)

    def cut_runs(held, emit, last):
        data = pa.Table.from_batches(held).combine_chunks()
        ids = [data.column(c).to_numpy() for c in ("t", "key", "x", "y")]
        change = np.zeros(data.num_rows, bool)
        for c in ids:
            change[1:] |= c[1:] != c[:-1]
        starts = np.concatenate([[0], np.flatnonzero(change)])
        ends = np.concatenate([starts[1:], [data.num_rows]])
        if not last:  # the last group may go on in the next batch
            starts, ends, rest = starts[:-1], ends[:-1], int(starts[-1])
        else:
            rest = data.num_rows
        room: list[tuple[np.ndarray, list[bytes], list[bytes], list[bytes]]] = []
        have, now = 0, -1
        for i, j in zip(starts.tolist(), ends.tolist()):
            if j - i < 2:
                continue
            t = int(ids[0][i])
            # buckets that follow each other share a block; what links across them is a link, too
            if room and (t != now or have + j - i > 512):
                yield from emit(room, now)
                room, have = [], 0
            own = data.slice(i, j - i)
            room.append((from_binary(own.column("print" if more else "fp"), words), own.column("fp").to_pylist(), bytes_list(own.column("text")) if exact else [], own.column("label").to_pylist() if "label" in more else []))
            have, now = have + j - i, t
        if room:
            yield from emit(room, now)
        return data.slice(rest).to_batches() if rest < data.num_rows else []

    return dealt.mapInArrow(tidied(run), "a binary, b binary")


def radius_of(similarity: float, words: int, deviations: float) -> int:
    p, n = differing(similarity), 64 * words
    return round(n * p + deviations * math.sqrt(n * p * (1 - p)))


#: Members of a class that one task compares, times the words of a fingerprint.
GROUP_WORDS = 8192
#: As how many fingerprints a row with its text counts, where partitions follow the rows.
TEXT_ROWS = 20


def refined(docs: DataFrame, marked: DataFrame, classes: DataFrame, similarity: float, width: int, words: int = 32) -> DataFrame:
    """(node, root) of the classes that stand when pairs of the classes found are decided by their sets of shingles.

    Fingerprints of 64 * words bits pass over pairs beyond five standard deviations of
    the distance at the similarity; a class of many templates would be slow without. Each
    text of a fingerprint in a class with others takes part once.
    """
    rank = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"))
    # copies shrink to a row before the join
    one = marked.groupBy("fp", "th").agg(F.min(rank).alias("r")).join(classes.withColumnRenamed("node", "fp"), "fp")
    one = one.select("fp", "root", F.col("r.none").alias("none"), F.col("r.id").alias("id"), "th")
    texts = docs.select(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), F.xxhash64("text").alias("th"), "text")
    met = texts.join(one, ["none", "id", "th"]).select("fp", "th", F.xxhash64("root").alias("key"), "text")
    wide = fingerprints(met, width, words, True, name="print").checkpoint()
    keyed = wide.dropDuplicates(["fp", "th"]).select("fp", "print", F.lit(0).alias("t"), "key", "text")
    return components(class_links(keyed, words, radius_of(similarity, words, 5.0), similarity, width, max(2, GROUP_WORDS // words), TEXT_ROWS * wide.count()))


def class_links(keyed: DataFrame, words: int, radius: int, similarity: float, width: int, size: int, rows: int = 0) -> DataFrame:
    """Links (a, b) between similar texts that span every class within each key; no task has much more than 2 * size texts of a key.

    Every text meets its own part of its key. Where a key has several parts, one text of
    the largest class of each part meets those of the other parts. By then most texts of a
    group of near copies are one class, and what is left is between texts that are not in
    the key's largest class: they meet each other, and they meet the parts of that class.
    So a key of n texts costs n rows and, for each text outside its largest class, a row a
    part, and no pair of texts goes undecided that nothing else has linked.
    """
    order = [np.random.default_rng(5).permutation(64 * words)]
    how = {"orders": order, "words": words, "radius": radius, "rows": rows, "similarity": similarity, "width": width}
    found = within_buckets(keyed, **how, bucket_rows=size, across=False).checkpoint()
    large = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > size).checkpoint()
    if large.isEmpty():
        return found
    parts = F.ceil(F.col("n") / size).cast("int")
    members = keyed.join(large, "key").withColumn("parts", parts).drop("n")
    members = members.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")).checkpoint()

    def largest(rows: DataFrame, *by: str) -> DataFrame:
        """(by, label) of the class with most members."""
        sizes = rows.groupBy(*by, "label").agg(F.count(F.lit(1)).alias("n"))
        return sizes.groupBy(*by).agg(F.max_by("label", F.struct("n", "label")).alias("label"))

    # labels need only be sound: what has the same one is linked. The stars of the parts say enough for that.
    centre = lambda links, name: links.groupBy(F.col("a").alias("fp")).agg(F.min("b").alias(name))
    own = members.join(centre(found, "own_centre"), "fp", "left").withColumn("label", F.coalesce("own_centre", "fp")).drop("own_centre").checkpoint()
    # the texts that name the largest class of each part
    best = largest(own, "key", "own").select("key", F.col("label").alias("fp")).distinct()
    heads = members.join(best, ["key", "fp"]).dropDuplicates(["key", "fp"]).select(*keyed.columns)
    met = within_buckets(heads, **how, bucket_rows=size).checkpoint()
    found = found.unionByName(met)
    joined = own.join(centre(met, "head").withColumnRenamed("fp", "label"), "label", "left").withColumn("label", F.coalesce("head", "label")).drop("head")
    joined = joined.join(largest(joined, "key").withColumnRenamed("label", "most"), "key").withColumn("out", F.col("label") != F.col("most")).drop("most").checkpoint()
    outside = joined.where("out").select(*keyed.columns, "label")
    if outside.isEmpty():
        return found
    number = outside.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("cuts"))
    cut = joined.join(number, "key").withColumn("cut", F.pmod(F.xxhash64("fp", F.lit(1)), F.col("cuts")).cast("int"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    asking = cut.where("out").withColumn("x", every("parts")).withColumn("y", F.col("cut"))
    asked = cut.where("not out").withColumn("x", F.col("own")).withColumn("y", every("cuts"))
    pairs = grouped_links(asking.unionByName(asked).select(*keyed.columns, "label", "x", "y"), **how)
    return found.unionByName(pairs).unionByName(within_buckets(outside, **how, bucket_rows=size))


def near_duplicates(docs: DataFrame, width: int = 5, radius: int = 3, similarity: float | None = None, recall: float = 0.995) -> DataFrame:
    """(doc_id, th, fp, root, component_id) for each row.

    th is a hash of the text, root the class's smallest fingerprint, component_id its
    smallest doc_id. With `similarity`, fingerprints have 256 bits, count a text's
    shingles once, and `radius` is not used: candidates lie within the expected distance
    at that similarity and three standard deviations, and `refined` decides. A lone pair of
    just the similarity is found with probability recall x 0.998, nearer ones more surely; only
    what has it links.
    """
    spark = docs.sparkSession
    shared_folder(spark)
    words = 1
    if similarity is not None:
        words, radius = 4, radius_of(similarity, 4, 3.0)
    marked = fingerprints(docs.select("doc_id", F.xxhash64("text").alias("th"), "text"), width, words, similarity is not None).drop("text").checkpoint()  # some 30 to 60 bytes a row
    nodes = marked.groupBy("fp").agg(F.min("doc_id").alias("least")).checkpoint()
    n = nodes.count()
    tables = pigeonhole_tables(n, radius) if similarity is None else random_tables(n, similarity, words, recall)
    found = components(linked(nodes, tables, words, radius, n))
    if similarity is not None:
        found = refined(docs, marked, found.checkpoint(), similarity, width)
    roots = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = roots.join(ids, "root").select("fp", "root", "component_id")
    return marked.join(by_fp, "fp").select("doc_id", "th", "fp", "root", "component_id")


def keep_one(docs: DataFrame, similarity: float = 0.8, width: int = 5) -> DataFrame:
    """One row of docs for each class: of its smallest doc_id (a null comes last), then of the smallest hash of the text."""
    classes = near_duplicates(docs, width=width, similarity=similarity).select("root", F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("id"), "th").alias("rank"))
    best = classes.groupBy("root").agg(F.min("rank").alias("best")).select(F.col("best.none").alias("_none"), F.col("best.id").alias("_id"), F.col("best.th").alias("_th"))
    # the row travels as one column, so that no name of docs meets one from here
    keyed = docs.select(F.struct(*docs.columns).alias("row"), F.col("doc_id").isNull().alias("_none"), F.coalesce("doc_id", F.lit(0)).alias("_id"), F.xxhash64("text").alias("_th"))
    met = keyed.join(best, ["_none", "_id", "_th"], "left_semi")
    again = Window.partitionBy("_none", "_id", "_th").orderBy("_th")  # equal rows are copies of each other
    return met.withColumn("_nth", F.row_number().over(again)).where("_nth = 1").select("row.*")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=3).select("doc_id", F.lower(F.hex("fp")).alias("fingerprint"), "component_id")
