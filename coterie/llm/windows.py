"""Repeated windows of fixed length over all documents, in two passes without loss.

A document is a sequence of units (bytes or words). Every window of `window`
units has an anchor: the smallest hash among its grams of `gram` units. Equal
windows have equal anchors at equal offsets, so a window can only occur twice if
its anchor's gram does; there are some 2 / (window - gram + 2) anchors a unit.

Pass one counts anchors. Each task keeps one of those that repeat within it (the
others are known to repeat already), the rest travels to the partition that owns
the hash. The owner adds up a count-min sketch over what the tasks sent, which
overestimates, and groups exactly only what the sketch has at two or more.
Pass two looks again at the documents with a repeated anchor, and only at the
windows that hold one.

Documents are named by 64 bits of doc_id and text, and in pass two by doc_id as well:
rows that share a doc_id but not a text stay apart, equal rows get the same answer. In
pass one two documents with one name would only be looked at more closely than needed.
A null doc_id counts as the smallest number, -2^63 (a row that has that number as its
doc_id is taken for one without).

Partitions follow the bytes of text (one for each `PART_BYTES` at least), so what a task
holds has a bound: some arrays over one chunk of text (or one longer document), the
anchors of what it has read, flushed at a bound, and the share of a partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from coterie.llm.common import bytes_list, sub_batches, tidied

CHUNK, FLUSH = 1 << 19, 3_000_000
#: Text for each partition that owns keys.
PART_BYTES = 32 << 20
BASES = (0x9E3779B97F4A7C15 | 1, 0xC2B2AE3D27D4EB4F | 1, 0xD6E8FEB86659FD93 | 1)
NO_ID = -(1 << 63)
#: What tasks send to the partition `part`: keys with their places, or places known to repeat (key null).
#: Beside the keys of pass one, lens has (row, times) of those that were there more than once.
RECORD = "part int, key binary, key2 binary, doc binary, th binary, pos binary, lens binary"
#: Places on their way to the partition that has all of a document's, and those of one document.
PLACES = "part int, doc binary, th binary, pos binary, lens binary"
MARKS = "doc_id long, th long, starts binary, lens binary"
#: The part of rows that hold keys of very many places.
HOT = -1

_POWERS: dict[tuple[int, bool], np.ndarray] = {}


def powers(base: int, n: int, inverse: bool = False) -> np.ndarray:
    got = _POWERS.get((base, inverse))
    if got is None or len(got) < n:
        size = 1 << max(20, int(n).bit_length())
        step = pow(base, -1, 1 << 64) if inverse else base
        got = np.ones(size, np.uint64)
        got[1:] = np.uint64(step)
        _POWERS[base, inverse] = got = np.multiply.accumulate(got)
    return got[:n]


def finished(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(29))


class Rolling:
    """Hashes of any ranges of a sequence of unsigned numbers."""

    def __init__(self, units: np.ndarray, base: int = BASES[0]):
        n = len(units)
        self.base = base
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum((units.astype(np.uint64) + np.uint64(1)) * powers(base, n), out=self.sums[1:])

    def ranges(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        back = powers(self.base, len(self.sums), True)
        return finished((self.sums[hi] - self.sums[lo]) * back[lo] + (hi - lo).astype(np.uint64))

    def grams(self, k: int) -> np.ndarray:
        m = max(0, len(self.sums) - k)
        return finished((self.sums[k:] - self.sums[:m]) * powers(self.base, len(self.sums), True)[:m] + np.uint64(k))


class Chunk:
    """Some documents end to end: units, where each begins, and each unit's place."""

    def __init__(self, units: np.ndarray, sizes: np.ndarray, window: int, gram: int):
        self.n, self.window, self.gram = len(units), window, gram
        self.sizes = sizes
        self.begins = np.cumsum(sizes) - sizes
        self.roll = Rolling(units)
        m = self.n - window + 1
        if m <= 0:
            self.starts = self.anchor = self.owner = np.zeros(0, np.int64)
            self.hashes = np.zeros(0, np.uint64)
            return
        self.hashes = self.roll.grams(gram)
        # 32 bits of the hash, then the place: the same bits in every chunk, so that equal windows choose alike
        bits = np.uint64(0xFFFFFFFF)
        v = (self.hashes & ~bits) | np.arange(len(self.hashes), dtype=np.uint64)
        width, span = window - gram + 1, 1
        while 2 * span <= width:
            v = np.minimum(v[: len(v) - span], v[span:])
            span *= 2
        if span < width:
            v = np.minimum(v[: len(v) - (width - span)], v[width - span :])
        anchor = (v & bits).astype(np.int64)  # of the window that starts at each place
        fits = np.zeros(self.n + 1, np.int32)
        some = sizes >= window
        np.add.at(fits, self.begins[some], 1)
        np.add.at(fits, self.begins[some] + sizes[some] - window + 1, -1)
        self.starts = np.flatnonzero(np.cumsum(fits[:m]))
        self.anchor = anchor[self.starts]
        self.owner = np.searchsorted(self.begins + sizes, self.starts, "right")

    def anchors(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(hash, document, place in it) of each anchor once."""
        if not len(self.starts):
            return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        new = np.concatenate([[True], (self.anchor[1:] != self.anchor[:-1]) | (self.owner[1:] != self.owner[:-1])])
        at, owner = self.anchor[new], self.owner[new]
        return self.hashes[at], owner, at - self.begins[owner]


Units = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


def byte_units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(texts), np.uint8), np.fromiter(map(len, texts), np.int64, len(texts))


_BLANK = np.zeros(256, bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True


def word_places(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of the texts: the joined bytes, each word's range there, and how many each text has."""
    joined = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    solid = ~_BLANK[joined]
    edge = np.flatnonzero(np.diff(np.concatenate([[False], solid]).astype(np.int8)))
    lo, hi = edge[::2], edge[1::2]
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
    return joined, lo, hi, np.diff(np.searchsorted(lo, ends), prepend=0)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(BASES[1])
    return x ^ (x >> np.uint64(32))


def _blended(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mixed(a * np.uint64(BASES[0]) + b * np.uint64(BASES[2]))


#: The bytes of a word that are kept of eight, by how many it has there.
_FRONT = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def word_hashes(joined: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """(words, 2): two independent 64-bit hashes of the bytes of each word joined[lo:hi].

    Up to 16 bytes and their number are mixed whole, in another order for each hash; a longer
    word has XXH3. Nothing is a sum over places, in which changes could cancel out.
    """
    padded = np.zeros(len(joined) + 16, np.uint8)
    padded[: len(joined)] = joined
    eight = np.ndarray((len(joined) + 9,), "<u8", padded, strides=(1,))  # the 8 bytes from each place
    size = hi - lo
    front, rest = eight[lo] & _FRONT[np.minimum(size, 8)], eight[lo + 8 * (size > 8)] & _FRONT[np.clip(size - 8, 0, 8)]
    number = size.astype(np.uint64)
    out = np.empty((len(lo), 2), np.uint64)
    out[:, 0] = _blended(_mixed(front ^ number * np.uint64(BASES[1])), rest)
    out[:, 1] = _blended(_mixed(rest ^ (number + np.uint64(77)) * np.uint64(BASES[2])), _mixed(front ^ np.uint64(BASES[1])))
    for i in np.flatnonzero(size > 16).tolist():
        out[i] = np.frombuffer(xxhash.xxh3_128_digest(joined[lo[i] : hi[i]].tobytes()), np.uint64)
    return out


def word_lanes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """word_hashes of all words of the texts, and how many each text has."""
    joined, lo, hi, sizes = word_places(texts)
    return word_hashes(joined, lo, hi), sizes


def word_units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    lanes, sizes = word_lanes(texts)
    return lanes[:, 0].copy(), sizes


def window_keys(units: np.ndarray, window: int) -> np.ndarray:
    """A hash of the units of each window: runs of 1, 2, 4, ... units are blended pair by pair, the last two overlapping.

    Each step is a full mix, so no arrangement of units cancels out, as it can in a sum of powers.
    """
    span, out = 1, units
    while 2 * span <= window:
        out = _blended(out[: max(0, len(out) - span)], out[span:])
        span *= 2
    rest = window - span
    return _blended(out[: max(0, len(out) - rest)], out[rest:]) if rest else out


def chunks(batches: Iterator[pa.RecordBatch], columns: list[str]):
    """For each chunk: texts as bytes and the other columns as lists of arrow arrays."""
    for batch in batches:
        for part in sub_batches(batch, "text", CHUNK):
            col = lambda c: part.column(part.schema.get_field_index(c))  # noqa: B023, E731
            yield bytes_list(col("text")), [col(c) for c in columns]


def keyed(docs: DataFrame, carried: tuple[str, ...] = ()) -> DataFrame:
    """The columns doc_id (null: NO_ID), th (of doc_id and text) and text, by which documents are found again, and those carried."""
    return docs.select(F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64("doc_id", "text").alias("th"), "text", *carried)


def by_slice(slices: np.ndarray, columns: list[np.ndarray]):
    """(slice, columns) for each slice that has rows; rows keep their order."""
    order = np.argsort(slices, kind="stable")
    s = slices[order]
    cuts = np.flatnonzero(np.diff(s)) + 1
    for at in np.split(order, cuts) if len(order) else []:
        yield int(slices[at[0]]), [c[at] for c in columns]


def part_of(th: np.ndarray, n: int) -> np.ndarray:
    """The partition, of n, that gathers a document's places; rows with one id are spread by their texts."""
    return (finished(th.view(np.uint64)) % np.uint64(n)).astype(np.int64)


def packed(part: int, names: list[str], columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *(pa.array([x if x is None else x.tobytes()], pa.binary()) for x in columns)], ["part", *names])


RECORD_NAMES, PLACE_NAMES = ["key", "key2", "doc", "th", "pos", "lens"], ["doc", "th", "pos", "lens"]


def first_of_keys(key: np.ndarray, key2: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(a row of each key, how often each row's key is there)."""
    order = np.lexsort((key,) if key2 is None else (key2, key))
    a = key[order]
    new = np.ones(len(order), bool)
    new[1:] = a[1:] != a[:-1]
    if key2 is not None:
        new[1:] |= key2[order][1:] != key2[order][:-1]
    group = np.cumsum(new) - 1
    times = np.empty(len(key), np.int64)
    times[order] = np.bincount(group)[group] if len(order) else 0
    return order[new], times


class Sender:
    """Collects (key, key2, document, th, place) of a task and makes rows for the owners; key2 and document may be None.

    Keys met twice here are settled here: their places go on without a key, and
    one of them with it, so that no owner gets more than one row of a key and flush.
    """

    def __init__(self, n: int):
        self.n, self.held, self.size = n, [], 0

    def add(self, *columns):
        self.held.append(columns)
        self.size += len(columns[0])
        if self.size >= FLUSH:
            yield from self.flush()

    def flush(self):
        if not self.size:
            return
        key, key2, doc, th, pos = (None if x[0] is None else np.concatenate(x) for x in zip(*self.held))
        self.held, self.size = [], 0
        first, times = first_of_keys(key, key2)
        first.sort()
        picked = [key[first], key2 if key2 is None else key2[first], doc if doc is None else doc[first], th[first], pos[first], times[first].astype(np.int32)]
        for s, (i,) in by_slice((picked[0] % np.uint64(self.n)).astype(np.int64), [np.arange(len(first))]):
            own = [x if x is None else x[i] for x in picked]
            often = np.flatnonzero(own[5] > 1).astype(np.int32)
            own[5] = np.stack([often, own[5][often]], axis=1) if len(often) else None
            yield packed(s, RECORD_NAMES, own)
        many = times > 1
        for s, (i,) in by_slice(part_of(th[many], self.n), [np.flatnonzero(many)]):
            yield packed(s, RECORD_NAMES, (None, None, doc if doc is None else doc[i], th[i], pos[i], None))


class Sketch:
    """Count-min over 64-bit keys, counts up to 255; sketches of the same width add up."""

    def __init__(self, width: int, rows: int = 2):
        self.mask = np.uint64(width - 1)
        self.cells = np.zeros((rows, width), np.uint8)

    def places(self, keys: np.ndarray, row: int) -> np.ndarray:
        return ((keys >> np.uint64(7 + 23 * row)) & self.mask).astype(np.int64)

    def add(self, keys: np.ndarray) -> None:
        """Adds the sketch of some keys; its cost has a part in the width, so keys come in large lots."""
        for row, cells in enumerate(self.cells):
            seen = np.bincount(self.places(keys, row), minlength=len(cells))
            np.minimum(cells + seen, 255, out=seen)
            cells[:] = seen

    def estimate(self, keys: np.ndarray) -> np.ndarray:
        return np.minimum.reduce([cells[self.places(keys, row)] for row, cells in enumerate(self.cells)])


def per_document(doc: np.ndarray, th: np.ndarray, pos: np.ndarray, lens: np.ndarray | None = None):
    """One row (doc_id, th, starts, lens) for each document."""
    if not len(doc):
        return
    order = np.lexsort((pos, th, doc))
    doc, th, pos = doc[order], th[order], pos[order].astype(np.int32)
    lens = np.ones(len(doc), np.int32) if lens is None else lens[order].astype(np.int32)
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])]))
    ends = [*new[1:].tolist(), len(doc)]
    yield pa.RecordBatch.from_arrays([pa.array(doc[new]), pa.array(th[new]), *(pa.array([x[i:j].tobytes() for i, j in zip(new.tolist(), ends)], pa.binary()) for x in (pos, lens))], ["doc_id", "th", "starts", "lens"])


def owners(n: int, hot: int = 0):
    """For mapInArrow: PLACES of the keys that are there twice or more, among all that a partition owns.

    hot: keys of more places than that go out as well, in a row of the part HOT.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent, often = [], []
        for batch in batches:
            for row in batch.to_pylist():
                if row["key"] is None:
                    yield pa.RecordBatch.from_pylist([{c: row[c] for c in ("part", *PLACE_NAMES)}], schema=PLACES_ARROW)
                    continue
                get = lambda name, kind: None if row[name] is None else np.frombuffer(row[name], kind)  # noqa: B023, E731
                part = (get("key", np.uint64), get("key2", np.uint64), get("doc", np.int64), get("th", np.int64), get("pos", np.int32))
                sent.append(part)
                if hot and row["lens"] is not None:
                    at, times = get("lens", np.int32).reshape(-1, 2).T
                    often.append((part[0][at], times - 1))
        if not sent:
            return
        total = sum(len(x[0]) for x in sent)
        merged, lot = Sketch(1 << max(12, int(2 * total).bit_length())), []
        for i, part in enumerate(sent):
            lot.append(part[0])
            if sum(map(len, lot)) >= len(merged.cells[0]) // 4 or i == len(sent) - 1:
                merged.add(np.concatenate(lot))
                lot = []
        kept = []
        while sent:
            part = sent.pop()
            likely = merged.estimate(part[0]) >= 2
            kept.append([c if c is None else c[likely] for c in part])
        key, key2, doc, th, pos = (None if x[0] is None else np.concatenate(x) for x in zip(*kept))
        _, times = first_of_keys(key, key2)
        many = times > 1
        for s, (i,) in by_slice(part_of(th[many], n), [np.flatnonzero(many)]):
            yield packed(s, PLACE_NAMES, (doc if doc is None else doc[i], th[i], pos[i], None))
        if hot:
            keys = np.concatenate([key, *(k for k, _ in often)])
            more = np.concatenate([np.ones(len(key), np.int64), *(t for _, t in often)])
            each, at = np.unique(keys, return_inverse=True)
            great = each[np.bincount(at, weights=more, minlength=len(each)) > hot]
            if len(great):
                yield packed(HOT, PLACE_NAMES, (None, great, None, None))

    return run


PLACES_ARROW = pa.schema([("part", pa.int32()), *((c, pa.binary()) for c in PLACE_NAMES)])


def merged_places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each document whose places this partition has."""
    got = []
    for batch in batches:
        for row in batch.to_pylist():
            th = np.frombuffer(row["th"], np.int64)
            doc = np.frombuffer(row["doc"], np.int64) if row["doc"] is not None else np.zeros(len(th), np.int64)
            lens = np.frombuffer(row["lens"], np.int32) if row["lens"] is not None else np.ones(len(th), np.int32)
            got.append((doc, th, np.frombuffer(row["pos"], np.int32), lens))
    if got:
        yield from per_document(*(np.concatenate(x) for x in zip(*got)))


def by_document(places: DataFrame, n: int) -> DataFrame:
    """MARKS from PLACES: all places of a document in one row."""
    return places.repartitionById(n, "part").mapInArrow(tidied(merged_places), MARKS)


def text_bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def partitions_for(docs: DataFrame, size: int) -> int:
    """How many partitions own the keys of so many bytes of text."""
    return max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // PART_BYTES))


def found_anchors(docs: DataFrame, units: Units, window: int, gram: int, n: int, hot: int = 0) -> DataFrame:
    """PLACES of repeated anchors, by th alone; with rows of the part HOT for those of more than `hot` places."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Sender(n)
        for texts, (ths,) in chunks(batches, ["th"]):
            data, sizes = units(texts)
            key, owner, pos = Chunk(data, sizes, window, gram).anchors()
            yield from out.add(key, None, None, ths.to_numpy()[owner], pos.astype(np.int32))
        yield from out.flush()

    return docs.select("th", "text").mapInArrow(tidied(send), RECORD).repartitionById(n, "part").mapInArrow(tidied(owners(n, hot)), PLACES)


def places_of(found: DataFrame, n: int) -> DataFrame:
    """(th, places): int32 places of repeated anchors, for each document with one."""
    return by_document(found, n).select("th", F.col("starts").alias("places"))


def with_marks(docs: DataFrame, marks: DataFrame) -> DataFrame:
    """docs (as from keyed()) with the starts and lens of their MARKS, or nulls.

    Rows meet by th, as they do when places are looked up, so that one shuffle of the texts
    serves both; that doc_id is the same as well is a condition beside the join's key.
    """
    own = marks.select(F.col("th").alias("_th"), F.col("doc_id").alias("_id"), "starts", "lens")
    return docs.join(own, (docs["th"] == own["_th"]) & (docs["doc_id"].bitwiseXOR(own["_id"]) == 0), "left").drop("_th", "_id")


def flagged_windows(chunk: Chunk, places) -> np.ndarray:
    """Rows of chunk.starts whose anchor is among the documents' repeated ones."""
    flag = np.zeros(chunk.n + 1, bool)
    for begin, size, own in zip(chunk.begins.tolist(), chunk.sizes.tolist(), places):
        if own:
            at = np.frombuffer(own, np.int32)
            flag[begin + at[at < size]] = True
    return np.flatnonzero(flag[chunk.anchor])


def covered(size: int, starts: bytes, lens: bytes, window: int) -> np.ndarray:
    """Which units of a document the runs of marked windows cover."""
    step = np.zeros(size + 1, np.int32)
    lo = np.frombuffer(starts, np.int32).astype(np.int64)
    np.add.at(step, lo, 1)
    np.add.at(step, lo + np.frombuffer(lens, np.int32) - 1 + window, -1)
    return np.cumsum(step[:-1]) > 0
