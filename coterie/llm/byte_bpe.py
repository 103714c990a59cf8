"""Byte-level BPE as a monoid: texts are encoded by a balanced tree of joins.

Two trees are used, one inside the other.

* Over a text: halves are cut into pattern matches on their own, and two
  neighbours are joined by matching again from the last boundary on the left
  that nothing on the right can move, through a growing window, until a boundary
  of the right half is met. The pattern has no memory, so from a common boundary
  on both cuts are the same.
* Over one match: halves are merged on their own, and two token sequences are
  joined by merging the bytes of a growing window at the border again. The join
  stops when the tokens at both rims of the window form stable pairs with their
  neighbours: if every adjacent pair of tokens is the encoding of its own bytes,
  no merge ever crosses a token border, so the sequence is the encoding.

Decoding concatenates the bytes of halves up the same kind of tree.

Edge cases: a null text counts as empty and gives no ids; ids outside the
vocabulary raise ValueError when decoding; texts are never cut or skipped.
Memory in a worker is bounded by one sub-batch and two bounded caches.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coterie.llm.common import documents, sub_batches, tidied

#: Characters a leaf of the text tree has, bytes a leaf of the merge tree has.
TEXT_LEAF, MERGE_LEAF = 4096, 12
#: Characters after a match's start that can decide which kind of match it is: an apostrophe and two letters
#: in the usual pattern. For a pattern that looks further, `lookahead` must be raised.
LOOKAHEAD = 3
#: Entries of the caches in a worker.
CACHE = 600_000
NEVER = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class Pieces(dict):
    """Ids of matches, made when missing. Of two generations the older one goes when the newer is full."""

    def __init__(self, make, most: int = CACHE):
        self.make, self.most, self.older = make, most // 2, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.make(piece)
        if len(piece) <= 64:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """The encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, lookahead: int = LOOKAHEAD):
        self.ranks, self.pattern, self.lookahead = ranks, regex.compile(pattern), lookahead
        self._pieces = Pieces(self.encode_piece)
        self._pairs: dict[tuple[bytes, bytes], bool] = {}
        size = max(ranks.values()) + 1
        lengths = np.zeros(size, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        self.token_len, self.token_at = lengths, np.concatenate([[0], np.cumsum(lengths)[:-1]])
        by_rank = [b""] * size
        for token, rank in ranks.items():
            by_rank[rank] = token
        self.blob = np.frombuffer(b"".join(by_rank), np.uint8)

    # merging inside one match
    def _merge(self, data: bytes) -> list[bytes]:
        """Tokens of a short byte string: the lowest rank first, the leftmost of equals."""
        parts, get = [data[i : i + 1] for i in range(len(data))], self.ranks.get
        pairs = [get(data[i : i + 2], NEVER) for i in range(len(data) - 1)]
        while pairs:
            best = min(pairs)
            if best == NEVER:
                break
            at = pairs.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = get(parts[at - 1] + parts[at], NEVER)
            if at < len(pairs):
                pairs[at] = get(parts[at] + parts[at + 1], NEVER)
        return parts

    def _stable(self, a: bytes, b: bytes) -> bool:
        known = self._pairs.get((a, b))
        if known is None:
            if len(self._pairs) >= CACHE:
                self._pairs.clear()
            known = self._pairs[a, b] = self._merge(a + b) == [a, b]
        return known

    def join_tokens(self, left: list[bytes], right: list[bytes]) -> list[bytes]:
        """The encoding of the bytes of both sides, from the encodings of each."""
        if not left or not right:
            return left or right
        a = b = 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            middle = self._merge(b"".join(left[-a:]) + b"".join(right[:b]))
            fits_left = a == len(left) or self._stable(left[-a - 1], middle[0])
            fits_right = b == len(right) or self._stable(middle[-1], right[b])
            if fits_left and fits_right:
                return left[:-a] + middle + right[b:]
            a, b = a if fits_left else 2 * a, b if fits_right else 2 * b

    def merge_tree(self, data: bytes) -> list[bytes]:
        if len(data) <= MERGE_LEAF:
            return self._merge(data)
        half = len(data) // 2
        return self.join_tokens(self.merge_tree(data[:half]), self.merge_tree(data[half:]))

    def encode_piece(self, piece: str) -> bytes:
        """Ids of one match as int32 bytes."""
        data = piece.encode("utf-8", "surrogatepass")
        whole = self.ranks.get(data)
        return array("i", [whole] if whole is not None else [self.ranks[t] for t in self.merge_tree(data)]).tobytes()

    # cutting a text into matches
    def cut_tree(self, text: str, lo: int = 0, hi: int | None = None) -> list[str]:
        """The matches of text[lo:hi] taken as a text of its own."""
        hi = len(text) if hi is None else hi
        if hi - lo <= TEXT_LEAF:
            return self.pattern.findall(text[lo:hi])
        mid = (lo + hi) // 2
        return self._join_cuts(text, self.cut_tree(text, lo, mid), mid, self.cut_tree(text, mid, hi), hi)

    def _join_cuts(self, text: str, left: list[str], mid: int, right: list[str], hi: int) -> list[str]:
        at = mid
        while left:  # drop what the right side could change
            start = at - len(left[-1])
            if at < mid and start + self.lookahead <= mid:
                break
            left.pop()
            at = start
        width = 64
        while True:
            end = min(hi, mid + width)
            pos, j, bound, seam = at, 0, mid, []
            for match in self.pattern.finditer(text[at:end]):
                start, stop = at + match.start(), at + match.end()
                if end < hi and (stop >= end or start + self.lookahead > end):
                    break
                seam.append(match[0])
                pos = stop
                while bound < pos and j < len(right):
                    bound += len(right[j])
                    j += 1
                if pos == bound and pos >= mid:
                    left += seam
                    left += right[j:]
                    return left
            if end == hi:
                return left + seam
            width *= 4

    def encode(self, text: str) -> bytes:
        """Ids of a text as int32 bytes."""
        known = self._pieces
        return b"".join([known[p] for p in self.cut_tree(text)])

    def decode(self, ids: np.ndarray, leaf: int = 1 << 16) -> bytes:
        """Bytes of ids: those of the halves, one after the other."""
        if len(ids) > leaf:
            half = len(ids) // 2
            return self.decode(ids[:half], leaf) + self.decode(ids[half:], leaf)
        if not len(ids):
            return b""
        if ids.min() < 0 or ids.max() >= len(self.token_len) or not self.token_len[ids].all():
            raise ValueError("an id is not in the vocabulary")
        sizes = self.token_len[ids]
        ends = np.cumsum(sizes)
        return self.blob[np.arange(ends[-1]) + np.repeat(self.token_at[ids] - (ends - sizes), sizes)].tobytes()


_CODECS: dict[tuple, Codec] = {}


def codec(path: str, pattern: str, lookahead: int = LOOKAHEAD) -> Codec:
    key = path, pattern, lookahead
    if key not in _CODECS:
        _CODECS[key] = Codec(read_ranks(path), pattern, lookahead)
    return _CODECS[key]


def _encoded(batches: Iterator[pa.RecordBatch], own: Codec, text: str, ids: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = [c for c in batch.schema.names if c != ids]
        for part in sub_batches(batch, text):
            got = [own.encode(x or "") for x in part.column(part.schema.get_field_index(text)).to_pylist()]
            ends = np.cumsum([0, *(len(x) // 4 for x in got)]).astype(np.int32)
            array = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(got), np.int32)))
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), array], [*kept, ids])


def _decoded(batches: Iterator[pa.RecordBatch], own: Codec, ids: str, decoded: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = [c for c in batch.schema.names if c != decoded]
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            column = part.column(part.schema.get_field_index(ids))
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).astype(np.int64)
            got = [own.decode(flat[ends[i] : ends[i + 1]]) for i in range(part.num_rows)]
            yield pa.RecordBatch.from_arrays([*(part.column(part.schema.get_field_index(c)) for c in kept), pa.array(got, pa.binary())], [*kept, decoded])


IDS, DECODED = T.ArrayType(T.IntegerType(), False), T.BinaryType()


def _with(df: DataFrame, *fields: tuple[str, T.DataType]) -> T.StructType:
    names = [n for n, _ in fields]
    return T.StructType([*(f for f in df.schema if f.name not in names), *(T.StructField(n, kind, False) for n, kind in fields)])


def encode(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", lookahead: int = LOOKAHEAD) -> DataFrame:
    """Adds the column `ids` (array<int>) for the column `text`; `path` must be readable on every executor."""
    return df.mapInArrow(tidied(lambda batches: _encoded(batches, codec(path, pattern, lookahead), text, ids)), _with(df, (ids, IDS)))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """Adds the column `decoded` (binary) for the column `ids`; null ids decode to no bytes."""
    return df.mapInArrow(tidied(lambda batches: _decoded(batches, codec(path, pattern), ids, decoded)), _with(df, (decoded, DECODED)))


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str = "decoded", lookahead: int = LOOKAHEAD) -> DataFrame:
    """encode, then decode of its ids, in one worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(path, pattern, lookahead)
        return _decoded(_encoded(batches, own, text, ids), own, ids, decoded)

    return df.mapInArrow(tidied(run), _with(df, (ids, IDS), (decoded, DECODED)))


def digest(ids: str = "ids"):
    """Lower-case hex SHA-256 of the decimal ids joined by commas."""
    return F.sha2(F.array_join(F.col(ids).cast("array<string>"), ",").cast("binary"), 256)


def op6_byte_bpe(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    both = round_trip(documents(spark, sf_dir).select("doc_id", "text"), path, pattern)
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest().alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
