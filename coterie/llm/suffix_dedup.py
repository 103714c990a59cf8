"""Suffix-array dedup: bytes covered by a string of `window` bytes that starts earlier, too.

Prefix-free parsing at two levels, without ever bringing the corpus together. Above, the
documents are parsed at their anchors (`windows`): for each anchor that repeats, the text
around it that holds its windows is a phrase, its context. Equal contexts are one entry
of the dictionary, found by two hashes and then compared byte by byte; all but the
earliest of them are repeats whole, first within a task, then at the partition that owns
the anchor. Below, that partition parses its dictionary again at rolling-hash triggers
(`prefix_free`), where the suffix arrays of that dictionary and its parse combine into
the order in which equal windows stand next to each other; all but the earliest of each
are marked. Equal windows have equal anchors, so the orders of the partitions together
say all that one order of the corpus would.

An anchor with very many places (more than `hot`, and than a 2^20th of all anchors) would
make one partition large. Its windows are phrases of their own, each owned by its own hash:
the most that then meets in one place is what is equal, one row of it a task.

Order of documents: by doc_id, a null first; then by the hash of doc_id and text. Rows that
share doc_id and text count as one document: what an earlier one has goes from each of
them, and nothing goes because they repeat each other. A null or empty text keeps nothing
and loses nothing; texts below the window are kept whole. Extra columns with names
of the result's are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from coterie.llm.common import WORD, documents, shared_folder, tidied
from coterie.llm.prefix_free import repeats
from coterie.llm.windows import BASES, HOT, NO_ID, PLACE_NAMES, PLACES, Chunk, Rolling, by_document, by_slice, byte_units, chunks, covered, flagged_windows, found_anchors, keyed, packed, part_of, partitions_for, places_of, text_bytes, with_marks

WINDOW, GRAM = 100, 32
#: Bytes of contexts a task holds before it sends them, and of those an owner sorts at once.
HELD, SORTED = 16 << 20, 1 << 20
#: Places of an anchor above which its windows are owned one by one; no more than MOST_HOT anchors are.
HOT_PLACES, MOST_HOT = 100_000, 1 << 20
#: Contexts on their way to the owner of their anchor; their bytes are compressed. A null anchor: settled places.
NAMES = ["anchor", "doc", "th", "pos", "sizes", "text"]
CONTEXTS = "part int, anchor binary, doc binary, th binary, pos binary, sizes binary, text binary"
CODEC = "zstd"


def settled_rows(doc, th, pos, lens, n: int, names: list[str]):
    """Rows with runs of marked starts for the partitions that gather them; other columns are null."""
    for s, (d, t, p, z) in by_slice(part_of(th, n), [doc, th, pos.astype(np.int32), lens.astype(np.int32)]):
        by_name = {"doc": d, "th": t, "pos": p, "sizes": z, "lens": z}
        yield packed(s, names, [by_name.get(c) for c in names])


class Contexts:
    """A task's contexts: (hash a, hash b, doc, th, place, size) and their bytes; copies but the earliest go out as marks."""

    def __init__(self, n: int, window: int):
        self.n, self.window, self.held, self.size = n, window, [], 0

    def add(self, columns: list[np.ndarray], texts: np.ndarray):
        """columns: anchor, a, b, doc, th, pos, size; texts: the bytes, one context after the other."""
        self.held.append((columns, texts))
        self.size += len(texts)
        if self.size >= HELD:
            yield from self.flush()

    def flush(self):
        if not self.held:
            return
        columns = [np.concatenate(x) for x in zip(*(c for c, _ in self.held))]
        text = np.concatenate([t for _, t in self.held])
        self.held, self.size = [], 0
        anchor, a, b, doc, th, pos, size = columns
        begins = np.cumsum(size) - size
        keep, drop = earliest(a, b, doc, th, pos, text, begins, size)
        yield from settled_rows(doc[drop], th[drop], pos[drop], size[drop] - self.window + 1, self.n, NAMES)
        rows = np.flatnonzero(keep)
        for s, (i,) in by_slice((anchor[rows] % np.uint64(self.n)).astype(np.int64), [rows]):
            squeezed = np.frombuffer(pa.compress(ranges(text, begins[i], size[i]).tobytes(), CODEC, asbytes=True), np.uint8)
            yield packed(s, NAMES, (anchor[i], doc[i], th[i], pos[i], size[i].astype(np.int32), squeezed))


def ranges(text: np.ndarray, lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The bytes of the given ranges, one after the other."""
    ends = np.cumsum(size)
    return text[np.arange(ends[-1] if len(ends) else 0) + np.repeat(lo - (ends - size), size)]


def earliest(a, b, doc, th, pos, text, begins, size) -> tuple[np.ndarray, np.ndarray]:
    """Marks the earliest row of each string, and the rows that repeat it elsewhere.

    a, b: two hashes of the string text[begins:begins + size], by which rows meet; a row is
    a repeat if its bytes are those of the earliest row with its hashes, and stays for itself
    if they are not. A row with the same doc, th and pos is of an equal row of the table,
    which is the same document: it is neither, as what holds for the earliest holds for it.
    """
    keep, drop = np.zeros(len(a), bool), np.zeros(len(a), bool)
    if len(a):
        order = np.lexsort((pos, th, doc, b, a))
        new = np.concatenate([[True], (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])])
        head = np.empty(len(a), np.int64)
        head[order] = order[new][np.cumsum(new) - 1]
        keep[order[new]] = True
        drop = (doc != doc[head]) | (th != th[head]) | (pos != pos[head])
        some = np.flatnonzero(drop)
        for at in range(0, len(some), 1 << 12):
            i = some[at : at + (1 << 12)]
            j = head[i]
            same = size[i] == size[j]
            i, j, unequal = i[same], j[same], i[~same]
            differs = np.add.reduceat(ranges(text, begins[i], size[i]) != ranges(text, begins[j], size[j]), np.cumsum(size[i]) - size[i]) if len(i) else i
            unequal = np.concatenate([unequal, i[differs > 0]])
            drop[unequal], keep[unequal] = False, True
    return keep, drop


def _settle(parts: list[dict], window: int):
    """(doc, th, start, windows) of the runs to mark among all contexts of a partition."""
    get = lambda name, kind: np.concatenate([np.frombuffer(p[name], kind) for p in parts])
    anchor, doc, th = get("anchor", np.uint64), get("doc", np.int64), get("th", np.int64)
    pos, size = get("pos", np.int32).astype(np.int64), get("sizes", np.int32).astype(np.int64)
    text = np.frombuffer(b"".join(pa.decompress(p["text"], int(np.frombuffer(p["sizes"], np.int32).sum(dtype=np.int64)), CODEC, asbytes=True) for p in parts), np.uint8)
    parts.clear()
    begins = np.cumsum(size) - size
    # equal contexts and equal windows have equal anchors, so lots by anchor can be settled one by one
    lots = max(1, -(-len(text) // SORTED))
    for _, (i,) in by_slice(((anchor >> np.uint64(32)) % np.uint64(lots)).astype(np.int64), [np.arange(len(anchor))]):
        own, z = ranges(text, begins[i], size[i]), size[i]
        at = np.cumsum(z) - z
        one, two = Rolling(own), Rolling(own, BASES[1])
        keep, drop = earliest(one.ranges(at, at + z), two.ranges(at, at + z), doc[i], th[i], pos[i], own, at, z)
        if not keep.all():
            copies = i[drop]
            yield doc[copies], th[copies], pos[copies], size[copies] - window + 1
            own, i = ranges(own, at[keep], z[keep]), i[keep]
            one, two = Rolling(own), Rolling(own, BASES[1])
        s, inside = repeats(own, size[i], window, (doc[i], th[i], pos[i]), lambda lo, hi: (one.ranges(lo, hi), two.ranges(lo, hi)))  # noqa: B023
        order = np.lexsort((inside, s))  # neighbouring windows of a context go as one run
        s, inside = s[order], inside[order]
        new = np.flatnonzero(np.concatenate([[True], (s[1:] != s[:-1]) | (inside[1:] != inside[:-1] + 1)])) if len(s) else np.zeros(0, np.int64)
        row = i[s[new]]
        yield doc[row], th[row], pos[row] + inside[new], np.diff(np.concatenate([new, [len(s)]]))


def contexts(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT_PLACES) -> tuple[DataFrame, int]:
    """The rows of CONTEXTS that go to the partitions which own them, and how many partitions there are. docs: as from keyed()."""
    shared_folder(docs.sparkSession)
    size = text_bytes(docs)
    n = partitions_for(docs, size)
    # no more than size anchors, so no more than MOST_HOT keys of 8 bytes are hot
    found = found_anchors(docs, byte_units, window, gram, n, max(hot, size // MOST_HOT)).checkpoint()
    hottest = [np.frombuffer(r["th"], np.uint64) for r in found.where(F.col("part") == HOT).select("th").collect()]
    great = docs.sparkSession.sparkContext.broadcast(np.sort(np.concatenate(hottest)) if hottest else np.zeros(0, np.uint64))
    flagged = docs.join(places_of(found.where(F.col("part") != HOT), n), "th")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, settled = Contexts(n, window), []
        for texts, (ids, ths, places) in chunks(batches, ["doc_id", "th", "places"]):
            data, sizes = byte_units(texts)
            chunk = Chunk(data, sizes, window, gram)
            hit = flagged_windows(chunk, places.to_pylist())
            if not len(hit):
                continue
            start, anchor, owner = chunk.starts[hit], chunk.anchor[hit], chunk.owner[hit]
            own_key = np.isin(chunk.hashes[anchor], great.value) if len(great.value) else np.zeros(len(anchor), bool)
            new = np.flatnonzero(np.concatenate([[True], (start[1:] != start[:-1] + 1) | (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])]) | own_key)
            lo, last = start[new], start[np.concatenate([new[1:], [len(start)]]) - 1]
            hi, own = last + window, owner[new]
            a, b = chunk.roll.ranges(lo, hi), Rolling(data, BASES[1]).ranges(lo, hi)
            doc, th, pos = ids.to_numpy()[own], ths.to_numpy()[own], (lo - chunk.begins[own]).astype(np.int32)
            size = hi - lo
            keep, drop = earliest(a, b, doc, th, pos, data, lo, size)
            key = np.where(own_key[new], a, chunk.hashes[anchor[new]])
            if drop.any():  # copies within the chunk: only their places go on
                settled.append((doc[drop], th[drop], pos[drop], size[drop] - window + 1))
            yield from out.add([x[keep] for x in (key, a, b, doc, th, pos, size)], ranges(data, lo[keep], size[keep]))
        yield from out.flush()
        if settled:
            yield from settled_rows(*(np.concatenate(x) for x in zip(*settled)), n, NAMES)

    return flagged.select("doc_id", "th", "text", "places").mapInArrow(tidied(send), CONTEXTS), n


def marked_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT_PLACES) -> DataFrame:
    """MARKS rows: runs of starts (in bytes) whose window also starts earlier. docs: as from keyed()."""
    sent, n = contexts(docs, window, gram, hot)

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                if row["anchor"] is None:  # settled before: on to where the document's marks meet
                    yield packed(row["part"], PLACE_NAMES, [np.frombuffer(row[c], np.uint8) for c in ("doc", "th", "pos", "sizes")])
                else:
                    held.append(row)
        if held:
            found = list(_settle(held, window))
            yield from settled_rows(*(np.concatenate(x) for x in zip(*found)), n, PLACE_NAMES)

    return by_document(sent.repartitionById(n, "part").mapInArrow(tidied(own), PLACES), n)


def suffix_dedup(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, carried: tuple[str, ...] = (), as_text: bool = False, hot: int = HOT_PLACES) -> DataFrame:
    """(doc_id, the carried columns, n_bytes, n_removed, n_spans, kept): kept has the bytes left (binary).

    as_text: kept is a string, without characters that were cut in two. Carried columns must
    not have the names of the others.
    """
    own = keyed(docs, carried)
    marks = marked_windows(own.select("doc_id", "th", "text"), window, gram, hot)
    marked = with_marks(own, marks)
    names = ["n_bytes", "n_removed", "n_spans", "kept"]
    out = T.StructType([T.StructField("doc_id", T.LongType()), *(docs.schema[c] for c in carried), *(T.StructField(c, T.LongType()) for c in names[:3]), T.StructField("kept", T.StringType() if as_text else T.BinaryType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for texts, (ids, starts, lens, *rest) in chunks(batches, ["doc_id", "starts", "lens", *carried]):
            removed, spans, kept = [], [], []
            for text, s, n in zip(texts, starts.to_pylist(), lens.to_pylist()):
                if not s:
                    removed.append(0)
                    spans.append(0)
                    kept.append(text)
                    continue
                hit = covered(len(text), s, n, window)
                removed.append(int(hit.sum()))
                spans.append(int(hit[0]) + int((hit[1:] & ~hit[:-1]).sum()))
                kept.append(np.frombuffer(text, np.uint8)[~hit].tobytes())
            yield pa.RecordBatch.from_arrays([ids, *rest, pa.array(list(map(len, texts)), pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())], ["doc_id", *carried, *names])

    cols = ["doc_id", "text", "starts", "lens", *carried]
    return marked.select(*cols).mapInArrow(tidied(cut), out).withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def deduplicated(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs with what is left of each text, read as UTF-8 (a character cut in two goes); texts left without a word go, with their rows.

    Columns are those of docs; n_chars, if there, is the new text's length.
    """
    carried = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    renamed = {c: f"_c{i}" for i, c in enumerate(carried)}  # whatever their names are, they don't meet the result's
    cut = suffix_dedup(docs.withColumnsRenamed(renamed), window, gram, tuple(renamed.values()), as_text=True)
    left = cut.where((F.col("n_removed") == 0) | F.col("kept").rlike(WORD))
    changed = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept").cast("long")}
    return left.select(*(changed.get(c, F.col(renamed.get(c, c))).alias(c) for c in docs.columns))


def op1_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return suffix_dedup(documents(spark, sf_dir).select("doc_id", "text")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


#: Every byte is a row, and every window a digest; doc_ids must be there once each.
ORACLE_OP1 = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, h, unnest(range(0, length(h) // 2)) AS i FROM d),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 2) AS b, CASE WHEN 2 * (i + {WINDOW}) <= length(h) THEN md5(substr(h, 2 * i + 1, {2 * WINDOW})) END AS s FROM p),
hit AS (SELECT doc_id, i, b, s IS NOT NULL AND row_number() OVER (PARTITION BY s ORDER BY doc_id, i) > 1 AS again FROM w),
gone AS (SELECT doc_id, i, b, bool_or(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW) AS x FROM hit),
runs AS (SELECT *, x AND NOT coalesce(lag(x) OVER (PARTITION BY doc_id ORDER BY i), false) AS first FROM gone),
cut AS (SELECT doc_id, count(*)::BIGINT AS n_bytes, count(*) FILTER (x)::BIGINT AS n_removed, count(*) FILTER (first)::BIGINT AS n_spans, coalesce(string_agg(b, '' ORDER BY i) FILTER (NOT x), '') AS kept FROM runs GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_bytes, 0) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN cut ON d.doc_id = cut.doc_id
"""
