"""Byte-level BPE, mixing, top-k and the pipeline against libraries, SQL and plain Python."""

import hashlib
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from coterie.llm import byte_bpe, mixing, queries, topk

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
DOC = "doc_id long, text string, lang string, source string, n_chars long, parts string, epoch int"


@pytest.fixture(scope="module")
def vocabulary():
    found = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = found.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=found.PATTERN, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    return path, found.PATTERN, own


def odd_texts(n=400):
    rng = random.Random(0)
    letters = "aabcde  \n\t'sdtrevlm.,!12é漢 \x85\u00a0😀THE\x1c"
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 200))) for _ in range(n)] + ["", "a" * 5000, " " * 3000 + "x", "theand" * 800, "'" * 1000, "\n \n" * 500, "don't we'll they've I'D"]


@pytest.mark.parametrize("text_leaf, merge_leaf", [(3, 2), (16, 5), (4096, 12)])
def test_bpe_is_the_library_s(monkeypatch, vocabulary, text_leaf, merge_leaf):
    path, pattern, own = vocabulary
    monkeypatch.setattr(byte_bpe, "TEXT_LEAF", text_leaf)
    monkeypatch.setattr(byte_bpe, "MERGE_LEAF", merge_leaf)
    codec = byte_bpe.Codec(byte_bpe.read_ranks(path), pattern)
    for t in odd_texts():
        ids = np.frombuffer(codec.encode(t), np.int32)
        assert ids.tolist() == own.encode_ordinary(t)
        assert codec.decode(ids, leaf=7) == t.encode()


def test_bpe_frames(spark, vocabulary):
    path, pattern, own = vocabulary
    rows = [(i, t, "x") for i, t in enumerate([None, *odd_texts(20)])] + [(None, "again", "x"), (None, "again", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, decoded string")
    got = byte_bpe.decode(byte_bpe.encode(df, path, pattern), path, pattern).select("doc_id", "text", "ids", "decoded", byte_bpe.digest().alias("d")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.ids == own.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
        assert r.d == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
    assert byte_bpe.encode(df.where("false"), path, pattern).count() == 0
    with pytest.raises(Exception, match="vocabulary"):
        byte_bpe.decode(spark.createDataFrame([([999999],)], "ids array<int>"), path, pattern).collect()


def plain_targets(sizes, share=1.5, most=2, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        level = left / sum(w[s] for s in open_)
        over = {s for s in open_ if level * w[s] > most * sizes[s]}
        if not over:
            return target | {s: level * w[s] for s in open_}
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        open_ -= over
    return target


def mixing_rows():
    rng = random.Random(4)
    rows = []
    for i in range(300):
        source = rng.choice(["a", "a", "a", "B", "c", None, "é", "tiny"]) if i else "none"
        rows.append((i, " ".join("w" for _ in range(rng.randint(0, 400))) if source != "none" else "", "en", source, 1, "p", 2))
    rows += [(None, None, None, None, None, None, None), (5, "twice here", "en", "a", 1, "p", 2), (5, "twice here", "en", "a", 1, "p", 2), (999, "x " * 40000, "en", "c", 1, "p", 2)]
    return rows


def test_mixing_targets_and_bounds(spark):
    rows = mixing_rows()
    docs = spark.createDataFrame(rows, DOC)
    got = mixing.mix(docs, block_words=16, shard_slots=256).collect()
    assert len(got) == len(rows)
    size = lambda t: len((t or "").split())
    sizes, taken = {}, {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + size(r[1])
    want = plain_targets(sizes)
    by_target = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by_target.setdefault((r.source_size, round(r.target, 6)), 0)
        by_target[r.source_size, round(r.target, 6)] += r.taken
    assert {k for k in by_target} == {(sizes[s], round(want[s], 6)) for s in sizes}
    for (n, target), words in by_target.items():
        assert abs(words - target) <= max(64, 0.02 * target)
    again = mixing.mix(docs.repartition(7), block_words=16, shard_slots=256).collect()
    key = lambda r: (str(r.doc_id), r.size, r.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix(docs.where("false")).count() == 0


def test_mixed_texts_hold_what_was_taken(spark):
    docs = spark.createDataFrame(mixing_rows(), DOC)
    taken = mixing.mix(docs, block_words=16).groupBy().agg(F.sum("taken")).first()[0]
    out = mixing.mixed_texts(docs, block_words=16)
    assert out.columns == docs.columns
    rows = out.collect()
    assert sum(len(r.text.split()) for r in rows) == taken
    assert all(r.n_chars == len(r.text) and r.parts in ("p", None) for r in rows)
    assert mixing.mixed_texts(docs.where("false")).count() == 0


def test_permutations_are_permutations(spark):
    for n in (1, 2, 7, 100, 1000):
        seen = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n).cast("long"), F.lit(3))).collect()]
        assert sorted(seen) == list(range(n))
        if n == 1000:
            assert sum(abs(a - b) > 50 for a, b in enumerate(seen)) > 800


def plain_topk(rows, k, queries_):
    ok = {i: v for i, v in rows if i is not None and v is not None}
    out = []
    for q in queries_:
        found = sorted(((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q])))[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("shard_rows, block, leaf", [(40, 7, 4), (100, 64, 16), (1000, 512, 256)])
def test_topk_is_exact(spark, monkeypatch, shard_rows, block, leaf):
    monkeypatch.setattr(topk.Tree.__init__, "__defaults__", (leaf,))
    rng = random.Random(6)
    rows = [(i, [rng.randint(-300, 300) for _ in range(6)]) for i in range(300)]
    rows += [(400 + i, [5, 5, 5, 5, 5, 5]) for i in range(60)]  # ties
    rows += [(500, [1, 2]), (501, [3, 4]), (502, []), (503, []), (504, [10**8] * 6), (505, [-(10**8)] * 6), (506, [1, 2, 3])]
    df = spark.createDataFrame(rows, "id long, v array<bigint>")
    asked = [i for i, _ in rows if i % 5 == 0] + [501, 503, 504, 506]
    got = sorted(tuple(r) for r in topk.top_k(df.union(spark.createDataFrame([(None, [1] * 6), (700, None)], df.schema)), df.where(F.col("id").isin(asked)), 5, shard_rows, block).collect())
    assert got == plain_topk(rows, 5, asked)
    assert topk.top_k(df.where("false"), df.where("false"), 5).count() == 0
    assert topk.top_k(df, df.where("false"), 5).count() == 0


def test_topk_repeats_and_few(spark):
    df = spark.createDataFrame([(1, [1, 0]), (2, [3, 0]), (2, [3, 0]), (3, [2, 9])], "id long, v array<bigint>")
    got = sorted(tuple(r) for r in topk.top_k(df, df.where("id = 1").union(df.where("id = 1")), 5).collect())
    assert got == sorted([(1, 1, 2, 3), (1, 2, 2, 3), (1, 3, 3, 2)] * 2)


@pytest.mark.parametrize("seed", range(3))
def test_trees_find_the_best(seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 200, (12, 5))
    points = np.floor(centres[rng.integers(0, 12, 900)] + rng.normal(0, 8, (900, 5))).astype(np.int64)
    ids = rng.permutation(2000)[:900].astype(np.int64)
    tree = topk.Tree(points, ids, leaf=16)
    assert (tree.child >= 0).sum() == (tree.child < 0).sum() - 1
    for node, (lo, hi) in enumerate(tree.cuts):
        own = tree.points[lo:hi]
        assert (own.min(axis=0) == tree.low[node]).all() and (own.max(axis=0) == tree.high[node]).all() and tree.ids[lo:hi].min() == tree.least[node]
    queries, own = points[::7], ids[::7]
    low = np.full(len(queries), topk.LOWEST)
    visited = []
    plain = topk.Tree._visit
    tree._visit = lambda *x: (visited.append(len(x[3])), plain(tree, *x))[1]
    for kind in (np.float64, np.int64):
        for name in ("points", "low", "high"):
            setattr(tree, name, getattr(tree, name).astype(kind))
        q, found, score = tree.search(queries.astype(kind), own, 4, low, low)
        for i in range(len(queries)):
            every = points @ queries[i]
            best = sorted((-int(every[j]), int(ids[j])) for j in range(900) if ids[j] != own[i])[:4]
            assert [(-int(s), int(f)) for f, s in zip(found[q == i], score[q == i])] == best
            floor, floor_id = -best[1][0], best[1][1]
            one = tree.search(queries[i : i + 1].astype(kind), own[i : i + 1], 4, np.array([floor]), np.array([floor_id]))
            assert [(-int(s), int(f)) for f, s in zip(one[1], one[2])] == best[:1]
    leaves = int((tree.child < 0).sum())
    assert sum(visited) < 0.6 * 2 * len(queries) * leaves * 2  # most leaves are never opened


def test_cells_cover_the_space():
    rng = np.random.default_rng(3)
    points = np.floor(rng.normal(0, 100, (3000, 4))).astype(np.int64)
    cells = topk.Cells(points[:500], 4)
    own = cells.of(points)
    assert own.min() == 0 and own.max() == 15 and np.bincount(own).max() < 600
    names = np.unique(own)
    boxes = topk.Boxes(names, np.array([points[own == c].min(axis=0) for c in names]), np.array([points[own == c].max(axis=0) for c in names]))
    bounds = boxes.bounds(points[:50])
    for i in range(50):
        every = points @ points[i]
        assert all(bounds[i, j] >= every[own == c].max() for j, c in enumerate(names))
    same = topk.Cells(np.full((40, 3), 7), 3).of(np.full((9, 3), 7))
    assert len(set(same.tolist())) == 1


def test_scores_beyond_64_bits_raise(spark):
    df = spark.createDataFrame([(1, [3 * 10**9] * 4), (2, [3 * 10**9] * 4), (3, [1] * 4)], "id long, v array<bigint>")
    with pytest.raises(Exception, match="64 bits"):
        topk.top_k(df, df, 2).collect()
    df = spark.createDataFrame([(1, [10**9] * 4), (2, [10**9] * 4), (3, [1] * 4)], "id long, v array<bigint>")
    assert sorted(tuple(r) for r in topk.top_k(df, df.where("id = 1"), 2).collect()) == [(1, 1, 2, 4 * 10**18), (1, 2, 3, 4 * 10**9)]


def test_unusable_vectors(spark):
    nan, inf = float("nan"), float("inf")
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0, None]), (4, [nan, 1.0]), (5, [inf, 1.0])], "vec_id long, embedding array<double>")
    assert [r.vec_id for r in df.where(topk.usable("embedding")).collect()] == [1]


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({queries.ORACLE[name]})").fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in df.select(*columns).collect())
