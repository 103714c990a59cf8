"""Parsing and reading of baskets and objects; spatial and keyword queries."""

import random
import struct

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from coterie.operators import mining, quadtree, spatial
from coterie.sources import objects, transactions


def test_parse_items(spark):
    lines = ["-5,1.5 abc 007", "", None, "99999999999999999999 3", "3 3 1"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lines)], "i int, line string")
    got = [r[0] for r in df.orderBy("i").select(transactions.parse_items(F.col("line"))).collect()]
    assert got == [[5, 1, 5, 7], [], [], [3], [3, 3, 1]]


def test_text_source(spark, tmp_path):
    (tmp_path / "t.txt").write_text("3 1 1\n\n-5,1.5 abc 007\n")
    assert sorted(map(tuple, (r[0] for r in transactions.read_text(spark, str(tmp_path / "t.txt")).select("items").collect()))) == [(), (1, 3), (1, 5, 7)]


def test_binary_source(spark, tmp_path):
    pack = lambda *rows: b"".join(struct.pack(f"={3 + len(r)}i", 9, 9, len(r), *r) for r in rows)
    (tmp_path / "a.bin").write_bytes(pack([3, 1, 3], [], [7]))
    got = transactions.read_binary(spark, str(tmp_path / "a.bin")).orderBy("nth").collect()
    assert [r["items"] for r in got] == [[1, 3], [], [7]]


def test_baskets_with_nulls_and_repeats(spark):
    df = spark.createDataFrame([(1, "b"), (1, "a"), (1, "a"), (2, None), (None, "x")], "tid long, item string")
    assert {r.tid: r["items"] for r in transactions.baskets(df).collect()} == {1: ["a", "b"], 2: []}
    df = spark.createDataFrame([(1, ["b", "a", None, "a"]), (2, None)], "tid long, items array<string>")
    assert {r.tid: r["items"] for r in transactions.from_arrays(df).collect()} == {1: ["a", "b"], 2: []}


def test_objects_and_queries(spark, tmp_path):
    (tmp_path / "o.txt").write_text("1, -86.5, 30.25, cafe, bar\n\n2, 1.0, 2.0\n3, 5, 5, bar\n")
    (tmp_path / "q.txt").write_text("7, -90, 30, 0, 31, cafe\n8, 0, 0, 5, 5, bar, bar\n9, 0, 0, 9, 9\n")
    o, q = objects.read_objects(spark, str(tmp_path / "o.txt")), objects.read_queries(spark, str(tmp_path / "q.txt"))
    assert {(r.id, tuple(r.kw)) for r in o.collect()} == {(1, ("cafe", "bar")), (2, ()), (3, ("bar",))}
    pairs = lambda df: {(r.qid, r.id) for r in df.collect()}
    assert pairs(spatial.box_query(o, q, 2.0, 2.0)) == {(7, 1), (8, 2), (8, 3), (9, 2), (9, 3)}
    assert pairs(spatial.spatial_keyword_query(o, q, 2.0, 2.0)) == {(7, 1), (8, 3), (9, 2), (9, 3)}
    assert pairs(spatial.spatial_keyword_query(o, q, 2.0, 2.0, "any")) == {(7, 1), (8, 3)}
    assert pairs(spatial.keyword_query(o, q)) == {(7, 1), (8, 1), (8, 3), (9, 1), (9, 2), (9, 3)}
    assert pairs(spatial.keyword_query(o, q, "any")) == {(7, 1), (8, 1), (8, 3)}
    assert spatial.keyword_query(o.where("false"), q).count() == 0
    assert {(r.kw, r.ids) for r in spatial.inverted_index(o).collect()} == {("cafe", "1"), ("bar", "1 3")}


def test_written_files_are_read(spark, tmp_path):
    df = spark.createDataFrame([(1, [1, 3, (1 << 31) - 1]), (2, []), (3, [7]), (4, [0, 255, 256, 65536, (1 << 24) - 1])], "tid long, items array<bigint>")
    want = sorted(r["items"] for r in df.collect())
    transactions.write_binary(df.coalesce(2), str(tmp_path / "b"))
    assert sorted(r["items"] for r in transactions.read_binary(spark, str(tmp_path / "b")).collect()) == want
    transactions.write_text(df, str(tmp_path / "t"))
    assert sorted(r["items"] for r in transactions.read_text(spark, str(tmp_path / "t")).collect()) == want
    with pytest.raises(Exception, match="2.24"):
        transactions.write_binary(spark.createDataFrame([(1, [1 << 24])], "tid long, items array<bigint>"), str(tmp_path / "x"))
    with pytest.raises(AnalysisException):
        transactions.read_text(spark, str(tmp_path / "missing"))
    o = spark.createDataFrame([(1, 0.1, -1e300, ["a b", "c"]), (2, 1.0, 2.0, [])], "id long, x double, y double, kw array<string>")
    objects.write_objects(o, str(tmp_path / "o"))
    assert sorted(map(tuple, objects.read_objects(spark, str(tmp_path / "o")).collect())) == sorted(map(tuple, o.collect()))


def test_frequent_sets_index(spark):
    rng = random.Random(4)
    rows = [(i, 0.0, 0.0, sorted(rng.sample(["a", "b", "a b", "c d", "e"], rng.randint(0, 5)))) for i in range(60)]
    o = spark.createDataFrame(rows, "id long, x double, y double, kw array<string>")
    fi = mining.mine(transactions.from_arrays(o, "id", "kw"), 8)
    got = {}
    for r in spatial.frequent_sets_index(o, fi, block=16).collect():
        got.setdefault(tuple(r["items"]), []).extend(map(int, r.ids.split()))
        assert r.n == len(r.ids.split()) and all(int(x) // 16 == r.block for x in r.ids.split())
    want = {tuple(r["items"]): [i for i, _, _, kw in rows if set(r["items"]) <= set(kw)] for r in fi.where("len >= 2").collect()}
    assert {k: sorted(v) for k, v in got.items()} == want and any(len(k) > 2 for k in want)


def test_hilbert_curve(spark):
    n = 16
    cells = spark.range(n * n).select((F.col("id") % n).alias("cx"), F.floor(F.col("id") / n).alias("cy"))
    at = {r.h: (r.cx, r.cy) for r in cells.withColumn("h", quadtree.hilbert(F.col("cx"), F.col("cy"), 4)).collect()}
    assert sorted(at) == list(range(n * n))
    assert all(abs(at[i][0] - at[i + 1][0]) + abs(at[i][1] - at[i + 1][1]) == 1 for i in range(n * n - 1))
    for k in range(4):  # a quadrant is a run of the curve
        assert len({(x // 8, y // 8) for i, (x, y) in at.items() if i // 64 == k}) == 1


def test_quadtree_layout(spark, tmp_path):
    rng = random.Random(8)
    rows = [(i, rng.gauss(3, 2), rng.gauss(7, 2), ["k"]) for i in range(500)] + [(1000 + i, 3.0, 7.0, []) for i in range(90)] + [(2000, -50.0, 99.0, []), (2001, None, 1.0, []), (2002, float("nan"), 1.0, [])]
    o = spark.createDataFrame(rows, "id long, x double, y double, kw array<string>")
    bounds, depth = (0.0, 0.0, 10.0, 10.0), 5
    tree = quadtree.leaves(o, bounds, 40, depth).collect()
    assert sum(r.n for r in tree) == 591 and all(r.n <= 40 or r.level == depth for r in tree) and any(r.level < depth for r in tree)
    spans = sorted((r.quad << 2 * (depth - r.level), (r.quad + 1) << 2 * (depth - r.level)) for r in tree)
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))  # no leaf is inside another
    quadtree.write_layout(o, str(tmp_path / "l"), bounds, 40, depth)
    boxes = [(1, 2.0, 6.0, 3.0, 7.0, ["k"]), (2, -100.0, 0.0, 0.0, 100.0, []), (3, 5.0, 5.0, 4.0, 6.0, []), (4, 0.0, 0.0, 10.0, 10.0, [])]
    got = {(r.qid, r.id) for r in quadtree.box_query_layout(spark, str(tmp_path / "l"), boxes).collect()}
    assert got == {(q, i) for q, x0, y0, x1, y1, _ in boxes for i, x, y, _ in rows if x is not None and x0 <= x <= x1 and y0 <= y <= y1}
    few, every = quadtree.touched(spark, str(tmp_path / "l"), boxes[0][1:5]), quadtree.touched(spark, str(tmp_path / "l"), boxes[3][1:5])
    assert 0 < len(few) < len(every) / 2
    plan = quadtree.box_query_layout(spark, str(tmp_path / "l"), boxes[:1])._jdf.queryExecution().toString()
    assert "PartitionFilters: [leaf" in plan
    assert quadtree.leaves(o.where("false"), bounds, 40, depth).count() == 0
    assert quadtree.box_query_layout(spark, str(tmp_path / "l"), []).count() == 0


def test_windowed_counts(spark, tmp_path):
    from coterie.streaming import support

    rows = [("a", "2026-01-01 00:10:00"), ("a", "2026-01-01 00:50:00"), ("b", "2026-01-01 01:00:00"), (None, "2026-01-01 00:00:00"), ("a", None)]
    df = spark.createDataFrame(rows, "item string, t string").select("item", F.to_timestamp("t").alias("ts"))
    df.write.parquet(str(tmp_path / "w"))
    counts = support.windowed_counts(support.stream_of_files(spark, str(tmp_path / "w")), "ts", "item")
    got = {(str(r.start), r.item, r.support) for r in support.final_table(spark, counts).collect()}
    assert got == {("2026-01-01 00:00:00", "a", 2), ("2026-01-01 01:00:00", "b", 1)}


def test_streams(spark, tmp_path):
    from coterie.streaming import support

    spark.createDataFrame([("a", 1), ("b", 2), ("a", 3), (None, 4)], "item string, v int").write.parquet(str(tmp_path / "s"))
    assert {(r.item, r.support) for r in support.item_support_of_files(spark, str(tmp_path / "s"), "item").collect()} == {("a", 2), ("b", 1)}
