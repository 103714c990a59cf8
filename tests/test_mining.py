"""Itemsets against brute force, by hand and at random."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from coterie.operators import counting, dense, mining, report, rules, tree

H1 = [[1, 2, 5], [2, 4], [2, 3], [1, 2, 4], [1, 3], [2, 3], [1, 3], [1, 2, 3, 5], [1, 2, 3]]
H2 = [[1, 2, 3], [1, 2], [1]]
H3 = [[1, 2, 3], [1, 2, 3], [1, 2, 3], [4], []]
H4 = [[1, 2, 3, 4], [1, 2, 3, 4], [1, 2], [1, 2], [5], [5]]
H8 = [[1, 2, 3], [1, 2, 3], [1], [1], [2]]


def brute(rows, t):
    items = sorted({x for r in rows for x in r})
    fi = {}
    for n in range(1, len(items) + 1):
        for s in itertools.combinations(items, n):
            k = sum(set(s) <= set(r) for r in rows)
            if k >= t:
                fi[s] = k
    closed = {s: k for s, k in fi.items() if not any(set(s) < set(o) and fi[o] == k for o in fi)}
    maximal = {s: k for s, k in fi.items() if not any(set(s) < set(o) for o in fi)}
    return fi, closed, maximal


def table(spark, rows):
    return spark.createDataFrame(list(enumerate(rows)), "tid long, items array<bigint>")


def as_dict(df):
    return {tuple(map(int, r.items_.split())) if r.items_ else (): r.support for r in df.select(F.col("itemset").alias("items_"), "support").collect()}


@pytest.mark.parametrize("rows, t", [(H1, 2), (H2, 1), (H3, 2), (H4, 2), (H8, 1)])
def test_hand_fixtures(spark, rows, t):
    bk = table(spark, rows)
    expected = brute(rows, t)
    for mode, want in zip(mining.MODES, expected):
        assert as_dict(mining.mine(bk, t, mode)) == want
    found = dense.closed_sets(bk, t)
    assert as_dict(found) == expected[1]
    assert as_dict(found.where("maximal")) == expected[2]


def test_known_counts(spark):
    hist = lambda rows, t, mode: [r.n for r in report.length_histogram(mining.mine(table(spark, rows), t, mode)).orderBy("len").collect()]
    assert hist(H1, 2, "frequent") == [5, 6, 2]
    assert hist(H1, 2, "maximal") == [0, 1, 2]
    assert hist(H4, 2, "closed") == [1, 1, 0, 1]


def test_empty_set_rows(spark):
    row = lambda rows, t, mode: [r.support for r in mining.mine(table(spark, rows), t, mode, True).where("len = 0").collect()]
    assert row(H1, 2, "frequent") == [9] and row(H1, 2, "closed") == [9] and row(H1, 2, "maximal") == []
    assert row(H2, 1, "frequent") == [3] and row(H2, 1, "closed") == []
    assert row(H3, 2, "frequent") == [5] and row(H3, 2, "closed") == [5]


def test_nothing_frequent(spark):
    for mode in mining.MODES:
        assert mining.mine(table(spark, [[1], [2]]), 2, mode, True).count() == 0
        assert mining.mine(table(spark, []), 1, mode, True).count() == 0
    assert mining.mine(table(spark, [[1]]), 5).count() == 0
    assert dense.closed_sets(table(spark, [[1], [2]]), 2).count() == 0
    assert report.length_histogram(mining.mine(table(spark, [[1], [2]]), 2)).count() == 0


def test_invalid_threshold(spark):
    with pytest.raises(ValueError):
        mining.mine(table(spark, H1), 0)
    with pytest.raises(ValueError):
        mining.mine(table(spark, H1), 1, "other")


def test_thresholds_are_exact():
    assert counting.min_count(88162, 7, 88162) == 7
    assert all(counting.min_count(n, 1, q) * q >= n > (counting.min_count(n, 1, q) - 1) * q for n in range(1, 300) for q in range(1, 40))


@pytest.mark.parametrize("seed", range(3))
def test_random_baskets(spark, seed):
    rng = random.Random(seed)
    rows = [sorted(rng.sample(range(8), rng.randint(0, 7))) for _ in range(25)]
    t = rng.randint(2, 5)
    bk = table(spark, rows)
    fi, closed, maximal = brute(rows, t)
    mined = mining.mine(bk, t).persist()
    assert as_dict(mined) == fi
    assert as_dict(mining.closed(mined)) == closed
    assert as_dict(mining.maximal(mined)) == maximal
    split = dense.closed_sets(bk, t, task_rows=3).persist()
    assert as_dict(split) == closed
    assert as_dict(split.where("maximal")) == maximal
    assert as_dict(mining.subsumed(mined, mining.maximal(mined))) == fi


def test_rules(spark):
    fi = mining.mine(table(spark, H1), 2)
    got = {(r.antecedent, r.consequent): (r.confidence, r.lift) for r in rules.association_rules(fi, 9).collect()}
    assert got["1", "2"] == (4 / 6, (4 / 6) / (7 / 9))
    assert got["1 5", "2"] == (1.0, 1.0 / (7 / 9))
    assert all(c >= 0.9 for c, _ in [(r.confidence, r.lift) for r in rules.association_rules(fi, 9, 0.9).collect()])


def test_tree(spark):
    bk = table(spark, H2)
    coded = counting.encoded(bk, counting.item_rank(bk, 1))
    t = tree.prefix_tree(coded).persist()
    assert {(r.prefix, r.level, r["count"]) for r in t.collect()} == {("1", 1, 3), ("1 2", 2, 2), ("1 2 3", 3, 1)}
    assert tree.single_path(t).first().single_path
    assert as_dict(tree.single_path_closed(t)) == brute(H2, 1)[1]
    assert as_dict(tree.path_power_set(t)) == brute(H2, 1)[0]
    bk = table(spark, H1)
    coded = counting.encoded(bk, counting.item_rank(bk, 2)).persist()
    assert not tree.single_path(tree.prefix_tree(coded)).first().single_path
    base = tree.conditional_base(coded.withColumn("items", F.col("items").cast("array<string>")), "5")
    assert {(r.path, r.weight) for r in base.collect()} == {("2 1", 1), ("2 1 3", 1)}
    assert {(r.item, r.support) for r in tree.conditional_support(base, 2).collect()} == {("2", 2), ("1", 2)}
    assert {(r.prefix, r["count"]) for r in tree.conditional_tree(base, 2).collect()} in ({("1", 2), ("1 2", 2)},)
    back = counting.decoded(counting.encoded(bk, counting.item_rank(bk, 1)), counting.item_rank(bk, 1))
    assert {r.tid: sorted(r["items"]) for r in back.collect()} == dict(enumerate(H1))


def test_lines_round_trip(spark, tmp_path):
    sets = mining.mine(table(spark, H1), 2, "frequent", True).persist()
    assert {r.line for r in report.itemset_lines(sets).where(F.col("line").rlike("^[(]")).collect()} == {"(9)"}
    report.write_lines(sets, str(tmp_path / "out"))
    back = report.read_lines(spark, str(tmp_path / "out"))
    assert as_dict(back) == as_dict(sets)


def test_items_with_blanks(spark):
    rows = [["Cream", "Ice"]] * 2 + [["Cream Ice"]] * 2 + [["Cream Ice", "Milk"]] * 2
    bk = spark.createDataFrame(list(enumerate(rows)), "tid long, items array<string>")
    fi = mining.mine(bk, 2)
    sets = lambda df: {(tuple(r["items"]), r.support) for r in df.collect()}
    assert sets(fi) == {(("Cream",), 2), (("Ice",), 2), (("Cream", "Ice"), 2), (("Cream Ice",), 4), (("Milk",), 2), (("Cream Ice", "Milk"), 2)}
    assert sets(mining.closed(fi)) == {(("Cream", "Ice"), 2), (("Cream Ice",), 4), (("Cream Ice", "Milk"), 2)}
    assert sets(mining.maximal(fi)) == {(("Cream", "Ice"), 2), (("Cream Ice", "Milk"), 2)}
    found = dense.closed_sets(bk, 2)
    assert sets(found) == sets(mining.closed(fi)) and sets(found.where("maximal")) == sets(mining.maximal(fi))
    by = mining.maximal(fi).where(F.col("len") == 2).where(F.array_contains("items", "Milk"))
    assert sets(mining.subsumed(fi, by)) == {(("Cream Ice",), 4), (("Milk",), 2), (("Cream Ice", "Milk"), 2)}
    confidence = {(r.antecedent, r.consequent): r.confidence for r in rules.association_rules(fi, 6).collect()}
    assert confidence == {("Cream", "Ice"): 1.0, ("Ice", "Cream"): 1.0, ("Cream Ice", "Milk"): 0.5, ("Milk", "Cream Ice"): 1.0}


def test_paths_of_items_with_blanks(spark):
    bk = spark.createDataFrame([(1, ["Ice Cream", "Milk"]), (2, ["Ice Cream", "Milk"]), (3, ["Ice Cream"])], "tid long, items array<string>")
    t = tree.prefix_tree(counting.encoded(bk, counting.item_rank(bk, 1)))
    assert {(r.itemset, r.len, r.support) for r in tree.path_power_set(t).collect()} == {("Ice Cream", 1, 3), ("Milk", 1, 2), ("Ice Cream Milk", 2, 2)}
    assert {(r.itemset, r.len, r.support) for r in tree.single_path_closed(t).collect()} == {("Ice Cream", 1, 3), ("Ice Cream Milk", 2, 2)}


def test_single_path_operators_refuse_other_trees(spark):
    bk = table(spark, [[1, 2], [3]])
    t = tree.prefix_tree(counting.encoded(bk, counting.item_rank(bk, 1)))
    for operator in (tree.single_path_closed, tree.path_power_set):
        with pytest.raises(Exception, match="not one path"):
            operator(t).collect()
        assert operator(t.where("false")).count() == 0


def test_ranks_over_partitions(spark):
    rng = random.Random(12)
    rows = [(f"i{k:04}", rng.randint(1, 40)) for k in range(2000)]
    df = spark.createDataFrame(rows, "item string, support long").repartition(7)
    got = [(r.item, r.support) for r in sorted(counting.ranked(df, *counting.by_support()).collect(), key=lambda r: r["rank"])]
    assert got == sorted(rows, key=lambda r: (-r[1], r[0]))
    assert sorted(r["rank"] for r in counting.ranked(df, *counting.by_support()).collect()) == list(range(1, 2001))
    assert counting.ranked(df.where("false"), *counting.by_support()).count() == 0


def test_conditional_support_by_pairs(spark):
    for rows, t in ((H1, 2), (H4, 2), (H2, 1)):
        bk = table(spark, rows)
        ranks, pairs = counting.item_rank(bk, t), counting.pair_support(bk)
        coded = counting.encoded(bk, ranks).withColumn("items", F.col("items").cast("array<string>"))
        for item in "12345":
            want = {(r.item, r.support) for r in tree.conditional_support(tree.conditional_base(coded, item), t).collect()}
            assert {(str(r.item), r.support) for r in counting.conditional_support_by_pairs(pairs, ranks, item, t).collect()} == want
