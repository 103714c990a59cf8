"""Properties that hold for any baskets, and a known table of itemsets."""

import random

import pytest
from pyspark.sql import functions as F

from coterie.operators import counting, mining, report

#: All frequent sets of nine baskets of five items, found by hand: items and support; the first is the empty set.
BY_HAND = """(9)
1 (6)
2 (7)
3 (6)
4 (2)
5 (2)
1 2 (4)
1 3 (4)
1 5 (2)
2 3 (4)
2 4 (2)
2 5 (2)
1 2 3 (2)
1 2 5 (2)
"""


def test_table_by_hand(spark, tmp_path):
    (tmp_path / "known.txt").write_bytes(BY_HAND.replace("\n", "\r\n").encode())
    sets = report.read_lines(spark, str(tmp_path / "known.txt")).persist()
    assert sets.count() == 14
    fi = sets.where("len > 0")
    assert [r.n for r in report.length_histogram(sets).orderBy("len").collect()] == [5, 6, 2]
    assert mining.closed(fi).count() == 9
    assert mining.maximal(fi).count() == 3
    assert [r.support for r in mining.empty_set(fi, 9, "closed").collect()] == [9]


@pytest.mark.parametrize("seed", range(2))
def test_relations_between_modes(spark, seed):
    rng = random.Random(100 + seed)
    rows = [(i, sorted({rng.choice("abcdefg") for _ in range(rng.randint(0, 6))})) for i in range(60)]
    bk = spark.createDataFrame(rows, "tid long, items array<string>").persist()
    fi, n = mining.mine(bk, 4).persist(), counting.transaction_count(bk).first()["n"]
    support = {frozenset(r["items"]): r.support for r in fi.collect()}
    closed = {frozenset(r["items"]): r.support for r in mining.closed(fi).collect()}
    maximal = {frozenset(r["items"]) for r in mining.maximal(fi).collect()}
    assert n == 60 and maximal <= set(closed) <= set(support)
    for s, k in support.items():
        assert all(s - {x} in support and support[s - {x}] >= k for x in s if len(s) > 1)
        assert any(s <= m for m in maximal)
        assert k == max(v for c, v in closed.items() if s <= c)
    pairs = {frozenset((r.item_a, r.item_b)): r.support for r in counting.pair_support(bk).collect()}
    assert {s: k for s, k in pairs.items() if k >= 4} == {s: k for s, k in support.items() if len(s) == 2}


def test_repeats_and_nulls_do_not_change_counts(spark):
    from coterie.sources.transactions import from_arrays

    df = spark.createDataFrame([(1, ["a", "a", None, "b"]), (2, None), (3, ["b"]), (3, ["b"])], "tid long, items array<string>")
    bk = from_arrays(df)
    assert {r.itemset: r.support for r in mining.mine(bk, 1).collect()} == {"a": 1, "b": 3, "a b": 1}
    assert {(r["item"], r["rank"]) for r in counting.item_rank(bk, 1).collect()} == {("b", 1), ("a", 2)}
    assert bk.where(F.size("items") == 0).count() == 1
