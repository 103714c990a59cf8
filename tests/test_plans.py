"""What the plans must not have, and what the scans must read."""

import os
import re

import pytest

from coterie.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.mark.parametrize("name", ["item_support", "pair_support", "parse_transactions", "conditional_base", "prefix_tree", "box_query", "keyword_all", "spatial_keyword", "inverted_index", "grid_cells", "closed_itemsets", "maximal_itemsets", "association_rules", "frequent_sets_index", "conditional_support_by_pairs", "quadtree_leaves", "subsumed_sets"])
def test_no_product_of_tables(spark, name):
    text = plan(QUERIES[name](spark, DATA))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython|ArrowEvalPython", text)
    spark.catalog.clearCache()


def test_scans_read_what_they_need(spark):
    schemas = re.findall(r"ReadSchema: (struct<.*?>)", plan(QUERIES["pair_support"](spark, DATA)))
    assert sorted(schemas) == ["struct<l_orderkey:bigint,l_partkey:bigint>", "struct<p_partkey:bigint,p_brand:string>"]
    text = plan(QUERIES["item_support"](spark, DATA))
    assert "PushedFilters: [IsNotNull(l_orderkey)" in text or "IsNotNull(l_partkey)" in text


def test_partial_sums_come_before_the_shuffle(spark):
    text = plan(QUERIES["pair_support"](spark, DATA))
    assert text.count("partial_count") >= 1
