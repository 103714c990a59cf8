"""The registered queries over the driver's tables: one for each operator.

Thresholds are shares p / q of the number of baskets, in whole numbers, so that the
same query means the same at any size.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from coterie import __main__ as cli
from coterie.functions.session import fresh_path, settled
from coterie.operators import counting, dense, mining, quadtree, report, rules, spatial, tree
from coterie.plans import tables
from coterie.sources import objects as object_files
from coterie.sources import transactions
from coterie.sources.transactions import parse_items

Query = Callable[[SparkSession, str], DataFrame]
#: Shares of the baskets.
SHARES = {"order_type": (1, 75), "order_brand": (1, 500), "cust_attr": (1, 150), "user_events": (1, 10), "cust_brand": (1, 2), "blank_items": (1, 100)}
#: The item that conditional queries are about.
ITEM = "ECONOMY"
LINE_SEPARATOR = "; "


def _count(bk: DataFrame, name: str) -> tuple[int, int]:
    n = bk.count()
    return n, counting.min_count(n, *SHARES[name])


def _baskets(name: str) -> Callable[[SparkSession, str], tuple[DataFrame, int, int]]:
    def load(spark: SparkSession, sf_dir: str):
        bk = getattr(tables, name)(spark, sf_dir)  # not cached: nobody could say when to give the cache back
        return bk, *_count(bk, name)

    return load


order_type, order_brand, cust_attr, user_events, cust_brand, blank_items = map(_baskets, ("order_type", "order_brand", "cust_attr", "user_events", "cust_brand", "blank_items"))


def transaction_count(spark, sf_dir):
    return counting.transaction_count(tables.order_type(spark, sf_dir))


def parse_transactions(spark, sf_dir):
    lines = tables.table(spark, sf_dir, "lineitem").select("l_orderkey", F.struct("l_linenumber", "l_partkey", "l_suppkey").alias("s"))
    lines = lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list("s")).alias("s"))
    text = F.array_join(F.transform("s", lambda x: F.concat(F.lit("-"), x["l_partkey"].cast("string"), F.lit(".00"), x["l_suppkey"].cast("string"))), LINE_SEPARATOR)
    parsed = lines.select(F.col("l_orderkey").alias("tid"), parse_items(text).alias("raw"))
    return parsed.select("tid", F.size("raw").alias("n_raw"), F.array_join(F.array_sort(F.array_distinct("raw")).cast("array<string>"), " ").alias("items"))


def item_support(spark, sf_dir):
    return counting.item_support(tables.order_brand(spark, sf_dir))


def frequent_items(spark, sf_dir):
    bk, n, _ = order_brand(spark, sf_dir)
    return counting.frequent_items(bk, counting.min_count(n, 16, 100))


def item_rank(spark, sf_dir):
    bk, _, t = order_brand(spark, sf_dir)
    return counting.item_rank(bk, t)


def _coded(spark, sf_dir, load, p=None):
    bk, n, t = load(spark, sf_dir)
    t = counting.min_count(n, *p) if p else t
    ranks = counting.item_rank(bk, t)
    return bk, ranks, counting.encoded(bk, ranks), t


def encoded_baskets(spark, sf_dir):
    _, _, coded, _ = _coded(spark, sf_dir, order_brand, (16, 100))
    return coded.select("tid", F.array_join(F.col("ranks").cast("array<string>"), " ").alias("ranks"), F.array_join("items", " ").alias("items"))


def decoded_baskets(spark, sf_dir):
    _, ranks, coded, _ = _coded(spark, sf_dir, order_brand, (16, 100))
    return counting.decoded(coded, ranks).select("tid", F.array_join(F.array_sort("items"), " ").alias("items"))


def pair_support(spark, sf_dir):
    return counting.pair_support(tables.order_brand(spark, sf_dir))


def _base(spark, sf_dir):
    _, _, coded, t = _coded(spark, sf_dir, order_type)
    return tree.conditional_base(coded, ITEM), t


def conditional_base(spark, sf_dir):
    return _base(spark, sf_dir)[0].select("path", "weight")


def conditional_support(spark, sf_dir):
    return tree.conditional_support(*_base(spark, sf_dir))


def conditional_support_by_pairs(spark, sf_dir):
    bk, _, t = order_type(spark, sf_dir)
    return counting.conditional_support_by_pairs(counting.pair_support(bk), counting.item_rank(bk, t), ITEM, t)


def conditional_rank(spark, sf_dir):
    return tree.conditional_rank(*_base(spark, sf_dir))


def conditional_tree(spark, sf_dir):
    return _nodes(tree.conditional_tree(*_base(spark, sf_dir)))


def _tree(spark, sf_dir, load=order_type):
    return tree.prefix_tree(_coded(spark, sf_dir, load)[2])


def _nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select("prefix", "level", "count")


def prefix_tree(spark, sf_dir):
    return _nodes(_tree(spark, sf_dir))


def tree_levels(spark, sf_dir):
    return tree.tree_levels(_tree(spark, sf_dir))


def tree_shape(spark, sf_dir):
    return tree.upper_quarter(_tree(spark, sf_dir))


def single_path(spark, sf_dir):
    both = tree.single_path(_tree(spark, sf_dir)).withColumn("baskets", F.lit("order_type"))
    return both.unionByName(tree.single_path(_tree(spark, sf_dir, user_events)).withColumn("baskets", F.lit("user_events")))


def single_path_closed(spark, sf_dir):
    return tree.single_path_closed(_tree(spark, sf_dir, user_events))


def path_power_set(spark, sf_dir):
    return tree.path_power_set(_tree(spark, sf_dir, user_events))


def _mined(load, mode: str, with_empty: bool = False) -> Query:
    def query(spark, sf_dir):
        bk, _, t = load(spark, sf_dir)
        return mining.rows_of(mining.mine(bk, t, mode, with_empty))

    return query


def _dense(load, only_maximal: bool) -> Query:
    def query(spark, sf_dir):
        bk, _, t = load(spark, sf_dir)
        found = dense.closed_sets(bk, t)
        return mining.rows_of(found.where("maximal") if only_maximal else found)

    return query


def _histogram(mode: str) -> Query:
    def query(spark, sf_dir):
        bk, _, t = cust_attr(spark, sf_dir)
        return report.length_histogram(mining.mine(bk, t, mode))

    return query


def _blank(mode: str) -> Query:
    """Items that hold blanks, and sets whose texts are the same although the sets are not."""

    def query(spark, sf_dir):
        bk, _, t = blank_items(spark, sf_dir)
        return mining.mine(bk, t, mode).select(F.array_join("items", "|").alias("items"), "len", "support")

    return query


def subsumed_sets(spark, sf_dir):
    """Frequent sets that some set of a region and a segment contains."""
    bk, _, t = cust_attr(spark, sf_dir)
    fi = mining.frequent_itemsets(bk, t)
    both = fi.where((F.col("len") == 2) & F.exists("items", lambda x: x.startswith("region=")) & F.exists("items", lambda x: x.startswith("seg=")))
    return mining.rows_of(mining.subsumed(fi, both))


def subsumed_sets_closed(spark, sf_dir):
    """Frequent sets that a closed set of two or three items and at least their support contains."""
    bk, _, t = cust_attr(spark, sf_dir)
    fi = mining.frequent_itemsets(bk, t)
    return mining.rows_of(mining.subsumed(fi, mining.closed(fi).where("len >= 2"), same_support=True))


def itemset_lines(spark, sf_dir):
    bk, _, t = order_type(spark, sf_dir)
    return report.itemset_lines(mining.mine(bk, t, "frequent", True))


def itemset_files(spark, sf_dir):
    """Itemset lines written to the shared folder and read again."""
    bk, _, t = order_type(spark, sf_dir)
    path = fresh_path(spark, "itemsets")
    report.write_lines(mining.mine(bk, t, "frequent", True), path)
    return settled(mining.rows_of(report.read_lines(spark, path)), path)


def _of_files(bk: DataFrame) -> DataFrame:
    return bk.groupBy(F.array_join(F.col("items").cast("array<string>"), " ").alias("items")).agg(F.count(F.lit(1)).alias("n"))


def _suppliers(spark, sf_dir) -> DataFrame:
    lines = tables.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tid"), F.pmod("l_suppkey", F.lit(50)).cast("int").alias("item"))
    return transactions.baskets(lines)


def text_files(spark, sf_dir):
    """An order's supplier groups, written as lines of numbers and read again."""
    path = fresh_path(spark, "lines")
    transactions.write_text(_suppliers(spark, sf_dir), path)
    return settled(_of_files(transactions.read_text(spark, path)), path)


def binary_files(spark, sf_dir):
    """The same baskets, written as binary records and read again."""
    path = fresh_path(spark, "records")
    transactions.write_binary(_suppliers(spark, sf_dir), path)
    return settled(_of_files(transactions.read_binary(spark, path)), path)


def _command(mode: str) -> Query:
    """What the command line mines from a file of supplier groups and writes to another."""

    def query(spark, sf_dir):
        bk = _suppliers(spark, sf_dir)
        read, written = fresh_path(spark, "lines"), fresh_path(spark, "mined")
        transactions.write_text(bk, read)
        cli.mine_file(spark, read, counting.min_count(bk.count(), 1, 150), written, mode)
        return settled(mining.rows_of(cli.lines_of_file(spark, written)), read, written)

    return query


def association_rules(spark, sf_dir):
    bk, n, t = order_type(spark, sf_dir)
    return rules.association_rules(mining.frequent_itemsets(bk, t), n)


def box_query(spark, sf_dir):
    return spatial.box_query(tables.objects(spark, sf_dir), tables.box_queries(spark), *tables.GRID).select("qid", "id")


def _keyword(mode: str) -> Query:
    return lambda spark, sf_dir: spatial.keyword_query(tables.objects(spark, sf_dir), tables.box_queries(spark), mode)


def _spatial_keyword(mode: str) -> Query:
    return lambda spark, sf_dir: spatial.spatial_keyword_query(tables.objects(spark, sf_dir), tables.box_queries(spark), *tables.GRID, mode)


def inverted_index(spark, sf_dir):
    return spatial.inverted_index(tables.objects(spark, sf_dir))


def spatial_keyword_files(spark, sf_dir):
    """Objects and queries written as delimited text and read again, then the combined query."""
    of, qf = fresh_path(spark, "objects"), fresh_path(spark, "queries")
    object_files.write_objects(tables.objects(spark, sf_dir), of)
    object_files.write_queries(tables.box_queries(spark), qf)
    return settled(spatial.spatial_keyword_query(object_files.read_objects(spark, of), object_files.read_queries(spark, qf), *tables.GRID), of, qf)


def _frequent_keywords(spark, sf_dir) -> DataFrame:
    bk, n, _ = order_brand(spark, sf_dir)
    return mining.frequent_itemsets(bk, counting.min_count(n, 1, 250))


def frequent_sets_index(spark, sf_dir):
    found = spatial.frequent_sets_index(tables.objects(spark, sf_dir), _frequent_keywords(spark, sf_dir))
    return found.select("itemset", "len", "block", "n", "ids")


def hilbert_cells(spark, sf_dir):
    """The occupied cells of a grid along the Hilbert curve."""
    cells = quadtree.keyed(tables.objects(spark, sf_dir), tables.BOUNDS, tables.DEPTH)
    return cells.groupBy("cx", "cy", "h").agg(F.count(F.lit(1)).alias("n"))


def quadtree_leaves(spark, sf_dir):
    return quadtree.leaves(tables.objects(spark, sf_dir), tables.BOUNDS, tables.CAPACITY, tables.DEPTH)


def box_query_layout(spark, sf_dir):
    """Objects laid out by quadtree leaf; each box reads the leaves it meets."""
    path = fresh_path(spark, "layout")
    quadtree.write_layout(tables.objects(spark, sf_dir), path, tables.BOUNDS, 10 * tables.CAPACITY, tables.DEPTH)
    return settled(quadtree.box_query_layout(spark, path, tables.BOXES).select("qid", "id"), path)


def grid_cells(spark, sf_dir):
    """How many objects each grid cell has."""
    return spatial.cells(tables.objects(spark, sf_dir), *tables.GRID).groupBy("cx", "cy").agg(F.count(F.lit(1)).alias("n"))


def streamed_item_support(spark, sf_dir):
    from coterie.streaming.support import item_support_of_files

    return item_support_of_files(spark, f"{sf_dir}/events.parquet", "event_type")


def streamed_hourly_counts(spark, sf_dir):
    """Event types by hour of event time."""
    from coterie.streaming import support

    stream = support.stream_of_files(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    counts = support.final_table(spark, support.windowed_counts(stream, "ts", "event_type"))
    return counts.select(F.col("start").cast("timestamp_ntz").alias("start"), "item", "support")


QUERIES: dict[str, Query] = {
    "transaction_count": transaction_count, "parse_transactions": parse_transactions, "item_support": item_support, "frequent_items": frequent_items, "item_rank": item_rank,
    "encoded_baskets": encoded_baskets, "decoded_baskets": decoded_baskets, "pair_support": pair_support,
    "conditional_base": conditional_base, "conditional_support": conditional_support, "conditional_support_by_pairs": conditional_support_by_pairs, "conditional_rank": conditional_rank, "conditional_tree": conditional_tree,
    "prefix_tree": prefix_tree, "tree_levels": tree_levels, "tree_shape": tree_shape, "single_path": single_path, "single_path_closed": single_path_closed, "path_power_set": path_power_set,
    "frequent_itemsets": _mined(order_brand, "frequent"), "frequent_itemsets_with_empty": _mined(order_type, "frequent", True), "frequent_itemsets_cust_attr": _mined(cust_attr, "frequent"),
    "closed_itemsets": _mined(cust_attr, "closed"), "closed_itemsets_with_empty": _mined(cust_attr, "closed", True), "closed_itemsets_single_path": _mined(user_events, "closed", True),
    "maximal_itemsets": _mined(cust_attr, "maximal"), "maximal_itemsets_order_brand": _mined(order_brand, "maximal"), "maximal_itemsets_with_empty": _mined(cust_attr, "maximal", True),
    "dense_closed_itemsets": _dense(cust_attr, False), "dense_maximal_itemsets": _dense(cust_attr, True), "dense_maximal_order_brand": _dense(order_brand, True), "dense_closed_cust_brand": _dense(cust_brand, False),
    "len_hist_fi": _histogram("frequent"), "len_hist_cfi": _histogram("closed"), "len_hist_mfi": _histogram("maximal"),
    "maximal_itemsets_blank_items": _blank("maximal"), "closed_itemsets_blank_items": _blank("closed"),
    "subsumed_sets": subsumed_sets, "subsumed_sets_closed": subsumed_sets_closed, "itemset_lines": itemset_lines, "itemset_files": itemset_files, "association_rules": association_rules,
    "text_files": text_files, "binary_files": binary_files, "command_frequent": _command("frequent"), "command_closed": _command("closed"), "command_maximal": _command("maximal"),
    "box_query": box_query, "keyword_all": _keyword("all"), "keyword_any": _keyword("any"), "spatial_keyword": _spatial_keyword("all"), "spatial_keyword_any": _spatial_keyword("any"),
    "spatial_keyword_files": spatial_keyword_files, "inverted_index": inverted_index, "frequent_sets_index": frequent_sets_index,
    "grid_cells": grid_cells, "hilbert_cells": hilbert_cells, "quadtree_leaves": quadtree_leaves, "box_query_layout": box_query_layout,
    "streamed_item_support": streamed_item_support, "streamed_hourly_counts": streamed_hourly_counts,
}
