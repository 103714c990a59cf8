"""SQL (DuckDB) that gives the rows of the registered queries from the same tables."""

from __future__ import annotations

from coterie.plans.queries import ITEM, SHARES
from coterie.plans.tables import BOUNDS, BOXES, CAPACITY, DEPTH, GRID

PAIRS = {
    "order_type": "SELECT DISTINCT l_orderkey AS tid, p_type AS item FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_type IS NOT NULL",
    "order_brand": "SELECT DISTINCT l_orderkey AS tid, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IS NOT NULL",
    "cust_attr": "SELECT c_custkey AS tid, unnest(['nation=' || replace(n_name, ' ', '_'), 'region=' || replace(r_name, ' ', '_'), 'seg=' || replace(c_mktsegment, ' ', '_')]) AS item FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "blank_items": "SELECT c_custkey AS tid, unnest(CASE c_custkey % 3 WHEN 0 THEN [r_name, c_mktsegment] WHEN 1 THEN [c_mktsegment || ' ' || r_name] ELSE [c_mktsegment || ' ' || r_name, 'of ' || n_name] END) AS item FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "cust_brand": "SELECT DISTINCT o_custkey AS tid, p_brand AS item FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey IS NOT NULL AND p_brand IS NOT NULL",
    "suppliers": "SELECT DISTINCT l_orderkey AS tid, l_suppkey % 50 AS item FROM lineitem",
    "user_events": "SELECT DISTINCT user_id AS tid, event_type AS item FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL",
}


def base(name: str, share: tuple[int, int] | None = None) -> str:
    p, q = share or SHARES[name]
    return f"""b AS MATERIALIZED ({PAIRS[name]}),
t AS MATERIALIZED (SELECT count(DISTINCT tid) AS n, greatest(1, ({p} * count(DISTINCT tid) + {q} - 1) // {q}) AS t FROM b),
sup AS MATERIALIZED (SELECT item, count(*)::BIGINT AS support FROM b GROUP BY item),
rk AS MATERIALIZED (SELECT item, support, row_number() OVER (ORDER BY support DESC, item)::INT AS rank FROM sup WHERE support >= (SELECT t FROM t))"""


def sets(name: str, share: tuple[int, int] | None = None) -> str:
    return f"""WITH RECURSIVE {base(name, share)},
fb AS MATERIALIZED (SELECT b.tid, b.item FROM b JOIN rk USING (item)),
r(tid, last, items) AS (SELECT tid, item, [item] FROM fb UNION ALL SELECT r.tid, fb.item, list_append(r.items, fb.item) FROM r JOIN fb ON fb.tid = r.tid AND fb.item > r.last),
fi AS MATERIALIZED (SELECT items, array_to_string(items, ' ') AS itemset, len(items)::INT AS len, count(*)::BIGINT AS support FROM r GROUP BY items HAVING count(*) >= (SELECT t FROM t)),
closed AS (SELECT * FROM fi x WHERE NOT EXISTS (SELECT 1 FROM fi y WHERE y.len = x.len + 1 AND y.support = x.support AND list_has_all(y.items, x.items))),
maximal AS (SELECT * FROM fi x WHERE NOT EXISTS (SELECT 1 FROM fi y WHERE y.len = x.len + 1 AND list_has_all(y.items, x.items)))"""


def wide_sets(name: str, share: tuple[int, int] | None = None) -> str:
    """The same for long baskets: sets grow by an item, each with the list of its baskets."""
    return f"""WITH RECURSIVE {base(name, share)},
one AS MATERIALIZED (SELECT item, list(tid ORDER BY tid) AS tids FROM b JOIN rk USING (item) GROUP BY item),
r(last, items, tids) AS (SELECT item, [item], tids FROM one UNION ALL SELECT one.item, list_append(r.items, one.item), list_intersect(r.tids, one.tids) FROM r JOIN one ON one.item > r.last AND len(list_intersect(r.tids, one.tids)) >= (SELECT t FROM t)),
fi AS MATERIALIZED (SELECT items, array_to_string(items, ' ') AS itemset, len(items)::INT AS len, len(tids)::BIGINT AS support FROM r),
closed AS (SELECT * FROM fi x WHERE NOT EXISTS (SELECT 1 FROM fi y WHERE y.len = x.len + 1 AND y.support = x.support AND list_has_all(y.items, x.items)))"""


#: Sets of numbers as text: in the order of their texts, as itemsets are.
NUMBERS = "SELECT array_to_string(list_sort(list_transform(items, lambda x: x::VARCHAR)), ' ') AS itemset, len, support FROM {}"
ROWS = "SELECT itemset, len, support FROM {}"
EMPTY_FI = "SELECT '' AS itemset, 0::INT AS len, n::BIGINT AS support FROM t WHERE EXISTS (SELECT 1 FROM fi)"
EMPTY_CFI = EMPTY_FI + " AND n <> (SELECT max(support) FROM fi)"
CODED = "coded AS MATERIALIZED (SELECT tid, list(item ORDER BY rank) AS items, list(rank ORDER BY rank) AS ranks FROM b JOIN rk USING (item) GROUP BY tid)"
TREE = "tree AS MATERIALIZED (SELECT array_to_string(p, ' ') AS prefix, len(p)::INT AS level, count(*)::BIGINT AS count FROM (SELECT items[1:k] AS p FROM (SELECT items, unnest(range(1, len(items) + 1)) AS k FROM coded)) GROUP BY p)"
BASE_ROWS = f"cb AS MATERIALIZED (SELECT items[1:list_position(items, '{ITEM}') - 1] AS items, count(*)::BIGINT AS weight FROM coded WHERE list_contains(items, '{ITEM}') GROUP BY 1)"
COND = "cs AS MATERIALIZED (SELECT item, sum(weight)::BIGINT AS support FROM (SELECT unnest(items) AS item, weight FROM cb) GROUP BY item HAVING sum(weight) >= (SELECT t FROM t))"
COND_RANK = "cr AS MATERIALIZED (SELECT item, support, row_number() OVER (ORDER BY support DESC, item)::INT AS rank FROM cs)"
HISTOGRAM = "SELECT l::INT AS len, (SELECT count(*) FROM {0} WHERE len = l)::BIGINT AS n FROM (SELECT unnest(range(1, (SELECT max(len) FROM {0}) + 1)) AS l)"


def tree_of(name: str) -> str:
    return f"WITH {base(name)}, {CODED}, {TREE}"


PAIRS_AS = f"b AS ({PAIRS['suppliers']})"
_BOXES = ", ".join(f"({q}, {x0}::DOUBLE, {y0}::DOUBLE, {x1}::DOUBLE, {y1}::DOUBLE, {kw!r})" for q, x0, y0, x1, y1, kw in BOXES)
OBJECTS = f"""WITH kws AS (SELECT l_orderkey, list(DISTINCT p_brand) AS kw FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IS NOT NULL GROUP BY 1),
o AS MATERIALIZED (SELECT o_orderkey AS id, o_totalprice AS x, c_acctbal AS y, coalesce(kw, []) AS kw FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN kws ON o_orderkey = l_orderkey),
q(qid, x0, y0, x1, y1, wanted) AS (VALUES {_BOXES})"""
INSIDE = "x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1"
MATCH = "SELECT qid::BIGINT AS qid, id FROM o, q WHERE {}"

def _cell(value: str, low: float, high: float) -> str:
    return f"greatest(0, least({(1 << DEPTH) - 1}, floor(({value} - ({low})::DOUBLE) / {(high - low) / (1 << DEPTH)}::DOUBLE)))::BIGINT"


#: cells(cx, cy, h, n): the curve is walked a bit at a time, from the highest on.
HILBERT = f"""{OBJECTS.replace('WITH', 'WITH RECURSIVE', 1)},
occupied AS MATERIALIZED (SELECT {_cell('x', BOUNDS[0], BOUNDS[2])} AS cx, {_cell('y', BOUNDS[1], BOUNDS[3])} AS cy, count(*)::BIGINT AS n FROM o GROUP BY ALL),
walk(cx, cy, x, y, s, h) AS (SELECT cx, cy, cx, cy, {1 << (DEPTH - 1)}::BIGINT, 0::BIGINT FROM occupied UNION ALL
  SELECT cx, cy, CASE WHEN y & s > 0 THEN x WHEN x & s > 0 THEN {(1 << DEPTH) - 1} - y ELSE y END, CASE WHEN y & s > 0 THEN y WHEN x & s > 0 THEN {(1 << DEPTH) - 1} - x ELSE x END,
    s >> 1, h + s * s * xor(3 * (x & s > 0)::BIGINT, (y & s > 0)::BIGINT) FROM walk WHERE s > 0),
cells AS MATERIALIZED (SELECT cx, cy, h, n FROM walk JOIN occupied USING (cx, cy) WHERE s = 0)"""

ORACLE: dict[str, str] = {
    "transaction_count": f"WITH {base('order_type')} SELECT n::BIGINT AS n FROM t",
    "parse_transactions": "WITH l AS (SELECT l_orderkey AS tid, string_agg('-' || l_partkey || '.00' || l_suppkey, '; ' ORDER BY l_linenumber, l_partkey, l_suppkey) AS line FROM lineitem GROUP BY 1), p AS (SELECT tid, list_transform(regexp_extract_all(line, '[0-9]+'), lambda x: x::BIGINT) AS raw FROM l) SELECT tid, len(raw)::INT AS n_raw, array_to_string(list_sort(list_distinct(raw)), ' ') AS items FROM p",
    "item_support": f"WITH {base('order_brand')} SELECT item, support FROM sup",
    "frequent_items": f"WITH {base('order_brand', (16, 100))} SELECT item, support FROM rk",
    "item_rank": f"WITH {base('order_brand')} SELECT item, support, rank FROM rk",
    "encoded_baskets": f"WITH {base('order_brand', (16, 100))}, {CODED} SELECT tid, array_to_string(ranks, ' ') AS ranks, array_to_string(items, ' ') AS items FROM coded",
    "decoded_baskets": f"WITH {base('order_brand', (16, 100))}, {CODED} SELECT tid, array_to_string(list_sort(items), ' ') AS items FROM coded",
    "pair_support": f"WITH {base('order_brand')} SELECT x.item AS item_a, y.item AS item_b, count(*)::BIGINT AS support FROM b x JOIN b y ON x.tid = y.tid AND x.item < y.item GROUP BY ALL",
    "conditional_base": f"WITH {base('order_type')}, {CODED}, {BASE_ROWS} SELECT array_to_string(items, ' ') AS path, weight FROM cb",
    "conditional_support": f"WITH {base('order_type')}, {CODED}, {BASE_ROWS}, {COND} SELECT item, support FROM cs",
    "conditional_support_by_pairs": f"WITH {base('order_type')}, {CODED}, {BASE_ROWS}, {COND} SELECT item, support FROM cs",
    "conditional_rank": f"WITH {base('order_type')}, {CODED}, {BASE_ROWS}, {COND}, {COND_RANK} SELECT item, support, rank FROM cr",
    "conditional_tree": f"WITH {base('order_type')}, {CODED}, {BASE_ROWS}, {COND}, {COND_RANK}, own AS (SELECT items AS path, weight, list(item ORDER BY rank) AS ordered FROM (SELECT items, weight, unnest(items) AS item FROM cb) JOIN cr USING (item) GROUP BY items, weight) SELECT array_to_string(p, ' ') AS prefix, len(p)::INT AS level, sum(weight)::BIGINT AS count FROM (SELECT ordered[1:k] AS p, weight FROM (SELECT ordered, weight, unnest(range(1, len(ordered) + 1)) AS k FROM own)) GROUP BY p",
    "prefix_tree": f"{tree_of('order_type')} SELECT prefix, level, count FROM tree",
    "tree_levels": f"{tree_of('order_type')} SELECT level, count(*)::BIGINT AS nodes, sum(count)::BIGINT AS baskets FROM tree GROUP BY level",
    "tree_shape": f"{tree_of('order_type')}, u AS (SELECT count(*)::BIGINT AS nodes, coalesce(sum((level <= floor((SELECT max(level) FROM tree) * 0.25))::INT), 0)::BIGINT AS upper_nodes FROM tree) SELECT nodes, upper_nodes, CASE WHEN nodes > 0 THEN 100.0::DOUBLE * upper_nodes / nodes ELSE 0 END AS percent FROM u",
    "single_path": " UNION ALL ".join(f"(WITH {base(n)}, {CODED}, {TREE} SELECT coalesce((SELECT max(k) FROM (SELECT count(*) AS k FROM tree GROUP BY level)), 0) <= 1 AS single_path, '{n}' AS baskets)" for n in ("order_type", "user_events")),
    "single_path_closed": f"{tree_of('user_events')} SELECT array_to_string(list_sort(string_split(prefix, ' ')), ' ') AS itemset, level AS len, count AS support FROM (SELECT *, lead(count, 1, -1) OVER (ORDER BY level) AS after FROM tree) WHERE count > after",
    "path_power_set": f"{sets('user_events')} {ROWS.format('fi')}",
    "frequent_itemsets": f"{sets('order_brand')} {ROWS.format('fi')}",
    "frequent_itemsets_with_empty": f"{sets('order_type')} {ROWS.format('fi')} UNION ALL {EMPTY_FI}",
    "frequent_itemsets_cust_attr": f"{sets('cust_attr')} {ROWS.format('fi')}",
    "closed_itemsets": f"{sets('cust_attr')} {ROWS.format('closed')}",
    "closed_itemsets_with_empty": f"{sets('cust_attr')} {ROWS.format('closed')} UNION ALL {EMPTY_CFI}",
    "closed_itemsets_single_path": f"{sets('user_events')} {ROWS.format('closed')} UNION ALL {EMPTY_CFI}",
    "maximal_itemsets": f"{sets('cust_attr')} {ROWS.format('maximal')}",
    "maximal_itemsets_order_brand": f"{sets('order_brand')} {ROWS.format('maximal')}",
    "maximal_itemsets_with_empty": f"{sets('cust_attr')} {ROWS.format('maximal')}",
    "dense_closed_itemsets": f"{sets('cust_attr')} {ROWS.format('closed')}",
    "dense_maximal_itemsets": f"{sets('cust_attr')} {ROWS.format('maximal')}",
    "dense_maximal_order_brand": f"{sets('order_brand')} {ROWS.format('maximal')}",
    "dense_closed_cust_brand": f"{wide_sets('cust_brand')} {ROWS.format('closed')}",
    "maximal_itemsets_blank_items": f"{sets('blank_items')} SELECT array_to_string(items, '|') AS items, len, support FROM maximal",
    "closed_itemsets_blank_items": f"{sets('blank_items')} SELECT array_to_string(items, '|') AS items, len, support FROM closed",
    "len_hist_fi": f"{sets('cust_attr')} {HISTOGRAM.format('fi')}",
    "len_hist_cfi": f"{sets('cust_attr')} {HISTOGRAM.format('closed')}",
    "len_hist_mfi": f"{sets('cust_attr')} {HISTOGRAM.format('maximal')}",
    "subsumed_sets": f"{sets('cust_attr')} SELECT itemset, len, support FROM fi x WHERE EXISTS (SELECT 1 FROM fi y WHERE y.len = 2 AND y.itemset LIKE '%region=%' AND y.itemset LIKE '%seg=%' AND list_has_all(y.items, x.items))",
    "subsumed_sets_closed": f"{sets('cust_attr')} SELECT itemset, len, support FROM fi x WHERE EXISTS (SELECT 1 FROM closed y WHERE y.len >= 2 AND y.support >= x.support AND list_has_all(y.items, x.items))",
    "itemset_files": f"{sets('order_type')} {ROWS.format('fi')} UNION ALL {EMPTY_FI}",
    **{name: f"WITH {PAIRS_AS} SELECT items, count(*)::BIGINT AS n FROM (SELECT array_to_string(list(item ORDER BY item), ' ') AS items FROM b GROUP BY tid) GROUP BY items" for name in ("text_files", "binary_files")},
    "command_frequent": f"{sets('suppliers', (1, 150))} {NUMBERS.format('fi')} UNION ALL {EMPTY_FI}",
    "command_closed": f"{sets('suppliers', (1, 150))} {NUMBERS.format('closed')} UNION ALL {EMPTY_CFI}",
    "command_maximal": f"{sets('suppliers', (1, 150))} {NUMBERS.format('maximal')}",
    "itemset_lines": f"{sets('order_type')} SELECT array_to_string(list_transform(items, lambda x: x || ' '), '') || '(' || support || ')' AS line FROM fi UNION ALL SELECT '(' || n || ')' FROM t WHERE EXISTS (SELECT 1 FROM fi)",
    "association_rules": f"{sets('order_type')}, c AS (SELECT items, support, unnest(items) AS consequent FROM fi WHERE len > 1), d AS (SELECT array_to_string(list_filter(items, lambda x: x <> consequent), ' ') AS antecedent, consequent, support FROM c) SELECT d.antecedent, d.consequent, d.support, d.support / l.support AS confidence, (d.support / l.support) / (r.support / (SELECT n FROM t)::DOUBLE) AS lift FROM d JOIN fi l ON l.itemset = d.antecedent JOIN fi r ON r.itemset = d.consequent",
    "box_query": f"{OBJECTS} {MATCH.format(INSIDE)}",
    "keyword_all": f"{OBJECTS} {MATCH.format('list_has_all(kw, wanted)')}",
    "keyword_any": f"{OBJECTS} {MATCH.format('list_has_any(kw, wanted)')}",
    "spatial_keyword": f"{OBJECTS} {MATCH.format(INSIDE + ' AND list_has_all(kw, wanted)')}",
    "spatial_keyword_any": f"{OBJECTS} {MATCH.format(INSIDE + ' AND list_has_any(kw, wanted)')}",
    "inverted_index": f"{OBJECTS} SELECT w AS kw, block, count(*)::BIGINT AS n, string_agg(id::VARCHAR, ' ' ORDER BY id) AS ids FROM (SELECT unnest(kw) AS w, id // 4096 AS block, id FROM o) GROUP BY ALL",
    "spatial_keyword_files": f"{OBJECTS} {MATCH.format(INSIDE + ' AND list_has_all(kw, wanted)')}",
    "frequent_sets_index": f"{sets('order_brand', (1, 250))} SELECT itemset, len, block, count(*)::BIGINT AS n, string_agg(id::VARCHAR, ' ' ORDER BY id) AS ids FROM (SELECT items, itemset, len, unnest(tids) // 4096 AS block, unnest(tids) AS id FROM (SELECT items, list(tid) AS tids FROM r GROUP BY items) JOIN fi USING (items) WHERE len >= 2) GROUP BY ALL",
    "hilbert_cells": f"{HILBERT} SELECT cx, cy, h, n FROM cells",
    "quadtree_leaves": f"""{HILBERT},
nodes AS MATERIALIZED (SELECT level, h >> (2 * ({DEPTH} - level)) AS quad, sum(n)::BIGINT AS n FROM (SELECT h, n, unnest(range(0, {DEPTH + 1}))::INT AS level FROM cells) GROUP BY ALL)
SELECT level, quad, n FROM nodes x WHERE (n <= {CAPACITY} OR level = {DEPTH}) AND NOT EXISTS (SELECT 1 FROM nodes y WHERE y.level = x.level - 1 AND y.quad = x.quad >> 2 AND y.n <= {CAPACITY})""",
    "box_query_layout": f"{OBJECTS} {MATCH.format(INSIDE)}",
    "grid_cells": f"{OBJECTS} SELECT floor(x / {GRID[0]}::DOUBLE)::BIGINT AS cx, floor(y / {GRID[1]}::DOUBLE)::BIGINT AS cy, count(*)::BIGINT AS n FROM o GROUP BY ALL",
    "streamed_hourly_counts": "SELECT date_trunc('hour', ts) AS start, event_type AS item, count(*)::BIGINT AS support FROM events WHERE ts IS NOT NULL AND event_type IS NOT NULL GROUP BY ALL",
    "streamed_item_support": "SELECT event_type AS item, count(*)::BIGINT AS support FROM events WHERE event_type IS NOT NULL GROUP BY 1",
}
