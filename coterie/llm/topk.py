"""Exact top-k inner products with KD-trees, over the whole table and in each shard.

A first tree, of median splits in the widest dimension, is fitted on a bounded sample of the
vectors and cuts space into at most `MOST_CELLS` cells. Every vector goes to its cell, and a
cell to as many shards as its rows need; a shard holds vectors of one length only. Each
shard has a tree of its own, by median splits down to leaves of `LEAF` rows, with the tight
box of every node. A box bounds the inner products of a query with all that is in it.

A query first visits one shard of the cell with the best bound. The kth score found there
goes with it to the shards of those cells whose boxes can still reach it, and to no others.
Inside a shard the search is best-first: the nodes with the best bounds are opened, few at
first and more as the search goes on, children enter with bounds of their own, and a query
is done when no open node reaches its kth score. Queries travel and search in blocks.

A shard answers with at most k rows a query, only those that beat the score it was given,
so what is ranked in the end has little more than k rows a query and cell visited. Memory
in a task: one tree and one block of queries; sample and cells' boxes have a bound of some
16 MB for each length of vectors. How much is pruned depends on the data: where nothing
is, all queries meet all shards, as any exact search must then.

Edge cases: a vector that is null or holds null or non-finite components takes no
part; queries meet vectors of their own length only (an empty vector scores 0);
rows with a null id take no part; ties go to the smaller id; a repeated id other
than the query's own is a candidate each time it occurs; a repeated query is answered each
time. Scores are exact in 64 bits; where a block's and a shard's numbers are so large that
a score could go beyond, the search raises ArithmeticError.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coterie.llm.common import shared_folder, table

SHARD_ROWS, SHARD_BYTES, BLOCK_QUERIES, LEAF = 16_384, 8 << 20, 512, 256
#: Of the tree over the table: rows and numbers of its sample, cells, numbers of the cells' boxes.
SAMPLE_ROWS, SAMPLE_NUMBERS, MOST_CELLS, BOX_NUMBERS = 1 << 14, 1 << 21, 1024, 1 << 19
#: Nodes a query opens at once, at most.
OPENED = 16
EXACT = 2.0**53
LOWEST = np.iinfo(np.int64).min
NONE = np.iinfo(np.int64).max


def usable(vector: str):
    v = F.col(vector)
    return v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


class Tree:
    """One shard's tree: points in the order of the leaves, and for each node its range, box, children (-1: a leaf) and smallest id."""

    NAMES = ("points", "ids", "cuts", "low", "high", "least", "child")

    def __init__(self, points: np.ndarray, ids: np.ndarray, leaf: int = LEAF):
        order, cuts, child, todo = np.arange(len(ids)), [(0, len(ids))], [-1], [0]
        while todo:  # a node's children come after it
            node = todo.pop()
            lo, hi = cuts[node]
            own = order[lo:hi]
            if hi - lo <= leaf:
                order[lo:hi] = own[np.argsort(ids[own], kind="stable")]  # ids ascend in a leaf
                continue
            mid = lo + (hi - lo) // 2
            if points.shape[1]:
                block = points[own]
                axis = int((block.max(axis=0) - block.min(axis=0)).argmax())
                order[lo:hi] = own[np.argpartition(block[:, axis], mid - lo, kind="introselect")]
            child[node] = len(cuts)
            todo += [len(cuts), len(cuts) + 1]
            cuts += [(lo, mid), (mid, hi)]
            child += [-1, -1]
        self.cuts, self.child = np.array(cuts, np.int64).reshape(-1, 2), np.array(child, np.int64)
        self.points, self.ids = points[order], ids[order]
        self.low, self.high = np.empty((len(cuts), points.shape[1]), np.int64), np.empty((len(cuts), points.shape[1]), np.int64)
        self.least = np.empty(len(cuts), np.int64)
        for node in range(len(cuts) - 1, -1, -1):
            (lo, hi), c = cuts[node], child[node]
            if c < 0:
                self.low[node], self.high[node], self.least[node] = self.points[lo:hi].min(axis=0), self.points[lo:hi].max(axis=0), self.ids[lo]
            else:
                self.low[node], self.high[node], self.least[node] = np.minimum(self.low[c], self.low[c + 1]), np.maximum(self.high[c], self.high[c + 1]), min(self.least[c], self.least[c + 1])

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray, floor_id: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, id, score) of each query's k best here that beat (floor, floor_id); ids equal to own don't count."""
        n = len(queries)
        up, down = np.maximum(queries, 0), np.minimum(queries, 0)
        score = np.full((n, k + 1), LOWEST, np.int64)
        ids = np.full((n, k + 1), NONE, np.int64)
        score[:, k], ids[:, k] = floor, floor_id  # stands behind the k best, and is the bar until they are found
        bar, bar_id = floor.copy(), floor_id.copy()
        shut = LOWEST if queries.dtype == np.int64 else -np.inf
        # open nodes of each query: their numbers and bounds; a slot that is done has the bound `shut`
        slots = int((self.child < 0).sum()) + 1
        node = np.zeros((n, slots), np.int64)
        bound = np.full((n, slots), shut, queries.dtype)
        bound[:, 0] = up @ self.high[0] + down @ self.low[0]
        used, live, opened = np.ones(n, np.int64), np.arange(n), 1
        while len(live):
            width = min(opened, int(used[live].max()))
            own_bound = bound[live, : int(used[live].max())]
            best = np.argpartition(own_bound, own_bound.shape[1] - width, axis=1)[:, -width:] if width < own_bound.shape[1] else np.broadcast_to(np.arange(width), own_bound.shape)
            b = np.take_along_axis(own_bound, best, 1)
            reach = (b != shut) & (b >= bar[live, None])
            live, best, b, reach = (x[reach.any(axis=1)] for x in (live, best, b, reach))  # the others are done
            i, j = np.nonzero(reach)
            row, slot = live[i], best[i, j]
            at, b = node[row, slot], b[i, j]
            bound[row, slot] = shut
            may = (b > bar[row]) | (self.least[at] < bar_id[row])  # at the kth score itself only smaller ids count
            row, slot, at = row[may], slot[may], at[may]
            inner = self.child[at] >= 0
            r, s, c = row[inner], slot[inner], self.child[at[inner]]
            if len(r):  # rows ascend: one child takes its parent's slot, the other the next free one
                nth = np.arange(len(r)) - np.searchsorted(r, r, "left")
                for where, which in ((s, c), (used[r] + nth, c + 1)):
                    node[r, where] = which
                    bound[r, where] = np.einsum("ij,ij->i", up[r], self.high[which]) + np.einsum("ij,ij->i", down[r], self.low[which])
                used += np.bincount(r, minlength=n)
            r, leaf = row[~inner], at[~inner]
            order = np.argsort(leaf, kind="stable")
            r, leaf = r[order], leaf[order]
            for x in np.split(np.arange(len(r)), np.flatnonzero(np.diff(leaf)) + 1) if len(r) else []:
                self._visit(queries, own, k, r[x], int(leaf[x[0]]), score, ids, bar, bar_id)
            opened = min(2 * opened, OPENED)
        q, j = np.nonzero(ids[:, :k] != NONE)
        return q, ids[q, j], score[q, j]

    def _visit(self, queries, own, k, rows, leaf, score, ids, bar, bar_id) -> None:
        """Compares some queries with a leaf's points and takes what beats their bars."""
        lo, hi = self.cuts[leaf]
        got = (queries[rows] @ self.points[lo:hi].T).astype(np.int64)
        names = np.broadcast_to(self.ids[lo:hi], got.shape)
        fits = ((got > bar[rows, None]) | ((got == bar[rows, None]) & (names < bar_id[rows, None]))) & (names != own[rows, None])
        some = fits.any(axis=1)
        if not some.any():
            return
        rows, got, names, fits = rows[some], got[some], names[some], fits[some]
        masked = np.where(fits, got, LOWEST)
        # ids ascend in a leaf, so a stable sort keeps the smaller id first among equals
        top = np.argsort(~masked, axis=1, kind="stable")[:, : min(k, hi - lo)]
        take = np.take_along_axis
        s = np.concatenate([score[rows, :k], take(masked, top, 1)], axis=1)
        i = np.concatenate([ids[rows, :k], np.where(take(fits, top, 1), take(names, top, 1), NONE)], axis=1)
        keep = np.lexsort((i, ~s), axis=1)[:, :k]  # ~ turns the order of signed numbers round, without overflow
        score[rows, :k], ids[rows, :k] = take(s, keep, 1), take(i, keep, 1)
        full = ids[rows, k - 1] != NONE
        bar[rows[full]], bar_id[rows[full]] = score[rows[full], k - 1], ids[rows[full], k - 1]


class Cells:
    """The tree over the table for vectors of one length: splits in the order of a heap, 2 ** depth cells."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth if sample.shape[1] and len(sample) else 0
        self.axis, self.cut = np.zeros(1 << self.depth, np.int64), np.zeros(1 << self.depth)
        groups = {1: sample}
        for node in range(1, 1 << self.depth):
            points = groups.pop(node)
            if len(points):
                self.axis[node] = int((points.max(axis=0) - points.min(axis=0)).argmax())
                own = points[:, self.axis[node]]
                self.cut[node] = np.median(own)
                groups[2 * node], groups[2 * node + 1] = points[own < self.cut[node]], points[own >= self.cut[node]]
            else:
                groups[2 * node] = groups[2 * node + 1] = points

    def of(self, points: np.ndarray) -> np.ndarray:
        at = np.ones(len(points), np.int64)
        for _ in range(self.depth):
            at = 2 * at + (points[np.arange(len(points)), self.axis[at]] >= self.cut[at])
        return at - (1 << self.depth)


class Boxes:
    """The boxes of the cells that have rows; bounds are in floating point, with room for its errors."""

    def __init__(self, cells: np.ndarray, low: np.ndarray, high: np.ndarray):
        self.cells, self.low, self.high = cells, low.astype(float), high.astype(float)
        self.most = np.maximum(np.abs(self.low), np.abs(self.high))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        q = queries.astype(float)
        return np.maximum(q, 0) @ self.high.T + np.minimum(q, 0) @ self.low.T + 1e-9 * (np.abs(q) @ self.most.T)


def _by_length(batch: pa.RecordBatch):
    """(length, rows, their vectors as a matrix) of a batch with the column v."""
    v = batch.column(batch.schema.get_field_index("v"))
    sizes = v.value_lengths().to_numpy(zero_copy_only=False)
    flat, ends = v.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes)
    for dims in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == dims)
        yield dims, rows, flat[(ends[rows] - dims)[:, None] + np.arange(dims)].reshape(len(rows), dims)


def _numbers(whole: np.ndarray, limit: float) -> np.ndarray:
    """As float64 where every product and sum is exact there, else as int64."""
    return whole.astype(np.float64) if limit < EXACT else whole


def _bytes(*values: np.ndarray) -> list[pa.Array]:
    return [pa.array([np.ascontiguousarray(x).astype(np.int64).tobytes()], pa.binary()) for x in values]


BLOCK = ("q", "qid", "qn", "floor", "floor_id", "home")
BLOCKS = "dims int, cell int, " + ", ".join(f"{c} binary" for c in BLOCK)
TREES = "dims int, cell int, sub int, " + ", ".join(f"{c} binary" for c in Tree.NAMES)


def top_k(vectors: DataFrame, queries: DataFrame, k: int, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """Rows (query_id, rank, vec_id, score) for integer vectors.

    Both inputs have the columns id (long) and v (array<long>).
    """
    spark = vectors.sparkSession
    sc = spark.sparkContext
    shared_folder(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    vectors, queries = (x.where(F.col("id").isNotNull() & F.col("v").isNotNull()).select("id", "v") for x in (vectors, queries))
    count = lambda df: {r["dims"]: r["n"] for r in df.groupBy(F.size("v").alias("dims")).agg(F.count(F.lit(1)).alias("n")).collect()}  # noqa: E731 - one number for each vector length
    sizes, asked = count(vectors), count(queries)
    lengths = sorted(set(sizes) & set(asked))
    if not lengths:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows_of = {d: max(1, min(shard_rows, SHARD_BYTES // (8 * max(d, 1)))) for d in lengths}
    vectors, queries = (x.where(F.size("v").isin(lengths)) for x in (vectors, queries))

    # the tree over the table: its sample has a bound in rows and in numbers
    cells = {}
    for d in lengths:
        most = max(1, min(SAMPLE_ROWS, SAMPLE_NUMBERS // max(d, 1)))
        depth = int(np.ceil(np.log2(max(1, min(MOST_CELLS, BOX_NUMBERS // max(d, 1), -(-sizes[d] // rows_of[d])))))) if d else 0
        own = vectors.where(F.size("v") == d).where(F.pmod(F.xxhash64("id", "v"), F.lit(1 << 30)) <= int((1 << 30) * min(1.0, most / sizes[d]))).select("v").limit(most)
        cells[d] = Cells(np.array([r["v"] for r in own.collect()], np.int64).reshape(-1, d) if depth else np.zeros((0, d), np.int64), depth)
    tops = sc.broadcast(cells)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cell = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int32)
            for d, rows, points in _by_length(batch):
                dims[rows], cell[rows] = d, tops.value[d].of(points)
            yield pa.RecordBatch.from_arrays([pa.array(dims), pa.array(cell), *batch.columns], ["dims", "cell", *batch.schema.names])

    placed = vectors.mapInArrow(place, "dims int, cell int, id long, v array<long>")
    # at most MOST_CELLS rows for each length
    held = {(r["dims"], r["cell"]): r["n"] for r in placed.groupBy("dims", "cell").agg(F.count(F.lit(1)).alias("n")).collect()}
    subs = {key: -(-n // rows_of[key[0]]) for key, n in held.items()}
    shards = F.broadcast(spark.createDataFrame([(d, c, n) for (d, c), n in subs.items()], "dims int, cell int, subs int"))

    def build(keys: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        d = keys[0].as_py()
        points = t.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, d)
        tree = Tree(points, t.column("id").to_numpy())
        yield pa.RecordBatch.from_arrays([*(pa.array([x.as_py()], pa.int32()) for x in keys), *_bytes(*(getattr(tree, c) for c in Tree.NAMES))], ["dims", "cell", "sub", *Tree.NAMES])

    sub = F.pmod(F.xxhash64("id", "v"), F.col("subs")).cast("int").alias("sub")
    trees = placed.join(shards, ["dims", "cell"]).select("dims", "cell", sub, "id", "v").groupBy("dims", "cell", "sub").applyInArrow(build, TREES).checkpoint()

    def box(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got: dict[tuple, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                low, high = (np.frombuffer(r[c], np.int64) for c in ("low", "high"))
                key, d = (r["dims"], r["cell"]), r["dims"]
                last = got.get(key, [low[:d], high[:d]])
                got[key] = [np.minimum(last[0], low[:d]), np.maximum(last[1], high[:d])]  # a shard's first box is its root's
        for (d, c), (low, high) in got.items():
            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([c], pa.int32()), *_bytes(low, high)], ["dims", "cell", "low", "high"])

    boxed = "dims int, cell int, low binary, high binary"
    roots = trees.select("dims", "cell", F.substring("low", F.lit(1), F.col("dims") * 8).alias("low"), F.substring("high", F.lit(1), F.col("dims") * 8).alias("high"))
    by_length: dict[int, list] = {d: [] for d in lengths}
    # one box for each cell: at most BOX_NUMBERS numbers a side for each length
    for r in roots.mapInArrow(box, boxed).repartition(parts, "dims", "cell").mapInArrow(box, boxed).collect():
        by_length[r["dims"]].append((r["cell"], np.frombuffer(r["low"], np.int64), np.frombuffer(r["high"], np.int64)))
    boxes = sc.broadcast({d: Boxes(np.array([c for c, _, _ in found]), *(np.array([f[side] for f in found]).reshape(len(found), d) for side in (1, 2))) for d, found in by_length.items() if found})

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims, cell = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int32)
            for d, rows, points in _by_length(batch):
                own = boxes.value[d]
                dims[rows], cell[rows] = d, own.cells[own.bounds(points).argmax(axis=1)]
            yield pa.RecordBatch.from_arrays([pa.array(dims), pa.array(cell), *batch.columns], ["dims", "cell", *batch.schema.names])

    # queries of one home lie together, but a home of very many is spread
    spread = F.pmod(F.xxhash64("id", "v", F.lit(2)), F.lit(max(1, sum(asked.values()) // (16 * block_queries)))).cast("int")
    homed = queries.mapInArrow(route, "dims int, cell int, id long, v array<long>").join(shards, ["dims", "cell"]).select("dims", "cell", sub, spread.alias("salt"), "id", "v")
    homed = homed.repartition(parts, "dims", "cell", "sub", "salt").sortWithinPartitions("dims", "cell", "sub").drop("salt").withColumn("qn", F.monotonically_increasing_id()).checkpoint()

    def pack(visits):
        """For mapInArrow: blocks of the queries of a batch for the cells that visits(length, matrix, batch rows, floor) names."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for at in range(0, batch.num_rows, block_queries):
                    part = batch.slice(at, block_queries)
                    col = lambda c: part.column(part.schema.get_field_index(c))  # noqa: B023, E731
                    qid, qn, cell, subn = (col(c).to_numpy() for c in ("id", "qn", "cell", "sub"))
                    floor, floor_id = (col(c).to_numpy() for c in ("floor", "floor_id"))
                    for d, rows, points in _by_length(part):
                        for c, own in visits(d, points, cell[rows], floor[rows]):
                            r = rows[own]
                            home = np.where(cell[r] == c, subn[r], -1)
                            yield pa.RecordBatch.from_arrays([pa.array([d], pa.int32()), pa.array([c], pa.int32()), *_bytes(points[own], qid[r], qn[r], floor[r], floor_id[r], home)], ["dims", "cell", *BLOCK])

        return run

    def at_home(d, points, cell, floor):
        for c in np.unique(cell).tolist():
            yield c, np.flatnonzero(cell == c)

    def reached(d, points, cell, floor):
        own = boxes.value[d]
        may = own.bounds(points) >= floor[:, None].astype(float)
        for j in np.flatnonzero(may.any(axis=0)).tolist():
            yield int(own.cells[j]), np.flatnonzero(may[:, j])

    def searched(blocks: DataFrame, first: bool) -> DataFrame:
        """Answers of blocks from the shards of their cells: of the home shards first, then of all others."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            last, tree = None, None
            for batch in batches:
                for r in range(batch.num_rows):
                    get = lambda name: batch.column(batch.schema.get_field_index(name))[r]  # noqa: B023, E731
                    long = lambda name: np.frombuffer(get(name).as_buffer(), np.int64)  # noqa: B023, E731
                    d, key = get("dims").as_py(), tuple(get(c).as_py() for c in ("dims", "cell", "sub"))
                    if key != last:
                        tree, last = Tree.__new__(Tree), key
                        for name in Tree.NAMES:
                            setattr(tree, name, long(name))
                        tree.cuts, tree.points = tree.cuts.reshape(-1, 2), tree.points.reshape(len(tree.ids), d)
                        tree.low, tree.high = (x.reshape(len(tree.child), d) for x in (tree.low, tree.high))
                        exact = tree.points, tree.low, tree.high
                        most = float(np.abs(tree.points.astype(np.float64)).max(initial=0))
                    mine = np.flatnonzero((long("home") == key[2]) == first)
                    if not len(mine):
                        continue
                    q, qid, qn = long("q").reshape(-1, d)[mine] if d else np.zeros((len(mine), 0), np.int64), long("qid")[mine], long("qn")[mine]
                    limit = most * float(np.abs(q.astype(np.float64)).sum(axis=1).max(initial=0))
                    if limit >= 2.0**63 * (1 - 1e-9):
                        raise ArithmeticError("a score could go beyond 64 bits")
                    tree.points, tree.low, tree.high = (_numbers(x, limit) for x in exact)
                    i, ids, score = tree.search(_numbers(q, limit), qid, k, long("floor")[mine], long("floor_id")[mine])
                    yield pa.RecordBatch.from_arrays([pa.array(qn[i]), pa.array(qid[i]), pa.array(ids), pa.array(score)], ["qn", "query_id", "vec_id", "score"])

        each = F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub")
        sent = blocks.join(shards, ["dims", "cell"]).select("dims", "cell", each, *BLOCK)
        return sent.join(trees, ["dims", "cell", "sub"]).sortWithinPartitions("dims", "cell", "sub").mapInArrow(run, "qn long, query_id long, vec_id long, score long")

    lowest = F.lit(LOWEST)
    first = searched(homed.withColumn("floor", lowest).withColumn("floor_id", lowest).mapInArrow(pack(at_home), BLOCKS), True).checkpoint()
    # what the home shard proves: a query's kth score there, where it found k
    kth = first.groupBy("qn").agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list(F.struct(F.bitwise_not("score").alias("s"), F.col("vec_id")))).alias("best")).where(F.col("n") >= k)
    kth = kth.select("qn", F.bitwise_not(F.element_at("best", k)["s"]).alias("floor"), F.element_at("best", k)["vec_id"].alias("floor_id"))
    barred = homed.join(kth, "qn", "left").withColumn("floor", F.coalesce("floor", lowest)).withColumn("floor_id", F.coalesce("floor_id", lowest))
    rest = searched(barred.sortWithinPartitions("dims", "cell").select("dims", "cell", "sub", "id", "v", "qn", "floor", "floor_id").mapInArrow(pack(reached), BLOCKS), False)
    ranked = first.unionByName(rest).withColumn("rank", F.row_number().over(Window.partitionBy("qn").orderBy(F.col("score").desc(), F.col("vec_id").asc())))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_topk(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(usable("embedding"))
    whole = rows.select(F.col("vec_id").alias("id"), F.transform("embedding", lambda x: F.floor(F.lit(256) * x.cast("double")).cast("long")).alias("v"))
    return top_k(whole, whole.where(F.col("id") % 50 == 0), 5)


ORACLE_OP10 = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM pairs)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""
