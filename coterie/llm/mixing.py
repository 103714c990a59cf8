"""Mixing sources to target weights with DataFrame operations only.

Each source's documents are laid end to end and packed into blocks of
`block_words` words. A source's target turns into a number of slots; the output
is cut into shards of `shard_slots` slots, and each shard's counts per source are
drawn: every slot is dealt to a shard by a pseudorandom permutation of all slots,
which is the multinomial draw with the sources' totals held fixed, so that the
noise of the shards cancels and no total drifts. The slots a source has in a
shard get consecutive numbers, a number gives an epoch and, through the epoch's
pseudorandom permutation of the source's blocks, a block, and blocks are joined
by index. As no source has more than two epochs, nothing is taken three times.

Permutations are swap-or-not shuffles (Hoang, Morris and Rogaway, 2012): they work
on any size without a table, so no task needs to see a whole source. Positions in
a source are prefix sums in two levels, over small hash buckets and over the
buckets' totals, so that a source with a third of all rows is spread like others.

Edge cases: a null text has no words; documents without words take none; a null
source is a source of its own, the last; a source without words has target 0; an
empty table gives no rows; repeated rows count each on its own. Only the table of
sources is broadcast, and only up to `most_broadcast` sources.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from coterie.llm.common import documents, shared_folder, word_count

WEIGHTS = (5, 2, 1)
BLOCK_WORDS, SHARD_SLOTS, ROUNDS, SEED = 128, 16_384, 8, 17
PRIME = 2147483647


def mixed_hash(x: Column, y: Column) -> Column:
    """31 bits from two non-negative numbers, by plain arithmetic."""
    return F.pmod(F.pmod(F.pmod(x, F.lit(PRIME)) * 48271 + F.pmod(y, F.lit(PRIME)), F.lit(PRIME)) * 69621, F.lit(PRIME))


def permuted(i: Column, n: Column, key: Column, rounds: int = ROUNDS) -> Column:
    """Where the permutation `key` of 0..n-1 puts i."""

    def turn(at: Column, r: Column) -> Column:
        salt = key * 64 + r
        other = F.pmod(mixed_hash(salt, r) * PRIME + mixed_hash(r, salt) - at, n)
        return F.when(F.pmod(mixed_hash(F.greatest(at, other), salt), F.lit(2)) == 1, other).otherwise(at)

    return F.aggregate(F.sequence(F.lit(1).cast("long"), F.lit(rounds).cast("long")), i.cast("long"), turn)


def plan(sized: DataFrame, share: float = 1.5, most: int = 2, weights=WEIGHTS, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row a source: sid, source, source_size, target, blocks, slots. Windows here run over sources, not rows."""
    every = Window.orderBy(F.col("source").asc_nulls_last())
    s = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    s = s.withColumn("sid", F.row_number().over(every).cast("long"))
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.col("sid") - 1, F.lit(len(weights))) + 1).cast("int")).cast("long"))
    by_room = Window.orderBy((F.lit(float(most)) * F.col("source_size") / F.col("weight")).asc(), F.col("sid").asc())
    whole, before = Window.partitionBy(), by_room.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("total", F.sum("source_size").over(whole)).withColumn("room_rank", F.row_number().over(by_room))
    s = s.withColumn("left", F.lit(share) * F.col("total") - most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
    s = s.withColumn("level", F.col("left") / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    s = s.withColumn("free", F.min(F.when(F.col("level") * F.col("weight") <= most * F.col("source_size"), F.col("room_rank"))).over(whole))
    s = s.withColumn("at", F.max(F.when(F.col("room_rank") == F.col("free"), F.col("level"))).over(whole))
    s = s.withColumn("target", F.when(F.col("free").isNull() | (F.col("room_rank") < F.col("free")), (most * F.col("source_size")).cast("double")).otherwise(F.col("at") * F.col("weight")))
    s = s.withColumn("blocks", F.ceil(F.col("source_size") / block_words).cast("long"))
    slots = F.floor(F.when(F.col("source_size") > 0, F.col("blocks") * F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)) + 0.5).cast("long")
    s = s.withColumn("slots", F.least(slots, most * F.col("blocks")))
    s = s.withColumn("first", F.coalesce(F.sum("slots").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return s.select("sid", "source", "source_size", "target", "blocks", "slots", "first", F.sum("slots").over(whole).alias("all_slots"))


def draw(sources: DataFrame, shard_slots: int = SHARD_SLOTS, seed: int = SEED) -> DataFrame:
    """Drawn counts: sid, blocks, shard, n, start (number of the first slot)."""
    step = 1 << 13
    chunks = sources.where("slots > 0").select("sid", "blocks", "slots", "first", "all_slots", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(slots - 1) div {step}"))).alias("c"))
    parts = int(sources.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = chunks.repartition(parts, "sid", "c").select("sid", "blocks", "all_slots", F.explode(F.sequence(F.col("first") + F.col("c") * step, F.least(F.col("first") + F.col("slots"), F.col("first") + (F.col("c") + 1) * step) - 1)).alias("x"))
    to = F.expr(f"at div {shard_slots}").alias("shard")
    counts = each.select("sid", "blocks", permuted(F.col("x"), F.col("all_slots"), F.lit(seed)).alias("at")).groupBy("sid", "blocks", to).agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("sid").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))


def slots(drawn: DataFrame, seed: int = SEED) -> DataFrame:
    """One row a slot: shard, sid, epoch, block."""
    parts = int(drawn.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    each = drawn.repartition(parts, "sid", "shard").select("shard", "sid", "blocks", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("n") - 1)).alias("i"))
    epoch = F.expr("i div blocks")
    return each.select("shard", "sid", epoch.alias("epoch"), permuted(F.pmod("i", "blocks"), F.col("blocks"), F.lit(seed + 1) + F.col("sid") * 2 + epoch).alias("block"))


def mix(docs: DataFrame, block_words: int = BLOCK_WORDS, shard_slots: int = SHARD_SLOTS, seed: int = SEED, most_broadcast: int = 50_000, with_parts: bool = False) -> DataFrame:
    """One row a document: doc_id, k (its content's hash), nth (of equal rows), size, source_size, target, taken.

    With `with_parts`, also parts: for each block taken from it a struct of
    epoch, shard and the document's words [lo, hi) that the block holds.
    """
    spark = docs.sparkSession
    shared_folder(spark)
    sized = docs.select("doc_id", "source", F.xxhash64("doc_id", "source", "text").alias("k"), word_count("text").alias("size")).checkpoint()
    n = sized.count()
    sources = plan(sized, block_words=block_words).checkpoint()
    few = sources.count() <= most_broadcast
    small = sources.select("sid", F.col("source").alias("_source"), "source_size", "target")
    placed = sized.join(F.broadcast(small) if few else small, F.col("source").eqNullSafe(F.col("_source")))
    buckets = max(64, n // 20_000)
    # by id and size, so that rows without an id are spread as well
    doc = F.pmod(F.coalesce(F.col("doc_id"), F.lit(0)), F.lit(PRIME))
    placed = placed.withColumn("bucket", F.pmod(F.pmod(doc * 48271 + F.col("size"), F.lit(PRIME)), F.lit(buckets)))
    within = Window.partitionBy("sid", "bucket").orderBy(F.col("doc_id").asc_nulls_first(), "k")
    placed = placed.withColumn("inside", F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("row", F.row_number().over(within))
    totals = placed.groupBy("sid", "bucket").agg(F.sum("size").alias("bucket_size"))
    totals = totals.withColumn("before", F.coalesce(F.sum("bucket_size").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("bucket_size")
    # merge hints: what grows with the input is never broadcast, whatever its estimated size
    placed = placed.join(totals.hint("merge"), ["sid", "bucket"]).withColumn("at", F.col("before") + F.col("inside"))
    key = ["sid", "bucket", "row"]
    rows = placed.where("size > 0").select(*key, "at", "size", F.explode(F.sequence(F.expr(f"at div {block_words}"), F.expr(f"(at + size - 1) div {block_words}"))).alias("block"))
    lo = F.greatest(F.lit(0), F.col("block") * block_words - F.col("at"))
    hi = F.least(F.col("size"), (F.col("block") + 1) * block_words - F.col("at"))
    rows = rows.select(*key, "block", lo.alias("lo"), hi.alias("hi"))
    taken_slots = slots(draw(sources, shard_slots, seed), seed)
    if with_parts:
        met = rows.join(taken_slots.hint("merge"), ["sid", "block"])
        sums = met.groupBy(*key).agg(F.sum(F.col("hi") - F.col("lo")).alias("taken"), F.array_sort(F.collect_list(F.struct("epoch", "lo", "hi", "shard"))).alias("parts"))
    else:
        times = taken_slots.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"))
        sums = rows.join(times.hint("merge"), ["sid", "block"]).groupBy(*key).agg(F.sum(F.col("times") * (F.col("hi") - F.col("lo"))).alias("taken"))
    out = placed.join(sums.hint("merge"), key, "left").withColumn("nth", F.row_number().over(Window.partitionBy("k", "doc_id").orderBy(*key)) if with_parts else F.lit(None))
    return out.select("doc_id", "k", "nth", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), *(["parts"] if with_parts else []))


def mixed_texts(docs: DataFrame, **how) -> DataFrame:
    """The mixture as documents: one row for each epoch a document is taken in, with the words taken then.

    White space before a word stays with it. Columns are those of docs; n_chars, if
    there, is the new text's length.
    """
    parts = mix(docs, with_parts=True, **how).where("taken > 0").select(F.col("doc_id").alias("_id"), F.col("k").alias("_k"), F.col("nth").alias("_nth"), "parts")
    # the row travels as one column, so that no name of docs meets one from here
    keyed = docs.select(F.struct(*docs.columns).alias("row"), "doc_id", F.xxhash64("doc_id", "source", "text").alias("_k"))
    keyed = keyed.withColumn("_nth", F.row_number().over(Window.partitionBy("_k", "doc_id").orderBy(F.lit(1))))
    met = keyed.join(parts.hint("merge"), (keyed["_k"] == parts["_k"]) & keyed["doc_id"].eqNullSafe(parts["_id"]) & (keyed["_nth"] == parts["_nth"]))
    met = met.select("row", "parts", F.regexp_extract_all(F.col("row.text"), F.lit(r"([\x20\x09-\x0D]*[^\x20\x09-\x0D]+)"), F.lit(1)).alias("pieces"))
    met = met.withColumn("epoch", F.explode(F.array_distinct(F.transform("parts", lambda p: p["epoch"]))))
    own = F.filter("parts", lambda p: p["epoch"] == F.col("epoch"))
    text = F.array_join(F.flatten(F.transform(own, lambda p: F.slice("pieces", (p["lo"] + 1).cast("int"), (p["hi"] - p["lo"]).cast("int")))), "")
    met = met.select("row", text.alias("text"))
    changed = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return met.select(*(changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns))


def op2_mixing(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def _sql_hash(x: str, y: str) -> str:
    return f"(((({x}) % {PRIME}) * 48271 + ({y}) % {PRIME}) % {PRIME} * 69621 % {PRIME})"


def _sql_permuted(i: str, n: str, key: str) -> str:
    salt = f"(({key}) * 64 + r)"
    other = f"((({_sql_hash(salt, 'r')} * {PRIME} + {_sql_hash('r', salt)} - a) % ({n}) + ({n})) % ({n}))"
    return f"list_reduce(list_prepend(({i})::BIGINT, range(1, {ROUNDS + 1})), lambda a, r: CASE WHEN {_sql_hash(f'greatest(a, {other})', salt)} % 2 = 1 THEN {other} ELSE a END)"


ORACLE_OP2 = f"""
WITH sized AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS sid FROM sized GROUP BY source),
s1 AS (SELECT *, [5, 2, 1][((sid - 1) % 3) + 1]::BIGINT AS weight FROM s0),
s2 AS (SELECT *, row_number() OVER w AS room_rank, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - 2 * coalesce(sum(source_size) OVER b, 0)::DOUBLE AS remaining,
  (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0))::DOUBLE AS weights FROM s1
  WINDOW w AS (ORDER BY 2.0::DOUBLE * source_size / weight, sid), b AS (ORDER BY 2.0::DOUBLE * source_size / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s3 AS (SELECT *, remaining / weights AS lvl FROM s2),
s4 AS (SELECT *, min(CASE WHEN lvl * weight <= 2 * source_size THEN room_rank END) OVER () AS free FROM s3),
s5 AS (SELECT *, max(CASE WHEN room_rank = free THEN lvl END) OVER () AS at_level FROM s4),
s6 AS (SELECT sid, source, source_size, CASE WHEN free IS NULL OR room_rank < free THEN (2 * source_size)::DOUBLE ELSE at_level * weight END AS target, ceil(source_size / {BLOCK_WORDS}.0::DOUBLE)::BIGINT AS blocks FROM s5),
s7 AS (SELECT *, least(2 * blocks, floor(CASE WHEN source_size > 0 THEN blocks * target / source_size ELSE 0.0 END + 0.5)::BIGINT) AS slots FROM s6),
sources AS (SELECT *, coalesce(sum(slots) OVER (ORDER BY sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS first, (sum(slots) OVER ())::BIGINT AS all_slots FROM s7),
dealt AS (SELECT sid, blocks, {_sql_permuted('x', 'all_slots', str(SEED))} // {SHARD_SLOTS} AS shard FROM (SELECT *, unnest(range(first, first + slots)) AS x FROM sources)),
counts AS (SELECT sid, blocks, shard, count(*) AS n FROM dealt GROUP BY ALL),
drawn AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY sid ORDER BY shard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM counts),
numbered AS (SELECT sid, blocks, unnest(range(start, start + n)) AS i FROM drawn),
times AS (SELECT sid, {_sql_permuted('i % blocks', 'blocks', f'{SEED + 1} + sid * 2 + i // blocks')} AS block, count(*) AS times FROM numbered GROUP BY ALL),
n AS (SELECT greatest(64, count(*) // 20000) AS buckets FROM sized),
placed AS (SELECT d.doc_id, d.size, s.*, ((coalesce(d.doc_id, 0) % {PRIME} + {PRIME}) % {PRIME} * 48271 + d.size) % {PRIME} % (SELECT buckets FROM n) AS bucket FROM sized d JOIN sources s ON d.source IS NOT DISTINCT FROM s.source),
laid AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY sid ORDER BY bucket, doc_id NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at_word FROM placed),
spread AS (SELECT doc_id, sid, at_word, size, unnest(range(at_word // {BLOCK_WORDS}, (at_word + size - 1) // {BLOCK_WORDS} + 1)) AS block FROM laid WHERE size > 0),
sums AS (SELECT doc_id, sum(times * (least(size, (block + 1) * {BLOCK_WORDS} - at_word) - greatest(0, block * {BLOCK_WORDS} - at_word))) AS taken FROM spread JOIN times USING (sid, block) GROUP BY doc_id)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM laid LEFT JOIN sums USING (doc_id)
"""
