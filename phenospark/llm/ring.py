"""Sharding on a consistent-hash ring with bounded loads (operator 2).

Every shard has ``vnodes`` points on a ring. A row's key is its text: its hash
is a place on the ring, and the first point clockwise is its own. A shard takes
rows up to its bound; rows that overflow a full shard go on clockwise to the
next shard with room. The bounds add up to the number of rows, so the law is
``rows``: counts differ by one at most.

Equal texts have one place on the ring and so share a shard. Within an arc rows stay
in the order of their places, so that where an arc is cut (a shard is full) at most
the group at the cut is split; and a group larger than a shard has to be, since
balance comes first. With one more shard the bounds sink, so rows also move between
old shards; :func:`moved` counts them.

All of it is DataFrame work. Rows are counted by arc and cell; the counts by arc
(shards x vnodes rows, whatever the input) give the overflow, as intervals of
ranks within the arcs; the rank comes from a window within a cell and the cells'
sums. An arc's cells are ranges of a hash of the place; a place of more rows than
``cell_rows`` and a 2000th of all (so 2000 places at most, which are sent to all
tasks) has cells of its own, by a hash of doc_id: neither an arc nor a group of
copies that holds a third of all rows meets in one task. The text is read once and
never shuffled.

Null text: size 1, crc32 of nothing (0), and the place of the empty text. Null
doc_id: its own rank before others. Empty table: no rows. Repeated rows get
slots of their own.
"""

from __future__ import annotations

from bisect import bisect_left

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phenospark.llm.common import written

#: Rows that one window should hold at most, on average.
CELL_ROWS = 2000
#: Places with cells of their own, at most.
MOST_HOT = 2000


def ring_points(spark: SparkSession, shards: int, vnodes: int) -> list[tuple[int, int]]:
    """(point, shard) in ring order; points depend on the shard and the vnode alone."""
    at = spark.range(shards * vnodes).select((F.col("id") % shards).cast("int").alias("shard"), F.xxhash64(F.lit("ring"), F.col("id") % shards, F.floor(F.col("id") / shards)).alias("point"))
    return sorted((r.point, r.shard) for r in at.collect())


def arc_of(place: Column, points: list[int]) -> Column:
    """The number of the first point at or after a place; past the last one the first.

    A table over equal ranges of places gives the first point of a place's range;
    the points of one range are compared one by one.
    """
    bits = max(4, len(points).bit_length() + 2)
    ranges = [bisect_left(points, (k << (64 - bits)) - (1 << 63)) for k in range(1 << bits)] + [len(points)]
    most = max(b - a for a, b in zip(ranges, ranges[1:], strict=False))
    table, edges = (F.split(F.lit(",".join(map(str, x))), ",").cast(f"array<{kind}>") for x, kind in ((ranges, "int"), (points, "long")))
    first = F.get(table, (F.shiftright(place, 64 - bits) + (1 << (bits - 1))).cast("int"))
    past = first
    for j in range(most):
        past = past + F.when(F.get(edges, first + j) < place, 1).otherwise(0)
    return F.pmod(past, F.lit(len(points))).cast("int")


def overflow(counts: list[int], owner: list[int], room: list[int]) -> list[tuple[int, int, int, int, int]]:
    """Intervals (arc, from rank, to rank, shard, first slot).

    Arcs first fill their own shards in ring order; what is left of each goes on
    clockwise, in ring order too. Sizes are those of the ring, not of the data.
    """
    n, used, out, over = len(owner), [0] * len(room), [], []

    def take(arc: int, lo: int, hi: int, shard: int) -> int:
        k = min(hi - lo, room[shard] - used[shard])
        if k > 0:
            out.append((arc, lo, lo + k, shard, used[shard]))
            used[shard] += k
        return lo + max(k, 0)

    for a in range(n):
        lo = take(a, 0, counts[a], owner[a])
        if lo < counts[a]:
            over.append((a, lo))
    for a, lo in over:
        step = a
        while lo < counts[a]:
            step = (step + 1) % n
            lo = take(a, lo, counts[a], owner[step])
    return out


def shard(docs: DataFrame, shards: int = 16, vnodes: int = 64, cell_rows: int = CELL_ROWS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (null) for each row."""
    return placed(docs, shards, vnodes, cell_rows).drop("place")


def moved(docs: DataFrame, shards: int = 16, vnodes: int = 64) -> DataFrame:
    """One row: rows, and how many of them have another shard when there is one more."""
    one, more = (placed(docs, n, vnodes).select("doc_id", "text_crc32", F.col("shard").alias(name)) for n, name in ((shards, "before"), (shards + 1, "after")))
    # rows that are equal are paired by their turn
    turn = F.row_number().over(Window.partitionBy("doc_id", "text_crc32").orderBy(F.lit(0)))
    both = one.withColumn("turn", turn).join(more.withColumn("turn", turn), ["doc_id", "text_crc32", "turn"])
    return both.agg(F.count("*").alias("rows"), F.count(F.when(F.col("before") != F.col("after"), 1)).alias("moved"))


def placed(docs: DataFrame, shards: int, vnodes: int, cell_rows: int = CELL_ROWS) -> DataFrame:
    """shard(), with the place of each row."""
    spark = docs.sparkSession
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    points = ring_points(spark, shards, vnodes)
    owner = [s for _, s in points]
    slim = docs.select(
        F.col("doc_id").cast("long"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text).alias("place"),
    )
    # written: the texts are read once, and lost executors cost nothing
    slim = written(slim.withColumn("arc", arc_of(F.col("place"), [p for p, _ in points])).withColumn("turn", F.xxhash64(F.lit("turn"), "doc_id")), "ring")
    by_arc = {r.arc: r.n for r in slim.groupBy("arc").agg(F.count("*").alias("n")).collect()}  # at most shards * vnodes rows
    counts = [by_arc.get(a, 0) for a in range(len(points))]
    total = sum(counts)
    room = [total // shards + (s < total % shards) for s in range(shards)]
    intervals = overflow(counts, owner, room)
    cells = max(64, -(-max(counts, default=0) // cell_rows))
    # more rows than this: at most MOST_HOT places
    hot = slim.groupBy("place").agg(F.count("*").alias("hot_rows")).where(F.col("hot_rows") > max(cell_rows, total // MOST_HOT)).withColumnRenamed("place", "hot_place")
    slim = slim.join(F.broadcast(hot), F.col("place") == F.col("hot_place"), "left")
    is_hot = F.col("hot_place").isNotNull()
    # the rest of the places first, in ranges of a hash; then each hot place, in ranges of the turn
    own = F.coalesce("hot_place", F.lit(0))
    cell = F.pmod(F.when(is_hot, F.col("turn")).otherwise(F.xxhash64(F.lit("cell"), "place")), F.lit(cells))
    slim = slim.withColumn("hot", is_hot).withColumn("own", own).withColumn("cell", cell).drop("hot_place", "hot_rows")
    keys = ["arc", "hot", "own", "cell"]
    before = Window.partitionBy("arc").orderBy("hot", "own", "cell").rowsBetween(Window.unboundedPreceding, -1)
    bases = slim.groupBy(*keys).agg(F.count("*").alias("n")).select(*keys, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy(*keys).orderBy("place", "turn", "doc_id", "text_crc32", "size")
    ranked = slim.withColumn("own_rank", F.row_number().over(within) - 1).join(bases, keys)
    ranked = ranked.withColumn("rank", F.col("base") + F.col("own_rank"))
    schema = "arc int, lo long, hi long, shard int, first long"
    where = spark.createDataFrame(intervals, schema).groupBy("arc").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "shard", "first"))).alias("parts"))
    # at most shards * vnodes rows with a few intervals each: the ring's size, not the data's
    found = ranked.join(F.broadcast(where), "arc").withColumn("part", F.filter("parts", lambda p: (p["lo"] <= F.col("rank")) & (F.col("rank") < p["hi"]))[0])
    return found.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("part.shard").alias("shard"), (F.col("part.first") + F.col("rank") - F.col("part.lo")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "place")
