"""Functions over expression tables in long form: gene, col, value. An absent row is 0 and is never made."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def common_genes(bulk: DataFrame, cells: DataFrame) -> DataFrame:
    """The genes that both tables have."""
    return bulk.select("gene").distinct().join(cells.select("gene"), "gene", "left_semi")


def gene_table(spark: SparkSession, genes: list[str]) -> DataFrame:
    """gene: a row for each of a list of genes."""
    return spark.createDataFrame([(g,) for g in genes], "gene string")


def side_by_side(bulk: DataFrame, cells: DataFrame, genes: list[str] | None = None) -> DataFrame:
    """The stored rows of both tables' columns over their common genes, marked by side."""
    common = common_genes(bulk, cells) if genes is None else gene_table(bulk.sparkSession, genes)
    parts = [t.join(common, "gene", "left_semi").select(F.lit(s).alias("side"), "gene", "col", "value") for s, t in (("bulk", bulk), ("cell", cells))]
    return parts[0].unionByName(parts[1])


def shape(columns: DataFrame) -> tuple[int, int]:
    """How many genes and how many columns (of either side) the rows name."""
    got = columns.agg(F.count_distinct("gene"), F.count_distinct("side", "col")).first()
    return got[0], got[1]


def _absent(n_genes: int) -> Column:
    """The genes that a column has no row of; each is a 0."""
    return F.lit(n_genes) - F.count("*").over(Window.partitionBy("side", "col"))


def quantile_target(columns: DataFrame, n_genes: int | None = None, n_columns: int | None = None) -> DataFrame:
    """rank, target: the mean over all columns of each order statistic, absent rows being zeros.

    Zeros add nothing, so only stored rows are ranked: those above 0 stand behind
    the column's absent genes. n_genes, n_columns: all of them, counted in the
    rows where they aren't given.
    """
    if n_genes is None or n_columns is None:
        n_genes, n_columns = (known or got for known, got in zip((n_genes, n_columns), shape(columns), strict=True))
    by = Window.partitionBy("side", "col").orderBy("value", "gene")
    ranked = columns.withColumn("rank", F.row_number().over(by) + F.when(F.col("value") > 0, _absent(n_genes)).otherwise(0))
    sums = ranked.groupBy("rank").agg(F.sum("value").alias("total"))
    every = columns.sparkSession.range(1, n_genes + 1).select(F.col("id").cast("int").alias("rank"))  # a row for each gene
    return every.join(sums, "rank", "left").select("rank", (F.coalesce("total", F.lit(0.0)) / n_columns).alias("target"))


def quantile_normalize(columns: DataFrame, target: DataFrame, n_genes: int | None = None) -> DataFrame:
    """Columns with the target's values by rank, and zero: what the column's absent rows become.

    Ties have their mean rank. Where it ends in a half, the value is the mean of
    the two neighbouring targets; else the target of that rank. A column's absent
    genes are ties at 0, so they share one value, which goes with each of its
    rows (null in a column that has all genes).
    """
    n_genes = n_genes if n_genes is not None else shape(columns)[0]
    by = Window.partitionBy("side", "col")
    is_zero, low = F.col("value") == 0, F.rank().over(by.orderBy("value"))
    below, zeros = F.count(F.when(F.col("value") < 0, 1)).over(by), F.count(F.when(is_zero, 1)).over(by)
    ranked = columns.withColumn("absent", _absent(n_genes)).withColumn("low", low + F.when(F.col("value") > 0, F.col("absent")).otherwise(0))
    ranked = ranked.withColumn("many", F.count("*").over(Window.partitionBy("side", "col", "value")) + F.when(is_zero, F.col("absent")).otherwise(0))
    ranked = ranked.withColumn("zero_many", zeros + F.col("absent")).withColumn("zero_low", below + 1)

    def place(first: str, many: str) -> Column:
        return F.floor(F.col(first) + (F.col(many) - 1) / 2).cast("int")

    # each rank's next target by a join; ranks whose two targets are 0 give 0 and need no row
    after = target.select((F.col("rank") - 1).alias("rank"), F.col("target").alias("next"))
    pairs = target.join(after, "rank", "left").where((F.col("target") != 0) | (F.coalesce("next", F.lit(0.0)) != 0))
    pairs = pairs.select("rank", "target", F.coalesce((F.col("target") + F.col("next")) / 2, "target").alias("between"))
    at_zero = pairs.select(F.col("rank").alias("zero_rank"), F.col("target").alias("zero_target"), F.col("between").alias("zero_between"))
    ranked = ranked.withColumn("rank", place("low", "many")).withColumn("zero_rank", F.when(F.col("absent") > 0, place("zero_low", "zero_many")))
    joined = ranked.join(pairs, "rank", "left").join(at_zero, "zero_rank", "left")
    value = F.coalesce(F.when(F.col("many") % 2 == 0, F.col("between")).otherwise(F.col("target")), F.lit(0.0))
    zero = F.coalesce(F.when(F.col("zero_many") % 2 == 0, F.col("zero_between")).otherwise(F.col("zero_target")), F.lit(0.0))
    return joined.select("side", "gene", "col", value.alias("value"), F.when(F.col("absent") > 0, zero).alias("zero"))


def unit(value: Column, mean: Column, deviation: Column) -> Column:
    """Centred and scaled; a deviation of 0 or none counts as 1."""
    return (value - mean) / F.coalesce(F.nullif(deviation, F.lit(0.0)), F.lit(1.0))


def center_scale(columns: DataFrame, n_genes: int | None = None) -> DataFrame:
    """Each column with mean 0 and sample deviation 1 over all genes, and zero: what its absent rows become.

    Absent rows are 0, or the column's ``zero`` if columns has that.
    """
    n_genes = n_genes if n_genes is not None else shape(columns)[0]
    w = Window.partitionBy("side", "col")
    before = columns if "zero" in columns.columns else columns.withColumn("zero", F.lit(0.0))
    before = before.withColumn("absent", _absent(n_genes)).withColumn("zero", F.coalesce("zero", F.lit(0.0)))
    mean = before.withColumn("mean", (F.sum("value").over(w) + F.col("absent") * F.col("zero")) / n_genes)
    d, gap = F.col("value") - F.col("mean"), F.col("zero") - F.col("mean")
    dev = mean.withColumn("dev", F.sqrt((F.sum(d * d).over(w) + F.col("absent") * gap * gap) / (F.lit(n_genes - 1) if n_genes > 1 else F.lit(None))))
    scaled = [unit(F.col(c), F.col("mean"), F.col("dev")) for c in ("value", "zero")]
    return dev.select("side", "gene", "col", scaled[0].alias("value"), F.when(F.col("absent") > 0, scaled[1]).alias("zero"))


#: Entries of a block of scaled samples that is sent to all tasks (64 MB); more samples go in more blocks.
BLOCK_ENTRIES = 8_000_000
#: Entries of X that a task makes at a time (16 MB).
SLICE_ENTRIES = 2_000_000


def listed(scaled: DataFrame) -> DataFrame:
    """side, col, i, v, zero: the columns of :func:`center_scale`, whose genes are numbers from 0, one a row:
    the stored genes, their values less the column's zero, and that."""
    some = scaled.withColumn("zero", F.coalesce("zero", F.lit(0.0))).groupBy("side", "col")
    e = some.agg(F.collect_list(F.struct(F.col("gene").cast("int").alias("i"), (F.col("value") - F.col("zero")).alias("v"))).alias("e"), F.first("zero").alias("zero"))
    return e.select("side", "col", F.col("e.i").alias("i"), F.col("e.v").alias("v"), "zero")


def sliced(batches: Iterator[pa.RecordBatch], samples: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts for which X has at most SLICE_ENTRIES entries, or of one row."""
    step = max(1, SLICE_ENTRIES // max(1, samples))
    for batch in batches:
        for lo in range(0, batch.num_rows, step):
            yield batch.slice(lo, step)


#: Entries of X that a task gives on as rows at a time, of at most so many samples: 6 MB that stay in its caches.
TILE_ENTRIES, TILE_SAMPLES = 1 << 18, 2048


def rounded(x: np.ndarray, digits: int) -> np.ndarray:
    """Spark's round of finite numbers: halves away from zero, as the shortest decimal has them; no -0."""
    if not len(x):
        return x
    power, large = 10.0**digits, 2.0**40
    y = x * power
    out = np.rint(y)
    rest = np.abs(np.subtract(y, out, out=y), out=y)
    # a product so near to a half, or so large, may fall on the wrong side of it
    most = max(float(x.max()), -float(x.min())) * power
    doubtful = rest >= 0.5 - 1e-15 * (min(most, large) + 1)
    if most >= large:
        doubtful |= np.abs(x) >= large / power
    out /= power
    out += 0.0
    if doubtful.any():
        some, at = np.unique(x[doubtful], return_inverse=True)
        unit = Decimal(1).scaleb(-digits)
        # beyond 2^60 no double has digits to round
        out[doubtful] = np.array([float(Decimal(repr(float(v))).quantize(unit, ROUND_HALF_UP)) + 0.0 if abs(v) < 2.0**60 / power else v for v in some])[at]
    return out


def lists(rows: np.ndarray) -> pa.Array:
    """The rows of a matrix as lists."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32()), pa.array(np.ascontiguousarray(rows).ravel()))


def _entries(x: pa.StructArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """row, i, v of the entries and zero of the rows of (i, v, zero)."""
    i, v, zero = (x.field(f) for f in range(3))
    row = np.repeat(np.arange(len(x)), np.diff(np.asarray(i.offsets)))
    return row, np.asarray(i.flatten()), np.asarray(v.flatten()), np.asarray(zero)


@dataclass
class Block:
    """Scaled samples: dense, genes x samples and a row of their sums, or the stored entries (less the sample's zero) by gene."""

    n: int
    zero: np.ndarray
    total: np.ndarray
    dense: np.ndarray | None = None
    start: np.ndarray | None = None
    at: np.ndarray | None = None
    value: np.ndarray | None = None

    def against(self, row: np.ndarray, i: np.ndarray, v: np.ndarray, zero: np.ndarray) -> np.ndarray:
        """The products of the cells of some entries with the block's samples; over genes less one these are correlations."""
        n, width = len(zero), len(self.zero)
        if self.dense is not None:
            x = np.empty((n, width))
            step = max(1, SLICE_ENTRIES // self.n)
            for lo in range(0, n, step):
                mine = (row >= lo) & (row < lo + step)
                m = np.zeros((min(step, n - lo), self.n + 1))
                m[row[mine] - lo, i[mine]], m[:, -1] = v[mine], zero[lo : lo + step]
                np.matmul(m, self.dense, out=x[lo : lo + step])
        else:
            x = np.outer(zero, self.total) + np.outer(np.bincount(row, v, n), self.zero)
            many = self.start[i + 1] - self.start[i]
            ends = np.cumsum(many)
            lo = 0
            while lo < len(i):  # the pairs of stored entries, some SLICE_ENTRIES at a time
                before = ends[lo - 1] if lo else 0
                hi = max(lo + 1, int(np.searchsorted(ends, before + SLICE_ENTRIES, "right")))
                c = many[lo:hi]
                which = np.repeat(np.arange(lo, hi), c)
                place = np.arange(len(which)) - np.repeat(ends[lo:hi] - c - before, c) + np.repeat(self.start[i[lo:hi]], c)
                x += np.bincount(row[which] * width + self.at[place], v[which] * self.value[place], n * width).reshape(n, width)
                lo = hi
        return x

    def columns(self) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
        """Each sample's genes and what they have beyond zero, and zero; of a dense block all genes, and 0."""
        if self.dense is not None:
            return [np.arange(self.n)] * len(self.zero), list(self.dense[:-1].T), np.zeros(len(self.zero))
        by, ends = np.argsort(self.at, kind="stable"), np.cumsum(np.bincount(self.at, minlength=len(self.zero)))[:-1]
        gene = np.repeat(np.arange(self.n), np.diff(self.start))
        return np.split(gene[by], ends), np.split(self.value[by], ends), self.zero

    def of(self, at: np.ndarray) -> Block:
        """The block of the samples at some ascending places."""
        if self.dense is not None:
            return Block(self.n, self.zero[at], self.total[at], np.ascontiguousarray(self.dense[:, at]))
        place = np.full(len(self.zero), -1, np.int32)
        place[at] = np.arange(len(at))
        kept = place[self.at] >= 0
        start = np.concatenate([[0], np.cumsum(kept)])[self.start].astype(np.int32)
        return Block(self.n, self.zero[at], self.total[at], None, start, place[self.at[kept]], self.value[kept])


@dataclass
class Similarity:
    """X as what it is made of, which grows with samples plus cells and not with their product.

    rows: cell, x, a struct of i, v, zero (see :func:`listed`), written; blocks: the scaled samples, sent to all tasks, each of a
    checked size. A pass over X makes its rows again, a few at a time: they are never written or
    shuffled. clip: negative entries as 0; scale multiplies.
    """

    rows: DataFrame
    blocks: list  # of broadcasts of Block
    widths: list[int]
    samples: int
    n_genes: int
    scale: float = 1.0
    clip: bool = False

    @property
    def cells(self) -> DataFrame:
        return self.rows.select("cell")

    @property
    def short(self) -> bool:
        """Whether the parts of X are smaller than its rows."""
        return self.n_genes < self.samples and len(self.blocks) <= 4

    def look(self, blocks: list | None = None) -> Callable[[pa.Array], np.ndarray]:
        """The rows of X that structs of (i, v, zero) stand for."""
        blocks, clip, least = self.blocks if blocks is None else blocks, self.clip, max(self.n_genes - 1, 1) / self.scale

        def rows_of(x: pa.Array) -> np.ndarray:
            row, i, v, zero = _entries(x)
            entries = row, i, v / least, zero / least
            got = [b.value.against(*entries) for b in blocks] or [np.zeros((len(x), 0))]
            out = got[0] if len(got) == 1 else np.hstack(got)
            if not np.isfinite(out.sum()):
                out[~np.isfinite(out)] = 0
            return np.maximum(out, 0, out=out) if clip else out

        return rows_of

    def view(self, rows: list[int]) -> Similarity:
        """X of the samples at ascending positions: the others' entries aren't made."""
        rows, context = np.asarray(rows, np.int64), self.rows.sparkSession.sparkContext
        ends = np.cumsum(self.widths)
        places = [rows[(rows >= end - width) & (rows < end)] - (end - width) for end, width in zip(ends, self.widths, strict=True)]
        some = [(b, at) for b, at in zip(self.blocks, places, strict=True) if len(at)]
        return replace(self, blocks=[context.broadcast(b.value.of(at)) for b, at in some], widths=[len(at) for _, at in some], samples=len(rows))

    def panels(self) -> list[DataFrame]:
        """cell, x: the rows of X over each block of samples."""

        def of(block, samples: int) -> DataFrame:
            look = self.look([block])

            def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for part in sliced(batches, samples):
                    yield pa.RecordBatch.from_arrays([part.column(0), lists(look(part.column(1)))], ["cell", "x"])

            return self.rows.mapInArrow(run, "cell long, x array<double>")

        return [of(b, n) for b, n in zip(self.blocks, self.widths, strict=True)]

    def frame(self) -> DataFrame:
        """cell, x."""
        out = None
        for part in self.panels():
            out = part if out is None else out.join(part.withColumnRenamed("x", "y"), "cell").select("cell", F.concat("x", "y").alias("x"))
        return self.rows.select("cell", F.array().cast("array<double>").alias("x")) if out is None else out

    def extent(self) -> tuple[float, float]:
        """The sum of squares and the least entry, in one pass."""
        look, samples = self.look(), self.samples

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            square, least = 0.0, 0.0
            for part in sliced(batches, samples):
                x = look(part.column(1))
                square, least = square + float(np.vdot(x, x)), min(least, float(x.min(initial=0.0)))
            yield pa.RecordBatch.from_arrays([pa.array([square]), pa.array([least])], ["square", "least"])

        got = self.rows.mapInArrow(run, "square double, least double").agg(F.sum("square"), F.min("least")).first()
        return got[0] or 0.0, got[1] or 0.0

    def long(self, samples: DataFrame, digits: int | None = None) -> DataFrame:
        """sample, cell, value, rounded to some digits; samples: pos, sample.

        Tasks make the rows themselves, in tiles of some cells and samples, sample by sample: whatever stores
        columns packs a tile's sample and cell to next to nothing.
        """
        got = samples.select("pos", "sample").orderBy("pos").toArrow()  # a row for each sample
        pos, ids = np.asarray(got.column("pos").combine_chunks()), got.column("sample").combine_chunks()
        known = samples.sparkSession.sparkContext.broadcast(ids)
        schema, out, lo = f"sample {samples.schema['sample'].dataType.simpleString()}, cell long, value double", None, 0
        for block, width in zip(self.blocks, self.widths, strict=True):
            own = np.flatnonzero((pos >= lo) & (pos < lo + width))
            part = self.rows.mapInArrow(self._tiles(block, pos[own] - lo, own, known, digits), schema)
            out, lo = part if out is None else out.unionByName(part), lo + width
        return long_x(self.frame(), samples, digits) if out is None else out

    def _tiles(self, block, at: np.ndarray, own: np.ndarray, known, digits: int | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """What makes sample, cell, value of (cell, x) for the samples at some places of a block, which are at ``own`` among the known."""
        # without the table, which no task can have
        most, bare, of = TILE_ENTRIES, replace(self, rows=None, blocks=[]), _tile_of
        # stored entries are laid out by gene for a whole block: its tiles would each have as long a list of genes
        wide = TILE_SAMPLES if block.value.dense is not None else max(1, len(at))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tiles = [(bare.look([of(block, at[lo : lo + wide])]), own[lo : lo + wide]) for lo in range(0, len(at), wide)]
            for batch in batches:
                step = max(1, most // min(wide, max(1, len(at))))
                for lo in range(0, batch.num_rows, step):
                    part = batch.slice(lo, step)
                    n, cells = part.num_rows, np.tile(np.asarray(part.column(0)), min(wide, len(at)))
                    for make, who in tiles:
                        value = np.ascontiguousarray(make(part.column(1)).T).ravel()
                        sample = known.value.take(pa.array(np.repeat(who, n)))
                        yield pa.RecordBatch.from_arrays([sample, pa.array(cells[: len(value)]), pa.array(value if digits is None else rounded(value, digits))], ["sample", "cell", "value"])

        return run


@dataclass
class _Tile:
    """A block in a task, where looks expect what was sent."""

    value: Block


def _tile_of(block, at: np.ndarray):
    """The block of some ascending places; of all, or of neighbouring ones of a dense block, nothing is copied."""
    b = block.value
    if len(at) == len(b.zero):
        return block
    if b.dense is not None and len(at) and at[-1] - at[0] == len(at) - 1:
        span = slice(int(at[0]), int(at[-1]) + 1)
        return _Tile(Block(b.n, b.zero[span], b.total[span], b.dense[:, span]))
    return _Tile(b.of(at))


def blocks_of(columns: DataFrame, samples: list[int], n_genes: int) -> tuple[list, list[int]]:
    """The scaled samples, sent to all tasks in blocks: of BLOCK_ENTRIES numbers, or of stored entries that take
    as much, whichever makes fewer. columns: col, i, v, zero of samples; one block passes the driver at a time."""
    context = columns.sparkSession.sparkContext
    stored = columns.agg(F.coalesce(F.sum(F.size("i")), F.lit(0))).first()[0]
    sparse = 2 * stored + len(samples) * 2 + n_genes < n_genes * len(samples) and n_genes * len(samples) > BLOCK_ENTRIES
    each = max(1, -(-2 * stored // max(1, len(samples)))) if sparse else max(1, n_genes)
    width = max(1, BLOCK_ENTRIES // each)
    out = []
    for lo in range(0, len(samples), width):
        own = samples[lo : lo + width]
        got = columns.where(F.col("col").between(own[0], own[-1])).select("col", "i", "v", "zero").toArrow().combine_chunks()
        zero = np.zeros(len(own))
        at = np.searchsorted(own, np.asarray(got.column("col").combine_chunks()).astype(np.int64)) if got.num_rows else np.zeros(0, int)
        i, v = ((np.asarray(c.flatten()), np.diff(np.asarray(c.offsets))) for c in (got.column(n).combine_chunks() for n in ("i", "v"))) if got.num_rows else ((np.zeros(0, int), np.zeros(0, int)), (np.zeros(0), None))
        zero[at] = np.asarray(got.column("zero").combine_chunks()) if got.num_rows else 0
        col = np.repeat(at, i[1])
        if sparse:
            by = np.argsort(i[0], kind="stable")
            start = np.concatenate([[0], np.cumsum(np.bincount(i[0], minlength=n_genes))]).astype(np.int32)
            total = n_genes * zero + np.bincount(col, v[0], len(own))
            block = Block(n_genes, zero, total, None, start, col[by].astype(np.int32), v[0][by])
        else:
            z = np.tile(zero, (n_genes, 1))
            z[i[0], col] += v[0]
            block = Block(n_genes, zero, z.sum(0), np.vstack([z, z.sum(0)]))
        out.append(context.broadcast(block))
    return out, [min(width, len(samples) - lo) for lo in range(0, len(samples), width)]


def stored_samples(x: Similarity, spark: SparkSession) -> DataFrame:
    """cell (the sample's position), x (i, v, zero): the scaled samples of all blocks as :func:`listed` has them."""
    out, lo = None, 0
    for block, width in zip(x.blocks, x.widths, strict=True):
        i, v, zero = block.value.columns()
        ends = pa.array(np.concatenate([[0], np.cumsum([len(c) for c in i])]), pa.int32())
        flat = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(c) if c else np.zeros(0), kind)) for c, kind in ((i, pa.int32()), (v, pa.float64()))]
        own = pa.table({"cell": pa.array(np.arange(lo, lo + width), pa.int64()), "i": flat[0], "v": flat[1], "zero": pa.array(zero)})
        part = spark.createDataFrame(own, "cell long, i array<int>, v array<double>, zero double").select("cell", F.struct("i", "v", "zero").alias("x"))
        out, lo = part if out is None else out.unionByName(part), lo + width
    return out


def seen(x: DataFrame | Similarity) -> tuple[DataFrame, Callable[[pa.Array], np.ndarray]]:
    """cell, x, and what makes rows of X of the values of x, which are these or their parts."""
    if isinstance(x, Similarity):
        return x.rows, x.look()
    return x, lambda v: np.asarray(v.flatten()).reshape(len(v), -1)


def long_x(x: DataFrame | Similarity, samples: DataFrame, digits: int | None = None) -> DataFrame:
    """sample, cell, value of X, rounded to some digits; samples: pos, sample."""
    if isinstance(x, Similarity):
        return x.long(samples, digits)
    flat = x.select("cell", F.posexplode("x").alias("pos", "value"))
    # a row for each sample goes to all tasks, whatever Spark would broadcast by itself: else every entry of X is shuffled
    value = F.col("value") if digits is None else F.round("value", digits).alias("value")
    return flat.join(F.broadcast(samples), "pos").select("sample", "cell", value)


def fro_square(x: DataFrame) -> Column:
    """The sum of squares of a row of X."""
    return F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v)


def fro_norm(x: DataFrame | Similarity) -> DataFrame:
    if isinstance(x, Similarity):
        return x.rows.sparkSession.createDataFrame([(x.extent()[0] ** 0.5,)], "fro_norm double")
    return x.agg(F.sqrt(F.sum(fro_square(x))).alias("fro_norm"))


def normalized(x: DataFrame | Similarity) -> DataFrame | Similarity:
    """X with a Frobenius norm of 1; zero or no X is an error."""
    norm = x.extent()[0] ** 0.5 if isinstance(x, Similarity) else fro_norm(x).first()[0]
    if not norm or not 0 < norm < float("inf"):
        raise ValueError("X is zero or not finite")
    if isinstance(x, Similarity):
        return replace(x, scale=x.scale / norm)
    return x.select("cell", F.transform("x", lambda v: v / F.lit(norm)).alias("x"))


def max_difference(x: Similarity, other: Similarity) -> DataFrame:
    """One row: :func:`tables.max_difference` of two X in parts; their rows are made where the parts meet."""
    looks, same, samples = (x.look(), other.look()), x.samples == other.samples, max(x.samples, other.samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        most = 0.0
        for part in sliced(batches, samples):
            if not same or part.column(0).null_count or part.column(1).null_count:
                most = float("inf")
            else:
                a, b = (look(part.column(i)) for i, look in enumerate(looks))
                most = max(most, float(np.abs(a - b).max(initial=0.0)))
        yield pa.RecordBatch.from_arrays([pa.array([most])], ["d"])

    met = x.rows.select("cell", F.col("x").alias("a")).join(other.rows.select("cell", F.col("x").alias("b")), "cell", "full")
    return met.select("a", "b").mapInArrow(run, "d double").agg(F.coalesce(F.max("d"), F.lit(0.0)).alias("max_difference"))
