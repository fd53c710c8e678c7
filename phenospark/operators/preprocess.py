"""Single-cell preparation on long tables: gene, col (the cell), value; absent rows are 0."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phenospark.operators.components import components, projected, sparse_rows
from phenospark.operators.neighbours import usable
from phenospark.sources.tables import cut


def log_normalize(counts: DataFrame, scale: float = 10_000.0) -> DataFrame:
    """log1p(count / cell total * scale)."""
    return rc_normalize(counts, scale).withColumn("value", F.log1p("value"))


def rc_normalize(counts: DataFrame, scale: float = 10_000.0) -> DataFrame:
    """count / cell total * scale."""
    total = F.sum("value").over(Window.partitionBy("col"))
    return counts.withColumn("value", F.coalesce(F.col("value") / F.nullif(total, F.lit(0.0)), F.lit(0.0)) * scale)


def clr_normalize(counts: DataFrame, n_genes: int | None = None) -> DataFrame:
    """Centred log ratio in a cell: log1p(count / exp(sum of log1p(count) / genes))."""
    genes = F.lit(n_genes if n_genes is not None else counts.select("gene").distinct().count())
    center = F.exp(F.sum(F.when(F.col("value") > 0, F.log1p("value")).otherwise(0.0)).over(Window.partitionBy("col")) / genes)
    return counts.withColumn("value", F.log1p(F.col("value") / center))


def gene_stats(values: DataFrame, n_cells: int) -> DataFrame:
    """gene, mean, variance over all cells, those without a row as 0; one partial-and-final sum.

    The spread of the stored rows and that between them and the zeros add up, so
    no large squares are subtracted from each other.
    """
    got = values.groupBy("gene").agg(F.count("value").alias("c"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    spread = F.col("c") * F.col("v") + F.col("m") * F.col("m") * F.col("c") * (n_cells - F.col("c")) / n_cells
    return got.select("gene", (F.col("m") * F.col("c") / n_cells).alias("mean"), (spread / max(1, n_cells - 1)).alias("variance"))


def gene_parts(values: DataFrame) -> DataFrame:
    """gene, c, m, s of some cells' stored rows: how many, their mean, and the squares of what they are off it.
    Parts of other cells can be put beside them."""
    return values.groupBy("gene").agg(F.count("value").alias("c"), F.avg("value").alias("m"), (F.var_pop("value") * F.count("value")).alias("s"))


def merged_stats(parts: DataFrame, n_cells: int) -> DataFrame:
    """:func:`gene_stats` from the parts of all cells."""
    own = parts.withColumn("all", F.sum(F.col("c") * F.col("m")).over(Window.partitionBy("gene")) / F.sum("c").over(Window.partitionBy("gene")))
    got = own.groupBy("gene").agg(F.sum("c").alias("c"), F.first("all").alias("m"), F.sum(F.col("s") + F.col("c") * (F.col("m") - F.col("all")) * (F.col("m") - F.col("all"))).alias("s"))
    spread = F.col("s") + F.col("m") * F.col("m") * F.col("c") * (n_cells - F.col("c")) / n_cells
    return got.select("gene", (F.col("m") * F.col("c") / n_cells).alias("mean"), (spread / max(1, n_cells - 1)).alias("variance"))


def scale_data(values: DataFrame, n_cells: int, clip: float = 10.0) -> DataFrame:
    """Rows centred and scaled by gene, clipped above. Only stored rows come back: a cell
    without one has the gene's value of :func:`scaled_zeros`, which pca() takes for it."""
    stats = gene_stats(values, n_cells)
    return values.join(stats, "gene").select("gene", "col", _scaled(F.col("value"), clip).alias("value"))


def _scaled(value: Column, clip: float) -> Column:
    """By mean and variance of the row; a deviation of 0 counts as 1."""
    dev = F.sqrt(F.greatest("variance", F.lit(0.0)))
    return F.least((value - F.col("mean")) / F.coalesce(F.nullif(dev, F.lit(0.0)), F.lit(1.0)), F.lit(clip))


def scaled_zeros(values: DataFrame, n_cells: int, clip: float = 10.0) -> DataFrame:
    """gene, zero: what an absent row of values is after scale_data, -mean / deviation."""
    return gene_stats(values, n_cells).select("gene", _scaled(F.lit(0.0), clip).alias("zero"))


def variable_genes(values: DataFrame | None, n_cells: int, n: int = 3000, method: str = "vst", stats: DataFrame | None = None) -> DataFrame:
    """gene, score of the n most variable genes: by dispersion (disp), its z-score within
    20 bins of the mean (mvp), or the variance after standardising by the trend (vst).
    stats: :func:`gene_stats` where they are known; disp and mvp need no values then."""
    stats = gene_stats(values, n_cells) if stats is None else stats
    if method == "disp":
        scored = stats.select("gene", F.coalesce(F.try_divide("variance", "mean"), F.lit(0.0)).alias("score"))
    elif method == "mvp":
        d = stats.where("mean > 0").select("gene", F.log1p("mean").alias("m"), F.log(F.col("variance") / F.col("mean")).alias("d"))
        edge = d.agg(F.min("m").alias("low"), F.max("m").alias("high")).first()
        width = ((edge.high or 0) - (edge.low or 0)) / 20 or 1.0
        by = Window.partitionBy(F.least(F.floor((F.col("m") - F.lit(edge.low or 0.0)) / width), F.lit(19)))
        scored = d.select("gene", F.coalesce((F.col("d") - F.avg("d").over(by)) / F.nullif(F.stddev_samp("d").over(by), F.lit(0.0)), F.lit(0.0)).alias("score"))
    elif method == "vst":
        table = stats.toPandas()  # a row for each gene
        ok = (table["mean"] > 0) & (table["variance"] > 0)
        trend = np.zeros(len(table))
        trend[ok] = 10 ** (loess(np.log10(table["mean"][ok].to_numpy()), np.log10(table["variance"][ok].to_numpy())) / 2)
        fitted = values.sparkSession.createDataFrame(table.assign(trend=trend)[["gene", "mean", "trend"]])
        top = float(np.sqrt(n_cells))
        z = F.least((F.col("value") - F.col("mean")) / F.nullif(F.col("trend"), F.lit(0.0)), F.lit(top))
        zero = F.least(-F.col("mean") / F.nullif(F.col("trend"), F.lit(0.0)), F.lit(top))
        sums = values.join(fitted, "gene").groupBy("gene").agg(F.sum(z * z).alias("s"), F.count("*").alias("c"), F.first(zero).alias("zero"))
        scored = sums.select("gene", F.coalesce((F.col("s") + (n_cells - F.col("c")) * F.col("zero") * F.col("zero")) / max(1, n_cells - 1), F.lit(0.0)).alias("score"))
    else:
        raise ValueError("method is vst, mvp or disp")
    return scored.orderBy(F.desc("score"), "gene").limit(n)


def loess(x: np.ndarray, y: np.ndarray, span: float = 0.3) -> np.ndarray:
    """Local quadratic fits with tricube weights, at up to 200 places, interpolated between."""
    order = np.argsort(x)
    xs, ys = x[order], y[order]
    k = max(3, min(len(xs), int(np.ceil(span * len(xs)))))
    at = np.unique(np.quantile(xs, np.linspace(0, 1, min(200, len(xs)))))
    out = []
    for p in at:
        lo = int(np.clip(np.searchsorted(xs, p) - k // 2, 0, len(xs) - k))
        while lo + k < len(xs) and p - xs[lo] > xs[lo + k] - p:
            lo += 1
        u, v = xs[lo : lo + k] - p, ys[lo : lo + k]
        weight = np.sqrt(np.clip(1 - (np.abs(u) / (np.abs(u).max() + 1e-12)) ** 3, 0, None) ** 3 + 1e-9)
        basis = np.stack([np.ones(k), u, u * u], 1) * weight[:, None]
        out.append(np.linalg.lstsq(basis, v * weight, rcond=None)[0][0])
    return np.interp(x, at, out)


def pca(scaled: DataFrame, genes: DataFrame, k: int = 50, zeros: DataFrame | None = None, cells: DataFrame | None = None) -> DataFrame:
    """col, pc array of k: principal components of the cells over the given genes.

    zeros: gene, zero, the value of a gene that a cell has no row of (0 where it
    isn't given); cells: col of all cells, also of those without a row. Components are those
    of the centred cells, cells are projected as they are; each component's largest entry
    is above 0. Rows stay sparse, see :mod:`components`. Without cells or genes: no rows.
    """
    rows, zero, names = sparse_rows(scaled, genes, zeros, cells)
    if not names or rows.isEmpty():
        return rows.select("col", F.col("v").alias("pc")).where("false")
    return projected(rows, zero, components(rows, len(names), names, k))


PACKED = "block int, cells binary, dims int, data binary"


def foremost_of(score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column of each row's k highest scores, ties to the smaller column; minus infinity takes no part.

    The k-th highest of the maxima of groups of columns is a lower bound, so that only a few entries a row are sorted.
    """
    n, m = score.shape
    width = m // (4 * k)
    bound = np.full(n, -np.inf)
    if width > 1:
        top = score[:, : m // width * width].reshape(n, -1, width).max(2)
        bound = np.partition(top, top.shape[1] - k, 1)[:, -k]
    r, c = np.nonzero(score >= bound[:, None])
    order = np.lexsort((c, -score[r, c], r))
    r, c = r[order], c[order]
    keep = (np.arange(len(r)) - np.searchsorted(r, r, "left") < k) & (score[r, c] > -np.inf)
    return r[keep], c[keep]


#: Blocks into which cells are dealt, while these have 4096 to 32,768 rows: every cell is sent to each block, on either side.
BLOCKS = 12


def block_rows(count: int) -> int:
    """The rows of a block: the number of blocks stays the same as cells become more, so what is sent grows as the cells do."""
    return min(32_768, max(4096, -(-count // BLOCKS)))


def knn_graph(vectors: DataFrame, k: int = 20, block: int | None = None, metric: str = "inner") -> DataFrame:
    """src, rank, dst, score: each cell's k best other cells, ties to the smaller cell.

    score: the inner product, or minus the squared distance (metric="euclidean").
    vectors: cell, v. Blocks of cells meet as packed rows; NumPy takes each pair
    of blocks and keeps k a cell; Spark merges the blocks. Their size is that of
    :func:`block_rows`, unless it is given. Every block meets every other: see :mod:`neighbours` for an index. Vectors that are null or hold null, NaN or
    infinite entries are left out, shorter ones count as filled with 0.
    """
    vectors = usable(vectors)
    count = vectors.count()
    block = block or block_rows(count)
    n = max(1, -(-count // block))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, block):
                part = batch.slice(lo, block)
                flat = np.asarray(part.column(2).flatten())
                yield pa.RecordBatch.from_arrays([part.column(0).slice(0, 1), pa.array([np.asarray(part.column(1)).tobytes()], pa.binary()), pa.array([len(flat) // part.num_rows], pa.int32()), pa.array([flat.tobytes()], pa.binary())], ["block", "cells", "dims", "data"])

    packed = vectors.select("cell", F.col("v").cast("array<double>").alias("v")).repartition(n).select(F.spark_partition_id().alias("block"), "cell", "v").mapInArrow(pack, PACKED)
    every = F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = packed.select(F.col("block").alias("a"), every.alias("b"), F.struct("cells", "dims", "data").alias("l"))
    right = packed.select(F.col("block").alias("b"), every.alias("a"), F.struct("cells", "dims", "data").alias("r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                ids = [np.frombuffer(t[s]["cells"], np.int64) for s in ("l", "r")]
                own, other = (np.frombuffer(t[s]["data"]).reshape(-1, t[s]["dims"]) for s in ("l", "r"))
                by = np.argsort(ids[1])
                ids[1], other = ids[1][by], other[by]
                step = max(1, (1 << 21) // max(1, len(other)))  # scores of 16 MB
                for lo in range(0, len(own), step):
                    score = own[lo : lo + step] @ other.T
                    if metric == "euclidean":
                        score = 2 * score - (own[lo : lo + step] ** 2).sum(1)[:, None] - (other**2).sum(1)[None, :]
                    score[ids[0][lo : lo + step, None] == ids[1][None, :]] = -np.inf
                    r, c = foremost_of(score, k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[0][lo + r]), pa.array(ids[1][c]), pa.array(score[r, c])], ["src", "dst", "score"])

    found = left.join(right, ["a", "b"]).select("l", "r").mapInArrow(run, "src long, dst long, score double")
    best = Window.partitionBy("src").orderBy(F.desc("score"), "dst")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("src", "rank", "dst", "score")


#: Sets of one shared neighbour that meet in one task, at most, on either side.
CROWD = 2000


def neighbour_sets(knn: DataFrame) -> DataFrame:
    """src, near (n, dst: each neighbour and in how many sets it is, the least popular first), size; written."""
    own = cut(knn.select("src", "dst").unionByName(knn.select("src", F.col("src").alias("dst"))).distinct(), "sets")
    popular = own.groupBy("dst").agg(F.count("*").alias("n"))
    sets = own.join(popular, "dst").groupBy("src").agg(F.sort_array(F.collect_list(F.struct("n", "dst"))).alias("near"))  # k + 1 at most
    return cut(sets.withColumn("size", F.size("near")), "sets")


def telling(sets: DataFrame, prune: float) -> DataFrame:
    """src, via, n: the neighbours of each set of which two sets alike enough share one."""
    least = sets.agg(F.min("size")).first()[0] or 1
    # an index of prune with a set of at least the least size takes this many in common
    overlap = F.greatest(F.lit(1), F.ceil(F.lit(prune / (1 + prune)) * (F.col("size") + least) - 1e-9))
    shown = F.slice("near", F.lit(1), F.greatest(F.lit(1), F.col("size") - overlap + 1).cast("int"))
    return sets.select("src", F.explode(shown).alias("e")).select("src", F.col("e.dst").alias("via"), "e.n")


def snn_graph(knn: DataFrame, k: int, prune: float = 1 / 15, crowd: int = CROWD) -> DataFrame:
    """src, dst, w: Jaccard index of neighbour sets (a cell is its own neighbour), weights below prune left out.

    Sets that are alike enough have several neighbours in common, so they share one among
    all but their few most popular ones. Only these make pairs: each set leaves out as many
    of its most popular neighbours as can't make up the least overlap by themselves, which
    keeps hubs from pairing all their admirers. The pairs found are measured on the whole
    sets. A neighbour that is in more than ``crowd`` sets is dealt to blocks of both sides.
    """
    sets = neighbour_sets(knn)
    shown = telling(sets, prune)
    blocks = F.ceil(F.col("n") / crowd).cast("int")
    deal, every = F.pmod(F.xxhash64("src"), blocks).cast("int"), F.explode(F.sequence(F.lit(0), blocks - 1))
    left = shown.select("src", "via", deal.alias("a"), every.alias("b"))
    right = shown.select(F.col("src").alias("dst"), "via", deal.alias("b"), every.alias("a"))
    pairs = left.join(right, ["via", "a", "b"]).where("src < dst").select("src", "dst").distinct()
    names = sets.select("src", F.transform("near", lambda e: e["dst"]).alias("l"))
    met = pairs.join(names, "src").join(names.select(F.col("src").alias("dst"), F.col("l").alias("r")), "dst")
    c = F.size(F.array_intersect("l", "r"))
    found = met.select("src", "dst", (c / (F.size("l") + F.size("r") - c)).alias("w")).where(F.col("w") >= prune)
    return found.select("src", "dst", "w", F.explode(F.array(F.lit(False), F.lit(True))).alias("back")).select(F.when(F.col("back"), F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(F.col("back"), F.col("src")).otherwise(F.col("dst")).alias("dst"), "w")


def two_sided(z: Column) -> Column:
    """The probability of a normal number as far from 0 as z, either way, in the JVM.

    A series up to 3 (terms fall below 1e-12 of it), the continued fraction of the
    tail beyond; absolute errors stay below 1e-10, relative ones of the tail below 1e-7.
    """
    x = F.abs(z)
    total = F.lit(1.0)
    for n in range(40, 0, -1):
        total = 1 + total * x * x / (2 * n + 1)
    near = 1 - F.sqrt(F.lit(2 / math.pi)) * F.exp(-x * x / 2) * x * total
    tail = x
    for n in range(40, 0, -1):
        tail = x + n / tail
    far = F.sqrt(F.lit(2 / math.pi)) * F.exp(-x * x / 2) / tail
    return F.when(x <= 3, near).otherwise(far)


def markers(values: DataFrame, cells: DataFrame) -> DataFrame:
    """gene, log_fc, u, z, p_value, p_adj between cells with chosen = 1 and the rest.

    values: log-normalised; cells: col, chosen, all cells. log_fc: log2 of the
    means of expm1(value) plus 1. Wilcoxon rank sums with mean ranks, zeros as one
    tie, normal approximation with tie correction; Bonferroni over genes.
    """
    sizes = cells.agg(F.sum("chosen").alias("n1"), F.count("*").alias("n")).first()
    n1, n = int(sizes.n1 or 0), int(sizes.n)
    n2 = n - n1
    some = values.where("value > 0").join(cells.select("col", "chosen"), "col")
    by = Window.partitionBy("gene")
    # values above 0 follow the zeros, which share the mean rank (zeros + 1) / 2
    zeros = F.lit(n) - F.count("*").over(by)
    tie = F.count("*").over(Window.partitionBy("gene", "value"))
    ranked = some.withColumn("zeros", zeros).withColumn("r", zeros + F.rank().over(by.orderBy("value")) + (tie - 1) / 2).withColumn("t", (tie * tie - 1).cast("double"))
    total = F.expm1("value")
    one, two = F.sum(F.when(F.col("chosen") == 1, total).otherwise(0.0)), F.sum(F.when(F.col("chosen") == 0, total).otherwise(0.0))
    hits = F.sum("chosen")
    got = ranked.groupBy("gene").agg(one.alias("a"), two.alias("b"), F.sum(F.when(F.col("chosen") == 1, F.col("r")).otherwise(0.0)).alias("rs"), hits.alias("hits"), F.first("zeros").cast("double").alias("zeros"), F.sum("t").alias("ties"))
    u = F.col("rs") + (n1 - F.col("hits")) * (F.col("zeros") + 1) / 2 - n1 * (n1 + 1) / 2.0
    ties = F.col("ties") + F.col("zeros") * (F.col("zeros") * F.col("zeros") - 1)
    dev = F.sqrt(F.lit(n1 * n2 / 12.0) * (n + 1 - ties / (n * max(1, n - 1))))
    fc = F.log2(F.col("a") / max(1, n1) + 1) - F.log2(F.col("b") / max(1, n2) + 1)
    out = got.select("gene", fc.alias("log_fc"), u.alias("u"), F.coalesce((u - n1 * n2 / 2.0) / F.nullif(dev, F.lit(0.0)), F.lit(0.0)).alias("z"))
    genes = out.count()

    # z is bound once, as a variable
    return out.withColumn("p_value", F.get(F.transform(F.array("z"), two_sided), F.lit(0))).withColumn("p_adj", F.least(F.lit(1.0), F.col("p_value") * genes))


def significant(found: DataFrame, cut: float = 0.05, column: str = "p_adj") -> DataFrame:
    """The markers below a probability, most telling first."""
    return found.where(F.col(column) < cut).orderBy(column, F.desc(F.abs(F.col("log_fc"))), "gene")
