"""Cell graphs as edges (src, dst, w); the Laplacian is never made."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenospark.sources.tables import Bucketed, cut


def clean(edges: DataFrame, binarize: bool = True) -> DataFrame:
    """Without loops and zeros; weights become 1 if binarize."""
    kept = edges.where((F.col("src") != F.col("dst")) & (F.col("w") != 0))
    return kept.withColumn("w", F.lit(1.0)) if binarize else kept


def degrees(edges: DataFrame, cells: DataFrame) -> DataFrame:
    """cell, deg (row sums; 0 for an isolated cell), d (1 if deg > 0)."""
    sums = edges.groupBy(F.col("src").alias("cell")).agg(F.sum("w").alias("deg"))
    full = cells.select("cell").join(sums, "cell", "left").withColumn("deg", F.coalesce("deg", F.lit(0.0)))
    return full.withColumn("d", F.when(F.col("deg") > 0, 1.0).otherwise(0.0))


def info(degree: DataFrame) -> DataFrame:
    zero = F.count(F.when(F.col("deg") == 0, 1))
    return degree.agg(zero.alias("n_zero"), F.min("deg").alias("min_deg"), F.max("deg").alias("max_deg"), F.avg("deg").alias("mean_deg"))


def normalize(edges: DataFrame, degree: DataFrame) -> DataFrame:
    """w / sqrt(deg(src) deg(dst)), row sums for both ends; edges of a cell without degree get 0."""
    d = degree.select("cell", "deg")
    joined = edges.join(d.select(F.col("cell").alias("src"), F.col("deg").alias("a")), "src").join(d.select(F.col("cell").alias("dst"), F.col("deg").alias("b")), "dst")
    return joined.select("src", "dst", F.when((F.col("a") > 0) & (F.col("b") > 0), F.col("w") / F.sqrt(F.col("a") * F.col("b"))).otherwise(0.0).alias("w"))


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "w")


def symmetrize(edges: DataFrame) -> DataFrame:
    """(A + A') / 2."""
    return edges.select("src", "dst", "w").unionByName(transpose(edges)).groupBy("src", "dst").agg((F.sum("w") / 2).alias("w"))


def symmetry_defect(edges: DataFrame, tolerance: float = 1e-12) -> DataFrame:
    """One row: the Frobenius norm of A - A', and whether it is within the tolerance."""
    other = transpose(edges).withColumnRenamed("w", "v")
    d = F.coalesce("w", F.lit(0.0)) - F.coalesce("v", F.lit(0.0))
    total = F.sqrt(F.coalesce(F.sum(d * d), F.lit(0.0)))
    return edges.join(other, ["src", "dst"], "full").agg(total.alias("sym_fro")).withColumn("is_symmetric", F.col("sym_fro") <= tolerance)


def laplacian(edges: DataFrame, degree: DataFrame) -> DataFrame:
    """The entries of D - A of a normalised graph; for looking at, since no operator needs it."""
    diagonal = degree.where("d > 0").select(F.col("cell").alias("src"), F.col("cell").alias("dst"), F.col("d").alias("w"))
    return diagonal.unionByName(edges.where("w <> 0").select("src", "dst", (-F.col("w")).alias("w")))


def spmm(edges: DataFrame, h: DataFrame, k: int) -> DataFrame:
    """cell, g: H A' for H as (cell, h array of k), one join and one sum of k columns."""
    return _summed(edges.join(h.select(F.col("cell").alias("dst"), "h"), "dst"), k)


#: Edges into one cell that stay together.
HUB = 100_000


class Edges:
    """A graph laid out for many products: edges in buckets by the cell they read, so that H in the same buckets
    moves nothing. A cell that more than ``hub`` edges read is dealt to blocks by the edges' other ends, and its row
    of H goes to each block: no bucket holds a hub's edges. What blocks add up is put together by cell at the end."""

    def __init__(self, edges: DataFrame, hub: int | None = None):
        hub = HUB if hub is None else hub
        edges = edges.select("src", F.col("dst").cast("long").alias("dst"), "w")
        self.light, self.heavy = Bucketed(edges, "dst"), None
        # at most a hub for every ``hub`` edges
        self.hubs = cut(self.light.read().groupBy("dst").agg(F.ceil(F.count("*") / hub).cast("int").alias("blocks")).where("blocks > 1"), "hubs")
        if not self.hubs.isEmpty():
            whole, edges = self.light, self.light.read()
            block = F.pmod(F.xxhash64("src"), F.col("blocks")).cast("int").alias("block")
            self.heavy = cut(edges.join(self.hubs, "dst").select("src", "dst", "w", block).repartition("dst", "block"), "heavy")
            self.light = Bucketed(edges.join(self.hubs, "dst", "left_anti"), "dst")
            whole.drop()

    def product(self, h: DataFrame, k: int) -> DataFrame:
        """cell, g: :func:`spmm` with H as (cell, h array of k)."""
        if self.heavy is None:
            return spmm(self.light.read(), h, k)
        other = h.select(F.col("cell").alias("dst"), "h")
        part = self.light.read().join(other, "dst").select("src", "w", "h")
        sent = other.join(self.hubs, "dst").select("dst", "h", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
        return _summed(part.unionByName(self.heavy.join(sent, ["dst", "block"]).select("src", "w", "h")), k)

    def drop(self) -> None:
        """The buckets and their files go."""
        self.light.drop()


def product(edges: DataFrame | Edges, h: DataFrame, k: int) -> DataFrame:
    """cell, g: H A', of edges in either form."""
    return edges.product(h, k) if isinstance(edges, Edges) else spmm(edges, h, k)


def _summed(met: DataFrame, k: int) -> DataFrame:
    sums = met.groupBy(F.col("src").alias("cell")).agg(*(F.sum(F.col("w") * F.col("h")[i]).alias(f"g{i}") for i in range(k)))
    return sums.select("cell", F.array(*(f"g{i}" for i in range(k))).alias("g"))


def quadratic(edges: DataFrame | Edges, h: DataFrame, k: int) -> DataFrame:
    """One row: the sum of H o (H A')."""
    joined = product(edges, h, k).join(h.select("cell", "h"), "cell")
    dot = F.aggregate(F.zip_with("g", "h", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return joined.agg(F.coalesce(F.sum(dot), F.lit(0.0)).alias("quadratic"))
