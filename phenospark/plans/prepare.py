"""From raw counts to a cell graph: normalise, pick genes, scale, reduce, link."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenospark.operators import preprocess
from phenospark.operators.neighbours import usable
from phenospark.sources.tables import cut


@dataclass
class Prepared:
    """values: normalised; genes: the variable ones; components: col, pc; graph: src, dst, w of the cells that
    stand for themselves; members: cell, like, w of the others (see :func:`grouped`)."""

    values: DataFrame
    genes: DataFrame
    components: DataFrame
    graph: DataFrame
    members: DataFrame


NORMALIZE = {"LogNormalize": preprocess.log_normalize, "RC": preprocess.rc_normalize, "CLR": preprocess.clr_normalize}


def prepare(counts: DataFrame, method: str = "LogNormalize", scale: float = 10_000.0, selection: str = "vst", n_genes: int = 3000, dims: int = 40, neighbours: int = 20) -> Prepared:
    """counts: gene, col, value. The graph is that of shared neighbours over the first ``dims`` components."""
    if method not in NORMALIZE:
        raise ValueError(f"method is one of {', '.join(NORMALIZE)}")
    values = cut(preprocess.clr_normalize(counts) if method == "CLR" else NORMALIZE[method](counts, scale), "values")
    n_cells = values.select("col").distinct().count()
    # the variance trend is that of counts, dispersions are of normalised values
    genes = cut(preprocess.variable_genes(counts if selection == "vst" else values, n_cells, n_genes, selection), "genes")
    chosen = values.join(genes.select("gene"), "gene", "left_semi")
    components = cut(preprocess.pca(preprocess.scale_data(chosen, n_cells), genes, dims, preprocess.scaled_zeros(chosen, n_cells), values.select("col")), "pc")
    kept, members = grouped(components.select(F.col("col").alias("cell"), F.col("pc").alias("v")), neighbours)
    return Prepared(values, genes, components, preprocess.snn_graph(cut(nearest(kept, neighbours), "knn"), neighbours), members)


def grouped(vectors: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """Cells of equal vectors: kept (cell, v, first, place), the first size + 1 of each class in the order of their
    numbers, first being the class's number; and members (cell, like, w), the class's others.

    Ties go to smaller cells, so a set of ``size`` nearest, the cell among them, never holds a cell beyond the first ``size``
    of its class. All cells beyond them have the same neighbours, so they have the same links: those of the last one kept
    (like), and one of the same weight w with it and with each other, which are as many as their number squared and aren't made.
    """
    vectors = usable(vectors)
    whole = cut(vectors.join(vectors.groupBy("v").agg(F.min("cell").alias("first")), "v"), "classes")
    order = Window.partitionBy("first").orderBy("cell")
    kept = cut(whole.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size + 1), "kept")
    last = kept.where(F.col("place") == size + 1).select("first", F.col("cell").alias("like"))
    members = whole.join(last, "first").where(F.col("cell") > F.col("like"))
    return kept, members.select("cell", "like", F.lit((size - 1) / (size + 1)).alias("w"))


def nearest(kept: DataFrame, size: int) -> DataFrame:
    """src, dst: the ``size`` - 1 nearest others, among all cells, of each cell that :func:`grouped` keeps."""
    heads = kept.where(F.col("place") <= size).select(F.col("first").alias("near"), F.col("cell").alias("dst"))
    classes = kept.where("place = 1").select("cell", "v")
    between = preprocess.knn_graph(classes, size - 1, metric="euclidean").select(F.col("src").alias("first"), F.col("dst").alias("near"), "score")
    own = classes.select(F.col("cell").alias("first"), F.col("cell").alias("near"), F.lit(float("inf")).alias("score"))
    order = Window.partitionBy("first").orderBy(F.desc("score"), "dst")
    met = between.unionByName(own).join(heads, "near").withColumn("at", F.row_number().over(order)).where(F.col("at") <= size)  # one may be the cell itself
    pairs = kept.select("first", F.col("cell").alias("src")).join(met.select("first", "at", "dst"), "first").where("src <> dst")
    rank = F.row_number().over(Window.partitionBy("src").orderBy("at"))
    return pairs.withColumn("rank", rank).where(F.col("rank") < size).select("src", "dst")


def expanded(graph: DataFrame, members: DataFrame) -> DataFrame:
    """src, dst, w of all cells: every link of :func:`grouped`'s classes, which grow with their cells squared."""
    like = members.select("cell", "like").unionByName(members.select(F.col("like").alias("cell"), "like").distinct())
    for end in ("src", "dst"):
        graph = graph.join(like.withColumnRenamed("like", end), end, "left").withColumn(end, F.coalesce("cell", end)).drop("cell")
    weight = members.select("like", "w").distinct()
    inner = like.select(F.col("cell").alias("src"), "like").join(like.select(F.col("cell").alias("dst"), "like"), "like").where("src <> dst").join(weight, "like")
    return graph.select("src", "dst", "w").unionByName(inner.select("src", "dst", "w"))
