"""From expression, graph and phenotype to the tables of a fit."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenospark.functions import expression as ex
from phenospark.operators import graph, survival
from phenospark.sources import tables
from phenospark.sources.tables import cut


@dataclass
class Object:
    """x: cell, x; samples: pos, sample; s: by sample position; edges, degree: the normalised graph."""

    x: DataFrame
    samples: DataFrame
    s: np.ndarray
    edges: DataFrame | None
    degree: DataFrame | None
    method: str
    n_genes: int
    fro_norm: float


def parts(bulk: DataFrame, cells: DataFrame, quantile: bool = True) -> ex.Similarity:
    """What X is made of: the cells' and the samples' scaled columns over the common genes, after quantile
    normalisation of all columns together.

    Absent rows are zeros. A cell without a row of a common gene is constant: its
    correlations are 0. Genes are numbered on tables; the driver gets the samples' numbers.
    """
    genes = cut(tables.positions(ex.common_genes(bulk, cells).select(F.col("gene").alias("cell"))).select(F.col("cell").alias("gene"), F.col("pos").cast("int").alias("num")), "genes")
    samples = sorted(r[0] for r in bulk.select("col").distinct().collect())  # a row for each sample
    named, n = cut(cells.select(F.col("col").cast("long").alias("cell")).distinct(), "cells"), genes.count()
    sides = [t.join(genes, "gene").select(F.lit(s).alias("side"), F.col("num").alias("gene"), "col", "value") for s, t in (("bulk", bulk), ("cell", cells))]
    columns = cut(sides[0].unionByName(sides[1]), "columns")
    if quantile:
        # a row for each gene, read by both sides
        columns = ex.quantile_normalize(columns, cut(ex.quantile_target(columns, n, len(samples) + named.count()), "target"), n)
    found = cut(ex.listed(ex.center_scale(columns, n)), "scaled")
    blocks, widths = ex.blocks_of(found.where("side = 'bulk'"), samples, n)
    none = lambda kind: F.array().cast(f"array<{kind}>")
    own = found.where("side = 'cell'").select(F.col("col").cast("long").alias("cell"), "i", "v", "zero")
    rows = named.join(own, "cell", "left").select("cell", F.coalesce("i", none("int")).alias("i"), F.coalesce("v", none("double")).alias("v"), F.coalesce("zero", F.lit(0.0)).alias("zero"))
    # many files, as the work on a row is its samples' number and not its size
    dealt = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "cell")
    return ex.Similarity(cut(dealt.select("cell", F.struct("i", "v", "zero").alias("x")), "rows"), blocks, widths, len(samples), n)


def similarity(bulk: DataFrame, cells: DataFrame, quantile: bool = True) -> DataFrame:
    """cell, x: correlations over the common genes; see :func:`parts`."""
    return parts(bulk, cells, quantile).frame()


def kept(x: ex.Similarity) -> ex.Similarity | DataFrame:
    """X for many passes: as its parts where they are smaller than its rows, else written."""
    return x if x.short else cut(x.frame(), "x")


def samples_of(bulk: DataFrame) -> DataFrame:
    """pos, sample: positions in X by the samples' numbers; one row a sample."""
    ordered = bulk.agg(F.sort_array(F.collect_set("col")).alias("c"))
    return ordered.select(F.posexplode("c").alias("pos", "sample"))


def create(bulk: DataFrame, cells: DataFrame, phenotype: DataFrame, edges: DataFrame | None = None, method: str = "survival", binarize: bool = True, quantile: bool = True) -> Object:
    """Checks, then X (norm 1), S and the normalised graph. Phenotype rows are joined by sample, never by order."""
    n_genes = ex.common_genes(bulk, cells).count()
    if n_genes == 0:
        raise ValueError("bulk and cells have no gene in common")
    if n_genes < 2:
        raise ValueError("correlations need two genes at least")
    raw = cut(similarity(bulk, cells, quantile), "x")
    norm = ex.fro_norm(raw).first()[0]
    x = ex.normalized(raw)
    samples = samples_of(bulk)
    found = samples.join(survival.phenotype_s(phenotype, method).withColumnRenamed("col", "sample"), "sample", "left").orderBy("pos").toPandas()  # a row for each sample
    if found["s"].isna().any():
        raise ValueError("a sample has no phenotype")
    clean = degree = None
    if edges is not None:
        clean = graph.clean(edges, binarize)
        degree = graph.degrees(clean, x)
        clean = graph.normalize(clean, degree)
    return Object(x, samples, found["s"].to_numpy(float), clean, degree, method, n_genes, float(norm))
