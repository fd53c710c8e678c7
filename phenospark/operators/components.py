"""Principal components of cells whose rows are mostly zeros, without making them dense.

A cell's vector is what all cells have where they have no row (one vector, of the genes'
scaled zeros) plus a sparse vector of its stored rows less that. The common vector drops
out of the covariance, so a pass over the sparse rows gives the product of the covariance
V with a block Q: the sums of (row)'(row Q), less those of the mean row. A randomised range
finder starts from a random block; the eigenvectors of Q'V Q give the components, whose
residuals need no further pass. Power passes follow until these are small; where a few
passes don't get there the block is doubled, up to the full dimension, which is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenospark.sources.tables import cut

#: Stored entries that are multiplied at once, and columns of a block taken at once.
SLICE, WIDE = 1 << 18, 64
#: Largest residual of a component, relative to the largest eigenvalue.
RESIDUAL = 1e-9


@dataclass
class Components:
    """genes x k unit vectors, their variances (divisor n - 1), the trace of V; the genes in order; whether the block grew to all genes."""

    vectors: np.ndarray
    variances: np.ndarray
    total: float
    genes: list[str]
    passes: int


def sparse_rows(values: DataFrame, genes: DataFrame, zeros: DataFrame | None, cells: DataFrame | None) -> tuple[DataFrame, np.ndarray, list[str]]:
    """col, i, v (places and values less the zero) of each cell, written; the zeros and names of the genes in order.

    Rows of one gene and cell are added up; null values count as absent.
    """
    numbered = genes.select("gene").distinct().select("gene", (F.row_number().over(Window.orderBy("gene")) - 1).alias("i"))  # a few thousand genes
    if zeros is not None:
        numbered = numbered.join(zeros.select("gene", "zero"), "gene", "left")
    else:
        numbered = numbered.withColumn("zero", F.lit(0.0))
    numbered = cut(numbered.withColumn("zero", F.coalesce("zero", F.lit(0.0))), "genes")
    order = numbered.orderBy("i").collect()  # a row for each gene
    some = values.where("value IS NOT NULL").join(F.broadcast(numbered) if len(order) <= 10_000 else numbered, "gene").groupBy("col", "i").agg((F.sum("value") - F.first("zero")).alias("v"))
    rows = some.groupBy("col").agg(F.sort_array(F.collect_list(F.struct("i", "v"))).alias("e")).select("col", F.col("e.i").alias("i"), F.col("e.v").alias("v"))
    if cells is not None:
        none = lambda kind: F.array().cast(f"array<{kind}>")
        rows = cells.select("col").distinct().join(rows, "col", "left").select("col", F.coalesce("i", none("int")).alias("i"), F.coalesce("v", none("double")).alias("v"))
    return cut(rows.select("col", F.col("i").cast("array<int>").alias("i"), "v"), "sparse"), np.array([r.zero for r in order]), [r.gene for r in order]


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Parts of the batches with some SLICE entries: the part, and row, place and value of each entry."""
    for batch in batches:
        sizes = np.diff(np.asarray(batch.column(1).offsets))
        ends = np.cumsum(sizes)
        lo = 0
        while lo < batch.num_rows:
            before = ends[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(ends, before + SLICE, "right")))
            part = batch.slice(lo, hi - lo)
            yield part, np.repeat(np.arange(part.num_rows), sizes[lo:hi]), np.asarray(part.column(1).flatten()), np.asarray(part.column(2).flatten())
            lo = hi


def dot(row: np.ndarray, place: np.ndarray, value: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
    """The sparse rows times q."""
    return np.stack([np.bincount(row, value * q[place, j], n) for j in range(q.shape[1])], 1)


def product(rows: DataFrame, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, float, int]:
    """Sums over the sparse rows of (row)'(row q); of the rows; of their squares; and how many there are."""
    dims, width = q.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        y, total, square, n = np.zeros((dims, width)), np.zeros(dims), 0.0, 0
        for part, row, place, value in slices(batches):
            total += np.bincount(place, value, dims)
            square, n = square + float(value @ value), n + part.num_rows
            for lo in range(0, width, WIDE):
                t = dot(row, place, value, q[:, lo : lo + WIDE], part.num_rows)
                for j in range(t.shape[1]):
                    y[:, lo + j] += np.bincount(place, value * t[row, j], dims)
        out = np.column_stack([y, total])
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(dims), -1)), pa.array([*out.tolist(), [square, float(n)]], pa.list_(pa.float64()))], ["r", "values"])

    parts = rows.select("col", "i", "v").mapInArrow(run, "r long, values array<double>")
    long = parts.select("r", F.posexplode("values").alias("j", "v")).groupBy("r", "j").agg(F.sum("v").alias("v")).toPandas()  # genes times the block's width
    got = np.zeros((dims, width + 1))
    rest = np.zeros(2)
    main = long[long["r"] >= 0]
    got[main["r"].to_numpy(), main["j"].to_numpy()] = main["v"].to_numpy()
    for r in long[long["r"] < 0].itertuples():
        rest[r.j] = r.v
    return got[:, :width], got[:, width], float(rest[0]), int(rest[1])


def components(rows: DataFrame, dims: int, genes: list[str], k: int, oversample: int = 10, passes: int = 6, seed: int = 11) -> Components:
    """The first k components of sparse rows (see :func:`sparse_rows`)."""
    k, width, taken = min(k, dims), min(dims, k + oversample), 0
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.normal(size=(dims, width)))[0]
    since = 0
    while True:
        if q.shape[1] == dims:
            q = np.eye(dims)
        y, total, square, n = product(rows, q)
        taken, since = taken + 1, since + 1
        mean, free = total / max(1, n), max(1, n - 1)
        y = (y - n * np.outer(mean, mean @ q)) / free
        small = q.T @ y
        values, w = np.linalg.eigh((small + small.T) / 2)
        values, w = values[::-1], w[:, ::-1]
        u = q @ w
        residual = np.linalg.norm(y @ w - u * values, axis=0)[:k]
        if q.shape[1] == dims or (residual <= RESIDUAL * max(values[0], 0.0)).all():
            break
        basis = y
        if since > passes:
            since = 0
            basis = np.column_stack([y, rng.normal(size=(dims, min(dims, 2 * q.shape[1]) - q.shape[1])) * np.abs(y).max()])
        q = np.linalg.qr(basis)[0]
    u = u[:, :k]
    u = u * np.where(u[np.abs(u).argmax(0), np.arange(k)] < 0, -1.0, 1.0)  # the largest entry is above 0
    return Components(u, values[:k], float((square - n * (mean @ mean)) / free), genes, taken)


def projected(rows: DataFrame, zeros: np.ndarray, found: Components) -> DataFrame:
    """col, pc: each cell's whole vector, its zeros too, on the components."""
    u, kind, base = found.vectors, dict(rows.dtypes)["col"], zeros @ found.vectors

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, row, place, value in slices(batches):
            t = dot(row, place, value, u, part.num_rows) + base
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(t) + 1) * t.shape[1], pa.int32()), pa.array(t.ravel()))], ["col", "pc"])

    return rows.select("col", "i", "v").mapInArrow(run, f"col {kind}, pc array<double>")
