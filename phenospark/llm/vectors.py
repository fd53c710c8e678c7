"""Blocks of vectors, and the join of query blocks with candidate blocks.

Vectors travel as packed blocks of bounded size, so a tile (one query block, one
candidate block) is one row, and the join is an equi-join on the tile's two
numbers. Vectors that are null or hold null, NaN or infinite components are left
out; vectors of different lengths count as if the shorter were filled with 0.

Of many rows with one vector only those of the least ids can be among a query's
best: the rest tie with them and have larger ids. :func:`foremost` keeps these,
and its limit is applied before any shuffle, so a vector that a third of all rows
share is a few rows from there on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PACKED = "block int, ids binary, dims int, data binary"


def clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v array<double> of the usable vectors."""
    v = F.col(vector_col)
    usable = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) != float("inf")), F.lit(False)))
    return vectors.where(usable).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"))


def foremost(vectors: DataFrame, k: int) -> DataFrame:
    """The rows of the k + 1 least ids of each vector; one of them may be the query's own.

    Rows with one id and one vector count once. Vectors are looked at by 128 bits
    first, and only where some repeat beyond the limit are they dealt themselves.
    """
    keys = vectors.select("id", F.xxhash64("v").alias("a"), F.xxhash64(F.lit(1), "v").alias("b"))
    rows = keys.groupBy("a", "b", "id").agg(F.count("*").alias("n"))
    if rows.groupBy("a", "b").agg(F.count("*").alias("ids"), F.max("n").alias("n")).where((F.col("ids") > k + 1) | (F.col("n") > 1)).isEmpty():
        return vectors
    rank = F.dense_rank().over(Window.partitionBy("v").orderBy("id"))
    return vectors.distinct().withColumn("place", rank).where(F.col("place") <= k + 1).select("id", "v")


def matrix_of(lists: pa.ListArray) -> np.ndarray:
    """Lists as the rows of a matrix, the shorter ones filled with 0."""
    sizes = np.diff(np.asarray(lists.offsets))
    dims = int(sizes.max(initial=0))
    flat = np.asarray(lists.flatten())
    if (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    matrix = np.zeros((len(sizes), dims))
    matrix[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return matrix


def numbers(ids: pa.Array) -> np.ndarray:
    """Ids, or structs of several numbers as the rows of a matrix."""
    return np.stack([np.asarray(x) for x in ids.flatten()], 1) if pa.types.is_struct(ids.type) else np.asarray(ids)


def pack(vectors: DataFrame, rows: int, blocks: int, encode: Callable[[np.ndarray], bytes]) -> DataFrame:
    """Blocks of about ``rows`` vectors, numbered from 0; several packed rows may share a number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                matrix = matrix_of(part.column(2))
                number = part.column(0)[0].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([numbers(part.column(1)).tobytes()], pa.binary()), pa.array([matrix.shape[1]], pa.int32()), pa.array([encode(matrix)], pa.binary())], ["block", "ids", "dims", "data"])

    dealt = vectors.repartition(blocks)
    return dealt.select(F.spark_partition_id().alias("block"), "id", "v").mapInArrow(run, PACKED)


def tiles(queries: DataFrame, candidates: DataFrame, rows: int, encode: Callable[[np.ndarray], bytes]) -> DataFrame:
    """One row for each query block and candidate block: q_* and c_*; encode: a matrix as it travels."""
    n_q, n_c = (max(1, -(-x.count() // rows)) for x in (queries, candidates))
    q = pack(queries, rows, n_q, encode).select(F.col("block").alias("qb"), *(F.col(c).alias(f"q_{c}") for c in ("ids", "dims", "data")), F.explode(F.sequence(F.lit(0), F.lit(n_c - 1))).alias("cb"))
    c = pack(candidates, rows, n_c, encode).select(F.col("block").alias("cb"), *(F.col(c).alias(f"c_{c}") for c in ("ids", "dims", "data")), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("qb"))
    return q.hint("shuffle_merge").join(c, ["qb", "cb"]).drop("qb", "cb")


def widened(matrix: np.ndarray, width: int) -> np.ndarray:
    return np.pad(matrix, ((0, 0), (0, width - matrix.shape[1]))) if matrix.shape[1] < width else matrix
