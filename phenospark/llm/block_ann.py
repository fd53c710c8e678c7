"""Nearest neighbours by a block matrix join (operator 5).

Each vector is quantised once, to int8 steps of its own scale, and travels as
these steps, the scale, its square and the norm of its rounding error; originals
stay where they are. A tile's product of int8 matrices gives all its inner
products at once, up to a bound that follows from the two vectors' errors; so each
squared distance lies in a known interval. (The steps are multiplied as single
floats, which hold such sums exactly; NumPy has no fast product of bytes.) A pair
survives if its lower end doesn't exceed the k-th smallest upper end of its query,
in its tile and then over all tiles. The originals of the survivors' rows are
joined by row number, distances are computed again in double precision, and each
query keeps its nearest k in a heap. The bounds hold for every pair, so nothing
near is lost.

Ties go to the smaller id. Rows with the query's id are its own and are left
out; repeated rows of an id and a vector count once, and an id with several vectors
is a query with each and may be found with each. Null, zero or non-finite vectors
take no part. Fewer candidates than k: all. Empty table: no rows. Extra columns are
not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenospark.llm.common import written
from phenospark.llm.vectors import clean, foremost, matrix_of, tiles, widened

BLOCK, RUN, QUERIES = 8192, 2048, 256


def quantised(m: np.ndarray) -> bytes:
    """The rows' scales, squares and errors, then their int8 steps.

    A row whose square isn't a finite double has scale 0 and no bound.
    """
    scale = np.abs(m).max(1, initial=0) / 127
    with np.errstate(over="ignore"):
        square = (m**2).sum(1)
    bounded = np.isfinite(square) & (square > 1e-280)
    safe = np.where(scale > 0, scale, 1)
    steps = np.where(bounded[:, None], np.rint(m / safe[:, None]), 0).astype(np.int8)
    with np.errstate(over="ignore", invalid="ignore"):
        error = np.sqrt(((m - steps * safe[:, None]) ** 2).sum(1))
    return np.stack([np.where(bounded, scale, 0), square, np.where(bounded, error, np.inf)]).tobytes() + steps.tobytes()


def unquantised(raw: bytes, rows: int, dims: int) -> tuple[np.ndarray, np.ndarray]:
    """(scale, square, error) x rows, and the steps."""
    return np.frombuffer(raw, np.float64, 3 * rows).reshape(3, rows), np.frombuffer(raw, np.int8, offset=24 * rows).reshape(rows, dims)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distance of paired rows, summed component by component."""
    total = np.zeros(len(a))
    with np.errstate(over="ignore"):
        for j in range(a.shape[1]):
            d = a[:, j] - b[:, j]
            total += d * d
    return np.sqrt(total)


def tile_survivors(q: tuple, q_ids: np.ndarray, c: tuple, c_ids: np.ndarray, k: int):
    """(query place, candidate place, lower, upper) of the pairs that can be among a query's k nearest of the tile."""
    (q_scale, q_square, q_err), q8 = q
    kind = np.float32 if q8.shape[1] <= 1000 else np.float64  # exact for products of int8
    q_tile = q8.astype(kind)
    upper = np.full((len(q_ids), k), np.inf)  # the k smallest upper ends of each query
    kept: list[tuple[np.ndarray, ...]] = []
    for lo in range(0, len(c_ids), RUN):
        ids = c_ids[lo : lo + RUN]
        (c_scale, c_square, c_err), c8 = c[0][:, lo : lo + RUN], c[1][lo : lo + RUN]
        with np.errstate(invalid="ignore", over="ignore"):
            product = (q_tile @ c8.astype(kind).T).astype(np.float64) * (q_scale[:, None] * c_scale[None, :])
            # q.c = q'.c' + q'.(c - c') + (q - q').c, and |q'| <= |q| + |q - q'|
            error = (np.sqrt(q_square) + q_err)[:, None] * c_err[None, :] + q_err[:, None] * np.sqrt(c_square)[None, :]
            size = q_square[:, None] + c_square[None, :]
            middle, reach = size - 2 * product, 2 * error + 1e-9 * size
            low, high = middle - reach, middle + reach
        unknown = ~np.isfinite(middle) | ~np.isfinite(reach)
        low[unknown], high[unknown] = -np.inf, np.inf
        own = q_ids[:, None] == ids[None, :]
        high[own] = np.inf
        most = min(k, high.shape[1])
        upper = np.sort(np.concatenate([upper, np.partition(high, most - 1, 1)[:, :most]], 1), 1)[:, :k]
        at, row = np.nonzero((low <= upper[:, -1:]) & ~own)
        kept.append((at, lo + row, low[at, row], high[at, row]))
    at, row, low, high = (np.concatenate(x) for x in zip(*kept, strict=True)) if kept else (np.zeros(0, int),) * 4
    still = low <= upper[at, -1]
    return at[still], row[still], low[still], high[still]


def survivors(queries: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """q, c (row numbers), low, high of the pairs that can be among a query's nearest k; q and c: id, v, key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                ids = {s: np.frombuffer(t[f"{s}_ids"], np.int64).reshape(-1, 2) for s in "qc"}
                width = max(t["q_dims"], t["c_dims"])
                sides = {s: unquantised(t[f"{s}_data"], len(ids[s]), t[f"{s}_dims"]) for s in "qc"}
                sides = {s: (m, widened(steps, width)) for s, (m, steps) in sides.items()}
                for lo in range(0, len(ids["q"]), QUERIES):
                    some = slice(lo, lo + QUERIES)
                    at, row, low, high = tile_survivors((sides["q"][0][:, some], sides["q"][1][some]), ids["q"][some, 0], sides["c"], ids["c"][:, 0], k)
                    yield pa.RecordBatch.from_arrays([pa.array(ids["q"][some, 1][at]), pa.array(ids["c"][row, 1]), pa.array(low), pa.array(high)], ["q", "c", "low", "high"])

    # the packed id is a pair: the row's id and its number
    pairs = [t.select(F.struct("id", "key").alias("id"), "v") for t in (queries, candidates)]
    found = tiles(*pairs, BLOCK, quantised).mapInArrow(run, "q long, c long, low double, high double")
    near, own = Window.partitionBy("q").orderBy("high"), Window.partitionBy("q")
    # the k-th smallest upper end; a query with fewer than k pairs keeps all
    placed = found.withColumn("place", F.row_number().over(near))
    limit = F.when(F.count("*").over(own) >= k, F.max(F.when(F.col("place") <= k, F.col("high"))).over(own)).otherwise(F.lit(float("inf")))
    return placed.withColumn("limit", limit).where(F.col("low") <= F.col("limit")).select("q", "c")


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """query_id, rank, vec_id, score of each query's nearest k; pairs: query_id, vec_id, q, c (vectors).

    A task keeps a heap of k for each of its queries, and so does the merge: a
    query's pairs are those of its tiles' survivors.
    """

    def heaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, list[tuple[float, int]]] = {}
        for b in batches:
            q, c = (matrix_of(b.column(b.schema.get_field_index(x))) for x in ("q", "c"))
            width = max(q.shape[1], c.shape[1])
            score = distance(widened(q, width), widened(c, width)).tolist()
            for i, n, d in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), score, strict=True):
                heap = best.setdefault(i, [])
                # the heap's first is its farthest, with the largest id
                if len(heap) < k:
                    heapq.heappush(heap, (-d, -n))
                elif (-d, -n) > heap[0]:
                    heapq.heapreplace(heap, (-d, -n))
        if best:
            rows = [(i, -n, -d) for i, heap in best.items() for d, n in heap]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*rows, strict=True)], ["query_id", "vec_id", "score"])

    found = pairs.select("query_id", "vec_id", "q", "c").mapInArrow(heaps, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(embeddings: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score of each query's nearest k."""
    vectors = clean(embeddings, "vec_id", "embedding").where(F.exists("v", lambda x: x != 0))
    # written: the rows are numbered once
    numbered = written(foremost(vectors, k).withColumn("key", F.monotonically_increasing_id() * 2), "candidates")
    queries = written(vectors.where(F.col("id") % every == 0).distinct().withColumn("key", F.monotonically_increasing_id() * 2 + 1), "queries")
    pairs = survivors(queries, numbered, k)
    q = queries.select(F.col("key").alias("q"), F.col("id").alias("query_id"), F.col("v").alias("qv"))
    c = numbered.select(F.col("key").alias("c"), F.col("id").alias("vec_id"), F.col("v").alias("cv"))
    joined = pairs.join(q, "q").join(c, "c").select("query_id", "vec_id", F.col("qv").alias("q"), F.col("cv").alias("c"))
    return nearest(joined, k)
