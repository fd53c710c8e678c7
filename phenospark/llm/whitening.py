"""Embedding whitening by a randomised range finder (operator 12).

Entries become whole numbers x = floor(1024 c) + 100000, so sums are exact. The range
finder starts from a random block Q of k + oversample columns. A pass over all rows
gives Y = VQ, the product with the covariance V of the centred rows, as sums of
(row)'(row Q): each task adds up its own rows in blocks of bounded size, Spark adds the
tasks' sums by row and column block of Y, and the driver gets Y alone, whose size
depends on the dimensions and never on the rows. The Rayleigh-Ritz step takes the
eigenvectors of Q'Y for the components; their residuals need no further pass, as
VU = YW. While residuals, also measured against the gaps between the eigenvalues,
aren't small, Q becomes the orthonormal basis of Y: a power pass. If ``passes`` of them
don't bring the residuals down (a flat spectrum), the block is expanded to the full
dimension, Q = I, where one pass gives V itself and Ritz vectors are eigenvectors.

A last pass takes the covariance of the whitened rows, which gives ``identity_error``.

Rows with a vector that is null or holds null or non-finite entries are left out.
Vectors of different lengths count as if the shorter were filled with 0, an empty
vector too. Repeated rows count as often as they are there, a null vec_id is an id
like others. Equal eigenvalues: any basis of their space. A component whose eigenvalue
is 0 by the precision of doubles (fewer rows than components, constant entries) has a
null whitened value and no part in identity_error. A deviation beyond a long is null;
an entry beyond 2^52 / 1024 is an error, as x isn't exact there. Empty table, or
vectors without entries alone: no rows. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: x = floor(SCALE c) + SHIFT.
SCALE, SHIFT = 1024.0, 100_000
#: Entries of a block of rows, and columns of Y in one row on its way to the driver.
BLOCK, WIDE = 1 << 20, 64
#: Largest residual, relative to the largest eigenvalue and to the gap to the nearest one.
RESIDUAL, TURN = 1e-12, 1e-10
LONG = 2**63 - 1


def whole_rows(vectors: pa.Array, dims: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of the usable rows, and their whole numbers as a matrix of ``dims`` columns (or as many as needed)."""
    sizes = np.asarray(pc.fill_null(pc.list_value_length(vectors), 0), np.int64)
    flat = vectors.flatten().to_numpy(zero_copy_only=False)  # a null entry is a NaN here
    row = np.repeat(np.arange(len(sizes)), sizes)
    fine = np.asarray(vectors.is_valid()) & (np.bincount(row, ~np.isfinite(flat), len(sizes)) == 0)
    used = fine[row]
    x = np.floor(flat[used] * SCALE)
    if len(x) and np.abs(x).max() >= 2.0**52:
        raise ValueError("an entry is too large for whole numbers")
    keep = np.flatnonzero(fine)
    out = np.full((len(keep), int(sizes[keep].max(initial=0)) if dims is None else dims), SHIFT, np.int64)
    begin = np.cumsum(sizes) - sizes
    out[np.repeat(np.arange(len(keep)), sizes[keep]), (np.arange(len(flat)) - begin[row])[used]] = x.astype(np.int64) + SHIFT
    return keep, out


def blocks(batches: Iterator[pa.RecordBatch], dims: int, column: int = 0) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with the places and whole numbers of their usable rows."""
    step = max(1, BLOCK // max(1, dims))
    for batch in batches:
        for lo in range(0, batch.num_rows, step):
            part = batch.slice(lo, step)
            yield part, *whole_rows(part.column(column), dims)


@dataclass
class Centre:
    """Rows n, and the exact sums S of each dimension."""

    n: int
    sums: list[int]

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, the whole part taken off before any rounding."""
        base = np.array([s // self.n for s in self.sums], np.int64)
        rest = np.array([(s % self.n) / self.n for s in self.sums])
        return (x - base) - rest

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """The exact sum of (n x - S)^2 of each row; None beyond a long."""
        most = self.n * int(np.abs(x).max(initial=0)) + max((abs(s) for s in self.sums), default=0)
        kind = np.int64 if most < LONG else object
        off = self.n * x.astype(kind) - np.array(self.sums, kind)
        if kind is object or len(self.sums) * int(np.abs(off).max(initial=0)) ** 2 > LONG:
            off = off.astype(object)
        return [int(d) if d <= LONG else None for d in (off * off).sum(1)]


@dataclass
class Whitening:
    """The centre, unit components as columns, their eigenvalues, V's trace; passes taken, and whether the block was expanded."""

    centre: Centre
    components: np.ndarray
    values: np.ndarray
    trace: float
    passes: int
    expanded: bool

    @property
    def filled(self) -> np.ndarray:
        """Whether a component has an eigenvalue that doubles tell from 0."""
        return self.values > max(self.trace, 0.0) * len(self.components) * 2.0**-52

    def whitened(self, x: np.ndarray) -> np.ndarray:
        scale = np.where(self.filled, np.sqrt(np.where(self.filled, self.values, 1.0)), np.nan)
        return self.centre.centred(x) @ self.components / scale


def added(vectors: DataFrame, width: int, sums: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum over tasks of a matrix of ``width`` columns; Spark adds pieces by row and column block."""
    some = min(WIDE, width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sums(batches)
        m = np.pad(m, ((0, 0), (0, -m.shape[1] % some)))
        pieces = m.reshape(len(m), -1, some)
        at = np.indices(pieces.shape[:2]).reshape(2, -1)
        yield pa.RecordBatch.from_arrays([pa.array(at[0]), pa.array(at[1]), *(pa.array(np.ascontiguousarray(pieces[:, :, j]).ravel()) for j in range(some))], ["r", "b", *(f"v{j}" for j in range(some))])

    tasks = vectors.mapInArrow(run, ", ".join(["r long", "b long", *(f"v{j} double" for j in range(some))]))
    rows = tasks.groupBy("r", "b").agg(*(F.sum(f"v{j}").alias(f"v{j}") for j in range(some))).toPandas()  # a matrix of dims rows
    out = np.zeros((int(rows["r"].max()) + 1, (int(rows["b"].max()) + 1) * some))
    for (r, b), values in zip(rows[["r", "b"]].to_numpy(), rows[[f"v{j}" for j in range(some)]].to_numpy(), strict=True):
        out[r, b * some : (b + 1) * some] = values
    return out[:, :width]


def centre_of(vectors: DataFrame) -> Centre:
    """One pass: how many usable rows, and exact sums of their whole numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(0, np.int64)
        for batch in batches:
            for lo in range(0, batch.num_rows, 1 << 14):
                keep, x = whole_rows(batch.slice(lo, 1 << 14).column(0))
                n += len(keep)
                total = np.pad(total, (0, max(0, x.shape[1] - len(total))))
                total[: x.shape[1]] += (x - SHIFT).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total))), pa.array(np.append(n, total).astype(np.int64))], ["i", "total"])

    rows = vectors.mapInArrow(run, "i long, total long").groupBy("i").agg(F.sum("total").alias("total")).collect()  # a row for each dimension
    got = {r.i: r.total for r in rows}
    n = got.pop(-1, 0)
    return Centre(n, [got[i] + SHIFT * n for i in sorted(got)])


def covariance_times(vectors: DataFrame, centre: Centre, q: np.ndarray) -> tuple[np.ndarray, float]:
    """VQ, and V's trace, in one pass over all centred rows."""
    dims, width = q.shape

    def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        y = np.zeros((dims, width + 1))
        for _, _, x in blocks(batches, dims):
            c = centre.centred(x)
            y[:, :width] += c.T @ (c @ q)
            y[:, width] += (c * c).sum(0)
        return y

    got = added(vectors, width + 1, sums) / centre.n
    return got[:, :width], float(got[:, width].sum())


def settled(values: np.ndarray, residuals: np.ndarray, k: int) -> bool:
    """Whether the first k Ritz pairs are eigenpairs, judged by residuals against the size and the gaps."""
    if not values[0] > 0:
        return True
    gaps = np.abs(np.diff(values))
    near = np.minimum(np.append(np.inf, gaps)[:k], np.append(gaps, np.inf)[:k])
    return bool((residuals[:k] <= RESIDUAL * values[0]).all() and (residuals[:k] <= TURN * near).all())


def fit(embeddings: DataFrame, k: int = 8, oversample: int = 8, passes: int = 4, seed: int = 12, vector_col: str = "embedding") -> Whitening | None:
    """The first k components of all usable vectors; None where there are none."""
    vectors = embeddings.select(F.col(vector_col).cast("array<double>").alias("v"))
    centre = centre_of(vectors)
    dims = len(centre.sums)
    if not centre.n or not dims:
        return None
    width, taken = k + oversample, 0
    # the full dimension at once where the block has it anyway
    q = np.linalg.qr(np.random.default_rng(seed).normal(size=(dims, width)))[0] if width < dims else np.eye(dims)
    while True:
        y, trace = covariance_times(vectors, centre, q)
        taken += 1
        small = q.T @ y
        values, w = np.linalg.eigh((small + small.T) / 2)
        values, w = values[::-1], w[:, ::-1]
        full, u = q.shape[1] == dims, q @ w
        if full or settled(values, np.linalg.norm(y @ w - u * values, axis=0), k):
            break
        q = np.linalg.qr(y)[0] if taken <= passes else np.eye(dims)
    u = u[:, : min(k, dims)]
    u = u * np.where(u[np.abs(u).argmax(0), np.arange(u.shape[1])] < 0, -1.0, 1.0)  # the largest entry is above 0
    return Whitening(centre, u, values[: u.shape[1]], trace, taken, full and width < dims)


def identity_error(embeddings: DataFrame, model: Whitening, vector_col: str = "embedding") -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity, by a pass over all rows."""
    keep, dims = np.flatnonzero(model.filled), len(model.centre.sums)
    if not len(keep):
        return 0.0

    def sums(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros((len(keep), len(keep) + 1))
        for _, _, x in blocks(batches, dims):
            w = model.whitened(x)[:, keep]
            total[:, :-1] += w.T @ w
            total[:, -1] += w.sum(0)
        return total

    got = added(embeddings.select(F.col(vector_col).cast("array<double>").alias("v")), len(keep) + 1, sums) / model.centre.n
    return float(np.abs(got[:, :-1] - np.outer(got[:, -1], got[:, -1]) - np.eye(len(keep))).max())


def transform(embeddings: DataFrame, model: Whitening, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, deviation, whitened array (NaN for a component without variance) of each usable row."""
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    dims = len(model.centre.sums)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, keep, x in blocks(batches, dims, 1):
            w = model.whitened(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep)), pa.array(model.centre.deviations(x), pa.int64()), lists], ["id", "deviation", "whitened"])

    return rows.mapInArrow(run, "id long, deviation long, whitened array<double>")


def whiten(embeddings: DataFrame, k: int = 8, oversample: int = 8, passes: int = 4) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each usable row and component."""
    model = fit(embeddings, k, oversample, passes)
    if model is None:
        return embeddings.sparkSession.createDataFrame([], "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")
    error = identity_error(embeddings, model)
    share = [float(e / model.trace) if model.trace > 0 else 0.0 for e in model.values]
    long = transform(embeddings, model).select(F.col("id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("at", "w"))
    return long.select(
        "vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.centre.n).cast("long").alias("n"), "deviation",
        F.when(~F.isnan("w"), F.col("w")).alias("whitened"), F.get(F.array(*map(F.lit, share)), F.col("at")).alias("explained"), F.lit(error).alias("identity_error"),
    )
