"""Graphs of neighbours are of all vectors of the table, bulk samples of other queries among them."""

import numpy as np
import pytest

from phenospark.plans.queries import QUERIES

N = 130


@pytest.fixture(scope="module")
def v():
    return np.random.default_rng(8).normal(size=(N, 64)).astype(np.float32).astype(float)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory, v):
    path = tmp_path_factory.mktemp("vectors")
    rows = [(i, [float(x) for x in row], i % 10) for i, row in enumerate(v)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


def nearest(v: np.ndarray, k: int) -> np.ndarray:
    """Each row's k best others by inner product."""
    score = v @ v.T
    np.fill_diagonal(score, -np.inf)
    return np.argsort(-score, 1, kind="stable")[:, :k]


def test_approx_knn_graph(spark, folder, v):
    got = QUERIES["approx_knn_graph"](spark, folder).collect()
    assert {r.src for r in got} == {r.dst for r in got} | set(range(N)) == set(range(N)) and len(got) == 20 * N
    true = {(i, int(j)) for i, row in enumerate(nearest(v, 20)) for j in row}
    assert len(true & {(r.src, r.dst) for r in got}) >= 0.9 * len(true)


def test_knn_graph(spark, folder, v):
    got = {(r.src, r["rank"], r.dst) for r in QUERIES["knn_graph"](spark, folder).collect()}
    assert got == {(i, at, int(j)) for i, row in enumerate(nearest(v, 20)) for at, j in enumerate(row, 1)}


def test_snn_graph(spark, folder, v):
    own = [{i, *map(int, row)} for i, row in enumerate(nearest(v, 20))]
    jaccard = {(i, j): len(own[i] & own[j]) / len(own[i] | own[j]) for i in range(N) for j in range(N) if i != j}
    got = {(r.src, r.dst): r.w for r in QUERIES["snn_graph"](spark, folder).collect()}
    assert got == pytest.approx({pair: w for pair, w in jaccard.items() if w >= 1 / 15}, abs=1e-6)


def test_graph_symmetry(spark, folder, v):
    a = np.zeros((N, N))
    a[np.repeat(np.arange(N), 5), nearest(v, 5).ravel()] = 1
    (got,) = QUERIES["graph_symmetry"](spark, folder).collect()
    assert got.sym_fro == pytest.approx(np.linalg.norm(a - a.T), abs=1e-6) and not got.is_symmetric


def test_graph_quadratic(spark, folder, v):
    a = np.zeros((N, N))
    a[np.repeat(np.arange(N), 5), nearest(v, 5).ravel()] = 1
    a = np.maximum(a, a.T)
    a /= np.sqrt(np.outer(a.sum(1), a.sum(0)))
    h = (((np.arange(N) * 31)[None, :] + (np.arange(3) * 17)[:, None]) % 97 + 1) / 98
    assert QUERIES["graph_quadratic"](spark, folder).first().quadratic == pytest.approx((h * (h @ a.T)).sum(), abs=1e-6)
