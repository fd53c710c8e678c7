"""Operator 12 against NumPy's eigenvectors of the exact covariance, on flat and steep spectra and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenospark.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, label int, id string, n string, v string"


def table(spark, vectors, ids=None):
    return spark.createDataFrame([(i, v, 1, "x", "y", "z") for i, v in zip(ids or range(len(vectors)), vectors, strict=True)], SCHEMA).repartition(3)


def brute(vectors, dims):
    x = np.array([[int(np.floor(1024 * float(np.float32(c)))) + 100_000 for c in list(v) + [0] * (dims - len(v))] for v in vectors])
    n, s = len(x), x.sum(0)
    c = (n * x - s) / n
    values, u = np.linalg.eigh(c.T @ c / n)
    return [sum(int(e) ** 2 for e in row) for row in n * x - s], c, values[::-1], u[:, ::-1]


@pytest.mark.parametrize(("dims", "steep", "expanded"), [(40, 2.0, False), (40, 0.01, True), (6, 1.0, False)])
def test_components_are_eigenvectors(spark, dims, steep, expanded):
    rng = np.random.default_rng(3)
    vectors = (rng.normal(size=(400, dims)) * np.exp(-steep * np.arange(dims) / 2) + rng.normal(size=dims)).astype(np.float32).tolist()
    odd = [None, [1.0, None] * (dims // 2), [float("nan")] * dims, [float("inf")] + [0.0] * (dims - 1)]
    df = table(spark, vectors[:-1] + [[0.5], vectors[0]] + odd, [*range(400), None, *range(500, 504)])
    used = vectors[:-1] + [[0.5], vectors[0]]
    deviation, c, values, u = brute(used, dims)
    assert whitening.fit(df).expanded == expanded
    got = whitening.whiten(df).orderBy("component", F.col("vec_id").asc_nulls_last()).toPandas()
    k = min(8, dims)
    assert len(got) == len(used) * k and set(got["n"]) == {len(used)}
    assert got["identity_error"].nunique() == 1 and got["identity_error"][0] < 1e-4
    for j in range(k):
        part = got[got["component"] == j + 1]
        assert part["deviation"].tolist() == deviation
        assert abs(part["explained"].iloc[0] / (values[j] / values.sum()) - 1) < 1e-9
        want = c @ u[:, j] / np.sqrt(values[j])
        own = part["whitened"].to_numpy()
        assert np.abs(own * np.sign(own @ want) - want).max() < 1e-6


def test_constant_few_and_empty(spark):
    assert whitening.whiten(table(spark, [])).count() == 0
    assert whitening.whiten(table(spark, [None, []])).count() == 0
    got = whitening.whiten(table(spark, [[1.0, 2.0, 3.0]] * 5)).toPandas()
    assert len(got) == 15 and got["whitened"].isna().all() and (got["deviation"] == 0).all() and (got["identity_error"] == 0).all()
    two = whitening.whiten(table(spark, [[1.0, 2.0, 3.0], [2.0, 1.0, 3.0]])).toPandas()
    assert np.allclose(two[two["component"] == 1]["whitened"].abs(), 1) and two[two["component"] > 1]["whitened"].isna().all()


def test_large_entries(spark):
    got = whitening.whiten(table(spark, [[2.0**30, 0.0], [-(2.0**30), 1.0]])).toPandas()
    x = [2**40 + 100_000, -(2**40) + 100_000]
    want = sum((2 * v - sum(x)) ** 2 for v in x[:1]) + 1024**2
    assert want > 2**63 and got["deviation"].isna().all()
    with pytest.raises(Exception, match="too large"):
        whitening.whiten(table(spark, [[2.0**43, 0.0]])).collect()


def test_tasks_add_up(spark):
    vectors = np.random.default_rng(1).normal(size=(300, 100)).tolist()
    one, many = (whitening.fit(table(spark, vectors).repartition(n)) for n in (1, 7))
    assert one.centre == many.centre and np.allclose(one.components, many.components, atol=1e-9) and one.expanded
