"""Sparse principal components against dense eigenvectors; ranks of folds on tables and arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenospark.operators import components, preprocess, selection, survival


def table(spark, m):
    rows = [(f"g{j:03d}", i, float(v)) for i, row in enumerate(m) for j, v in enumerate(row) if v]
    return spark.createDataFrame(rows, "gene string, col long, value double").repartition(3)


@pytest.mark.parametrize(("steep", "genes"), [(True, 60), (False, 60), (False, 8)])
def test_components_are_those_of_dense_cells(spark, steep, genes):
    rng = np.random.default_rng(6)
    m = rng.random((120, genes)) * (rng.random((120, genes)) < 0.2) * (np.exp(-np.arange(genes) / 3) * 50 if steep else 1)
    m[7] = 0
    zero = rng.normal(size=genes)
    names = spark.createDataFrame([(f"g{j:03d}", float(z), "x") for j, z in enumerate(zero)], "gene string, zero double, i string")
    cells = spark.range(120).withColumnRenamed("id", "col")
    rows, zeros, order = components.sparse_rows(table(spark, m), names, names, cells)
    assert rows.count() == 120 and np.allclose(zeros, zero) and max(r[0] for r in rows.select(F.size("i")).collect()) < genes
    got = components.components(rows, len(order), order, 5)
    dense = np.where(m != 0, m, zero)
    v = np.cov(dense.T)
    values, u = np.linalg.eigh(v)
    assert np.allclose(got.variances, values[::-1][:5], rtol=1e-8) and np.isclose(got.total, np.trace(v))
    assert np.abs(v @ got.vectors - got.vectors * got.variances).max() < 1e-7 * values[-1]
    pc = {r["col"]: r["pc"] for r in preprocess.pca(table(spark, m), names, 5, names, cells).collect()}
    assert np.allclose([pc[i] for i in range(120)], dense @ got.vectors, atol=1e-8)


def test_few_rows(spark):
    one = table(spark, [[1.0, 2.0, 0.0]])
    names = spark.createDataFrame([("g000",), ("g001",), ("g002",), ("other",)], "gene string")
    got = preprocess.pca(one, names, 2).collect()
    assert len(got) == 1 and len(got[0]["pc"]) == 2
    assert preprocess.pca(one.where("false"), names, 2).count() == 0 and preprocess.pca(one, names.where("false"), 2).count() == 0


def test_ranks_of_folds(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.integers(1, 9)), int(rng.integers(0, 2))) for i in range(40)]
    people = selection.hashed_folds(spark.createDataFrame(rows, "col long, time double, status int"), 4).cache()
    frame = people.orderBy("col").toPandas()
    got = {(r.fold, r.col): r.s for r in selection.fold_weights(people, 4).collect()}
    assert len(got) == 120
    for f in range(1, 5):
        train = frame[frame["fold"] != f]
        alone = {r.col: 1 - r["rank"] for r in survival.guanrank(people.where(F.col("fold") != f)).collect()}
        for c, s in zip(train["col"], selection.train_s(frame, f), strict=True):
            assert abs(got[f, c] - s) < 1e-12 and abs(alone[c] - s) < 1e-12
