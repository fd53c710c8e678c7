"""Dip tests over partitions against those of whole factors."""

import numpy as np
import pytest

from phenospark.operators import modules


def loadings(spark, n=900):
    rng = np.random.default_rng(7)
    two = np.where(rng.random(n) < 0.6, rng.normal(0, 1, n), rng.normal(7, 1, n))
    h = np.stack([two, rng.normal(size=n), np.round(two), np.ones(n), rng.random(n) ** 3], 1)
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(h)]
    return h, spark.createDataFrame([*rows, (n, [float("nan")] * 5), (n + 1, [None] * 5)], "cell long, h array<double>").repartition(5)


@pytest.mark.parametrize("points", [100_000, 60])
def test_dips_of_all_factors(spark, points):
    """Few points decide as all do, since those that aren't sure are looked at again."""
    h, df = loadings(spark)
    got = modules.dips(modules.long_h(df), points, 2)
    assert got == {j + 1: modules.dip_p_value(h[:, j]) < 0.05 for j in range(5)} and got[1] and not got[2]


def test_thinned_dip_is_within_its_bound():
    rng = np.random.default_rng(8)
    for v in (np.sort(rng.random(2000)), np.sort(np.concatenate([rng.normal(size=800), rng.normal(6, 1, 1200)]).round(1))):
        whole = modules.dip_statistic(v)
        for step in (1, 3, 50):
            rank = np.unique(np.concatenate([[1], np.arange(step, 2001, step), [2000]]))
            counts = np.diff(rank, prepend=0)
            assert abs(modules.dip_statistic(v[rank - 1], counts) - whole) <= (counts.max() - 1) / 2000 + 1e-12


def test_cuts(spark):
    h, df = loadings(spark)
    cut = {r.factor: r.antimode for r in modules.antimodes(modules.long_h(df)).collect()}
    assert 2 not in cut and 2 < cut[1] < 5 and abs(cut[1] - modules.antimode(h[:, 0])) < 0.02
    found = {(r.factor, r.cell) for r in modules.find_module(df, 2.0, dip=True).collect()}
    assert {c for f, c in found if f == 1} == set(np.flatnonzero(h[:, 0] > cut[1]).tolist())
    plain = {(r.factor, r.cell) for r in modules.find_module(df, 2.0).collect()}
    # a NaN makes the mean of a factor NaN, as before: without a second mode nothing is selected then
    assert {c for f, c in found if f == 2} == {c for f, c in plain if f == 2}
    subset = {r.cell for r in modules.find_subset(df, 1, dip=True).where("subset1 = 'selected'").collect()}
    assert set(np.flatnonzero(h[:, 0] > cut[1]).tolist()) <= subset
    assert modules.find_module(df.where("cell < 0"), 2.0, dip=True).count() == 0
