"""Graph products with cells that most edges read."""

import numpy as np
from pyspark.sql import functions as F

from phenospark.operators import factorise, graph


def star(spark, n=400):
    """Every cell has an edge to and from cell 0, and to the next one."""
    pairs = [(i, 0, 0.5 + i / n) for i in range(1, n)] + [(0, i, 0.25) for i in range(1, n)] + [(i, i % (n - 1) + 1, 1.0) for i in range(1, n)]
    h = np.random.default_rng(1).random((n, 3))
    frame = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(h)], "cell long, h array<double>")
    a = np.zeros((n, n))
    for s, d, w in pairs:
        a[s, d] += w
    return spark.createDataFrame(pairs, "src long, dst long, w double").repartition(4), frame, a @ h, h


def test_product_of_a_star_in_blocks_of_a_bounded_size(spark):
    edges, h, want, _ = star(spark)
    laid = graph.Edges(edges, hub=50)
    try:
        assert [r.dst for r in laid.hubs.collect()] == [0]
        sizes = [r["count"] for r in laid.heavy.groupBy("dst", "block").count().collect()]
        assert len(sizes) == 8 and max(sizes) < 2 * 50 and laid.light.read().groupBy("dst").count().agg(F.max("count")).first()[0] <= 50
        got = np.zeros_like(want)
        for r in laid.product(h, 3).collect():
            got[r.cell] = r.g
        assert np.allclose(got, want)
    finally:
        laid.drop()


def test_fit_with_hubs_is_that_without_blocks(spark, monkeypatch):
    edges, h, _, _ = star(spark, 60)
    rng = np.random.default_rng(2)
    x = spark.createDataFrame([(i, rng.random(5).tolist()) for i in range(60)], "cell long, x array<double>")
    d = spark.createDataFrame([(i, 1.0) for i in range(60)], "cell long, d double")
    fits = []
    for hub in (1_000_000, 9):
        monkeypatch.setattr(graph, "HUB", hub)
        fits.append(factorise.fit(x, 3, None, edges, d, 0.0, 0.05, 4, 0.0, h0=h))
    assert np.allclose(fits[0].w, fits[1].w) and np.isclose(fits[0].loss, fits[1].loss)
