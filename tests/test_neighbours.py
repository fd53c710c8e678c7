"""The cell index against all pairs: clustered and structureless vectors, copies, odd rows."""

import numpy as np
import pytest

from phenospark.operators import neighbours, preprocess


def frame(spark, x, ids=None, odd=()):
    rows = [(int(i), [float(c) for c in v], 1) for i, v in zip(range(len(x)) if ids is None else ids, x, strict=True)]
    return spark.createDataFrame([*rows, *odd], "cell long, v array<double>, part int").repartition(4)


def graph(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.src, []).append((r["rank"], r.dst, r.score))
    return {s: sorted(v) for s, v in out.items()}


def overlap(got, want):
    return sum(len({d for _, d, _ in got.get(s, [])} & {d for _, d, _ in v}) for s, v in want.items()) / sum(map(len, want.values()))


@pytest.mark.parametrize(("kind", "metric"), [("clusters", "euclidean"), ("flat", "inner")])
def test_recall_and_work(spark, kind, metric):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 8)) if kind == "flat" else rng.normal(size=(30, 8))[rng.integers(30, size=1500)] * 8 + rng.normal(size=(1500, 8)) / 4
    df = frame(spark, x)
    index = neighbours.build(df, 10, metric, recall=0.95)
    got = graph(neighbours.search(index, df, 10))
    assert set(got) == set(range(1500)) and all([r for r, _, _ in v] == list(range(1, 11)) for v in got.values())
    assert overlap(got, graph(preprocess.knn_graph(df, 10, metric=metric))) > 0.9
    if kind == "clusters":  # a few of its 39 cells are enough
        assert index.probes <= 6
    scores = {s: [c for _, _, c in v] for s, v in got.items()}
    assert all(v == sorted(v, reverse=True) for v in scores.values())


def test_all_cells_probed_is_exact(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 40)  # cells of several blocks
    rng = np.random.default_rng(4)
    x = rng.integers(-2, 3, (300, 3)).astype(float)  # ties and many copies
    x[:120] = x[0]
    df = frame(spark, x)
    index = neighbours.build(df, 5, "euclidean", parts=6)
    index.probes = 6
    assert graph(neighbours.search(index, df, 5)) == graph(preprocess.knn_graph(df, 5, metric="euclidean"))


def test_odd_rows(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 4))
    odd = [(100, None, 1), (101, [1.0, None, 2.0, 3.0], 1), (102, [float("nan")] * 4, 1), (103, [float("inf"), 0.0, 0.0, 0.0], 1), (None, [1.0] * 4, 1), (104, [2.0], 1), (0, [float(c) for c in x[0]], 1)]
    df = frame(spark, x, odd=odd)
    want = graph(preprocess.knn_graph(frame(spark, [*x, [2.0, 0, 0, 0]], [*range(60), 104]), 3))
    for got in (graph(neighbours.approx_knn_graph(df, 3, recall=1.0)), graph(preprocess.knn_graph(df.distinct(), 3))):
        assert set(got) == {*range(60), 104}
        assert overlap(got, want) > 0.9
    assert graph(preprocess.knn_graph(df.distinct(), 3)).keys() == want.keys()
    assert neighbours.approx_knn_graph(df.where("false")).count() == 0 and preprocess.knn_graph(df.where("false")).count() == 0
    assert neighbours.approx_knn_graph(df.where("cell = 5")).count() == 0
    with pytest.raises(ValueError, match="metric"):
        neighbours.build(df, metric="other")


def test_cells_are_sent_to_as_many_blocks_however_many_they_are():
    from phenospark.operators.preprocess import block_rows

    assert block_rows(100) == block_rows(40_000) == 4096
    assert all(-(-n // block_rows(n)) <= 12 for n in (50_000, 92_307, 390_000)) and block_rows(10_000_000) == 32_768
