"""The best of blocks of scores, and rows sent to many cells in bounded pieces."""

import numpy as np
import pyarrow as pa

from phenospark.operators import neighbours, preprocess


def test_foremost_equals_a_stable_sort():
    rng = np.random.default_rng(3)
    for m, k in ((1, 3), (7, 3), (500, 5), (4096, 20)):
        for score in (rng.normal(size=(9, m)), rng.integers(0, 3, (9, m)).astype(float), np.zeros((9, m))):
            score[rng.random(score.shape) < 0.1] = -np.inf
            order = np.argsort(-score, 1, kind="stable")[:, :k]
            want = [(i, int(c)) for i, row in enumerate(order) for c in row if score[i, c] > -np.inf]
            r, c = preprocess.foremost_of(score, k)
            assert list(zip(r.tolist(), c.tolist(), strict=True)) == want


def test_assigned_rows_go_on_in_bounded_pieces():
    """A vector for each of many cells isn't put into one batch with two thousand others."""

    class Frame:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            self.run = run
            return self

    v = np.random.default_rng(0).normal(size=(2000, 3))
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(2000)), pa.array(v.tolist())], ["cell", "v"])
    got = list(neighbours.assigned(Frame(), np.random.default_rng(1).normal(size=(700, 3)), "inner", 700).run([batch]))
    assert max(b.num_rows for b in got) <= 1 << 16 and sum(b.num_rows for b in got) == 2000 * 700


def test_an_index_that_does_not_pay_is_passed_over(spark, monkeypatch):
    """Vectors without structure need most cells: then all pairs are compared, and every edge is a true one."""
    v = np.random.default_rng(4).normal(size=(400, 24))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(v)], "cell long, v array<double>")
    monkeypatch.setattr(neighbours, "search", lambda *_: 1 / 0)
    got = {(r.src, r["rank"], r.dst) for r in neighbours.approx_knn_graph(df, 5).collect()}
    assert got == {(r.src, r["rank"], r.dst) for r in preprocess.knn_graph(df, 5).collect()} and len(got) == 2000
