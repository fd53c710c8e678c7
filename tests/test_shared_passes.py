"""A choice of the rank on an X that no task can hold reads it for several ranks at once."""

import numpy as np
import pytest

from phenospark.operators import factorise, many, selection


def counted(monkeypatch) -> list:
    made = []
    monkeypatch.setattr(factorise, "LOCAL_ENTRIES", 10)
    monkeypatch.setattr(many, "_passed", lambda *a, f=many._passed: made.append(1) or f(*a))
    return made


def frame_of(spark, x: np.ndarray):
    return spark.createDataFrame([(i, x[:, i].tolist()) for i in range(x.shape[1])], "cell long, x array<double>").repartition(3)


def losses(choice) -> list:
    return [(r.k, r.repeat, pytest.approx(r.loss, rel=1e-9)) for r in choice.losses.orderBy("k", "repeat").collect()]


def test_ranks_share_passes(spark, monkeypatch):
    frame = frame_of(spark, np.random.default_rng(5).random((10, 60)))
    near = selection.select_k(frame, 5, 2, 4)
    made = counted(monkeypatch)
    far = selection.select_k(frame, 5, 2, 4)
    assert len(made) == 4 and far.selected == near.selected and losses(far) == losses(near)


@pytest.mark.parametrize("most", [7, 128])
def test_ranks_beyond_the_end_do_not_count(spark, monkeypatch, most):
    """X of rank 2: the search ends before the last rank, whichever ranks were fitted beside."""
    rng = np.random.default_rng(6)
    frame = frame_of(spark, rng.random((10, 2)) @ rng.random((2, 60)))
    near = selection.select_k(frame, 8, 1, 60)
    counted(monkeypatch)
    monkeypatch.setattr(selection, "FACTORS", most)
    far = selection.select_k(frame, 8, 1, 60)
    assert near.losses.agg({"k": "max"}).first()[0] < 8
    assert far.selected == near.selected and losses(far) == losses(near)


def test_ranks_are_grouped_by_their_factors():
    assert selection.grouped_ranks(list(range(2, 9)), 3, 12_000) == [list(range(2, 9))]
    assert selection.grouped_ranks(list(range(2, 9)), 3, 72_000) == [[2, 3, 4], [5], [6], [7], [8]]
    assert selection.grouped_ranks([2, 3], 10, 10**9) == [[2], [3]]
