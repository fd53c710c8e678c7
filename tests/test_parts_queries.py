"""Queries whose X has more samples than genes never make its rows: what they shuffle and write grows as the vectors do."""

import numpy as np
import pytest

from phenospark.functions import expression as ex
from phenospark.plans.queries import QUERIES


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, rng = tmp_path_factory.mktemp("vectors"), np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=64)], i % 10) for i in range(700)]  # 70 samples, 56 genes
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.mark.parametrize(("name", "rows"), [("clamped_steps", 3 * 700), ("x_difference", 1), ("gram_h", 9), ("project_w", 3 * 70), ("xht", 3 * 70)])
def test_no_row_of_x_is_made_for_a_table(spark, folder, monkeypatch, name, rows):
    def no_rows(self):
        raise AssertionError("rows of X")

    monkeypatch.setattr(ex.Similarity, "frame", no_rows)
    monkeypatch.setattr(ex.Similarity, "panels", no_rows)
    assert QUERIES[name](spark, folder).count() == rows
