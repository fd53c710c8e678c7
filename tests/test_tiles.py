"""X as rows of sample, cell and value, which tasks make and round themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_parts import sides

from phenospark.functions import expression as ex
from phenospark.plans import create
from phenospark.plans.queries import QUERIES


def test_rounded_is_spark_s_round(spark):
    rng = np.random.default_rng(1)
    near = np.concatenate([np.nextafter(h, [-1, h, 9]) for h in (rng.integers(0, 10**6, 300) + 0.5) / 1e6])
    x = np.concatenate([rng.normal(size=2000), rng.normal(size=500) * 1e-6, near, [0.0, -0.0, -1e-9, 0.0000005, -0.0000005, 2.5e-6, 1 / 128, 12345678.1234565, 3e9 + 1 / 3, 1e12 + 0.7, 1e300, 5e-324]])
    x = np.concatenate([x, -x])
    got, want = ex.rounded(x, 6), np.array([r[0] for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, v double").orderBy("i").select(F.round("v", 6)).collect()])
    assert np.array_equal(got, want) and not np.signbit(got[got == 0]).any()


@pytest.mark.parametrize("sparse", [False, True])
def test_tiles_make_every_row(spark, monkeypatch, sparse):
    """Tiles of some samples and cells over several blocks; positions without a sample have no rows."""
    bulk, cells = sides(spark, genes=120, samples=11, cells=13, share=0.15)
    want = create.parts(bulk, cells).frame().collect()
    if sparse:
        monkeypatch.setattr(ex, "BLOCK_ENTRIES", 150)
    monkeypatch.setattr(ex, "TILE_SAMPLES", 3)
    monkeypatch.setattr(ex, "TILE_ENTRIES", 7)
    x = create.parts(bulk, cells)
    assert (x.blocks[0].value.dense is None) == sparse
    names = create.samples_of(bulk).where("pos <> 4").withColumn("sample", F.concat(F.lit("s"), "sample"))
    got = [(r.sample, r.cell, r.value) for r in ex.long_x(x, names, 6).collect()]
    assert len(got) == len(set(g[:2] for g in got)) == 10 * len(want)
    known = {(f"s{100 + i}", r.cell): v for r in want for i, v in enumerate(r.x) if i != 4}
    assert {g[:2]: g[2] for g in got} == pytest.approx(known, abs=5.1e-7)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path, rng = tmp_path_factory.mktemp("vectors"), np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=64)], i % 10) for i in range(700)]  # 70 samples, 56 genes
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.mark.parametrize("name", ["corr_matrix", "constant_cells", "create_x", "x_sink", "row_view", "create_x_sparse", "corr_matrix_sparse"])
def test_no_list_is_taken_apart_and_no_name_joined(spark, folder, name):
    plan = QUERIES[name](spark, "/root/testdata/sf0.001" if "sparse" in name else folder)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan and "MapInArrow" in plan


def test_a_block_of_stored_entries_is_not_copied():
    block = ex._Tile(ex.Block(3, np.zeros(2), np.zeros(2), None, np.array([0, 1, 1, 2], np.int32), np.array([0, 1], np.int32), np.ones(2)))
    assert ex._tile_of(block, np.arange(2)) is block and len(ex._tile_of(block, np.array([1])).value.zero) == 1
