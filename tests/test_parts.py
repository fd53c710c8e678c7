"""X as its parts: the numbers of a written X, no rows of it on disk, and little at the driver."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenospark.functions import expression as ex
from phenospark.operators import factorise, many, selection
from phenospark.plans import create, queries
from phenospark.sources import tables


def sides(spark, genes=3, samples=7, cells=9, share=1.0, seed=0):
    rng = np.random.default_rng(seed)
    rows = lambda cols, at: [(f"g{g}", int(at + c), float(rng.normal())) for c in range(cols) for g in range(genes) if rng.random() < share]
    make = lambda r: spark.createDataFrame(r, "gene string, col long, value double")
    return make(rows(samples, 100)), make(rows(cells, 0))


@pytest.mark.parametrize("clip", [False, True])
def test_fits_on_parts_equal_those_on_rows(spark, clip, monkeypatch):
    monkeypatch.setattr(ex, "SLICE_ENTRIES", 15)  # two cells at a time
    parts = create.parts(*sides(spark))
    assert parts.short and isinstance(create.kept(parts), ex.Similarity)
    parts.clip = clip
    parts = ex.normalized(parts)
    rows = tables.cut(parts.frame())
    assert abs(ex.fro_norm(rows).first()[0] - 1) < 1e-12
    w0, h0 = np.random.default_rng(1).random((7, 2)), rows.select("cell", F.array((F.col("cell") + 1) / 10.0, F.lit(0.5)).alias("h"))
    for how in ({"guard": True}, {"x_sign": "clip"}):
        one, two = (factorise.fit(x, 2, maxiter=3, threshold=0.0, w0=w0, h0=h0, **how) for x in (parts, rows))
        assert np.allclose(one.w, two.w, rtol=1e-9) and abs(one.loss - two.loss) < 1e-12
    assert np.allclose(many.square_sums(parts), many.square_sums(rows)) and np.allclose(factorise.project(parts, h0, 2), factorise.project(rows, h0, 2))
    models = [many.Model(2, w0=w0), many.Model(2, np.array([0, 2, 5]), 1.5, w0=w0[:3])]
    for one, two in zip(*(many.fit_many(x, models, maxiter=2, h0=h0, guard=True) for x in (parts, rows)), strict=True):
        assert np.allclose(one.fit.w, two.fit.w, rtol=1e-9) and np.allclose(one.xht, two.xht)
    assert all(np.array_equal(a, b) for a, b in zip(selection.local_x(parts), selection.local_x(rows), strict=True))


def test_sparse_samples_in_blocks(spark, monkeypatch):
    """Many genes of which a column has a few: stored entries meet, in several blocks and slices."""
    bulk, cells = sides(spark, genes=120, samples=11, cells=13, share=0.15)
    whole = create.parts(bulk, cells)
    assert whole.blocks[0].value.dense is not None
    want = np.array([r.x for r in whole.frame().orderBy("cell").collect()])
    monkeypatch.setattr(ex, "BLOCK_ENTRIES", 150)
    monkeypatch.setattr(ex, "SLICE_ENTRIES", 40)
    got = create.parts(bulk, cells)
    assert len(got.blocks) > 1 and got.blocks[0].value.dense is None
    assert np.allclose(np.array([r.x for r in got.frame().orderBy("cell").collect()]), want, atol=1e-12)
    long = {(r.sample, r.cell): r.value for r in ex.long_x(got, create.samples_of(bulk)).collect()}
    ids = [r.cell for r in whole.rows.orderBy("cell").collect()]
    assert len(long) == want.size and all(abs(long[100 + s, c] - want[i, s]) < 1e-12 for i, c in enumerate(ids) for s in range(11))
    assert ex.max_difference(whole, got).first()[0] < 1e-12
    few = create.parts(bulk, cells.where("col > 2"))
    assert ex.max_difference(whole, few).first()[0] == float("inf")


def test_sums_reach_the_driver_as_one_row(spark):
    parts = spark.range(0, 500, 1, 50).select(F.array(F.col("id").cast("double"), F.lit(1.0)).alias("part")).union(spark.createDataFrame([(None,)], "part array<double>"))
    assert factorise.added(parts).tolist() == [124750.0, 500.0] == factorise.added(tables.cut(parts), written=True).tolist()
    assert len(factorise.added(parts.where("false"))) == 0


def test_view_of_a_view_makes_the_inner_one_once(spark):
    n = 1200  # the inner view made again for each entry would be 30 million steps a row
    x = spark.range(200).select(F.col("id").alias("cell"), F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: i.cast("double")).alias("x"))
    inner = list(range(0, n, 2))
    view = tables.row_view(tables.row_view(x, inner, 2.0), list(range(0, len(inner), 3)), 0.25)
    got = view.where("cell = 7").first().x
    assert got == [0.5 * v for v in range(0, n, 6)] and tables.row_view(x, []).first().x == []


def test_local_steps_without_a_task_that_holds_x(spark, monkeypatch):
    data = "/root/testdata/sf0.001"
    want = {(r.matrix, r.id, r.k): r.value for r in queries.local_steps(spark, data).collect()}
    monkeypatch.setattr(factorise, "LOCAL_ENTRIES", 10)
    got = {(r.matrix, r.id, r.k): r.value for r in queries.local_steps(spark, data).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1.1e-6 for k in want)


def test_ranks_without_a_target_give_zeros(spark):
    """Next targets come by a join, and ranks whose targets are 0 have no row."""
    columns = spark.createDataFrame([("cell", i, c, float(v)) for c in (1, 2) for i, v in ((0, 5 + c), (1, 3), (2, -c))], "side string, gene int, col long, value double")
    target = ex.quantile_target(columns, 9, 2)
    got = {(r.gene, r.col): (r.value, r.zero) for r in ex.quantile_normalize(columns, target, 9).collect()}
    assert got == {(0, 1): (6.5, 0.0), (1, 1): (3.0, 0.0), (2, 1): (-1.5, 0.0), (0, 2): (6.5, 0.0), (1, 2): (3.0, 0.0), (2, 2): (-1.5, 0.0)}
    plan = ex.quantile_normalize(columns, target, 9)._jdf.queryExecution().optimizedPlan().toString()
    assert "lead(" not in plan  # a window over all genes is one task


@pytest.mark.parametrize("dense", [True, False])
def test_views_of_parts_make_only_their_samples(spark, monkeypatch, dense):
    bulk, cells = sides(spark, genes=3, samples=7, cells=9) if dense else sides(spark, genes=120, samples=11, cells=13, share=0.15)
    if not dense:
        monkeypatch.setattr(ex, "BLOCK_ENTRIES", 150)
    parts = create.parts(bulk, cells)
    assert (parts.blocks[0].value.dense is not None) == dense
    rows = tables.cut(parts.frame())
    for outer, inner in (([0, 2, 4, 6], [0, 2]), ([1, 5], None), ([3, 1], [0, 0])):  # the last descends: rows of X
        one, two = (tables.row_view(tables.row_view(x, outer, 2.0), inner, 0.25) for x in (parts, rows))
        assert isinstance(one, ex.Similarity) == (outer[0] < outer[1])
        assert not isinstance(one, ex.Similarity) or sum(len(b.value.zero) for b in one.blocks) == one.samples == len(inner or outer)
        got, want = ({r.cell: r.x for r in (x.frame() if isinstance(x, ex.Similarity) else x).collect()} for x in (one, two))
        assert got.keys() == want.keys() and all(np.allclose(got[c], want[c], atol=1e-12) for c in want)


def test_the_driver_carries_parts_and_not_x(spark):
    parts = create.parts(*sides(spark, samples=300, cells=100))
    cells, values, look = selection.carried(parts)
    assert values.nbytes < 300 * 100 * 8 / 10 and look(values).shape == (100, 300)


@pytest.mark.parametrize("dense", [True, False])
def test_a_sink_of_parts_writes_no_rows_of_x(spark, tmp_path, monkeypatch, dense):
    bulk, cells = sides(spark, genes=3, samples=7, cells=9) if dense else sides(spark, genes=40, samples=60, cells=13, share=0.05)
    if not dense:
        monkeypatch.setattr(ex, "BLOCK_ENTRIES", 150)
    monkeypatch.setattr(ex.Similarity, "short", True)
    parts = ex.normalized(create.parts(bulk, cells))
    x = tables.row_view(parts, list(range(1, parts.samples, 2)), 2.0)
    x.clip = True
    assert (x.blocks[0].value.dense is not None) == dense
    tables.write_x(x, f"{tmp_path}/x", files=3)
    assert "x:array" not in spark.read.parquet(f"{tmp_path}/x").schema.simpleString()
    with pytest.raises(Exception, match="(?i)exists"):
        tables.write_x(x, f"{tmp_path}/x")
    back = tables.read_x(spark, f"{tmp_path}/x")
    assert isinstance(back, ex.Similarity) and tuple(tables.x_dim(back).first()) == tuple(tables.x_dim(x).first())
    want, got = ({r.cell: r.x for r in s.frame().collect()} for s in (x, back))
    assert got.keys() == want.keys() and all(np.allclose(got[c], want[c], atol=1e-12) for c in want)
    block = tables.x_block(back, 2, 4)
    assert {r.cell for r in block.frame().collect()} == {2, 3, 4} & want.keys() and "PushedFilters: [IsNotNull(cell)" in block.rows._jdf.queryExecution().toString()


def test_names_of_samples_go_to_the_entries(spark):
    """Without a broadcast by Spark's own estimate too, no entry of X is shuffled."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        bulk, cells = sides(spark)
        parts = create.parts(bulk, cells)
        for x in (parts, tables.cut(parts.frame())):
            long = ex.long_x(x, create.samples_of(bulk))
            assert long.count() == 63 and "SortMergeJoin" not in long._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)


def test_ranks_from_a_fixed_start_share_their_passes(spark, monkeypatch):
    passes, real = [], queries.many.square_sums
    monkeypatch.setattr(queries.many, "square_sums", lambda *a: passes.append(1) or real(*a))
    assert [r.k for r in queries.select_k_far(spark, "/root/testdata/sf0.001").orderBy("k").collect()] == [2, 3] and len(passes) == 1
