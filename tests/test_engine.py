"""The engine against golden values, plain NumPy and edge cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenospark.functions import expression as ex
from phenospark.operators import factorise, graph, modules, preprocess, selection, survival
from phenospark.plans import create
from phenospark.sources import tables

PATIENTS = [(1, 430.0, 0), (2, 257.0, 1), (3, 185.0, 0), (4, 298.0, 1), (5, 506.0, 0)]


@pytest.fixture(scope="module")
def patients(spark):
    return spark.createDataFrame(PATIENTS, "col long, time double, status int")


def columns_of(df, *names):
    return {r[names[0]]: r[names[1]] if len(names) == 2 else tuple(r[n] for n in names[1:]) for r in df.collect()}


def test_rank_example(patients):
    got = columns_of(survival.guanrank(patients), "col", "survival_rate", "rank")
    want = {3: (1.0, 0.6), 2: (0.75, 1.0), 4: (0.5, 2 / 3), 1: (0.5, 0.2), 5: (0.5, 0.2)}
    assert all(got[k] == pytest.approx(v) for k, v in want.items())
    future = columns_of(survival.future_time(survival.km_curve(patients)), "col", "future_time")
    assert future == pytest.approx({3: 206.75, 2: 134.75, 4: 104.0, 1: 38.0, 5: 0.0})
    elf = columns_of(survival.guanrank_elf(patients), "col", "exp_time", "rank")
    assert elf[3] == pytest.approx((391.75, 0.4588353413654619)) and elf[1] == pytest.approx((506, 0.0)) and elf[2] == pytest.approx((257, 1.0))
    unit = columns_of(survival.guanrank_elf(patients, unit_time=True), "col", "time")
    assert sorted(unit.values()) == [1, 2, 3, 4, 5]


def test_ranks_equal_the_double_loop(spark):
    rng = np.random.default_rng(0)
    for k in range(4):
        time, status = rng.integers(1, 12, 40).astype(float), (rng.random(40) < [0.5, 0.2, 0.9, 0.6][k]).astype(int)
        frame = spark.createDataFrame([(i, float(t), int(s)) for i, (t, s) in enumerate(zip(time, status, strict=True))], "col long, time double, status int")
        got = columns_of(survival.guanrank(frame), "col", "rank")
        assert [got[i] for i in range(40)] == pytest.approx(selection.rank_array(time, status).tolist())
        assert max(got.values()) == pytest.approx(1)


def test_all_censored_and_all_tied(spark):
    for rows in ([(i, float(i), 0) for i in range(5)], [(i, 3.0, i % 2) for i in range(6)]):
        frame = spark.createDataFrame(rows, "col long, time double, status int")
        got = columns_of(survival.guanrank(frame), "col", "rank")
        want = selection.rank_array(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]))
        assert [got[i] for i in range(len(rows))] == pytest.approx(want.tolist())


def test_phenotypes(spark, patients):
    labels = spark.createDataFrame([(1, 1.0), (2, 0.0)], "col long, label double")
    assert sorted(map(tuple, survival.coerce_phenotype(labels).collect())) == [(1, 1.0, 1), (2, 100.0, 0)]
    assert columns_of(survival.phenotype_s(labels, "binary"), "col", "s") == {1: 0.0, 2: 1.0}
    assert columns_of(survival.phenotype_s(patients, "survival"), "col", "s")[3] == pytest.approx(0.4)
    with pytest.raises(ValueError):
        survival.phenotype_s(labels, "other")


def test_concordance(spark):
    rows = [(1, 1.0, 1, 0.1), (2, 2.0, 1, 0.2), (3, 3.0, 0, 0.2), (4, 1.0, 0, 0.9)]
    frame = spark.createDataFrame(rows, "col long, time double, status int, score double")
    n, c = survival.concordance(frame).first()
    t, s, p = (np.array([r[i] for r in rows]) for i in (1, 2, 3))
    assert n == 4 and c == pytest.approx(3.5 / 4) == survival.concordance_of(t, s, p)
    assert survival.concordance(frame, reverse=True).first()[1] == pytest.approx(0.5 / 4)
    assert np.isnan(survival.concordance_of(t, np.zeros(4), p))


def test_cox(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 2))
    time = rng.exponential(np.exp(-(x @ [1.0, -0.5])))
    status = (rng.random(400) < 0.8).astype(int)
    b = survival.cox_fit(np.round(time, 2), status, x)
    assert b == pytest.approx([1.0, -0.5], abs=0.2)
    both = survival.cox_fit(time, status, np.column_stack([x, x[:, 0]]))  # collinear
    assert np.isfinite(both).all() and both[0] + both[2] == pytest.approx(survival.cox_fit(time, status, x)[0], abs=1e-3)
    assert survival.concordance_of(time, status, x @ b) < 0.4  # a risk score orders against time


GRAPH = [(0, 1, 1.0), (1, 0, 2.0), (1, 2, 1.0), (2, 1, 1.0), (2, 2, 5.0), (0, 2, 0.0)]


def test_graph(spark):
    cells = spark.createDataFrame([(i,) for i in range(4)], "cell long")
    edges = graph.clean(spark.createDataFrame(GRAPH, "src long, dst long, w double"))
    degree = graph.degrees(edges, cells)
    assert columns_of(degree, "cell", "deg", "d") == {0: (1, 1), 1: (2, 1), 2: (1, 1), 3: (0, 0)}
    normal = graph.normalize(edges, degree)
    assert [r.w for r in normal.collect()] == [pytest.approx(0.7071067811865475)] * 4
    assert tuple(graph.info(degree).first()) == (1, 0.0, 2.0, 1.0)
    assert graph.symmetry_defect(edges).first() == (0.0, True)
    odd = spark.createDataFrame([(0, 1, 2.0)], "src long, dst long, w double")
    assert graph.symmetry_defect(odd).first() == (pytest.approx(8**0.5), False)
    assert sorted(map(tuple, graph.symmetrize(odd).collect())) == [(0, 1, 1.0), (1, 0, 1.0)]
    a = np.zeros((4, 4))
    for r in normal.collect():
        a[r.src, r.dst] = r.w
    h = np.random.default_rng(2).random((3, 4))
    frame = spark.createDataFrame([(c, h[:, c].tolist()) for c in range(4)], "cell long, h array<double>")
    got = columns_of(graph.spmm(normal, frame, 3), "cell", "g")
    assert all(got[c] == pytest.approx((h @ a.T)[:, c].tolist()) for c in range(3))
    assert graph.quadratic(normal, frame, 3).first()[0] == pytest.approx((h * (h @ a.T)).sum())
    lap = {(r.src, r.dst): r.w for r in graph.laplacian(normal, degree).collect()}
    assert lap[0, 0] == 1 and lap[0, 1] == pytest.approx(-0.7071067811865475) and (3, 3) not in lap


X1 = np.array([[1.0, 2, 3], [4, 5, 6]])
W1, H1 = np.array([[0.1, 0.2], [0.3, 0.4]]), np.array([[0.5, 0.6, 0.7], [0.8, 0.9, 1.0]])


@pytest.mark.parametrize("n,loss,w0", [(1, 0.6108280298276391, (0.095669084369, 0.190214860163)), (2, 0.6056774339824234, (0.095919763996, 0.189989798775)), (3, 0.6010189420255211, (0.09605346284, 0.189934119303))])
def test_plain_steps(n, loss, w0):
    got = factorise.fit_local(X1, 2, maxiter=n, threshold=0, w0=W1, h0=H1)
    assert got.loss == pytest.approx(loss) and got.w[0] == pytest.approx(w0) and got.iter == n + 1 and not got.converged


def regularised():
    x = np.array([[1.0, 2, 3, 4], [4, 3, 2, 1]])
    e = 0.5**0.5
    edges = (np.array([0, 1, 1, 2]), np.array([1, 0, 2, 1]), np.full(4, e))
    return x / np.sqrt((x**2).sum()), np.array([0, 0.5]), edges, np.array([1.0, 1, 1, 0]), np.array([[0.5, 0.6, 0.7, 0.8], [0.8, 0.7, 0.6, 0.5]])


def test_regularised_steps():
    x, s, edges, d, h0 = regularised()
    got = factorise.fit_local(x, 2, s, edges, d, 0.005, 0.005, 2, 0, w0=W1, h0=h0)
    assert got.loss == pytest.approx(0.16794842288710263)
    assert got.w.ravel() == pytest.approx([0.220516460791, 0.331538454876, 0.223925619074, 0.348450919758])
    assert got.h[0] == pytest.approx([0.463041165873, 0.529127522631, 0.569244906063, 0.611040969257])
    assert factorise.fit_local(x, 2, s, edges, d, 0.005, 0.005, 1, 0, w0=W1, h0=h0).loss == pytest.approx(0.19413432033328062)


def test_distributed_equals_local(spark):
    x, s, (src, dst, w), d, h0 = regularised()
    frame = spark.createDataFrame([(c, x[:, c].tolist()) for c in range(4)], "cell long, x array<double>")
    edges = spark.createDataFrame([(int(a), int(b), float(v)) for a, b, v in zip(src, dst, w, strict=True)], "src long, dst long, w double")
    degree = spark.createDataFrame([(c, float(v)) for c, v in enumerate(d)], "cell long, d double")
    start = spark.createDataFrame([(c, h0[:, c].tolist()) for c in range(4)], "cell long, h array<double>")
    for n in (1, 3):
        far = factorise.fit(frame, 2, s, edges, degree, 0.005, 0.005, n, 0.0, w0=W1, h0=start)
        near = factorise.fit_local(x, 2, s, (src, dst, w), d, 0.005, 0.005, n, 0.0, w0=W1, h0=h0)
        assert far.loss == pytest.approx(near.loss, abs=1e-12) and far.w == pytest.approx(near.w) and far.iter == near.iter
        got = columns_of(far.h, "cell", "h")
        assert all(got[c] == pytest.approx(near.h[:, c].tolist()) for c in range(4))
    plain = factorise.nmf(frame, 2, maxiter=200, seed=3)
    assert plain.converged and plain.loss < 0.2


def test_fit_stops_and_warns(caplog):
    x = np.abs(np.random.default_rng(3).normal(size=(6, 30)))
    losses = [factorise.fit_local(x, 3, maxiter=n, threshold=0, seed=1).loss for n in range(1, 30)]
    assert all(b <= a + 1e-9 for a, b in zip(losses, losses[1:], strict=False))  # monotone for X >= 0
    done = factorise.fit_local(x, 3, seed=1, threshold=1e-3)
    assert done.converged and done.iter < 2000
    assert factorise.fit_local(x, 3, seed=1, threshold=1e9).iter == 1 and factorise.fit_local(x, 3, seed=1, threshold=1e9, compat="dense").iter == 2
    factorise.fit_local(-x, 2, maxiter=1)
    assert "negative" in caplog.text
    assert not factorise.fit_local(np.zeros((2, 3)), 2, maxiter=5, w0=np.zeros((2, 2))).converged  # 0 / 0
    with pytest.raises(ValueError):
        factorise.fit_local(x, 3, w0=np.zeros((2, 2)))
    assert factorise.seed_for("survival", None) == 7 and factorise.seed_for("binary", None) == 5 and factorise.seed_for("binary", 1) == 1 and factorise.seed_for(None, None) is None


def test_projection_is_that_of_the_pseudo_inverse(spark):
    rng = np.random.default_rng(4)
    x, h = rng.random((5, 20)), rng.random((3, 20))
    frame = spark.createDataFrame([(c, x[:, c].tolist()) for c in range(20)], "cell long, x array<double>")
    start = spark.createDataFrame([(c, h[:, c].tolist()) for c in range(20)], "cell long, h array<double>")
    assert factorise.project(frame, start, 3) == pytest.approx(x @ np.linalg.pinv(h))
    h[2] = h[1]
    assert factorise.pinv_project(x @ h.T, h @ h.T) == pytest.approx(x @ np.linalg.pinv(h, rcond=1e-8), abs=1e-6)


@pytest.mark.parametrize("means,stops,eii", [([10, 8, 7, 6.9], [False, False, False, True], {3: 1, 4: 1 / 3, 5: 0.1 / 3.1}), ([10, 8, 8.5], [False, False, True], {3: 1, 4: -0.5 / 1.5}), ([10, 8, 7], [False, False, False], {3: 1})])
def test_elbow(spark, means, stops, eii):
    assert [selection.stop_here(means[: i + 1]) for i in range(len(means))] == stops
    losses = spark.createDataFrame([(k + 2, r, float(m + r - 0.5)) for k, m in enumerate(means) for r in (0, 1)] + [(2, 9, float("nan"))], "k int, repeat int, loss double")
    got = columns_of(selection.elbow(losses), "k", "eii")
    assert got[2] is None and all(got[k] == pytest.approx(v) for k, v in eii.items())


def test_select_k(spark):
    rng = np.random.default_rng(5)
    x = rng.random((8, 3)) @ rng.random((3, 40))
    frame = spark.createDataFrame([(c, x[:, c].tolist()) for c in range(40)], "cell long, x array<double>")
    got = selection.select_k(frame, k_max=6, repeats=2, maxiter=300)
    assert 2 <= got.selected <= 5 and got.losses.count() >= 4
    assert selection.select_k(frame, k_max=2, repeats=1, maxiter=5).selected == 2
    with pytest.raises(ValueError):
        selection.select_k(frame, k_max=1)


def test_folds(spark):
    samples = spark.range(11).select(F.col("id").alias("col"))
    sizes = sorted(r["count"] for r in selection.hashed_folds(samples, 5).groupBy("fold").count().collect())
    assert sizes == [2, 2, 2, 2, 3]
    with pytest.raises(ValueError):
        selection.hashed_folds(samples, 12)
    assert selection.grid(spark, [0.1, 0.2], [0.3], 3).count() == 6


def test_cv_tables(spark):
    cv = spark.createDataFrame([(0.1, 0.2, 1, 0.5), (0.1, 0.2, 2, float("nan")), (0.1, 0.3, 1, 0.5), (0.2, 0.2, 1, 0.4), (0.2, 0.3, 1, None)], "alpha1 double, alpha2 double, fold int, cindex double")
    means = selection.summary(cv)
    assert means.count() == 3 and tuple(selection.best(means).first()) == (0.1, 0.2, 0.5)
    assert selection.pivoted(means, [0.2, 0.3]).where("alpha1 = 0.2").first()["0.3"] is None


def test_select_alpha(spark, monkeypatch):
    rng = np.random.default_rng(6)
    x = np.abs(rng.normal(size=(24, 30)))
    frame = spark.createDataFrame([(c, x[:, c].tolist()) for c in range(30)], "cell long, x array<double>")
    people = spark.createDataFrame([(i, float(t), int(s)) for i, (t, s) in enumerate(zip(rng.integers(1, 50, 24), rng.random(24) < 0.7, strict=True))], "col long, time double, status int")
    got = selection.select_alpha(frame, people, 2, alpha1=(0.01,), alpha2=(0.0, 0.1), cross_k=3, maxiter=20)
    cv = got.cv.toPandas()
    assert len(cv) == 6 and cv["cindex"].between(0, 1).all() and cv.sort_values(["alpha1", "alpha2", "fold"]).index.tolist() == list(range(6))
    assert got.summary.first()["cindex"] == got.summary.toPandas()["cindex"].max() and got.matrix.count() == 1 and got.alpha2 in (0.0, 0.1)
    flipped = selection.cross_validate(frame, people, 2, alpha1=(0.01,), alpha2=(0.0,), cross_k=3, maxiter=20, reverse=True).toPandas()
    binary = people.select("col", (F.col("col") % 2).cast("double").alias("label"))
    assert selection.cross_validate(frame, binary, 2, alpha1=(0.01,), alpha2=(0.0,), cross_k=2, maxiter=5).count() == 2
    near = selection.cross_validate(frame, people, 2, alpha1=(0.01,), alpha2=(0.0,), cross_k=2, maxiter=3).toPandas()
    near_k = selection.select_k(frame, k_max=3, repeats=1, maxiter=2).losses.toPandas()
    assert sorted(1 - flipped["cindex"]) == pytest.approx(sorted(cv[cv["alpha2"] == 0]["cindex"]))
    with pytest.raises(ValueError):
        selection.select_alpha(frame, people.where("col > 0"), 2)
    monkeypatch.setattr(factorise, "LOCAL_ENTRIES", 0)  # X stays distributed
    far = selection.cross_validate(frame, people, 2, alpha1=(0.01,), alpha2=(0.0,), cross_k=2, maxiter=3).toPandas()
    assert len(far) == 2 and far["cindex"].between(0, 1).all() and (far["iter"] <= 4).all()
    # the same answers on either side of the limit
    assert far.sort_values("fold")["loss"].tolist() == pytest.approx(near.sort_values("fold")["loss"].tolist()) and sorted(far["cindex"]) == pytest.approx(sorted(near["cindex"]))
    assert selection.select_k(frame, k_max=3, repeats=1, maxiter=2).losses.toPandas()["loss"].tolist() == pytest.approx(near_k["loss"].tolist())


def test_choice_of_ties(spark):
    cv = spark.createDataFrame([(a, b, 1, 0.5) for a in (0.1, 0.2) for b in (0.3, 0.4)] + [(0.2, 0.4, 2, float("nan"))], "alpha1 double, alpha2 double, fold int, cindex double")
    large, dense = (selection.chosen(cv, (0.2, 0.1), (0.4, 0.3), ties) for ties in ("large", "dense"))
    assert (large.alpha1, large.alpha2) == (0.1, 0.3) and (dense.alpha1, dense.alpha2) == (0.2, 0.4)
    with pytest.raises(ValueError):
        selection.chosen(cv, (0.2,), (0.4,), "other")
    with pytest.raises(ValueError):
        selection.chosen(cv.where("false"), (0.2,), (0.4,))


def test_fit_moves_only_the_graph_product(spark):
    """X and H meet in their buckets; the one exchange of an iteration is that of the product's sums."""
    x, s, (src, dst, w), d, h0 = regularised()
    frame = spark.createDataFrame([(c, x[:, c].tolist(), 1.0) for c in range(4)], "cell long, x array<double>, d double")
    links = spark.createDataFrame([(int(a), int(b), float(v)) for a, b, v in zip(src, dst, w, strict=True)], "src long, dst long, w double")
    start = spark.createDataFrame([(c, h0[:, c].tolist(), None) for c in range(4)], "cell long, h array<double>, part array<double>")
    made = [tables.Bucketed(t, key) for t, key in ((frame, "cell"), (links, "dst"), (start, "cell"))]
    x_rows, edges, h = (t.read() for t in made)
    for graph_of, exchanges in ((None, 0), (edges, 1)):
        state = factorise.joined(x_rows, h, graph_of, 2)
        state.collect()
        plan = state._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
        assert plan.count("Exchange ") == exchanges
    for t in made:
        t.drop()


def test_sparse_columns_equal_dense_ones(spark):
    """Absent rows are zeros in every step, on either side of 0, beside stored zeros (column 0 has
    them, so that no gene is lost) and where a cell has no row at all."""
    rng = np.random.default_rng(17)
    b, c = (rng.poisson(1.0, (12, n)) * rng.choice([1.0, -1.0, 0.0], (12, n), p=[0.5, 0.2, 0.3]) for n in (4, 7))
    c[:, 3] = 0
    bulk, cells = tables_of(spark, b, c)
    for quantile in (True, False):
        full = create.similarity(bulk, cells, quantile).persist()
        sparse_cells = cells.where("value <> 0 or col = 0").unionByName(spark.createDataFrame([("other", 3, 1.0)], "gene string, col long, value double"))
        gaps = create.similarity(bulk.where("value <> 0 or col = 0"), sparse_cells, quantile)
        assert tables.max_difference(full, gaps).first()[0] < 1e-12
    stats = columns_of(preprocess.gene_stats(cells.where("value <> 0"), 7), "gene", "mean", "variance")
    assert all(stats[f"g{i}"] == pytest.approx((c[i].mean(), c[i].var(ddof=1))) for i in range(12) if c[i].any())
    near = spark.createDataFrame([("a", i, 1e9 + i % 2) for i in range(10)], "gene string, col long, value double")
    assert preprocess.gene_stats(near, 10).first()["variance"] == pytest.approx(5 / 18)  # no cancellation


def test_positions(spark):
    cells = spark.createDataFrame([(int(c),) for c in np.random.default_rng(3).permutation(500) * 3], "cell long")
    assert columns_of(tables.positions(cells), "cell", "pos") == {3 * i: i for i in range(500)}


def test_two_sided(spark):
    import math

    z = np.linspace(-9, 9, 181)
    got = spark.createDataFrame([(float(v),) for v in z], "z double").select("z", preprocess.two_sided(F.col("z")).alias("p")).collect()
    assert all(r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), rel=1e-6, abs=1e-12) for r in got)


def test_session():
    from phenospark import session

    with pytest.raises(ValueError):
        session.builder(threads=0)


def long(m, side, first=0):
    return [(side, f"g{i}", c + first, float(v)) for i, row in enumerate(m) for c, v in enumerate(row)]


def test_quantile_normalisation(spark):
    schema = "side string, gene string, col long, value double"
    t = spark.createDataFrame(long([[5, 4], [2, 1], [3, 6]], "bulk"), schema)
    target = ex.quantile_target(t)
    assert columns_of(target, "rank", "target") == {1: 1.5, 2: 3.5, 3: 5.5}
    got = {(r.gene, r["col"]): r.value for r in ex.quantile_normalize(t, target).collect()}
    assert [got[f"g{i}", 0] for i in range(3)] == [5.5, 1.5, 3.5] and [got[f"g{i}", 1] for i in range(3)] == [3.5, 1.5, 5.5]
    tied = spark.createDataFrame(long([[1], [1], [2]], "bulk"), schema)
    abc = spark.createDataFrame([(1, 10.0), (2, 20.0), (3, 40.0)], "rank int, target double")
    assert {r.gene: r.value for r in ex.quantile_normalize(tied, abc).collect()} == {"g0": 15.0, "g1": 15.0, "g2": 40.0}


def tables_of(spark, bulk, cells):
    make = lambda m: spark.createDataFrame([r[1:] for r in long(m, "")], "gene string, col long, value double")
    return make(bulk), make(cells)


def test_correlation(spark):
    rng = np.random.default_rng(7)
    b, c = rng.normal(size=(9, 4)), rng.normal(size=(9, 6))
    c[:, 2] = 1.0  # constant
    bulk, cells = tables_of(spark, b, c)
    got = columns_of(create.similarity(bulk, cells, quantile=False), "cell", "x")
    with np.errstate(invalid="ignore"):
        want = np.nan_to_num(np.corrcoef(b.T, c.T)[:4, 4:])
    assert all(got[j] == pytest.approx(want[:, j].tolist()) for j in range(6))


def test_correlation_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(12)
    bulk, cells = tables_of(spark, rng.normal(size=(9, 5)), rng.normal(size=(9, 6)))
    whole = create.similarity(bulk, cells).persist()
    monkeypatch.setattr(ex, "BLOCK_ENTRIES", 20)
    assert tables.max_difference(whole, create.similarity(bulk, cells)).first()[0] < 1e-12
    assert tables.max_difference(whole, whole.where("cell > 0")).first()[0] == float("inf")


def test_pca_of_sparse_counts(spark):
    """Absent rows are zeros before scaling; a cell without a chosen gene is a cell too."""
    from phenospark.plans.prepare import prepare

    rng = np.random.default_rng(11)
    m = rng.poisson(0.6, (30, 6)) * rng.random((30, 6))
    m[4, :5] = 0
    m[4, 5] = 1.0
    rows = [(f"g{j}", i, float(m[i, j])) for i in range(30) for j in range(6) if m[i, j]]
    values = spark.createDataFrame(rows, "gene string, col long, value double")
    genes = spark.createDataFrame([(f"g{j}",) for j in range(5)], "gene string")
    got = preprocess.pca(preprocess.scale_data(values, 30), genes, 3, preprocess.scaled_zeros(values, 30), spark.range(30).withColumnRenamed("id", "col"))
    pc = {r["col"]: r["pc"] for r in got.collect()}
    assert sorted(pc) == list(range(30))
    pc = np.array([pc[i] for i in range(30)])
    z = (m[:, :5] - m[:, :5].mean(0)) / m[:, :5].std(0, ddof=1)
    want = z @ np.linalg.svd(z, full_matrices=False)[2][:3].T
    assert np.allclose(pc * np.sign((pc * want).sum(0)), want, atol=1e-6)
    ready = prepare(values, selection="disp", n_genes=2, dims=2, neighbours=3)
    assert ready.components.count() == len({i for _, i, _ in rows})


def test_prepare(spark):
    from phenospark.plans.prepare import prepare

    rng = np.random.default_rng(13)
    m = rng.poisson(2.0, (30, 24))
    counts = spark.createDataFrame([(f"g{i}", c, float(v)) for i, row in enumerate(m) for c, v in enumerate(row) if v], "gene string, col long, value double")
    for method, selection in (("LogNormalize", "vst"), ("RC", "mvp"), ("CLR", "disp")):
        got = prepare(counts, method, selection=selection, n_genes=10, dims=4, neighbours=5)
        assert got.genes.count() == 10 and got.components.count() == 24
        w = got.graph.toPandas()["w"]
        assert len(w) and w.between(1 / 15, 1).all()
    with pytest.raises(ValueError):
        prepare(counts, "other")


def test_create(spark):
    rng = np.random.default_rng(8)
    bulk, cells = tables_of(spark, rng.random((9, 4)), rng.random((9, 6)))
    people = spark.createDataFrame([(3, 5.0, 1), (1, 9.0, 0), (0, 2.0, 1), (2, 4.0, 1)], "col long, time double, status int")  # another order
    edges = spark.createDataFrame([(0, 1, 3.0), (1, 0, 3.0), (5, 5, 1.0)], "src long, dst long, w double")
    got = create.create(bulk, cells, people, edges)
    assert ex.fro_norm(got.x).first()[0] == pytest.approx(1) and got.n_genes == 9 and got.s[0] == pytest.approx(0)
    assert got.degree.count() == 6 and got.edges.count() == 2
    with pytest.raises(ValueError, match="no gene"):
        create.create(bulk.withColumn("gene", F.lit("other")), cells, people)
    with pytest.raises(ValueError, match="two genes"):
        create.create(bulk.where("gene = 'g1'"), cells, people)
    with pytest.raises(ValueError, match="phenotype"):
        create.create(bulk, cells, people.where("col > 0"))
    with pytest.raises(ValueError, match="zero"):
        create.create(bulk.withColumn("value", F.lit(1.0)), cells, people, quantile=False)


def test_scans(spark, tmp_path):
    x = spark.createDataFrame([(c, [float(c), 1.0, 2.0]) for c in range(10)], "cell long, x array<double>")
    tables.write_x(x, f"{tmp_path}/x")
    with pytest.raises(Exception, match="(?i)exists"):
        tables.write_x(x, f"{tmp_path}/x")
    tables.write_x(x, f"{tmp_path}/x", overwrite=True)
    back = tables.read_x(spark, f"{tmp_path}/x")
    assert tuple(tables.x_dim(back).first()) == (3, 10)
    view = tables.x_block(back, 2, 4, [2, 0], 0.5)
    assert columns_of(view, "cell", "x") == {c: [1.0, c / 2] for c in (2, 3, 4)}
    assert "PushedFilters: [IsNotNull(cell)" in view._jdf.queryExecution().toString()
    for bad in (0.0, float("inf"), -1.0):
        with pytest.raises(ValueError):
            tables.row_view(x, scale=bad)
    with pytest.raises(ValueError, match="lacks"):
        tables.checked(x, "graph")
    spark.createDataFrame([(0, 1, 0.0), (1, 0, 2.0)], "src long, dst long, w double").write.parquet(f"{tmp_path}/g")
    assert tables.read_graph(spark, f"{tmp_path}/g").count() == 1
    assert [tables.block_size(*a) for a in ((None, 50), (7, 50), (70, 50), (0, 50), (5, 0))] == [50, 7, 50, 1, 1]


def test_modules(spark):
    h = spark.createDataFrame([(i, [10.0 if i == 9 else 0.0, 1.0]) for i in range(10)], "cell long, h array<double>")
    assert [tuple(r) for r in modules.find_module(h).collect()] == [(1, 9)]  # a constant row has none
    rng = np.random.default_rng(14)
    two = np.concatenate([rng.normal(-4, 1, 150), rng.normal(4, 1, 150)])
    mixed = spark.createDataFrame([(i, [float(a), float(b)]) for i, (a, b) in enumerate(zip(rng.normal(size=300), two, strict=True))], "cell long, h array<double>")
    plain = {tuple(r) for r in modules.find_module(mixed, 1.0).collect()}
    dip = {tuple(r) for r in modules.find_module(mixed, 1.0, dip=True).collect()}
    assert {r for r in dip if r[0] == 1} == {r for r in plain if r[0] == 1} != set()
    assert {c for f, c in dip if f == 2} == set(range(150, 300))  # cut between the two modes
    got = columns_of(modules.find_subset(h, 2), "cell", "selected", "subset1", "subset2", "subset1_loading")
    assert got[9] == ("selected", "selected", "Other cells", 10.0) and got[0][0] == "Other cells"


def test_dip():
    rng = np.random.default_rng(9)
    one, two = rng.normal(size=400), np.concatenate([rng.normal(-4, 1, 200), rng.normal(4, 1, 200)])
    assert modules.dip_p_value(one) > 0.05 > modules.dip_p_value(two)
    assert -2 < modules.antimode(np.sort(two)) < 2


def test_preparation(spark):
    counts = spark.createDataFrame([("a", 1, 1.0), ("b", 1, 3.0), ("a", 2, 2.0), ("c", 3, 5.0)], "gene string, col long, value double")
    rc = {(r.gene, r["col"]): r.value for r in preprocess.rc_normalize(counts, 100).collect()}
    assert rc["b", 1] == 75 and rc["c", 3] == 100
    logs = {(r.gene, r["col"]): r.value for r in preprocess.log_normalize(counts, 100).collect()}
    assert logs["b", 1] == pytest.approx(np.log1p(75))
    clr = {(r.gene, r["col"]): r.value for r in preprocess.clr_normalize(counts).collect()}
    assert clr["b", 1] == pytest.approx(np.log1p(3 / np.exp((np.log1p(1) + np.log1p(3)) / 3)))
    stats = columns_of(preprocess.gene_stats(counts, 4), "gene", "mean", "variance")
    assert stats["a"] == pytest.approx((0.75, np.var([1, 2, 0, 0], ddof=1)))
    for method in ("vst", "mvp", "disp"):
        assert preprocess.variable_genes(counts, 4, 2, method).count() == 2
    with pytest.raises(ValueError):
        preprocess.variable_genes(counts, 4, 2, "other")
    scaled = {(r.gene, r["col"]): r.value for r in preprocess.scale_data(counts, 4).collect()}
    assert scaled["a", 2] == pytest.approx((2 - 0.75) / stats["a"][1] ** 0.5)
    assert len(preprocess.pca(preprocess.scale_data(counts, 4), counts.select("gene").distinct(), 2).first()["pc"]) == 2


def test_markers_equal_a_rank_sum(spark):
    rng = np.random.default_rng(10)
    m = rng.poisson(1.0, (5, 40)).astype(float)
    m[0, :15] += rng.poisson(3.0, 15)
    values = spark.createDataFrame([(f"g{i}", c, float(v)) for i, row in enumerate(m) for c, v in enumerate(row) if v], "gene string, col long, value double")
    cells = spark.createDataFrame([(c, int(c < 15)) for c in range(40)], "col long, chosen int")
    got = {r.gene: r for r in preprocess.markers(values, cells).collect()}
    for i, row in enumerate(m):
        a, b = row[:15], row[15:]
        u = sum((a[:, None] > b[None, :]).ravel() + 0.5 * (a[:, None] == b[None, :]).ravel())
        _, t = np.unique(row, return_counts=True)
        dev = np.sqrt(15 * 25 / 12 * (41 - (t**3 - t).sum() / (40 * 39)))
        r = got[f"g{i}"]
        assert (r.u, r.z, r.log_fc) == pytest.approx((u, (u - 15 * 25 / 2) / dev, np.log2(np.expm1(a).mean() + 1) - np.log2(np.expm1(b).mean() + 1)))
    assert got["g0"].p_adj < 0.05


def test_neighbours(spark):
    rng = np.random.default_rng(11)
    v = rng.normal(size=(60, 8))
    frame = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "cell long, v array<double>")
    want = {}
    for i in range(60):
        want[i] = [j for _, j in sorted((-float(v[i] @ v[j]), j) for j in range(60) if j != i)[:5]]
    for block in (4096, 16):
        got = {}
        for r in preprocess.knn_graph(frame, 5, block).orderBy("src", "rank").collect():
            got.setdefault(r.src, []).append(r.dst)
        assert got == want
    near = preprocess.knn_graph(frame, 1, metric="euclidean").where("src = 0").first()
    gap = ((v - v[0]) ** 2).sum(1)
    assert near.dst == np.argsort(gap)[1] and near.score == pytest.approx(-np.sort(gap)[1])
    snn = {(r.src, r.dst): r.w for r in preprocess.snn_graph(preprocess.knn_graph(frame, 5), 5).collect()}
    for (i, j), w in snn.items():
        a, b = {i, *want[i]}, {j, *want[j]}
        assert w == pytest.approx(len(a & b) / len(a | b)) and w >= 1 / 15
