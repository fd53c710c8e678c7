"""The registered queries: one for each operator, over whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from phenospark.functions import expression as ex
from phenospark.operators import components, factorise, graph, hazards, many, modules, neighbours, preprocess, selection, survival
from phenospark.plans import create, inputs, prepare
from phenospark.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
#: Factors, and iterations, of the fits with a fixed start.
K, STEPS, ALPHA = 3, 2, 0.005
#: Digits of values.
DIGITS = 6


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def r6(name: str | Column, alias: str | None = None) -> Column:
    c = F.col(name) if isinstance(name, str) else name
    return F.round(c.cast("double"), DIGITS).alias(alias or name)


def columns(spark, sf_dir, tied: bool = False) -> DataFrame:
    return ex.side_by_side(*(inputs.tied if tied else inputs.expression)(spark, sf_dir))


def x_raw(spark, sf_dir) -> ex.Similarity:
    return create.parts(*inputs.expression(spark, sf_dir))


def x_of(spark, sf_dir, clip: bool = False) -> tuple[ex.Similarity | DataFrame, DataFrame]:
    """X of norm 1 (clip: negative correlations as 0 before), and its samples."""
    bulk, cells = inputs.expression(spark, sf_dir)
    return ex.normalized(create.kept(replace(create.parts(bulk, cells), clip=clip))), create.samples_of(bulk)


def fixed_h(cells: ex.Similarity | DataFrame) -> DataFrame:
    return ex.seen(cells)[0].select("cell", F.array(*[(((F.col("cell") * 31 + k * 17) % 97) + 1) / 98.0 for k in range(K)]).alias("h"))


def fixed_w(samples: DataFrame) -> np.ndarray:
    s = np.array([r["sample"] for r in samples.orderBy("pos").collect()])  # a row for each sample
    return ((s[:, None] * 13 + np.arange(K)[None, :] * 29) % 89 + 1) / 90.0


def unsampled(spark, sf_dir) -> DataFrame:
    """The vectors that are X's cells, and not its samples."""
    return inputs.vectors(spark, sf_dir).where(F.col("cell") % 10 != 0)


def cell_graph(spark, sf_dir, v: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The normalised graph of each cell's five nearest others, made symmetric, and its degrees; v: of other cells than X's."""
    v = unsampled(spark, sf_dir) if v is None else v
    near = tables.cut(preprocess.knn_graph(v, 5).select("src", "dst"), "near")  # read both ways
    both = near.union(near.select("dst", "src")).distinct().withColumn("w", F.lit(1.0))
    both = tables.cut(both, "edges")
    degree = graph.degrees(both, v.select("cell"))
    return graph.normalize(both, degree), degree


def parts(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """The cleaned graph of parts and its degrees."""
    edges, cells = inputs.parts_graph(spark, sf_dir)
    clean = graph.clean(edges)
    return clean, graph.degrees(clean, cells)


def long_fit(spark, got: factorise.Fit, samples: DataFrame) -> DataFrame:
    ids = [r["sample"] for r in samples.orderBy("pos").collect()]
    w = factorise.w_frame(spark, got.w, ids).select(F.lit("w").alias("matrix"), F.col("sample").alias("id"), "k", "value")
    h = got.h.select(F.lit("h").alias("matrix"), F.col("cell").alias("id"), F.posexplode("h").alias("k", "value"))
    return w.unionByName(h).select("matrix", "id", "k", r6("value"))


# --- scans and projections


def saved(df: DataFrame, name: str) -> str:
    """Writes a table into the shared folder; its path."""
    path = f"{tables.shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


@query
def scan_expr(spark, sf_dir):
    sides = zip(("bulk", "cell"), inputs.expression(spark, sf_dir), strict=True)
    b, c = (tables.read_layer(spark, saved(t, side)).withColumn("side", F.lit(side)) for side, t in sides)
    return b.unionByName(c).groupBy("side", "gene").agg(F.count("*").alias("n"), r6(F.sum("value"), "total"))


@query
def read_graph(spark, sf_dir):
    edges, _ = inputs.parts_graph(spark, sf_dir)
    # every third edge is stored as an explicit zero
    return tables.read_graph(spark, saved(edges.withColumn("w", F.when((F.col("src") + F.col("dst")) % 3 == 0, 0.0).otherwise(F.col("w"))), "graph"))


@query
def x_sink(spark, sf_dir):
    """X written, read again and put together from blocks of cells."""
    x, samples = x_of(spark, sf_dir)
    path = f"{tables.shared_folder(spark)}/x-{uuid.uuid4().hex}"
    tables.write_x(x, path)
    back = tables.read_x(spark, path)
    last = ex.seen(back)[0].agg(F.max("cell")).first()[0]
    whole = None
    for lo in range(0, last + 1, last // 3 + 1):
        part = ex.long_x(tables.x_block(back, lo, lo + last // 3), samples, DIGITS)
        whole = part if whole is None else whole.unionByName(part)
    return whole


@query
def x_difference(spark, sf_dir):
    """How far quantile normalisation moves X."""
    bulk, cells = inputs.expression(spark, sf_dir)
    return ex.max_difference(x_raw(spark, sf_dir), create.parts(bulk, cells, quantile=False)).select(r6("max_difference"))


@query
def x_block_scan(spark, sf_dir):
    x, samples = x_of(spark, sf_dir)
    return ex.long_x(tables.x_block(x, 100, 299), samples, DIGITS)


@query
def x_dim(spark, sf_dir):
    return tables.x_dim(x_raw(spark, sf_dir))


@query
def x_blocks(spark, sf_dir):
    cells = inputs.vectors(spark, sf_dir).where(F.col("cell") % 10 != 0).select("cell")
    return tables.blocks(tables.positions(cells), 100)


@query
def row_view(spark, sf_dir):
    x, samples = x_of(spark, sf_dir)
    n = samples.count()
    keep = [i for i in range(n) if i % 2 == 0]
    view = tables.row_view(x, keep, 2.0)
    some = samples.where(F.col("pos") % 2 == 0).select((F.col("pos") / 2).cast("int").alias("pos"), "sample")
    return ex.long_x(view, some, DIGITS)


@query
def nested_view(spark, sf_dir):
    """A view of a view: every third sample of every second one."""
    x, samples = x_of(spark, sf_dir)
    n = samples.count()
    outer = list(range(0, n, 2))
    view = tables.row_view(tables.row_view(x, outer, 2.0), list(range(0, len(outer), 3)), 0.25)
    some = samples.where(F.col("pos") % 6 == 0).select((F.col("pos") / 6).cast("int").alias("pos"), "sample")
    return ex.long_x(view, some, DIGITS)


@query
def constant_cells(spark, sf_dir):
    """Cells without spread have no correlation, which X has as 0."""
    bulk, cells = inputs.expression(spark, sf_dir)
    flat = cells.withColumn("value", F.when(F.col("col") % 7 == 1, 1.0).otherwise(F.col("value")))
    return ex.long_x(create.parts(bulk, flat, quantile=False), create.samples_of(bulk), DIGITS)


@query
def common_genes(spark, sf_dir):
    return ex.common_genes(*inputs.expression(spark, sf_dir))


# --- expression


@query
def center_scale(spark, sf_dir):
    return ex.center_scale(columns(spark, sf_dir)).select("side", "gene", "col", r6("value"))


@query
def quantile_target(spark, sf_dir):
    return ex.quantile_target(columns(spark, sf_dir)).select("rank", r6("target"))


@query
def quantile_normalize(spark, sf_dir):
    c = columns(spark, sf_dir, tied=True)
    return ex.quantile_normalize(c, ex.quantile_target(c)).select("side", "gene", "col", r6("value"))


@query
def center_scale_sparse(spark, sf_dir):
    return ex.center_scale(ex.side_by_side(*inputs.sparse(spark, sf_dir))).select("side", "gene", "col", r6("value"), r6("zero"))


@query
def quantile_target_sparse(spark, sf_dir):
    return ex.quantile_target(ex.side_by_side(*inputs.sparse(spark, sf_dir))).select("rank", r6("target"))


@query
def quantile_normalize_sparse(spark, sf_dir):
    c = ex.side_by_side(*inputs.sparse(spark, sf_dir))
    return ex.quantile_normalize(c, ex.quantile_target(c)).select("side", "gene", "col", r6("value"), r6("zero"))


@query
def corr_matrix_sparse(spark, sf_dir):
    bulk, cells = inputs.sparse(spark, sf_dir)
    return ex.long_x(create.parts(bulk, cells, quantile=False), create.samples_of(bulk), DIGITS)


@query
def create_x_sparse(spark, sf_dir):
    bulk, cells = inputs.sparse(spark, sf_dir)
    x = ex.normalized(create.parts(bulk, cells))
    return ex.long_x(x, create.samples_of(bulk), DIGITS)


@query
def corr_matrix(spark, sf_dir):
    bulk, cells = inputs.expression(spark, sf_dir)
    x = create.parts(bulk, cells, quantile=False)
    return ex.long_x(x, create.samples_of(bulk), DIGITS)


@query
def fro_norm(spark, sf_dir):
    return ex.fro_norm(x_raw(spark, sf_dir)).select(r6("fro_norm"))


@query
def create_x(spark, sf_dir):
    x, samples = x_of(spark, sf_dir)
    return ex.long_x(x, samples, DIGITS)


# --- graph


@query
def graph_binarize(spark, sf_dir):
    return parts(spark, sf_dir)[0].select("src", "dst", "w")


@query
def graph_degree(spark, sf_dir):
    return parts(spark, sf_dir)[1]


@query
def graph_info(spark, sf_dir):
    return graph.info(parts(spark, sf_dir)[1]).select("n_zero", "min_deg", "max_deg", r6("mean_deg"))


@query
def graph_normalize(spark, sf_dir):
    return graph.normalize(*parts(spark, sf_dir)).select("src", "dst", r6("w"))


@query
def graph_laplacian(spark, sf_dir):
    edges, degree = parts(spark, sf_dir)
    return graph.laplacian(graph.normalize(edges, degree), degree).select("src", "dst", r6("w"))


def directed(v: DataFrame) -> DataFrame:
    """Each cell's five nearest, which isn't symmetric."""
    return tables.cut(preprocess.knn_graph(v, 5).select("src", "dst"), "near").withColumn("w", F.lit(1.0))  # read both ways


@query
def graph_symmetrize(spark, sf_dir):
    return graph.symmetrize(directed(unsampled(spark, sf_dir)))


@query
def graph_symmetry(spark, sf_dir):
    return graph.symmetry_defect(directed(inputs.vectors(spark, sf_dir))).select(r6("sym_fro"), "is_symmetric")


@query
def graph_spmm(spark, sf_dir):
    edges, degree = cell_graph(spark, sf_dir)
    g = graph.spmm(edges, fixed_h(degree), K)
    return g.select("cell", F.posexplode("g").alias("k", "value")).select("cell", "k", r6("value"))


@query
def graph_quadratic(spark, sf_dir):
    edges, degree = cell_graph(spark, sf_dir, inputs.vectors(spark, sf_dir))
    return graph.quadratic(edges, fixed_h(degree), K).select(r6("quadratic"))


@query
def knn_graph(spark, sf_dir):
    return preprocess.knn_graph(inputs.vectors(spark, sf_dir), 20).select("src", "rank", "dst", r6("score"))


@query
def snn_graph(spark, sf_dir):
    knn = tables.cut(preprocess.knn_graph(inputs.vectors(spark, sf_dir), 20), "knn")
    return preprocess.snn_graph(knn, 20).select("src", "dst", r6("w"))


@query
def approx_knn_graph(spark, sf_dir):
    """The graph of knn_graph by way of an index; each cell has its 20, some 19 of which are the true ones."""
    return neighbours.approx_knn_graph(inputs.vectors(spark, sf_dir), 20).select("src", "rank", "dst", r6("score"))


@query
def approx_knn_recall(spark, sf_dir):
    """How the index does for every 50th vector among all: true neighbours looked for, and whether nine of ten are found."""
    v = inputs.vectors(spark, sf_dir).select("cell", "v")
    index = neighbours.build(v, 20)
    asked = v.where(F.col("cell") % 50 == 0)
    found = tables.cut(neighbours.search(index, asked, 20), "found")
    index.probes = len(index.centroids)  # all cells: every row
    true = neighbours.search(index, asked, 20).join(found.select("src", "dst", F.lit(1).alias("hit")), ["src", "dst"], "left")
    return true.agg(F.count("*").alias("n_pairs"), (F.coalesce(F.sum("hit"), F.lit(0)) >= 0.9 * F.count("*")).alias("reached"))


# --- survival


@query
def km_curve(spark, sf_dir):
    return survival.km_curve(inputs.customers(spark, sf_dir)).select("col", "time", "status", r6("survival_rate"))


@query
def future_time(spark, sf_dir):
    return survival.future_time(survival.km_curve(inputs.patients(spark, sf_dir))).select("col", r6("future_time"))


@query
def guanrank_elf(spark, sf_dir):
    return survival.guanrank_elf(inputs.patients(spark, sf_dir)).select("col", r6("exp_time"), r6("rank"))


@query
def guanrank(spark, sf_dir):
    return survival.guanrank(inputs.customers(spark, sf_dir)).select("col", r6("rank"))


@query
def coerce_phenotype(spark, sf_dir):
    return survival.coerce_phenotype(inputs.labels(spark, sf_dir))


@query
def phenotype_s(spark, sf_dir):
    one = survival.phenotype_s(inputs.patients(spark, sf_dir), "survival").withColumn("method", F.lit("survival"))
    two = survival.phenotype_s(inputs.labels(spark, sf_dir), "binary").withColumn("method", F.lit("binary"))
    return one.unionByName(two).select("method", "col", r6("s"))


@query
def concordance(spark, sf_dir):
    scored = inputs.patients(spark, sf_dir).withColumn("score", (F.col("col") * 37 % 11).cast("double"))
    return survival.concordance(scored).select("n_pairs", r6("concordance"))


@query
def concordance_cohorts(spark, sf_dir):
    """All customers, by a key: scores and times with ties."""
    scored = inputs.customers(spark, sf_dir).withColumn("cohort", F.col("col") % 3).withColumn("score", (F.col("col") * 37 % 101).cast("double"))
    return survival.concordance(scored, by=("cohort",)).select("cohort", "n_pairs", r6("concordance"))


@query
def concordance_customers(spark, sf_dir):
    scored = inputs.customers(spark, sf_dir).withColumn("score", (F.col("col") * 37 % 101).cast("double"))
    return survival.concordance(scored, reverse=True).select("n_pairs", r6("concordance"))


@query
def future_time_customers(spark, sf_dir):
    return survival.future_time(survival.km_curve(inputs.customers(spark, sf_dir))).select("col", r6("future_time"))


@query
def guanrank_elf_customers(spark, sf_dir):
    return survival.guanrank_elf(inputs.customers(spark, sf_dir)).select("col", r6("exp_time"), r6("rank"))


def cox_rows(spark, sf_dir) -> DataFrame:
    """time, status, x of all customers: balance and a code of the nation."""
    known = inputs.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("col"), F.array(F.col("c_acctbal") / 10_000, (F.col("c_nationkey") % 5).cast("double")).alias("x"))
    return inputs.customers(spark, sf_dir).join(known, "col").select("time", "status", "x")


@query
def cox_steps(spark, sf_dir):
    """Log-likelihood, gradient and information with all coefficients 0."""
    model = hazards.CoxModel(cox_rows(spark, sf_dir))
    got = model.at(np.zeros(model.p))
    model.drop()
    rows = [("value", 0, 0, float(got.value))] + [("gradient", i, 0, float(g)) for i, g in enumerate(got.gradient)] + [("information", i, j, float(v)) for (i, j), v in np.ndenumerate(got.information)]
    return spark.createDataFrame(rows, "part string, i int, j int, value double").select("part", "i", "j", r6("value"))


@query
def cox_fit(spark, sf_dir):
    got = hazards.cox(cox_rows(spark, sf_dir))
    rows = [("coefficient", i, float(b)) for i, b in enumerate(got.coefficients)] + [("gain", 0, float(got.value - got.start))]
    return spark.createDataFrame(rows, "part string, i int, value double").select("part", "i", r6("value"))


# --- factorisation


def fixed_fit(spark, sf_dir, with_graph: bool) -> DataFrame:
    x, samples = x_of(spark, sf_dir, clip=True)
    start = {"w0": fixed_w(samples), "h0": fixed_h(x), "maxiter": STEPS, "threshold": 0.0}
    if not with_graph:
        return long_fit(spark, factorise.nmf(x, K, **start), samples)
    edges, degree = cell_graph(spark, sf_dir)
    s = survival.phenotype_s(inputs.patients(spark, sf_dir), "survival").orderBy("col").toPandas()["s"].to_numpy()
    return long_fit(spark, factorise.fit(x, K, s, edges, degree, ALPHA, ALPHA, **start), samples)


@query
def nmf_steps(spark, sf_dir):
    return fixed_fit(spark, sf_dir, False)


@query
def regularised_steps(spark, sf_dir):
    return fixed_fit(spark, sf_dir, True)


@query
def clamped_steps(spark, sf_dir):
    """X keeps its negative entries; what updates make negative or infinite becomes 0."""
    x, samples = x_of(spark, sf_dir)
    start = {"w0": fixed_w(samples), "h0": fixed_h(x), "maxiter": STEPS, "threshold": 0.0}
    return long_fit(spark, factorise.nmf(x, K, guard=True, **start), samples)


@query
def local_steps(spark, sf_dir):
    """The regularised fit on arrays, from the same start as regularised_steps."""
    x, samples = x_of(spark, sf_dir, clip=True)
    edges, degree = cell_graph(spark, sf_dir)
    s = survival.phenotype_s(inputs.patients(spark, sf_dir), "survival").orderBy("col").toPandas()["s"].to_numpy()
    start = {"w0": fixed_w(samples), "maxiter": STEPS, "threshold": 0.0}
    local = selection.local_x(x)
    if local is None:  # no task can hold X: the same fit on tables
        return long_fit(spark, factorise.fit(x, K, s, edges, degree, ALPHA, ALPHA, h0=fixed_h(x), **start), samples)
    array, cells = local
    h0 = np.array([r.h for r in fixed_h(x).orderBy("cell").collect()]).T
    got = factorise.fit_local(array, K, s, *selection.local_graph(edges, degree, cells), ALPHA, ALPHA, h0=h0, **start)
    h = spark.createDataFrame([(int(c), col.tolist()) for c, col in zip(cells, got.h.T, strict=True)], "cell long, h array<double>")
    return long_fit(spark, factorise.Fit(got.w, h, got.iter, got.loss, got.converged), samples)


def sums(spark, sf_dir):
    """X's samples, and XH' and HH' of the fixed start."""
    x, samples = x_of(spark, sf_dir)
    rows, look = ex.seen(x)
    state = factorise.joined(rows.withColumn("d", F.lit(0.0)), fixed_h(x), None, K)
    return x, samples, factorise.partial_sums(state, samples.count(), K, look)


def entries(spark, m: np.ndarray, rows: list, row: str, column: str) -> DataFrame:
    return factorise.w_frame(spark, m, rows).select(F.col("sample").alias(row), F.col("k").alias(column), r6("value"))


@query
def gram_h(spark, sf_dir):
    return entries(spark, sums(spark, sf_dir)[2][1], list(range(K)), "i", "j").withColumn("i", F.col("i").cast("int"))


@query
def xht(spark, sf_dir):
    _, samples, got = sums(spark, sf_dir)
    return entries(spark, got[0], [r["sample"] for r in samples.orderBy("pos").collect()], "sample", "k")


@query
def recon_loss(spark, sf_dir):
    x, samples, (xht, hht, _, _) = sums(spark, sf_dir)
    loss = factorise.squared_loss(ex.fro_norm(x).first()[0] ** 2, fixed_w(samples), xht, hht)
    return spark.createDataFrame([(loss,)], "loss double").select(r6("loss"))


@query
def project_w(spark, sf_dir):
    x, samples = x_of(spark, sf_dir)
    w = factorise.project(x, fixed_h(x), K)
    return factorise.w_frame(spark, w, [r["sample"] for r in samples.orderBy("pos").collect()]).select("sample", "k", r6("value"))


# --- selection


def k_losses(spark, sf_dir) -> DataFrame:
    """Losses of K = 2, 3, ... with three repeats: mean prices by part size."""
    p = inputs.table(spark, sf_dir, "part").where("p_size >= 2")
    return p.groupBy(F.col("p_size").alias("k"), (F.col("p_partkey") % 3).cast("int").alias("repeat")).agg((F.avg("p_retailprice") / F.first("p_size")).alias("loss"))


@query
def elbow_eii(spark, sf_dir):
    return selection.elbow(k_losses(spark, sf_dir)).select("k", r6("mean_loss"), r6("loss_drop"), r6("denom"), r6("eii"))


@query
def select_k(spark, sf_dir):
    x, _ = x_of(spark, sf_dir, clip=True)
    got = selection.select_k(x, k_max=8, repeats=3, maxiter=100)
    return got.summary.withColumn("selected", F.lit(got.selected))


@query
def select_k_steps(spark, sf_dir):
    """K = 2 and 3 from a fixed start."""
    x, samples = x_of(spark, sf_dir, clip=True)
    got = selection.select_k(x, k_max=K, repeats=1, maxiter=STEPS, w0=fixed_w(samples), h0=fixed_h(x))
    return got.summary.select("k", r6("mean_loss"), r6("loss_drop"))


@query
def cv_folds(spark, sf_dir):
    return selection.folds(inputs.patients(spark, sf_dir), 5, F.col("col") * 7919 % 101).select("col", "fold")


@query
def cv_grid(spark, sf_dir):
    return selection.grid(spark, [0.01, 0.005, 0.001], [0.01, 0.005, 0.001], 5)


def cv_results(spark, sf_dir) -> DataFrame:
    """A c-index for each penalty pair and fold: shares of returned items by line and quantity."""
    item = inputs.table(spark, sf_dir, "lineitem")
    share = F.avg(F.when(F.col("l_returnflag") == "R", 1.0).otherwise(0.0))
    return item.groupBy((F.col("l_linenumber") % 3 / 100.0).alias("alpha1"), (F.col("l_suppkey") % 3 / 100.0).alias("alpha2"), (F.col("l_partkey") % 5 + 1).cast("int").alias("fold")).agg(share.alias("cindex"))


@query
def cv_summary(spark, sf_dir):
    return selection.summary(cv_results(spark, sf_dir)).select("alpha1", "alpha2", r6("cindex"))


@query
def cv_best(spark, sf_dir):
    return selection.best(selection.summary(cv_results(spark, sf_dir))).select("alpha1", "alpha2", r6("cindex"))


@query
def cv_pivot(spark, sf_dir):
    got = selection.pivoted(selection.summary(cv_results(spark, sf_dir)), [0.0, 0.01, 0.02])
    return got.select("alpha1", *(r6(F.col(f"`{a}`"), n) for a, n in (("0.0", "a0"), ("0.01", "a1"), ("0.02", "a2"))))


@query
def cv_best_dense(spark, sf_dir):
    return selection.best(selection.summary(cv_results(spark, sf_dir)), [0.02, 0.0, 0.01], [0.01, 0.02, 0.0]).select("alpha1", "alpha2", r6("cindex"))


@query
def cv_ordered(spark, sf_dir):
    """The sorted rows of a cross-validation, numbered."""
    return selection.placed(cv_results(spark, sf_dir)).select(F.col("place").cast("int"), "alpha1", "alpha2", "fold", r6("cindex"))


@query
def fold_s(spark, sf_dir):
    people = selection.folds(inputs.patients(spark, sf_dir), 5, F.col("col") * 7919 % 101)
    return selection.fold_weights(people, 5).select("fold", "col", r6("s"))


@query
def select_alpha(spark, sf_dir):
    """The grid's means, and which pair is the best of either order of ties."""
    x, _ = x_of(spark, sf_dir, clip=True)
    edges, degree = cell_graph(spark, sf_dir)
    got = selection.select_alpha(x, inputs.patients(spark, sf_dir), 2, edges, degree)
    return got.summary.select("alpha1", "alpha2", r6("cindex"), ((F.col("alpha1") == got.alpha1) & (F.col("alpha2") == got.alpha2)).alias("best"))


@query
def fold_fits(spark, sf_dir):
    """W of two folds' models with two pairs of penalties each, fitted side by side from a fixed start."""
    x, samples = x_of(spark, sf_dir, clip=True)
    edges, degree = cell_graph(spark, sf_dir)
    people = selection.folds(inputs.patients(spark, sf_dir), 2, F.col("col") * 7919 % 101).orderBy("col").toPandas()  # a row for each sample
    tasks = selection.fold_models(people, many.square_sums(x), K, (ALPHA,), (ALPHA, 0.0), 2, 7, fixed_w(samples))
    fits = many.fit_many(x, [m for *_, m in tasks], edges, degree, STEPS, 0.0, h0=fixed_h(x), keep_h=False)
    ids = people["col"].to_numpy()
    rows = [(f, b, int(ids[m.rows[i]]), j, float(v)) for (_, b, f, m), got in zip(tasks, fits, strict=True) for (i, j), v in np.ndenumerate(got.fit.w)]
    return spark.createDataFrame(rows, "fold int, alpha2 double, sample long, k int, value double").select("fold", "alpha2", "sample", "k", r6("value"))


@query
def select_k_far(spark, sf_dir):
    """K = 2 and 3 from a fixed start, as for an X that no task can hold."""
    x, samples = x_of(spark, sf_dir, clip=True)
    fits = many.fit_many(x, [many.Model(k, w0=fixed_w(samples)[:, :k]) for k in range(2, K + 1)], maxiter=STEPS, h0=fixed_h(x), keep_h=False)
    rows = [(k, 0, got.fit.loss) for k, got in enumerate(fits, 2)]
    return selection.elbow(spark.createDataFrame(rows, "k int, repeat int, loss double")).select("k", r6("mean_loss"), r6("loss_drop"))


# --- modules


@query
def find_module(spark, sf_dir):
    h = inputs.vectors(spark, sf_dir).select("cell", F.col("v").alias("h"))
    return modules.find_module(h, 1.5)


@query
def find_module_dip(spark, sf_dir):
    h = inputs.vectors(spark, sf_dir).select("cell", F.col("v").alias("h"))
    return modules.find_module(h, 1.5, dip=True)


@query
def find_subset_dip(spark, sf_dir):
    """Two loadings of known modes: discounts' quarters and line numbers far apart, cut between them."""
    item = inputs.table(spark, sf_dir, "lineitem")
    bump = F.when(F.col("l_returnflag") == "R", 10.0).otherwise(0.0)
    h = item.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("cell"), F.array(bump + F.col("l_quantity") / 50, F.col("l_quantity") / 50).alias("h"))
    return modules.find_subset(h, 1, 1.5, dip=True).select("cell", "selected")


@query
def find_subset(spark, sf_dir):
    h = inputs.vectors(spark, sf_dir).select("cell", F.col("v").alias("h"))
    got = modules.find_subset(h, 64, 1.5)
    return got.select("cell", "selected", *(f"subset{i}" for i in range(1, 65)), *(r6(f"subset{i}_loading") for i in range(1, 65)))


# --- preparation


def suppliers(spark, sf_dir) -> DataFrame:
    return inputs.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("col"))


@query
def log_normalize(spark, sf_dir):
    return preprocess.log_normalize(inputs.counts(spark, sf_dir)).select("gene", "col", r6("value"))


@query
def rc_normalize(spark, sf_dir):
    return preprocess.rc_normalize(inputs.counts(spark, sf_dir)).select("gene", "col", r6("value"))


@query
def clr_normalize(spark, sf_dir):
    return preprocess.clr_normalize(inputs.counts(spark, sf_dir)).select("gene", "col", r6("value"))


@query
def scale_data(spark, sf_dir):
    values = preprocess.log_normalize(inputs.counts(spark, sf_dir))
    return preprocess.scale_data(values, suppliers(spark, sf_dir).count()).select("gene", "col", r6("value"))


@query
def variable_genes(spark, sf_dir):
    values = preprocess.log_normalize(inputs.counts(spark, sf_dir))
    return preprocess.variable_genes(values, suppliers(spark, sf_dir).count(), 300, "disp").select("gene", r6("score"))


@query
def variable_genes_mvp(spark, sf_dir):
    values = preprocess.log_normalize(inputs.counts(spark, sf_dir))
    return preprocess.variable_genes(values, suppliers(spark, sf_dir).count(), 300, "mvp").select("gene", r6("score"))


@query
def variable_genes_vst(spark, sf_dir):
    return preprocess.variable_genes(inputs.counts(spark, sf_dir), suppliers(spark, sf_dir).count(), 300, "vst")


@query
def pca(spark, sf_dir):
    values = preprocess.log_normalize(inputs.counts(spark, sf_dir))
    cells = suppliers(spark, sf_dir)
    n = cells.count()
    genes = preprocess.variable_genes(values, n, 50, "disp")
    return preprocess.pca(preprocess.scale_data(values, n), genes, 5, preprocess.scaled_zeros(values, n), cells)


@query
def pca_variance(spark, sf_dir):
    """The variance of all cells over the genes of pca, and that the components are eigenvectors of the exact covariance.

    The covariance comes from sums over all pairs of genes; a component's part off its own direction is measured on it.
    """
    values = preprocess.log_normalize(inputs.counts(spark, sf_dir))
    cells = suppliers(spark, sf_dir)
    n = cells.count()
    genes = preprocess.variable_genes(values, n, 50, "disp")
    rows, zeros, names = components.sparse_rows(preprocess.scale_data(values, n), genes, preprocess.scaled_zeros(values, n), cells)
    got = components.components(rows, len(names), names, 5)
    entries = rows.select("col", F.explode(F.arrays_zip("i", "v")).alias("e")).select("col", "e.i", "e.v")
    pairs = entries.join(entries.select("col", F.col("i").alias("j"), F.col("v").alias("u")), "col").groupBy("i", "j").agg(F.sum(F.col("v") * F.col("u")).alias("s")).collect()  # genes squared
    gram, total = np.zeros((len(names), len(names))), np.zeros(len(names))
    for r in pairs:
        gram[r.i, r.j] = r.s
    for r in entries.groupBy("i").agg(F.sum("v").alias("s")).collect():  # a row for each gene
        total[r.i] = r.s
    v = (gram - np.outer(total, total) / n) / (n - 1)
    off = np.abs(v @ got.vectors - got.vectors * got.variances).max(0)
    rows = [(i + 1, float(got.total), bool(off[i] <= 1e-8 * got.variances[0])) for i in range(5)]
    return spark.createDataFrame(rows, "component int, total double, exact boolean").select("component", r6("total"), "exact")


@query
def prepare_graph(spark, sf_dir):
    """The whole preparation chain: counts normalised, genes chosen and scaled, components, shared neighbours.

    member: src has all links of dst, and one of weight w with it and with dst's other members.
    """
    ready = prepare.prepare(inputs.counts(spark, sf_dir), selection="disp", n_genes=50, dims=5, neighbours=10)
    pairs = ready.graph.select("src", "dst", r6("w"), F.lit(False).alias("member"))
    return pairs.unionByName(ready.members.select(F.col("cell").alias("src"), F.col("like").alias("dst"), r6("w"), F.lit(True).alias("member")))


@query
def markers_logfc(spark, sf_dir):
    values = preprocess.log_normalize(inputs.counts(spark, sf_dir))
    cells = suppliers(spark, sf_dir).withColumn("chosen", (F.col("col") % 3 == 0).cast("int"))
    return preprocess.markers(values, cells).select("gene", *(r6(c) for c in ("log_fc", "u", "z", "p_value", "p_adj")))


@query
def markers_significant(spark, sf_dir):
    values = preprocess.log_normalize(inputs.counts(spark, sf_dir))
    cells = suppliers(spark, sf_dir).withColumn("chosen", (F.col("col") % 3 == 0).cast("int"))
    return preprocess.significant(preprocess.markers(values, cells), 0.05, "p_value").select("gene", r6("log_fc"), r6("p_value"))
