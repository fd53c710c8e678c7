"""Choice of the rank by an elbow rule, and of the penalties by cross-validation."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phenospark.functions.expression import Similarity, seen
from phenospark.operators import factorise
from phenospark.operators.factorise import fit_local, pinv_project, seed_for
from phenospark.operators.many import Model, fit_many, square_sums
from phenospark.operators.survival import coerce_phenotype, concordance_of, cox_fit, guanrank
from phenospark.sources.tables import cut


def elbow(losses: DataFrame) -> DataFrame:
    """k, mean_loss, loss_drop, denom, eii from (k, repeat, loss); NaN losses don't count."""
    mean = losses.groupBy("k").agg(F.avg(F.when(~F.isnan("loss"), F.col("loss"))).alias("mean_loss"))
    order = Window.orderBy("k")  # a row for each K tried
    drop, denom = F.lag("mean_loss").over(order) - F.col("mean_loss"), F.first("mean_loss").over(order) - F.col("mean_loss")
    return mean.select("k", "mean_loss", drop.alias("loss_drop"), denom.alias("denom"), F.when((F.col("k") > 2) & (denom > 0), drop / denom).alias("eii"))


def stop_here(means: list[float]) -> bool:
    """Whether the last of the mean losses of K = 2, 3, ... ends the search."""
    if len(means) < 2:
        return False
    drop, denom = means[-2] - means[-1], means[0] - means[-1]
    return not drop > 0 or (denom > 0 and drop / denom < 0.05)


@dataclass
class KChoice:
    selected: int
    losses: DataFrame
    summary: DataFrame


def carried(x: DataFrame | Similarity) -> tuple[np.ndarray, pa.Array, Callable[[pa.Array], np.ndarray]] | None:
    """The cells in order, and their rows of X or what these are made of, with what makes them, if X is within
    LOCAL_ENTRIES. X itself is made where it is used: of an X in parts the driver has the parts alone."""
    size = (x.samples, x.rows.count()) if isinstance(x, Similarity) else x.agg(F.max(F.size("x")), F.count("*")).first()
    if (size[0] or 0) * size[1] > factorise.LOCAL_ENTRIES:
        return None
    rows, look = seen(x)
    got = rows.select(F.col("cell").cast("long").alias("cell"), "x").orderBy("cell").toArrow().combine_chunks()
    cells, values = (pa.concat_arrays(got.column(c).chunks) if got.num_rows else pa.array([], got.schema.field(c).type) for c in ("cell", "x"))
    return np.asarray(cells), values, look


def local_x(x: DataFrame | Similarity) -> tuple[np.ndarray, np.ndarray] | None:
    """X as samples x cells in cell order, and the cells, if it is within LOCAL_ENTRIES."""
    got = carried(x)
    return None if got is None else (got[2](got[1]).T, got[0])


def local_graph(edges: DataFrame, d: DataFrame, cells: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray, np.ndarray], np.ndarray]:
    """A graph by the positions of its cells, and their degrees; for graphs within LOCAL_ENTRIES edges."""
    e = edges.select("src", "dst", "w").toPandas()
    degree = d.select("cell", "d").toPandas().set_index("cell")["d"].reindex(cells).fillna(0.0).to_numpy()
    return (np.searchsorted(cells, e["src"]), np.searchsorted(cells, e["dst"]), e["w"].to_numpy()), degree


#: Factors, and entries of their W, that share passes at most: more would take longer than making X, and more memory.
FACTORS, W_ENTRIES = 128, 2_000_000


def grouped_ranks(ranks: list[int], repeats: int, samples: int) -> list[list[int]]:
    """The ranks in runs that are fitted in the same passes, one rank at least in each."""
    most, out = min(FACTORS, W_ENTRIES // max(1, samples)), []
    for k in ranks:
        if not out or repeats * (sum(out[-1]) + k) > most:
            out.append([])
        out[-1].append(k)
    return out


def select_k(x: DataFrame | Similarity, k_max: int = 20, repeats: int = 10, maxiter: int = 2000, seed: int = 0, w0: np.ndarray | None = None, h0: DataFrame | None = None) -> KChoice:
    """Tries K = 2, 3, ... until the drop of the mean loss ends or is below 5 %; the answer is one less.

    w0 (samples x k_max), h0 (cell, h of k_max factors): a start for all repeats,
    of which a K takes the first K factors; else each repeat has a seed of its own.
    An X that no task can hold is read for several K in the same passes; those beyond the end of the search don't count.
    """
    if k_max < 2:
        raise ValueError("k_max has to be 2 at least")
    spark = (x.rows if isinstance(x, Similarity) else x).sparkSession
    local = carried(x)
    seeds = np.random.default_rng(seed).choice(2**31 - 1, (k_max - 1, repeats), replace=False)
    start = None
    if local is not None:
        if h0 is not None:
            start = np.array(h0.orderBy("cell").toPandas()["h"].tolist()).T
        shared, look = spark.sparkContext.broadcast((*local[:2], start)), local[2]  # within LOCAL_ENTRIES
    else:
        samples = x.samples if isinstance(x, Similarity) else x.agg(F.max(F.size("x"))).first()[0] or 0
        shares, ready = {g[0]: g for g in grouped_ranks(list(range(2, k_max + 1)), repeats, samples)}, {}
    means: list[float] = []
    rows: list[tuple[int, int, float]] = []
    for k in range(2, k_max + 1):
        own = [int(v) for v in seeds[k - 2]]
        if local is not None:
            tasks = spark.createDataFrame([(k, i, v) for i, v in enumerate(own)], "k int, repeat int, seed long").repartition(repeats, "repeat")

            def run(frame: pd.DataFrame) -> pd.DataFrame:
                cells, values, start = shared.value
                x = look(values).T
                fits = [fit_local(x, int(r.k), maxiter=maxiter, seed=int(r.seed), cells=cells, w0=None if w0 is None else w0[:, : r.k], h0=None if start is None else start[: r.k]) for r in frame.itertuples()]
                return frame.assign(loss=[f.loss for f in fits])[["k", "repeat", "loss"]]

            got = [(r.k, r.repeat, r.loss) for r in tasks.groupBy("repeat").applyInPandas(run, "k int, repeat int, loss double").collect()]
        else:
            if k in shares:
                models = [Model(j, seed=int(v), w0=None if w0 is None else w0[:, :j]) for j in shares[k] for v in seeds[j - 2]]
                for m, f in zip(models, fit_many(x, models, maxiter=maxiter, h0=h0, keep_h=False), strict=True):
                    ready.setdefault(m.k, []).append(f.fit.loss)
            got = [(k, i, loss) for i, loss in enumerate(ready.pop(k))]
        rows += got
        means.append(float(np.nanmean([v for _, _, v in got])))
        if stop_here(means):
            break
    losses = spark.createDataFrame(rows, "k int, repeat int, loss double")
    return KChoice(max(2, k - 1), losses, elbow(losses))


def folds(samples: DataFrame, k: int, key) -> DataFrame:
    """Adds fold 1 to k: sizes differ by one at most; ``key`` orders the samples."""
    return samples.withColumn("fold", ((F.row_number().over(Window.orderBy(key, "col")) - 1) % k + 1).cast("int"))


def hashed_folds(samples: DataFrame, k: int, seed: int = 0) -> DataFrame:
    n = samples.count()
    if k > n:
        raise ValueError("more folds than samples")
    return folds(samples, k, F.xxhash64(F.lit(seed), "col"))


def grid(spark: SparkSession, alpha1: list[float], alpha2: list[float], k: int) -> DataFrame:
    """alpha1, alpha2, fold: all tasks of a cross-validation, a few dozen rows."""
    one, two = spark.createDataFrame([(a,) for a in alpha1], "alpha1 double"), spark.createDataFrame([(a,) for a in alpha2], "alpha2 double")
    return one.crossJoin(two).crossJoin(spark.range(1, k + 1).select(F.col("id").cast("int").alias("fold")))


def summary(cv: DataFrame) -> DataFrame:
    """alpha1, alpha2, cindex: means over folds; NULL and NaN don't count."""
    return cv.where(F.col("cindex").isNotNull() & ~F.isnan("cindex")).groupBy("alpha1", "alpha2").agg(F.avg("cindex").alias("cindex"))


def ordered(cv: DataFrame) -> DataFrame:
    """The rows of a cross-validation by alpha1, alpha2 and fold."""
    return cv.orderBy("alpha1", "alpha2", "fold")


def placed(cv: DataFrame) -> DataFrame:
    """Adds place, from 1, in that order; a row for each pair and fold."""
    return cv.withColumn("place", F.row_number().over(Window.orderBy("alpha1", "alpha2", "fold")))


def best(means: DataFrame, alpha1: list[float] | None = None, alpha2: list[float] | None = None) -> DataFrame:
    """The pair of the largest mean. Ties go to the smaller penalties; or, where the lists of
    penalties are given, to the first cell of their matrix, column by column (alpha2's order,
    then alpha1's), as the dense path has it."""
    if alpha1 is None or alpha2 is None:
        return means.orderBy(F.desc("cindex"), "alpha1", "alpha2").limit(1)
    place = [F.array_position(F.array(*map(F.lit, values)), F.col(c)) for c, values in (("alpha2", alpha2), ("alpha1", alpha1))]
    return means.orderBy(F.desc("cindex"), *place).limit(1)


@dataclass
class AlphaChoice:
    """The best pair, and the tables it comes from: cv (by alpha1, alpha2, fold), summary (best
    first), matrix (a row for each alpha1, a column for each alpha2)."""

    alpha1: float
    alpha2: float
    cv: DataFrame
    summary: DataFrame
    matrix: DataFrame


def chosen(cv: DataFrame, alpha1: tuple[float, ...], alpha2: tuple[float, ...], ties: str = "large") -> AlphaChoice:
    """The choice from the rows of a cross-validation; ties="dense": the dense path's order."""
    if ties not in ("large", "dense"):
        raise ValueError("ties is large or dense")
    means = summary(cv)
    top = best(means, *((list(alpha1), list(alpha2)) if ties == "dense" else ())).first()
    if top is None:
        raise ValueError("no pair of penalties has a c-index")
    return AlphaChoice(top.alpha1, top.alpha2, ordered(cv), means.orderBy(F.desc("cindex"), "alpha1", "alpha2"), pivoted(means, list(alpha2)))


def pivoted(means: DataFrame, alpha2: list[float]) -> DataFrame:
    """A row for each alpha1, a column for each alpha2."""
    return means.groupBy("alpha1").pivot("alpha2", alpha2).agg(F.first("cindex"))


def rank_array(time: np.ndarray, status: np.ndarray) -> np.ndarray:
    """:func:`survival.guanrank` of arrays, by sums over the distinct times."""
    _, at, n = np.unique(time, return_inverse=True, return_counts=True)
    n0, n1, events = (np.bincount(at, v, len(n)) for v in (status == 0, status == 1, status))
    behind = lambda v: np.cumsum(v[::-1])[::-1]
    risk = behind(n)
    r = np.cumprod(1 - events / risk)
    with np.errstate(divide="ignore", invalid="ignore"):
        inverse = np.where(n0 > 0, n0 / r, 0.0)
        until = np.cumsum(inverse)
        event = risk - n + r * until + 0.5 * n1
        censored = behind(n0) - 0.5 * behind(n0 * r) / r + behind(n1) - behind(n1 * r) / r + 0.5 * r * (until - inverse)
    raw = np.select([status == 1, status == 0], [event[at], censored[at]], 0.0) - 0.5
    return raw / raw.max()


def train_s(people: pd.DataFrame, fold: int) -> np.ndarray:
    """The phenotype weights, 1 less the rank, of the samples outside a fold, ranked among themselves."""
    train = people[people["fold"] != fold]
    return 1 - rank_array(train["time"].to_numpy(float), train["status"].to_numpy(int))


def fold_weights(people: DataFrame, k: int) -> DataFrame:
    """fold, col, s: :func:`train_s` of all folds, on tables. people: col, time, status, fold."""
    train = people.withColumn("out", F.explode(F.sequence(F.lit(1), F.lit(k)))).where(F.col("fold") != F.col("out"))
    return guanrank(train, by=("out",)).select(F.col("out").alias("fold"), "col", (1 - F.col("rank")).alias("s"))


CV = "alpha1 double, alpha2 double, fold int, cindex double, iter int, loss double"


def _judged(time: np.ndarray, status: np.ndarray, test: np.ndarray, train_w: np.ndarray, test_w: np.ndarray, reverse: bool) -> float:
    """The concordance of the test rows under a Cox model of the train rows."""
    b = cox_fit(time[~test], status[~test], train_w)
    score = (test_w - train_w.mean(0)) @ b
    return concordance_of(time[test], status[test], -score if reverse else score)


def fold_models(people: pd.DataFrame, squares: np.ndarray, k: int, alpha1: tuple[float, ...], alpha2: tuple[float, ...], cross_k: int, seed: int, w0: np.ndarray | None = None) -> list[tuple[float, float, int, Model]]:
    """Every task of the grid as a model: the train samples of its fold, scaled to norm 1 by X's sums of squares by sample."""
    out = []
    for fold in range(1, cross_k + 1):
        rows = np.flatnonzero((people["fold"] != fold).to_numpy())
        norm, s = float(np.sqrt(squares[rows].sum())), train_s(people, fold)
        scale = 1 / norm if np.isfinite(norm) and norm > 0 else 1.0
        out += [(a, b, fold, Model(k, rows, scale, s, a, b, seed, None if w0 is None else w0[rows])) for a in alpha1 for b in alpha2]
    return out


def select_alpha(x: DataFrame | Similarity, patients: DataFrame, k: int, edges: DataFrame | None = None, d: DataFrame | None = None, alpha1: tuple[float, ...] = (0.01, 0.005, 0.001), alpha2: tuple[float, ...] = (0.01, 0.005, 0.001), cross_k: int = 5, seed: int = 0, model_seed: int | None = None, method: str = "survival", maxiter: int = 2000, reverse: bool = False, ties: str = "large") -> AlphaChoice:
    """The best pair of penalties; see :func:`cross_validate` and :func:`chosen`."""
    cv = cut(cross_validate(x, patients, k, edges, d, alpha1, alpha2, cross_k, seed, model_seed, method, maxiter, reverse), "cv")
    return chosen(cv, alpha1, alpha2, ties)


def cross_validate(x: DataFrame | Similarity, patients: DataFrame, k: int, edges: DataFrame | None = None, d: DataFrame | None = None, alpha1: tuple[float, ...] = (0.01, 0.005, 0.001), alpha2: tuple[float, ...] = (0.01, 0.005, 0.001), cross_k: int = 5, seed: int = 0, model_seed: int | None = None, method: str = "survival", maxiter: int = 2000, reverse: bool = False) -> DataFrame:
    """alpha1, alpha2, fold, cindex, iter, loss of every task of the grid.

    patients: col, time, status, or col, label of a binary phenotype, which is
    taken as survival; in the order of X's samples by col. Train rows
    are scaled to norm 1, test rows aren't. Cox models on W score the test rows;
    concordance is that of the score with time, so good models lie below one
    half unless ``reverse``. All pairs of a fold start from the same factors.
    """
    spark = patients.sparkSession
    local = carried(x)
    if "label" in patients.columns and "time" not in patients.columns:
        patients = coerce_phenotype(patients)
    people = hashed_folds(patients, cross_k, seed).orderBy("col").toPandas()
    if len(people) != (x.samples if isinstance(x, Similarity) else x.agg(F.max(F.size("x"))).first()[0] or 0):
        raise ValueError("phenotype and X differ in their samples")
    start = factorise.drawn_seed(seed_for(method, model_seed))
    if edges is not None and local is not None and edges.count() > factorise.LOCAL_ENTRIES:
        local = None  # the graph is too large for one task
    if local is None:
        # all fits in the same passes; held-out samples are projected from the sums that these take anyway
        tasks = fold_models(people, square_sums(x), k, alpha1, alpha2, cross_k, start)
        time, status = people["time"].to_numpy(float), people["status"].to_numpy(int)
        rows = []
        for (a, b, f, _), got in zip(tasks, fit_many(x, [m for *_, m in tasks], edges, d, maxiter, keep_h=False), strict=True):
            test = (people["fold"] == f).to_numpy()
            rows.append((a, b, f, _judged(time, status, test, got.fit.w, pinv_project(got.xht[test], got.hht), reverse), got.fit.iter, got.fit.loss))
        return spark.createDataFrame(rows, CV)
    cells, values, look = local
    links, degree = (None, None) if edges is None else local_graph(edges, d, cells)
    shared = spark.sparkContext.broadcast((cells, values, people, links, degree))  # within LOCAL_ENTRIES

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        cells, values, people, links, degree = shared.value
        array, out = look(values).T, []
        for t in frame.itertuples():
            test = (people["fold"] == t.fold).to_numpy()
            time, status = people["time"].to_numpy(float), people["status"].to_numpy(int)
            train = array[~test]
            norm = np.sqrt((train**2).sum())
            train = train / norm if np.isfinite(norm) and norm > 0 else train
            got = fit_local(train, k, train_s(people, t.fold), links, degree, t.alpha1, t.alpha2, maxiter, seed=start, cells=cells)
            c = _judged(time, status, test, got.w, pinv_project(array[test] @ got.h.T, got.h @ got.h.T), reverse)
            out.append((t.alpha1, t.alpha2, t.fold, c, got.iter, got.loss))
        return pd.DataFrame(out, columns=["alpha1", "alpha2", "fold", "cindex", "iter", "loss"])

    tasks = grid(spark, list(alpha1), list(alpha2), cross_k)
    return tasks.groupBy("alpha1", "alpha2", "fold").applyInPandas(run, CV)
