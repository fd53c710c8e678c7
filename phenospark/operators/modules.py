"""Cells of each factor, and their labels."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenospark.operators import scans
from phenospark.sources.tables import cut

#: Points that a factor's distribution is first seen by, at least, and times the root of its cells.
POINTS, PER_ROOT = 100_000, 50
#: Bins of the density in which an antimode is sought.
BINS = 2048

def long_h(h: DataFrame) -> DataFrame:
    """factor (from 1), cell, value of (cell, h)."""
    return h.select("cell", F.posexplode("h").alias("p", "value")).select((F.col("p") + 1).alias("factor"), "cell", "value")


def find_module(h: DataFrame, tred: float = 2.0, dip: bool = False) -> DataFrame:
    """factor, cell where the loading exceeds the factor's mean by more than tred deviations.

    dip: where a dip test rejects one mode (p < 0.05), the cut is the antimode
    of a two-mode density instead.
    """
    long = long_h(h)
    stats = long.groupBy("factor").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("dev"))
    limit = F.col("mean") + F.lit(float(tred)) * F.col("dev")
    if not dip:
        return long.join(stats, "factor").where(F.col("value") - F.col("mean") > F.lit(float(tred)) * F.col("dev")).select("factor", "cell")

    bound = F.when(F.col("antimode").isNull() | F.isnan("antimode"), limit).otherwise(F.col("antimode"))
    return long.join(stats, "factor").join(antimodes(long), "factor", "left").where((F.col("value") > bound) & ~F.isnan("value")).select("factor", "cell")


def thinned(ranked: DataFrame, sizes: DataFrame, points: int, root: int) -> DataFrame:
    """factor, value, rank, n, step: every so many cells of a factor by value, the first and the last; all of a factor
    with no more cells than points, or root times its square root."""
    step = F.greatest(F.lit(1), F.floor(F.col("n") / F.greatest(F.lit(points), F.ceil(F.lit(root) * F.sqrt("n"))))).cast("long")
    rows = ranked.join(sizes.withColumn("step", step), "factor")
    return rows.where((F.col("rank") % F.col("step") == 0) | (F.col("rank") == 1) | (F.col("rank") == F.col("n"))).select("factor", "value", "rank", "n", "step")


def dips(long: DataFrame, points: int = POINTS, root: int = PER_ROOT, level: float = 0.05, draws: int = 200) -> dict[int, bool]:
    """Whether a dip test rejects one mode, by factor; NULL and NaN loadings don't count.

    Cells are ranked by range partitions and carries, so no task holds a factor. The dip
    of every so many ranks is off by the mass between two of them at most, as it is by
    the largest difference of two distributions. Where p lies on both sides of the level
    within that bound, a factor is looked at again with eight times the points, and with all
    of its cells in the end; so thinning decides nothing.
    """
    rows = long.where(F.col("value").isNotNull() & ~F.isnan("value")).select("factor", "cell", F.col("value").cast("double").alias("value"))
    order = ["value", "cell"]
    ranked = cut(scans.running(scans.dealt(rows, ["factor"], order), ["factor"], order, {"rank": F.lit(1)}).select("factor", "value", F.col("rank").cast("long").alias("rank")), "ranks")
    sizes = ranked.groupBy("factor").agg(F.count("*").alias("n"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("rank")
        rank, n = frame["rank"].to_numpy(), int(frame["n"].iloc[0])
        counts = np.diff(rank, prepend=0)
        dip, error = dip_statistic(frame["value"].to_numpy(), counts), (counts.max() - 1) / n
        far, near = (_p_of(d, n, draws) < level for d in (dip + error, max(0.0, dip - error)))
        return pd.DataFrame({"factor": [frame["factor"].iloc[0]], "rejects": [bool(near)], "sure": [bool(far == near)], "whole": [len(frame) == n]})

    out: dict[int, bool] = {}
    while True:
        got = thinned(ranked, sizes, points, root).groupBy("factor").applyInPandas(run, "factor int, rejects boolean, sure boolean, whole boolean").collect()  # a row for each factor
        out |= {r.factor: r.rejects for r in got if r.sure or r.whole}
        left = [r.factor for r in got if not (r.sure or r.whole)]
        if not left:
            return out
        ranked, points, root = ranked.where(F.col("factor").isin(left)), points * 8, root * 8


def antimodes(long: DataFrame) -> DataFrame:
    """factor, antimode of the factors whose dip rejects one mode, from counts in bins of their range."""
    rejected = [f for f, r in dips(long).items() if r]
    rows = long.where(F.col("factor").isin(rejected) & F.col("value").isNotNull() & ~F.isnan("value"))
    ends = rows.groupBy("factor").agg(F.min("value").alias("low"), F.max("value").alias("high"))
    place = F.least(F.lit(BINS - 1), F.floor((F.col("value") - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * BINS)).cast("int")
    counts = rows.join(ends, "factor").groupBy("factor", "low", "high", F.coalesce(place, F.lit(0)).alias("bin")).agg(F.count("*").alias("c"))

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        c = np.bincount(frame["bin"], frame["c"], BINS)
        return pd.DataFrame({"factor": [frame["factor"].iloc[0]], "antimode": [antimode_of(c, float(frame["low"].iloc[0]), float(frame["high"].iloc[0]))]})

    return cut(counts.groupBy("factor").applyInPandas(run, "factor int, antimode double"), "antimodes")  # BINS rows a factor


def find_subset(h: DataFrame, k: int, tred: float = 2.0, positive: str = "selected", other: str = "Other cells", dip: bool = False) -> DataFrame:
    """cell, selected, subset1 ..., subset1_loading ...: one pass over H, no self-join.

    dip: factors of two modes are cut at the antimode, as by :func:`find_module`."""
    stats = h.agg(*(f(F.col("h")[i]).alias(f"{n}{i}") for i in range(k) for n, f in (("m", F.avg), ("s", F.stddev_samp))))
    joined = h.crossJoin(stats)  # one row of 2 k numbers
    hit = [F.col("h")[i] - F.col(f"m{i}") > F.lit(float(tred)) * F.col(f"s{i}") for i in range(k)]
    if dip:
        for r in antimodes(long_h(h)).collect():  # a row for each factor
            if r.factor <= k and r.antimode == r.antimode:
                hit[r.factor - 1] = (F.col("h")[r.factor - 1] > F.lit(r.antimode)) & ~F.isnan(F.col("h")[r.factor - 1])
    label = lambda c: F.when(c, positive).otherwise(other)
    any_hit = hit[0]
    for c in hit[1:]:
        any_hit = any_hit | F.coalesce(c, F.lit(False))
    return joined.select("cell", label(any_hit).alias("selected"), *(label(c).alias(f"subset{i + 1}") for i, c in enumerate(hit)), *(F.col("h")[i].alias(f"subset{i + 1}_loading") for i in range(k)))


def dip_statistic(v: np.ndarray, counts: np.ndarray | None = None) -> float:
    """Hartigan's dip of sorted values: half the largest gap between the distribution and the best unimodal one.
    counts: how many cells each value stands for."""
    v = np.asarray(v, float)
    n = len(v) if counts is None else int(counts.sum())
    if n < 2 or v[0] == v[-1]:
        return 0.5 / max(n, 1)
    x, up = np.unique(v, return_counts=True)
    if counts is not None:
        up = np.add.reduceat(counts, np.cumsum(up) - up)
    high = np.cumsum(up) / n
    low = high - up / n

    def hull(px: np.ndarray, py: np.ndarray, sign: float) -> np.ndarray:
        """The greatest convex minorant (sign 1) or least concave majorant (-1) at px."""
        keep: list[int] = []
        for i in range(len(px)):
            while len(keep) > 1 and sign * ((py[keep[-1]] - py[keep[-2]]) * (px[i] - px[keep[-2]]) - (py[i] - py[keep[-2]]) * (px[keep[-1]] - px[keep[-2]])) >= 0:
                keep.pop()
            keep.append(i)
        return np.interp(px, px[keep], py[keep])

    lo, hi, best = 0, len(x) - 1, 0.5 / n
    while True:
        own = slice(lo, hi + 1)
        convex, concave = hull(x[own], low[own], 1), hull(x[own], high[own], -1)
        gap = concave - convex
        at = int(np.argmax(gap))
        if gap[at] <= 2 * best:
            return float(best)
        # the modal interval: from the last touch of the minorant before the widest gap to the first of the majorant behind it
        below, above = np.flatnonzero(np.isclose(convex[: at + 1], low[own][: at + 1])), np.flatnonzero(np.isclose(concave[at:], high[own][at:])) + at
        left, right = int(below.max(initial=0)), int(above.min(initial=hi - lo))
        outside = np.concatenate([(high[own] - convex)[: left + 1], (concave - low[own])[right:]])
        best = max(best, float(outside.max()) / 2)
        new_lo, new_hi = lo + left, lo + right
        if (new_lo, new_hi) == (lo, hi) or new_hi <= new_lo:
            return float(best)
        lo, hi = new_lo, new_hi


@lru_cache(maxsize=4)
def _null_dips(n: int, draws: int, seed: int) -> np.ndarray:
    """The dips of uniform samples of n, which no data enter: a worker makes them once for all factors."""
    rng = np.random.default_rng(seed)
    return np.array([dip_statistic(np.sort(rng.random(n))) for _ in range(draws)])


#: Size of the samples that a dip is compared with, at most; the dip times sqrt(n) hardly changes beyond.
DIP_SAMPLE = 2000


def _p_of(dip: float, size: int, draws: int = 200, seed: int = 1) -> float:
    n = min(size, DIP_SAMPLE)
    return float(np.mean(_null_dips(n, draws, seed) >= dip * np.sqrt(size / n)))


def dip_p_value(v: np.ndarray, draws: int = 200, seed: int = 1) -> float:
    """The share of uniform samples of the same size with as large a dip; beyond DIP_SAMPLE values by
    the limit law of sqrt(n) times the dip. With 200 draws its standard error is 0.015 at 0.05."""
    return _p_of(dip_statistic(np.sort(np.asarray(v, float))), len(v), draws, seed)


def antimode(v: np.ndarray) -> float:
    """The minimum between two modes of a kernel density at the smallest bandwidth that has two at most."""
    v = np.asarray(v, float)
    return antimode_of(np.histogram(v, BINS)[0], float(v.min()), float(v.max()))


def antimode_of(counts: np.ndarray, least: float, most: float) -> float:
    """:func:`antimode` from counts in equal bins from the least value to the most."""
    at = np.linspace(least, most, 512)
    edges = np.linspace(least, most, len(counts) + 1)
    middle = (edges[1:] + edges[:-1]) / 2

    def turns(h: float) -> tuple[np.ndarray, np.ndarray]:
        z = (at[:, None] - middle[None, :]) / h
        f = np.exp(-0.5 * z * z) @ counts
        s = np.sign(np.diff(f))
        return np.flatnonzero((s[:-1] > 0) & (s[1:] <= 0)) + 1, np.flatnonzero((s[:-1] < 0) & (s[1:] >= 0)) + 1

    if most <= least:
        return float("nan")
    low, high = (most - least) / 1000, most - least
    for _ in range(40):
        h = (low + high) / 2
        low, high = (low, h) if len(turns(h)[0]) <= 2 else (h, high)
    bottoms = turns(high)[1]
    return float(at[bottoms[0]]) if len(bottoms) else float("nan")
