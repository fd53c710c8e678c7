"""Survival estimates and ranks by scans over time (see :mod:`scans`), O(n log n) in the patients.

Tables: col (the patient), time, status (1 event, 0 censored). ``by`` adds keys,
such as a fold, for which each group is ranked on its own. Patients without a time are
left out, and so are those with a null key: keys meet in joins.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenospark.operators import scans


def _rates(at: DataFrame, keys: list[str]) -> DataFrame:
    """The rows by distinct time, dealt, with risk (who is there at the time) and survival_rate."""
    rows = scans.dealt(at.where("time IS NOT NULL"), keys, ["time"])
    risk = scans.running(rows, keys, ["time"], {"risk": F.col("n")}, backwards=True)
    return scans.running(risk, keys, ["time"], {"survival_rate": 1 - F.col("events") / F.col("risk")}, "product")


def km_curve(patients: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds survival_rate at each patient's time (Kaplan-Meier)."""
    keys = list(by)
    at = patients.groupBy(*keys, "time").agg(F.sum("status").alias("events"), F.count("*").alias("n"))
    return patients.join(_rates(at, keys).select(*keys, "time", "survival_rate"), [*keys, "time"])


def future_time(curve: DataFrame, unit_time: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds future_time: the area under the curve from each patient's time on (0 at the end).

    unit_time: times are the places in the order of time and col, from 1.
    """
    keys = list(by)
    if unit_time:
        order = ["time", "col"]
        rows = scans.following(scans.dealt(curve.where("time IS NOT NULL"), keys, order), keys, order, "time", "after")
        rows = scans.running(rows, keys, order, {"place": F.lit(1)})
        rows = scans.running(rows, keys, order, {"future_time": F.when(F.col("after").isNotNull(), F.col("survival_rate")).otherwise(0.0)}, backwards=True)
        return rows.select(*keys, *(F.col("place").alias(c) if c == "time" else F.col(c) for c in curve.columns if c not in keys), "future_time")
    # patients of one time share what is to come
    at = curve.where("time IS NOT NULL").groupBy(*keys, "time").agg(F.min("survival_rate").alias("rate"))
    rows = scans.following(scans.dealt(at, keys, ["time"]), keys, ["time"], "time", "after")
    area = F.coalesce((F.col("after") - F.col("time")) * F.col("rate"), F.lit(0.0))
    return curve.join(scans.running(rows, keys, ["time"], {"future_time": area}, backwards=True).select(*keys, "time", "future_time"), [*keys, "time"])


def guanrank_elf(patients: DataFrame, unit_time: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds exp_time and rank (1 less the scaled expected time)."""
    keys, order = list(by), ["time", "col"]
    t = future_time(km_curve(patients, by), unit_time, by)
    t = scans.following(scans.dealt(t, keys, order), keys, order, "time", "after").drop("part")
    after = F.col("after")
    rest = F.coalesce(F.try_divide("future_time", "survival_rate"), (after - F.col("time")) * 0.5)
    t = t.withColumn("exp_time", F.when(after.isNull() | (F.col("status") != 0), F.col("time")).otherwise(F.col("time") + rest)).drop("after")
    ends = t.groupBy(*keys).agg(F.min("exp_time").alias("low"), F.max("exp_time").alias("high"))
    t = t.join(ends, keys) if keys else t.crossJoin(ends)  # one row a key
    return t.withColumn("rank", 1 - F.try_divide(F.col("exp_time") - F.col("low"), F.col("high") - F.col("low"))).drop("low", "high")


def guanrank(patients: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Adds survival_rate and rank: pairwise risk ranks, the largest being 1.

    Patients of one time share all sums over pairs. So they are added up by time
    first; each sum over pairs is then a running sum over the distinct times with
    a conditional input, and the patients are joined with their time's row.
    """
    keys = list(by)
    at = patients.groupBy(*keys, "time").agg(F.count("*").alias("n"), *(F.count(F.when(F.col("status") == s, 1)).cast("double").alias(f"n{s}") for s in (0, 1)), F.sum("status").alias("events"))
    at = _rates(at, keys)
    r, zero = F.col("survival_rate"), F.lit(0.0)
    at = at.withColumn("inverse", F.when(F.col("n0") > 0, F.col("n0") / F.nullif(r, zero)).otherwise(zero))
    at = scans.running(at, keys, ["time"], {"until": F.col("inverse")})
    at = scans.running(at, keys, ["time"], {"m0": F.col("n0"), "m1": F.col("n1"), "r0": F.col("n0") * r, "r1": F.col("n1") * r}, backwards=True)
    event = F.col("risk") - F.col("n") + r * F.col("until") + 0.5 * F.col("n1")
    censored = F.col("m0") - 0.5 * F.col("r0") / F.nullif(r, zero) + F.col("m1") - F.col("r1") / F.nullif(r, zero) + 0.5 * r * (F.col("until") - F.col("inverse"))
    at = at.select(*keys, "time", "survival_rate", (event - 0.5).alias("event"), (censored - 0.5).alias("censored"), "n0", "n1", "n")
    # patients of another status stay at the start, -0.5
    highest = F.greatest(F.max(F.when(F.col("n1") > 0, F.col("event"))), F.max(F.when(F.col("n0") > 0, F.col("censored"))), F.max(F.when(F.col("n") > F.col("n0") + F.col("n1"), -0.5)))
    top = at.groupBy(*keys).agg(highest.alias("highest"))
    at = at.join(top, keys) if keys else at.crossJoin(top)  # one row a key
    raw = F.when(F.col("status") == 1, F.col("event")).when(F.col("status") == 0, F.col("censored")).otherwise(F.lit(-0.5))
    joined = patients.join(at.drop("n0", "n1", "n"), [*keys, "time"])
    return joined.withColumn("rank", raw / F.col("highest")).drop("event", "censored", "highest")


def coerce_phenotype(labels: DataFrame) -> DataFrame:
    """A binary phenotype as survival: label 1 is an event at 1, label 0 censored at 100."""
    yes = F.col("label") != 0
    return labels.select("col", F.when(yes, 1.0).otherwise(100.0).alias("time"), F.when(yes, 1).otherwise(0).alias("status"))


def phenotype_s(patients: DataFrame, method: str) -> DataFrame:
    """col, s: 1 less the rank (survival) or the label (binary)."""
    if method == "survival":
        return guanrank(patients).select("col", (1 - F.col("rank")).alias("s"))
    if method == "binary":
        return patients.select("col", (1 - F.col("label").cast("double")).alias("s"))
    raise ValueError("method is survival or binary")


def dominated(group: np.ndarray, place: np.ndarray, score: np.ndarray, weight: np.ndarray, own: np.ndarray, half: float = 0.5) -> np.ndarray:
    """By group number, the sum over its rows i of own[i] times the weight of its rows of a later place with a
    higher score, plus ``half`` the weight of those with an equal one. No two rows of a group share place and score.

    A merge count: rows stand in the order of group and place, and in blocks of 1, 2, 4, ... the
    first half of each looks up how much of the second half is above it.
    """
    out = np.zeros(int(group.max()) + 1 if len(group) else 0)
    _, rank = np.unique(score, return_inverse=True)
    most = int(rank.max()) + 1 if len(rank) else 1
    order = np.lexsort((-rank, place, group))  # within a place from the highest score, so none of the place counts
    group, rank, weight, own = group[order], rank[order], weight[order].astype(float), own[order].astype(float)
    at = np.arange(len(group))
    size = 1
    while size < len(group):
        block = at // (2 * size)
        late = (at // size) % 2 == 1
        # rows of a block and group follow each other, by score
        key = (block * len(out) + group) * most + rank
        right = np.flatnonzero(late)
        right = right[np.argsort(key[right], kind="stable")]
        sums = np.concatenate([[0.0], np.cumsum(weight[right])])
        left = np.flatnonzero(~late & (own != 0))
        ends = [np.searchsorted(key[right], k, side) for k, side in ((key[left], "left"), (key[left], "right"), ((block[left] * len(out) + group[left] + 1) * most, "left"))]
        above, equal = sums[ends[2]] - sums[ends[1]], sums[ends[1]] - sums[ends[0]]
        out += np.bincount(group[left], own[left] * (above + half * equal), len(out))
        size *= 2
    return out


def _counted(rows: DataFrame, deal: str, keys: list[str], places: list[str], score: str, half: float = 0.5) -> DataFrame:
    """keys, good: :func:`dominated` of the rows within each value of ``deal``, which a task can hold."""
    types = dict(rows.dtypes)

    def run(table: pa.Table) -> pa.Table:
        c = {name: table.column(name).to_numpy() for name in (*places, score, "weight", "own")}
        place = np.zeros(table.num_rows, np.int64)
        for name in places:
            values, code = np.unique(c[name], return_inverse=True)
            place = place * len(values) + code
        # groups are numbered by their first rows
        number = pa.table({"_row": np.arange(table.num_rows)} | {k: table.column(k) for k in keys})
        first = number.group_by(keys).aggregate([("_row", "min")])
        group = np.zeros(table.num_rows, np.int64)
        if keys:
            each = number.join(first.append_column("_group", pa.array(np.arange(first.num_rows))), keys)
            group[each.column("_row").to_numpy()] = each.column("_group").to_numpy()
        return first.select(keys).append_column("good", pa.array(dominated(group, place, c[score], c["weight"], c["own"], half)))

    return rows.select(deal, *keys, *places, score, "weight", "own").groupBy(deal).applyInArrow(run, ", ".join([*(f"{k} {types[k]}" for k in keys), "good double"]))


def concordance(scored: DataFrame, reverse: bool = False, by: tuple[str, ...] = ()) -> DataFrame:
    """One row (for each key): the share of comparable pairs that score orders like time; ties of score count half.

    A pair is comparable if the earlier time is an event (or both times are equal and just
    one is, the other censored). Higher scores go with later times, so a risk score gives
    values below one half; reverse=True turns that round. Rows with a null or NaN time,
    status or score take no part; no comparable pair: null.

    Pairs are counted without being made. Patients are dealt by ranges of time, each range
    counts its own pairs (:func:`dominated`). For pairs of different ranges, rows are added
    up by score and range of time and dealt by ranges of score, which count their own pairs
    again; what lies in different ranges of both is counted on the sums by both, a table of
    no more rows than partitions squared (for each key).
    """
    keys = list(by)
    usable = F.col("time").isNotNull() & F.col("status").isNotNull() & F.col("score").isNotNull() & ~F.isnan(F.col("time").cast("double")) & ~F.isnan(F.col("score").cast("double"))
    event = F.when(F.col("status") == 1, 1).otherwise(0)
    # censored patients of a time come behind all others of it
    rows = scored.where(usable).select(*keys, F.col("time").cast("double").alias("time"), F.when(F.col("status") == 0, 1).otherwise(0).alias("late"), F.col("score").cast("double").alias("score"), event.alias("event"))
    rows = rows.groupBy(*keys, "time", "late", "score").agg(F.count("*").cast("double").alias("weight"), F.sum("event").cast("double").alias("own"))
    rows = scans.dealt(rows, keys, ["time", "late", F.desc("score")])
    near = _counted(rows, "part", keys, ["time", "late"], "score")
    sums = rows.withColumnRenamed("part", "range").groupBy(*keys, "score", "range").agg(F.sum("weight").alias("weight"), F.sum("own").alias("own"))
    sums = scans.dealt(sums, keys, ["score"])
    beside = _counted(sums, "part", keys, ["range"], "score")
    both = sums.groupBy(*keys, "range", "part").agg(F.sum("weight").alias("weight"), F.sum("own").alias("own"))
    far = _counted(both.withColumn("all", F.hash(*keys) if keys else F.lit(0)), "all", keys, ["range"], "part", 0.0)
    good = near.unionByName(beside).unionByName(far).groupBy(*keys).agg(F.sum("good").alias("good"))
    at = rows.groupBy(*keys, "time").agg(F.sum("weight").alias("n"), F.sum("own").alias("events"), F.sum(F.col("weight") * F.col("late")).alias("censored"))
    at = scans.running(scans.dealt(at, keys, ["time"]), keys, ["time"], {"risk": F.col("n")}, backwards=True)
    pairs = at.groupBy(*keys).agg(F.coalesce(F.sum(F.col("events") * (F.col("risk") - F.col("n") + F.col("censored"))), F.lit(0.0)).cast("long").alias("n_pairs"))
    found = pairs.join(good, keys) if keys else pairs.crossJoin(good)  # one row a key
    share = F.col("good") / F.nullif(F.col("n_pairs"), F.lit(0))
    return found.select(*keys, "n_pairs", (1 - share if reverse else share).alias("concordance"))


def cox_fit(time: np.ndarray, status: np.ndarray, x: np.ndarray, steps: int = 30) -> np.ndarray:
    """Coefficients of a proportional-hazards model (Efron ties), by Newton with halved steps.

    Columns that the others determine get 0.
    """
    order = np.argsort(-time, kind="stable")
    time, status, x = time[order], status[order], x[order] - x.mean(0)
    n, p = x.shape

    def at(b: np.ndarray):
        risk = np.exp(np.clip(x @ b, -500, 500))
        s0, s1, s2 = 0.0, np.zeros(p), np.zeros((p, p))
        value, slope, curve = 0.0, np.zeros(p), np.zeros((p, p))
        i = 0
        while i < n:
            j = i
            while j < n and time[j] == time[i]:
                j += 1
            own = slice(i, j)
            s0, s1, s2 = s0 + risk[own].sum(), s1 + risk[own] @ x[own], s2 + (x[own] * risk[own, None]).T @ x[own]
            dead = np.flatnonzero(status[own] == 1) + i
            if len(dead):
                d0, d1, d2 = risk[dead].sum(), risk[dead] @ x[dead], (x[dead] * risk[dead, None]).T @ x[dead]
                value, slope = value + (x[dead] @ b).sum(), slope + x[dead].sum(0)
                for k in range(len(dead)):
                    f = k / len(dead)
                    a0, a1, a2 = s0 - f * d0, s1 - f * d1, s2 - f * d2
                    value, slope = value - np.log(a0), slope - a1 / a0
                    curve += a2 / a0 - np.outer(a1, a1) / a0**2
            i = j
        return value, slope, curve

    b = np.zeros(p)
    value, slope, curve = at(b)
    for _ in range(steps):
        step = np.linalg.pinv(curve, rcond=1e-9) @ slope
        for _ in range(20):
            new = at(b + step)
            if np.isfinite(new[0]) and new[0] >= value - 1e-12:
                break
            step /= 2
        else:
            break
        gain, b = new[0] - value, b + step
        value, slope, curve = new
        if abs(gain) < 1e-9 * (abs(value) + 1e-9):
            break
    return b


def concordance_of(time: np.ndarray, status: np.ndarray, score: np.ndarray) -> float:
    """:func:`concordance` of arrays; NaN without comparable pairs."""
    first = (status[:, None] == 1) & ((time[:, None] < time[None, :]) | ((time[:, None] == time[None, :]) & (status[None, :] == 0)))
    np.fill_diagonal(first, False)
    sign = np.sign(score[None, :] - score[:, None])[first]
    return float(((sign > 0) + 0.5 * (sign == 0)).mean()) if len(sign) else float("nan")
