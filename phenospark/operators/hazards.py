"""Proportional-hazards models over patients that are spread over tasks.

Patients are dealt by ranges of time once, into buckets that stay in place. An evaluation at
given coefficients takes two passes. In the first, each range adds up its patients' risks,
their products with the covariates and with pairs of these. The sums of later ranges are
what a range's risk sets start from; in the second pass it adds its own patients, time by
time, and gives its part of the log-likelihood, gradient and information. A time may lie in
several ranges (times are tied, and a hot one is split): its parts come back as they are,
and are put together on the driver. That gets a few vectors from each range, never patients.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenospark.operators import scans
from phenospark.sources.tables import Bucketed


def risk_sums(x: np.ndarray, risk: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """By group: the sums of risk, risk x and risk x x' (rows of 1 + p + p^2 numbers)."""
    p = x.shape[1]
    out = np.empty((groups, 1 + p + p * p))
    out[:, 0] = np.bincount(group, risk, groups)
    for i in range(p):
        out[:, 1 + i] = np.bincount(group, risk * x[:, i], groups)
        for j in range(i, p):
            out[:, 1 + p + i * p + j] = out[:, 1 + p + j * p + i] = np.bincount(group, risk * x[:, i] * x[:, j], groups)
    return out


def efron(s: np.ndarray, d: np.ndarray, n: np.ndarray, linear: np.ndarray, first: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, gradient and information of event times.

    By time: s and d, the risk sums of all at risk and of the events; n events; the sum of
    their linear predictors, and of their covariates. The k-th of n events takes k/n of d off s.
    """
    p = first.shape[1]
    at = np.repeat(np.arange(len(n)), n)
    share = (np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)) / n[at]
    left = s[at, 0] - share * d[at, 0]
    u = 1 / left
    a, b, uu, fu, ff = (np.bincount(at, v, len(n)) for v in (u, share * u, u * u, share * u * u, share * share * u * u))
    s1, d1, s2, d2 = s[:, 1 : 1 + p], d[:, 1 : 1 + p], s[:, 1 + p :].reshape(-1, p, p), d[:, 1 + p :].reshape(-1, p, p)
    gradient = first.sum(0) - a @ s1 + b @ d1
    cross = np.einsum("t,ti,tj->ij", fu, s1, d1)
    information = np.einsum("t,tij->ij", a, s2) - np.einsum("t,tij->ij", b, d2) - np.einsum("t,ti,tj->ij", uu, s1, s1) + cross + cross.T - np.einsum("t,ti,tj->ij", ff, d1, d1)
    return float(linear.sum() - np.log(left).sum()), gradient, information


@dataclass
class Evaluation:
    value: float
    gradient: np.ndarray
    information: np.ndarray


@dataclass
class CoxFit:
    """Coefficients, the log-likelihood at 0 and at them, steps taken, and whether the last one gained nothing more."""

    coefficients: np.ndarray
    start: float
    value: float
    steps: int
    converged: bool


class CoxModel:
    """patients: time, status, x array<double>. Rows with a null, NaN or infinite entry take no part; shorter x are an error.

    Covariates are centred by their means, which doesn't change coefficients. ``drop`` frees the dealt rows.
    """

    def __init__(self, patients: DataFrame):
        finite = lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False))
        time = F.col("time").cast("double")
        rows = patients.select(time.alias("time"), F.col("status").cast("int").alias("status"), F.col("x").cast("array<double>").alias("x"))
        rows = rows.where(finite(F.col("time")) & F.col("status").isNotNull() & F.col("x").isNotNull() & F.forall("x", finite))
        dealt = scans.dealt(rows.withColumn("tie", F.xxhash64("status", "x")), [], ["time", "tie"]).drop("tie")
        sizes = dealt.agg(F.min(F.size("x")).alias("low"), F.max(F.size("x")).alias("p")).first()
        if sizes.low != sizes.p:
            raise ValueError("patients have different numbers of covariates")
        self.p = int(sizes.p or 0)
        means = dealt.agg(*(F.avg(F.col("x")[i]).alias(f"m{i}") for i in range(self.p))).first() if self.p else []
        self.mean = np.array([m for m in means], float)
        self.rows = Bucketed(dealt, "part")

    def drop(self) -> None:
        self.rows.drop()

    def _parts(self, b: np.ndarray, start: dict[int, np.ndarray] | None) -> list:
        """Without starts: part and its sums; with them: its inner times' share, and the sums of its first and last time."""
        p, mean = self.p, self.mean

        def run(table: pa.Table) -> pa.Table:
            part = table.column("part")[0].as_py()
            x = np.asarray(table.column("x").combine_chunks().flatten()).reshape(-1, p) - mean
            time, event = table.column("time").to_numpy(), table.column("status").to_numpy() == 1
            linear = np.clip(x @ b, -500, 500)
            risk = np.exp(linear)
            if start is None:
                total = risk_sums(x, risk, np.zeros(len(x), np.int64), 1)[0]
                return pa.table({"part": [part], "sums": [total.tolist()]})
            times, at = np.unique(-time, return_inverse=True)  # latest first
            own, dead = risk_sums(x, risk, at, len(times)), risk_sums(x[event], risk[event], at[event], len(times))
            n = np.bincount(at[event], minlength=len(times))
            more = np.column_stack([n, np.bincount(at[event], linear[event], len(times)), *(np.bincount(at[event], x[event, i], len(times)) for i in range(p))])
            edge = np.zeros(len(times), bool)
            edge[[0, -1]] = True
            after = start[part] + np.cumsum(own, 0)
            some = ~edge & (n > 0)
            value, gradient, information = efron(after[some], dead[some], n[some], more[some, 1], more[some, 2:])
            inner = np.concatenate([[value], gradient, information.ravel()])
            ends = [np.concatenate([[-times[i]], after[i] - own[i], own[i], dead[i], more[i]]).tolist() for i in np.flatnonzero(edge)]
            return pa.table({"part": [part], "sums": [inner.tolist()], "ends": pa.array([ends], pa.list_(pa.list_(pa.float64())))})

        schema = "part long, sums array<double>" + ("" if start is None else ", ends array<array<double>>")
        return sorted(self.rows.read().groupBy("part").applyInArrow(run, schema).collect(), key=lambda r: -r.part)  # a row for each range

    def at(self, b: np.ndarray) -> Evaluation:
        """Log-likelihood, gradient and information at coefficients b."""
        p = self.p
        width = 1 + p + p * p
        carry, start = np.zeros(width), {}
        for r in self._parts(b, None):  # the latest range first
            start[r.part] = carry.copy()
            carry += np.array(r.sums)
        value, gradient, information = 0.0, np.zeros(p), np.zeros((p, p))
        edges: dict[float, np.ndarray] = {}
        for r in self._parts(b, start):
            inner = np.array(r.sums)
            value, gradient, information = value + inner[0], gradient + inner[1 : 1 + p], information + inner[1 + p :].reshape(p, p)
            for end in r.ends:
                time, row = end[0], np.array(end[1:])
                if time in edges:  # what lies behind the time is known from its latest range
                    edges[time][width:] += row[width:]
                else:
                    edges[time] = row
        rows = np.array([row for row in edges.values() if row[3 * width] > 0]).reshape(-1, 3 * width + 2 + p)
        if len(rows):
            before, own, dead = (rows[:, i * width : (i + 1) * width] for i in range(3))
            v, g, h = efron(before + own, dead, rows[:, 3 * width].astype(np.int64), rows[:, 3 * width + 1], rows[:, 3 * width + 2 :])
            value, gradient, information = value + v, gradient + g, information + h
        return Evaluation(value, gradient, information)

    def fit(self, steps: int = 30) -> CoxFit:
        """Newton's method from 0, steps halved while the likelihood sinks. Columns that the others determine get 0."""
        b = np.zeros(self.p)
        here = self.at(b)
        start, taken, converged = here.value, 0, not self.p
        while taken < steps and not converged:
            step = np.linalg.pinv(here.information, rcond=1e-9) @ here.gradient
            for _ in range(20):
                new = self.at(b + step)
                if np.isfinite(new.value) and new.value >= here.value - 1e-12:
                    break
                step /= 2
            else:
                break
            gain, b, taken = new.value - here.value, b + step, taken + 1
            here = new
            converged = abs(gain) < 1e-9 * (abs(here.value) + 1e-9)
        return CoxFit(b, start, here.value, taken, converged)


def cox(patients: DataFrame, steps: int = 30) -> CoxFit:
    """The fit of a model of its own; its tables go afterwards."""
    model = CoxModel(patients)
    try:
        return model.fit(steps)
    finally:
        model.drop()
