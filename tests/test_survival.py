"""Scans, concordance and hazards over range partitions against brute force, with ties, hot times, keys and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from phenospark.operators import hazards, scans, survival


def people(spark, n=300, hot=0.4, seed=1, parts=6):
    rng = np.random.default_rng(seed)
    time = np.where(rng.random(n) < hot, 50.0, rng.integers(1, 100, n).astype(float))
    status, score = rng.integers(0, 2, n), rng.integers(0, 30, n) / 7.0
    key = np.where(rng.random(n) < 0.6, "a", rng.choice(["b", "c"], n))
    rows = [(int(i), float(t), int(s), float(p), str(k)) for i, (t, s, p, k) in enumerate(zip(time, status, score, key, strict=True))]
    return rows, spark.createDataFrame(rows, "col long, time double, status int, score double, cohort string").repartition(parts)


@pytest.mark.parametrize("by", [(), ("cohort",)])
def test_running_sums(spark, by):
    rows, df = people(spark)
    order = ["time", "col"]
    dealt = scans.dealt(df, by, order, 7)
    got = scans.following(scans.running(scans.running(dealt, by, order, {"up": F.col("score")}), by, order, {"down": F.col("score"), "n": F.lit(1)}, backwards=True), by, order, "time", "after")
    got = scans.running(got, by, order, {"grow": 1 + F.col("score") / 100}, "product")
    assert got.select("part").distinct().count() > 3
    for k in {r[4] for r in rows} if by else {None}:
        own = sorted((r for r in rows if k in (None, r[4])), key=lambda r: (r[1], r[0]))
        score = np.array([r[3] for r in own])
        mine = got.where(F.col("cohort") == k) if k else got
        for i, r in enumerate(mine.orderBy(*order).collect()):
            assert np.allclose([r.up, r.down, r.grow], [score[: i + 1].sum(), score[i:].sum(), np.prod(1 + score[: i + 1] / 100)])
            assert r.n == len(own) - i and r.after == (own[i + 1][1] if i + 1 < len(own) else None)


def brute_concordance(rows):
    pairs = good = 0
    for _, t, s, p, _ in rows:
        for _, u, f, q, _ in rows:
            if s == 1 and (t < u or (t == u and f == 0)):
                pairs, good = pairs + 1, good + (1 if q > p else 0.5 if q == p else 0)
    return pairs, good / pairs if pairs else None


@pytest.mark.parametrize("hot", [0.0, 0.5])
def test_concordance(spark, hot):
    rows, df = people(spark, hot=hot)
    odd = spark.createDataFrame([(900, None, 1, 1.0, "a"), (901, 3.0, None, 1.0, "a"), (902, 3.0, 1, None, "a"), (903, 3.0, 1, float("nan"), "b"), (904, 4.0, 0, 1.0, "d")], df.schema)
    df = df.unionByName(odd).withColumn("weight", F.lit("x")).withColumn("part", F.lit(3))
    want = brute_concordance([*rows, (904, 4.0, 0, 1.0, "d")])
    one = survival.concordance(df).first()
    assert one.n_pairs == want[0] and abs(one.concordance - want[1]) < 1e-12
    assert abs(survival.concordance(df, reverse=True).first().concordance - (1 - want[1])) < 1e-12
    got = {r.cohort: (r.n_pairs, r.concordance) for r in survival.concordance(df, by=("cohort",)).collect()}
    for k in "abc":
        n, c = brute_concordance([r for r in rows if r[4] == k])
        assert got[k][0] == n and abs(got[k][1] - c) < 1e-12
    assert got["d"] == (0, None)
    none = survival.concordance(df.where("false")).first()
    assert (none.n_pairs, none.concordance) == (0, None)


def test_concordance_makes_no_pairs(spark, capsys):
    _, df = people(spark)
    survival.concordance(df).explain()
    plan = capsys.readouterr().out
    assert "BroadcastNestedLoopJoin" not in plan.replace("BroadcastNestedLoopJoin BuildRight, Cross", "").replace("BroadcastNestedLoopJoin BuildLeft, Cross", "") and "CartesianProduct" not in plan


def test_dominated_is_a_double_loop():
    rng = np.random.default_rng(2)
    for n in (0, 1, 2, 37, 200):
        seen = {(int(g), int(p), int(s)) for g, p, s in rng.integers(0, 8, (n, 3))}
        g, p, s = np.array(sorted(seen) or np.zeros((0, 3), int), int).reshape(-1, 3).T
        w, own = rng.integers(1, 5, len(g)), rng.integers(0, 3, len(g))
        got = survival.dominated(g, p, s / 3, w, own)
        for k in range(len(got)):
            want = sum(own[i] * w[j] * (1 if s[j] > s[i] else 0.5 if s[j] == s[i] else 0) for i in range(len(g)) for j in range(len(g)) if g[i] == g[j] == k and p[j] > p[i])
            assert got[k] == want


@pytest.mark.parametrize("unit", [False, True])
def test_expected_times_of_cohorts(spark, unit):
    """Each key by itself gives what all keys at once do."""
    _, df = people(spark, 200)
    together = {r.col: (r.exp_time, r["rank"]) for r in survival.guanrank_elf(df, unit, by=("cohort",)).collect()}
    for k in "abc":
        own = survival.guanrank_elf(df.where(F.col("cohort") == k), unit).toPandas().sort_values(["time", "col"])
        assert all(np.allclose(together[r.col], (r.exp_time, r.rank)) for r in own.itertuples())
        rate = own["survival_rate"].to_numpy()
        if unit:
            assert own["time"].tolist() == list(range(1, len(own) + 1))
            assert np.allclose(own["future_time"], np.cumsum(np.append(rate[:-1], 0)[::-1])[::-1])
        else:
            area = np.append(np.diff(own["time"]) * rate[:-1], 0)
            assert np.allclose(own["future_time"], np.cumsum(area[::-1])[::-1])


@pytest.mark.parametrize(("hot", "collinear"), [(0.0, False), (0.6, False), (0.3, True)])
def test_cox_over_ranges_is_that_of_one_array(spark, hot, collinear):
    rows, df = people(spark, 400, hot)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 3)) + 5
    if collinear:
        x[:, 2] = x[:, 0] - 2 * x[:, 1]
    cox = spark.createDataFrame([(r[1], r[2], v.tolist()) for r, v in zip(rows, x, strict=True)] + [(None, 1, [1.0, 2.0, 3.0]), (2.0, 0, None), (2.0, 0, [1.0, None, 2.0]), (2.0, 1, [1.0, float("nan"), 2.0])], "time double, status int, x array<double>").repartition(5)
    got = hazards.cox(cox)
    want = survival.cox_fit(np.array([r[1] for r in rows]), np.array([r[2] for r in rows]), x)
    # only the linear predictor is determined where columns are collinear
    assert got.converged and np.allclose((x - x.mean(0)) @ got.coefficients, (x - x.mean(0)) @ want, atol=1e-6)


def test_cox_without_patients_or_events(spark):
    none = spark.createDataFrame([], "time double, status int, x array<double>")
    assert len(hazards.cox(none).coefficients) == 0
    alive = spark.createDataFrame([(1.0, 0, [1.0]), (2.0, 0, [2.0])], none.schema)
    assert np.allclose(hazards.cox(alive).coefficients, 0)
    with pytest.raises(ValueError, match="different numbers"):
        hazards.cox(spark.createDataFrame([(1.0, 0, [1.0]), (2.0, 0, [2.0, 1.0])], none.schema))


def test_no_task_sees_all_patients(spark):
    """Of windows and exchanges, only those over a row for each partition are in one partition."""
    _, df = people(spark, 2000, hot=0.0)
    rows = scans.dealt(df, [], ["time", "col"], 8)
    sizes = [r["count"] for r in rows.groupBy("part").count().collect()]
    assert len(sizes) == 8 and max(sizes) < 2 * 2000 / 8
