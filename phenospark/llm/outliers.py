"""Robust multivariate outliers among documents (operator 11), in DataFrame operations alone.

Each text gives base counts and six transformed statistics: the log of the mean word
length, and ln(1 + 20 share) of symbols to words, repeated lines to lines, words in
repeated 3-word windows to words, capitals and other marks to characters. They are kept
as whole multiples of 1/1024, so all their sums are exact, whatever the order.

The minimum covariance determinant is estimated for each language and source: sources of
fewer than ``least`` documents are taken together by language, languages that have too
few of these taken together again. Four starts (coordinatewise median and quartile range,
all documents, hyperbolic tangents, spatial signs) go through concentration steps: a step
takes the distances of all documents to the estimate, keeps those nearest until at least
``share`` of the group is in, and estimates again, until the determinant sinks no more.
The start with the least determinant stays; it is made consistent for the normal
distribution, estimated once more from all documents within its 97.5 % ellipsoid, and
documents beyond the ``inside`` quantile of the final squared distance are rejected.
``FLOORS`` squared are added to each covariance's diagonal, the least spread by which a
statistic counts: most groups have no repeated line at all, and a document with one, a
license line say, is no outlier for that; half the lines are. (So it is the determinant
of the regularised covariance.)

A step is one pass over the table of statistics: documents meet their group's estimates,
are counted and summed by group, start and bucket of distance (1/32 in the log, so a
half-subset has whole buckets and ties stay together), and a window over the buckets of
a group takes the nearest ones. Groups are dealt to cells of some ``CELL_ROWS``
documents for the join, so a hot group is many tasks; sums are added up before they are
shuffled. Nothing of the documents reaches the driver, only whether a step improved
anything.

Null or empty texts, and texts of white space: no words, base_failed, no vector, no part
in estimates. Null lang or source: a language or source of its own. Very long texts are
one row each, n log n in their words. Repeated rows and copies count as often as they are
there. A group smaller than ``least`` after all pooling is estimated all the same; one of
a single document has it at distance 0. Empty table: no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
from itertools import combinations_with_replacement

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phenospark.llm.common import written

WORD, SPACE_ONLY = r"[^\x20\x09-\x0D]+", r"[^\x20\x09-\x0D]"
#: Statistics, and the spread by which each counts at least.
FLOORS = {"word_length": 0.10, "symbols": 0.25, "dup_lines": 0.6, "repeats": 0.6, "capitals": 0.20, "marks": 0.20}
NAMES = tuple(FLOORS)
P = len(NAMES)
PAIRS = tuple(combinations_with_replacement(range(P), 2))
UNIT = 1024
#: Buckets of ln(squared distance), documents of a cell, concentration steps at most.
BUCKETS, CELL_ROWS, STEPS = 32, 20_000, 50
GROUP = ("g_lang", "g_source")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_windows(df: DataFrame) -> DataFrame:
    """Adds n_repeat_words: of the array w, the places that a 3-word window found twice or more covers.

    Windows are sorted by a hash with the place in its low bits. Neighbours with equal
    high bits are candidates, whose words themselves are compared then.
    """
    at = lambda i: [F.get("w", i + j) for j in range(3)]
    high = lambda x: x.bitwiseAND(F.bitwise_not(F.col("mask")))
    beside = lambda same, name: lambda x, j: F.coalesce(same(x, F.get(name, j - 1)), F.lit(False)) | F.coalesce(same(x, F.get(name, j + 1)), F.lit(False))
    df = df.withColumn("mask", F.expr("shiftleft(1L, CAST(ceil(log2(size(w) + 1.0D)) AS INT)) - 1L"))
    places = F.when(F.size("w") >= 3, F.sequence(F.lit(0), F.size("w") - 3)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn("keys", F.sort_array(F.transform(places, lambda i: high(F.xxhash64(*at(i))).bitwiseOR(i.cast("long")))))
    df = df.withColumn("some", F.filter("keys", beside(lambda x, y: high(x) == high(y), "keys"))).drop("keys")
    window = lambda x: F.struct(F.concat_ws(" ", *at(x.bitwiseAND(F.col("mask")).cast("int"))).alias("g"), x.bitwiseAND(F.col("mask")).cast("int").alias("i"))
    df = df.withColumn("windows", F.sort_array(F.transform("some", window))).drop("some", "mask")
    df = df.withColumn("found", F.sort_array(F.transform(F.filter("windows", beside(lambda x, y: x["g"] == y["g"], "windows")), lambda x: x["i"]))).drop("windows")
    covers = F.transform("found", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("found", j + 1) - p, F.lit(3))))
    return df.withColumn("n_repeat_words", F.aggregate(covers, F.lit(0).cast("long"), lambda a, b: a + b)).drop("found")


def counted(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, BASE counts, base_failed, and the vector's whole numbers by name (null without words)."""
    text = F.col("text")
    only = lambda kept: F.length(F.regexp_replace(text, f"[^{kept}]+", "")).cast("long")
    t = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(SPACE_ONLY))
    t = t.select(
        "doc_id", "lang", "source", only("#*$%&|<>").alias("n_symbols"), only(r"\p{Lu}").alias("n_capitals"), only(r"\p{Punct}").alias("n_marks"),
        lines.alias("lines"), F.regexp_extract_all(text, F.lit(WORD), F.lit(0)).alias("w"),
    )
    t = t.withColumn("n_lines", F.size("lines")).withColumn("n_dup_lines", (F.col("n_lines") - F.size(F.array_distinct("lines"))).cast("long")).drop("lines")
    t = repeated_windows(t).withColumn("n_words", F.size("w").cast("long")).withColumn("word_chars", F.length(F.concat_ws("", "w")).cast("long")).drop("w")
    share = lambda part, whole: F.log1p(20 * F.try_divide(F.col(part).cast("double"), F.col(whole).cast("double")))
    t = t.withColumn("n_marks", F.col("n_marks") - F.col("n_symbols"))
    z = {
        "word_length": F.log(F.try_divide(F.col("word_chars").cast("double"), F.col("n_words").cast("double"))), "symbols": share("n_symbols", "n_words"), "dup_lines": share("n_dup_lines", "n_lines"),
        "repeats": share("n_repeat_words", "n_words"), "capitals": share("n_capitals", "word_chars"), "marks": share("n_marks", "word_chars"),
    }
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return t.select("doc_id", "lang", "source", *BASE, failed.alias("base_failed"), *(F.round(v * UNIT).cast("long").alias(k) for k, v in z.items()))


def grouped(rows: DataFrame, least: int) -> DataFrame:
    """The rows with their group, and the cell of the group that each is in."""
    key = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("0"))
    keyed = rows.withColumn("k_lang", key("lang")).withColumn("k_source", key("source"))
    sizes = written(keyed.where(F.col(NAMES[0]).isNotNull()).groupBy("k_lang", "k_source").agg(F.count("*").alias("n")), "groups")
    small = sizes.where(F.col("n") < least)
    by_lang = small.groupBy("k_lang").agg(F.sum("n").alias("of_lang"))
    pooled = sizes.join(by_lang, "k_lang", "left")
    alone, rest = F.col("n") >= least, F.col("of_lang") < least
    g_lang = F.when(~alone & rest, "*").otherwise(F.col("k_lang"))
    named = pooled.select("k_lang", "k_source", "n", g_lang.alias("g_lang"), F.when(alone, F.col("k_source")).otherwise("*").alias("g_source"))
    of_group = named.groupBy(*GROUP).agg(F.ceil(F.sum("n") / CELL_ROWS).alias("cells"))
    named = written(named.join(of_group, list(GROUP)).drop("n"), "groups")
    cell = F.pmod(F.xxhash64("doc_id", *NAMES), F.col("cells")).cast("long")
    return written(keyed.join(named, ["k_lang", "k_source"], "left").withColumn("cell", cell).drop("k_lang", "k_source", "lang", "source"), "statistics")


def chi2_below(x: float, freedom: int) -> float:
    """The chi-squared distribution function for an even number of degrees of freedom."""
    term = total = 1.0
    for j in range(1, freedom // 2):
        term *= x / 2 / j
        total += term
    return 1 - math.exp(-x / 2) * total


def chi2_quantile(share: float, freedom: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_below(mid, freedom) < share else (lo, mid)
    return (lo + hi) / 2


def consistency(share: float) -> float:
    """What the covariance of the innermost share of a normal distribution is multiplied with."""
    return share / chi2_below(chi2_quantile(share, P), P + 2)


def entry(i: int, j: int) -> str:
    return f"a{min(i, j)}_{max(i, j)}"


def estimates(sums: DataFrame, keys: list[str], factor: float = 1.0, unit: float = UNIT) -> DataFrame:
    """keys, mean m*, inverse a*_* and lndet of the regularised covariance, from sums s*, s*_* over ``size`` rows."""
    mean = [F.col(f"s{i}") / F.col("size") / unit for i in range(P)]
    floor = list(FLOORS.values())
    cov = {(i, j): (F.col(f"s{i}_{j}") / F.col("size") / unit**2 - mean[i] * mean[j]) * factor + (floor[i] ** 2 if i == j else 0.0) for i, j in PAIRS}
    return inverted(sums.select(*keys, *(m.alias(f"m{i}") for i, m in enumerate(mean)), *(c.alias(entry(*ij)) for ij, c in cov.items())), [*keys, *(f"m{i}" for i in range(P))])


def inverted(df: DataFrame, keep: list[str]) -> DataFrame:
    """a*_* becomes its inverse, by a sweep of each pivot; lndet its log determinant."""
    df = df.withColumn("lndet", F.lit(0.0))
    for k in range(P):
        d = F.col(entry(k, k))
        a = {(i, j): -1 / d if i == j == k else F.col(entry(i, j)) / d if k in (i, j) else F.col(entry(i, j)) - F.col(entry(i, k)) * F.col(entry(j, k)) / d for i, j in PAIRS}
        df = df.select(*keep, (F.col("lndet") + F.log(d)).alias("lndet"), *(v.alias(entry(*ij)) for ij, v in a.items()))
    return df.select(*keep, "lndet", *((-F.col(entry(*ij))).alias(entry(*ij)) for ij in PAIRS))


def spread(estimate: DataFrame, cells: DataFrame) -> DataFrame:
    """An estimate for each cell of its group."""
    return estimate.join(cells, list(GROUP)).withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("cells") - 1))).drop("cells")


def squared() -> Column:
    """The squared distance of a row to the estimate beside it."""
    off = [F.col(f"y{i}") for i in range(P)]
    return sum((off[i] * off[j] * F.col(entry(i, j)) * (1 if i == j else 2) for i, j in PAIRS), F.lit(0.0))


def measured(rows: DataFrame, estimate: DataFrame, cells: DataFrame, how: str = "inner") -> DataFrame:
    """The rows with their distance d2 to their group's estimates."""
    near = rows.join(spread(estimate, cells), [*GROUP, "cell"], how)
    return near.withColumns({f"y{i}": F.col(name) / UNIT - F.col(f"m{i}") for i, name in enumerate(NAMES)}).withColumn("d2", F.when(F.col("y0").isNotNull(), F.greatest(squared(), F.lit(0.0))))


def summed() -> list[Column]:
    """Sums and products of the whole numbers."""
    return [F.sum(F.col(name)).alias(f"s{i}") for i, name in enumerate(NAMES)] + [F.sum(F.col(NAMES[i]) * F.col(NAMES[j])).alias(f"s{i}_{j}") for i, j in PAIRS]


SUMS = ["size", *(f"s{i}" for i in range(P)), *(f"s{i}_{j}" for i, j in PAIRS)]


def starts(rows: DataFrame, cells: DataFrame) -> DataFrame:
    """Estimates of the four starts of each group."""
    thirds = [F.percentile(name, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(name) for name in NAMES]
    q = rows.groupBy(*GROUP).agg(*thirds)
    width = [F.greatest((F.col(name)[2] - F.col(name)[0]) / UNIT / 1.349, F.lit(floor)) for name, floor in FLOORS.items()]
    robust = written(q.select(*GROUP, *((F.col(name)[1] / UNIT).alias(f"m{i}") for i, name in enumerate(NAMES)), *(w.alias(f"w{i}") for i, w in enumerate(width))), "starts")
    diagonal = robust.select(*GROUP, F.lit(0).alias("start"), *(f"m{i}" for i in range(P)), *((F.pow(f"w{i}", F.lit(2)) if i == j else F.lit(0.0)).alias(entry(i, j)) for i, j in PAIRS))
    # each row as it is, its hyperbolic tangents and its direction, in units of the group's spread
    near = rows.join(spread(robust, cells), [*GROUP, "cell"])
    u = [(F.col(name) / UNIT - F.col(f"m{i}")) / F.col(f"w{i}") for i, name in enumerate(NAMES)]
    near = near.select(*GROUP, F.array(*u).alias("u"))
    norm = F.sqrt(F.aggregate("u", F.lit(0.0), lambda a, b: a + b * b))
    kinds = F.array(F.struct(F.lit(1).alias("start"), F.col("u").alias("v")), F.struct(F.lit(2).alias("start"), F.transform("u", F.tanh).alias("v")), F.struct(F.lit(3).alias("start"), F.transform("u", lambda x: F.coalesce(F.try_divide(x, F.col("norm")), F.lit(0.0))).alias("v")))
    each = near.withColumn("norm", norm).select(*GROUP, F.inline(kinds)).select(*GROUP, "start", *(F.col("v")[i].alias(f"v{i}") for i in range(P)))
    sums = each.groupBy(*GROUP, "start").agg(F.count("*").alias("size"), *(F.sum(f"v{i}").alias(f"s{i}") for i in range(P)), *(F.sum(F.col(f"v{i}") * F.col(f"v{j}")).alias(f"s{i}_{j}") for i, j in PAIRS))
    sums = sums.join(robust, list(GROUP))
    mean = {i: F.col(f"s{i}") / F.col("size") for i in range(P)}
    free = F.when(F.col("start") == 3, 0.0).otherwise(1.0)  # directions aren't centred again
    cov = {(i, j): F.col(f"s{i}_{j}") / F.col("size") - free * mean[i] * mean[j] for i, j in PAIRS}
    scale = {1: lambda i, j: F.lit(1.0), 2: lambda i, j: F.try_divide(F.lit(1.0), F.sqrt(F.greatest(cov[i, i] * cov[j, j], F.lit(1e-12)))), 3: lambda i, j: F.lit(float(P))}
    sized = {ij: F.when(F.col("start") == 1, c * scale[1](*ij)).when(F.col("start") == 2, c * scale[2](*ij)).otherwise(c * scale[3](*ij)) for ij, c in cov.items()}
    floor = list(FLOORS.values())
    others = sums.select(
        *GROUP, "start", *((F.col(f"m{i}") + F.when(F.col("start") == 1, mean[i] * F.col(f"w{i}")).otherwise(0.0)).alias(f"m{i}") for i in range(P)),
        *((c * F.col(f"w{i}") * F.col(f"w{j}") + (floor[i] ** 2 if i == j else 0.0)).alias(entry(i, j)) for (i, j), c in sized.items()),
    )
    # a start's own determinant isn't that of a subset, so the first step always counts
    return written(inverted(diagonal.unionByName(others), [*GROUP, "start", *(f"m{i}" for i in range(P))]).withColumn("lndet", F.lit(float("inf"))), "starts")


def concentrated(rows: DataFrame, active: DataFrame, cells: DataFrame, share: float) -> DataFrame:
    """One concentration step: the estimates from the nearest rows, with the determinant before as ``last``."""
    near = measured(rows, active, cells).withColumn("bucket", F.floor(F.log(F.greatest("d2", F.lit(1e-9))) * BUCKETS).cast("int"))
    found = near.groupBy(*GROUP, "start", "bucket").agg(F.count("*").alias("size"), F.min("lndet").alias("last"), *summed())
    by = Window.partitionBy(*GROUP, "start")
    before = F.sum("size").over(by.orderBy("bucket")) - F.col("size")
    taken = found.withColumn("before", before).withColumn("all", F.sum("size").over(by)).where(F.col("before") < F.ceil(F.col("all") * share))
    sums = taken.groupBy(*GROUP, "start").agg(F.min("last").alias("last"), *(F.sum(c).alias(c) for c in SUMS))
    return written(estimates(sums, [*GROUP, "start", "last"]), "step")


def robust_estimates(rows: DataFrame, cells: DataFrame, share: float) -> DataFrame:
    """The reweighted estimate of each group."""
    active, done = starts(rows, cells), None
    for _ in range(STEPS):
        new = concentrated(rows, active, cells, share)
        sank = F.col("lndet") < F.col("last") - 1e-6
        over = active.join(new.where(~sank), [*GROUP, "start"], "semi")
        done = over if done is None else done.unionByName(over)
        active = new.where(sank).drop("last")
        if active.isEmpty():
            break
    every = done.unionByName(active)
    columns = [c for c in every.columns if c not in GROUP]
    best = every.groupBy(*GROUP).agg(F.min(F.struct("lndet", "start", *(c for c in columns if c not in ("lndet", "start")))).alias("b")).select(*GROUP, "b.*").drop("start")
    best = written(best, "raw")
    inner = 0.975
    kept = measured(rows, best, cells).where(F.col("d2") <= consistency(share) * chi2_quantile(inner, P))
    # a group always has rows within: its estimate is that of share of them
    sums = kept.groupBy(*GROUP).agg(F.count("*").alias("size"), *summed())
    return written(estimates(sums, list(GROUP), consistency(inner)), "robust")


def scored(docs: DataFrame, least: int = 60, share: float = 0.75) -> DataFrame:
    """doc_id, BASE, base_failed, the statistics' whole numbers, and d2, the squared robust distance (null without words)."""
    rows = grouped(written(counted(docs), "counted"), least)  # texts are read once
    vectors = rows.where(F.col(NAMES[0]).isNotNull()).select(*GROUP, "cell", *NAMES)
    cells = written(vectors.groupBy(*GROUP).agg((F.max("cell") + 1).alias("cells")), "cells")
    return measured(rows, robust_estimates(vectors, cells, share), cells, "left").select("doc_id", *BASE, "base_failed", *NAMES, "d2")


def judged(docs: DataFrame, least: int = 60, share: float = 0.75, inside: float = 0.9999) -> DataFrame:
    """doc_id, BASE, base_failed, kept, distance; kept: within the ellipsoid that holds ``inside`` of a normal distribution."""
    d2 = F.col("d2")
    kept = ~F.col("base_failed") & (d2 <= chi2_quantile(inside, P))
    return scored(docs, least, share).select("doc_id", *BASE, "base_failed", F.coalesce(kept, F.lit(False)).alias("kept"), F.round(F.sqrt("d2"), 6).alias("distance"))
