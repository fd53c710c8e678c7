"""Files of X by ranges of cells; shared neighbours with hubs."""

import glob
from itertools import combinations

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from phenospark.operators import preprocess
from phenospark.sources import tables


def ranges(path):
    out = []
    for f in glob.glob(f"{path}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        at = meta.schema.to_arrow_schema().names.index("cell")
        stats = [meta.row_group(i).column(at).statistics for i in range(meta.num_row_groups)]
        out.append((min(s.min for s in stats), max(s.max for s in stats)))
    return sorted(out)


def test_a_block_of_cells_is_in_few_files(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = spark.createDataFrame([(int(c), [float(c), 1.0]) for c in rng.permutation(4000)], "cell long, x array<double>").repartition(5)
    tables.write_x(x, str(tmp_path / "x"), files=16)
    found = ranges(str(tmp_path / "x"))
    assert len(found) >= 12 and all(a[1] < b[0] for a, b in zip(found, found[1:]))
    read = [r for r in found if r[1] >= 1000 and r[0] <= 1199]
    assert len(read) <= 3  # of 16
    block = tables.x_block(tables.read_x(spark, str(tmp_path / "x")), 1000, 1199)
    assert sorted(r.cell for r in block.collect()) == list(range(1000, 1200))
    assert {f.input for f in block.select(F.input_file_name().alias("input")).distinct().collect()} and block.select(F.input_file_name()).distinct().count() <= 3


def brute_snn(near, prune):
    own = {}
    for s, d in near:
        own.setdefault(s, {s}).add(d)
    out = {}
    for a, b in combinations(sorted(own), 2):
        c = len(own[a] & own[b])
        w = c / (len(own[a]) + len(own[b]) - c)
        if w >= prune and c:
            out[a, b] = out[b, a] = w
    return out


@pytest.mark.parametrize("prune", [1 / 15, 0.3, 0.01])
@pytest.mark.parametrize("crowd", [2000, 7])
def test_shared_neighbours_with_hubs(spark, prune, crowd):
    rng = np.random.default_rng(3)
    near = {(s, int(d)) for s in range(60) for d in rng.choice(60, rng.integers(1, 9), replace=False) if d != s} | {(s, 0) for s in range(1, 60)} | {(s, 1) for s in range(2, 60)}
    df = spark.createDataFrame(sorted(near), "src long, dst long").repartition(3)
    got = {(r.src, r.dst): r.w for r in preprocess.snn_graph(df, 8, prune, crowd).collect()}
    want = brute_snn(near, prune)
    assert got.keys() == want.keys() and all(abs(got[p] - w) < 1e-12 for p, w in want.items())


def test_a_star_makes_no_pairs_through_its_centre(spark):
    """All cells admire one; each has the others of its own five besides."""
    five = lambda s: [d for d in range(s // 5 * 5, s // 5 * 5 + 5) if d != s and 0 < d < 2000]
    near = [(s, 0) for s in range(1, 2000)] + [(s, d) for s in range(1, 2000) for d in five(s)]
    df = spark.createDataFrame(near, "src long, dst long")
    shown = preprocess.telling(preprocess.neighbour_sets(df), 0.3)
    assert shown.groupBy("via").count().agg(F.max("count")).first()[0] <= 5
    assert preprocess.snn_graph(df, 5, 0.3).count() == sum(len(five(s)) for s in range(1, 2000))
