"""Cells of equal components: the links of all of them from those of a few."""

from pyspark.sql import functions as F

from phenospark.operators import preprocess
from phenospark.plans import prepare


def test_classes_give_the_whole_graph(spark):
    """Small integers, whose distances are exact: classes of 1 to 40 cells, some at equal distances."""
    rows = [(c, [float(v), float(v % 2)]) for c in range(120) for v in [0 if c % 3 == 0 else c % 17 if c % 3 == 1 else 5 + c % 4]]
    v = spark.createDataFrame(rows, "cell long, v array<double>")
    size = 4
    kept, members = prepare.grouped(v, size)
    want = preprocess.snn_graph(preprocess.knn_graph(v, size - 1, metric="euclidean"), size)
    graph = preprocess.snn_graph(prepare.nearest(kept, size), size)
    assert kept.count() + members.count() == 120 and members.count() > 50
    assert graph.count() < want.count() / 4
    rounded = lambda g: sorted((r.src, r.dst, round(r.w, 9)) for r in g.collect())
    assert rounded(prepare.expanded(graph, members)) == rounded(want)


def test_one_class_of_all_cells_makes_few_pairs(spark):
    v = spark.range(5000).select(F.col("id").alias("cell"), F.array(F.lit(1.5)).alias("v"))
    kept, members = prepare.grouped(v, 10)
    graph = preprocess.snn_graph(prepare.nearest(kept, 10), 10)
    assert graph.count() == 11 * 10 and members.count() == 5000 - 11
    assert {round(r.w, 9) for r in members.collect()} == {round(9 / 11, 9)} and {r.like for r in members.collect()} == {10}
