"""Scans and sinks. Every table is Parquet; filters and columns reach the scan."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from phenospark.functions.expression import Similarity, blocks_of, stored_samples

#: Tables by kind: columns and types that must be there. More columns may be.
SCHEMAS = {
    "expression": {"gene": "string", "col": "bigint", "value": "double"},
    "graph": {"src": "bigint", "dst": "bigint", "w": "double"},
    "survival": {"col": "bigint", "time": "double", "status": "int"},
    "binary": {"col": "bigint", "label": "double"},
    "x": {"cell": "bigint", "x": "array<double>"},
}


def checked(df: DataFrame, kind: str) -> DataFrame:
    """df with the columns of the kind, cast to its types; ValueError names what lacks."""
    want = SCHEMAS[kind]
    lacking = sorted(set(want) - set(df.columns))
    if lacking:
        raise ValueError(f"{kind} table lacks the columns {', '.join(lacking)}")
    return df.select(*(F.col(c).cast(t).alias(c) for c, t in want.items()))


def read_layer(spark: SparkSession, path: str) -> DataFrame:
    """An expression layer in long form; an absent row is 0."""
    return checked(spark.read.parquet(path), "expression")


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """A graph as edges; explicit zeros are dropped in the scan."""
    return checked(spark.read.parquet(path).where("w <> 0"), "graph")


def write_x(x: DataFrame | Similarity, path: str, overwrite: bool = False, files: int | None = None) -> None:
    """X by cell, dealt to files by ranges of cells and sorted in them: a range of cells is in few files, whose
    statistics keep the others unread. files: how many (the session's shuffle partitions). Of an X in parts the parts are
    written, by side, as these are smaller than its rows; where they aren't, its rows are made."""
    n = files or int((x.rows if isinstance(x, Similarity) else x).sparkSession.conf.get("spark.sql.shuffle.partitions"))
    mode = "overwrite" if overwrite else "errorifexists"
    if isinstance(x, Similarity) and x.short:
        spark, alike = x.rows.sparkSession, [F.lit(v).alias(c) for c, v in (("n_genes", x.n_genes), ("scale", float(x.scale)), ("clip", x.clip))]
        cells = x.rows.repartitionByRange(n, "cell").select(F.lit("cell").alias("side"), "cell", "x", *alike)
        both = cells.unionByName(stored_samples(x, spark).select(F.lit("bulk").alias("side"), "cell", "x", *alike))
        both.sortWithinPartitions("side", "cell").write.mode(mode).partitionBy("side").parquet(path)
        return
    rows = x.frame() if isinstance(x, Similarity) else checked(x, "x")
    rows.repartitionByRange(n, "cell").sortWithinPartitions("cell").write.mode(mode).parquet(path)


def read_x(spark: SparkSession, path: str) -> DataFrame | Similarity:
    """X as :func:`write_x` has left it: its rows, or its parts."""
    found = spark.read.parquet(path)
    if "side" not in found.columns:
        return checked(found, "x")
    samples = found.where("side = 'bulk'")
    last, n_genes, scale, clip = samples.agg(F.max("cell"), F.max("n_genes"), F.max("scale"), F.max("clip")).first()
    blocks, widths = blocks_of(samples.select(F.col("cell").alias("col"), "x.i", "x.v", "x.zero"), list(range(last + 1)), n_genes)
    return Similarity(found.where("side = 'cell'").select("cell", "x"), blocks, widths, last + 1, n_genes, scale, clip)


def x_block(x: DataFrame | Similarity, first: int, last: int, rows: list[int] | None = None, scale: float = 1.0) -> DataFrame | Similarity:
    """Cells first to last; rows picks sample positions, scale multiplies (a lazy row view)."""
    own = F.col("cell").between(first, last)
    return row_view(replace(x, rows=x.rows.where(own)) if isinstance(x, Similarity) else x.where(own), rows, scale)


def row_view(x: DataFrame | Similarity, rows: list[int] | None = None, scale: float = 1.0) -> DataFrame | Similarity:
    """A view of sample positions ``rows``, times ``scale``; nothing is copied.

    A scale within sqrt(eps) of 1 is dropped; one that isn't finite and positive is an error. A view of an X in parts
    is one too, of which only these samples' entries are ever made, if the positions ascend.
    """
    if not 0 < scale < float("inf"):
        raise ValueError("scale has to be finite and positive")
    if isinstance(x, Similarity):
        if rows is None or (len(rows) and 0 <= rows[0] and rows[-1] < x.samples and all(a < b for a, b in itertools.pairwise(rows))):
            x = x if rows is None else x.view(rows)
            return replace(x, scale=x.scale * scale) if abs(scale - 1) > 2.0**-26 else x
        x = x.frame()
    scaled = (lambda e: e * F.lit(scale)) if abs(scale - 1) > 2.0**-26 else lambda e: e
    if rows is None:
        v = F.transform("x", scaled)
    else:
        # one literal, however many rows; the viewed row is bound once, as it may be a view itself
        places = F.split(F.lit(",".join(map(str, rows))), ",").cast("array<int>") if len(rows) else F.array().cast("array<int>")
        v = F.get(F.transform(F.array("x"), lambda x: F.transform(places, lambda r: scaled(F.get(x, r)))), F.lit(0))
    return x.select("cell", v.alias("x"))


def max_difference(x: DataFrame, other: DataFrame) -> DataFrame:
    """One row: the largest absolute difference of two X, infinite where just one has a cell or a sample.

    Rows are compared whole, as arrays, once they have met.
    """
    none = F.array().cast("array<double>")
    d = F.zip_with(F.coalesce("a", none), F.coalesce("b", none), lambda a, b: F.coalesce(F.abs(a - b), F.lit(float("inf"))))
    met = x.select("cell", F.col("x").alias("a")).join(other.select("cell", F.col("x").alias("b")), "cell", "full")
    return met.select(F.array_max(d).alias("d")).agg(F.coalesce(F.max("d"), F.lit(0.0)).alias("max_difference"))


def x_dim(x: DataFrame | Similarity) -> DataFrame:
    """One row: n_sample, n_cell."""
    if isinstance(x, Similarity):
        return x.rows.agg(F.when(F.count("*") > 0, x.samples).otherwise(0).cast("long").alias("n_sample"), F.count("*").alias("n_cell"))
    return x.agg(F.coalesce(F.max(F.size("x")), F.lit(0)).cast("long").alias("n_sample"), F.count("*").alias("n_cell"))


def block_size(size: int | None, n: int, fallback: int = 10_000) -> int:
    """A block size within 1 and n; the fallback where none is given."""
    if n < 0:
        raise ValueError("n can't be negative")
    return max(1, min(n, fallback if size is None else int(size)))


def positions(cells: DataFrame) -> DataFrame:
    """cell, pos: places from 0 in the order of the cells' numbers.

    Cells are dealt by ranges of their numbers; a task counts its own, and a row
    of each count goes before the next ones, so no task sees all cells.
    """
    n = int(cells.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(cells.select("cell").repartitionByRange(n, "cell").select("cell", F.spark_partition_id().alias("part")), "cells")
    counts = dealt.groupBy("part").agg(F.count("*").alias("n"))  # a row for each partition
    before = counts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("cell")) - 1
    return dealt.withColumn("place", place).join(before, "part").select("cell", (F.col("before") + F.col("place")).alias("pos"))


def blocks(cells: DataFrame, size: int) -> DataFrame:
    """block, first_cell, n_cells: ranges of cell positions of a given size."""
    return cells.groupBy(F.floor(F.col("pos") / size).cast("long").alias("block")).agg(F.min("cell").alias("first_cell"), F.count("*").alias("n_cells"))


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that the session names in spark.checkpoint.dir; a temporary one only for a
    local master, where driver and executors are one process."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="phenospark-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def cut(df: DataFrame, name: str = "step") -> DataFrame:
    """The rows as a table in the shared folder that the session names, so lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Bucketed:
    """A table in the shared folder, in as many buckets by key as the session has shuffle partitions:
    joins on the key with another such table, or with a shuffle by it, move nothing of this one.

    dealt: the rows come from such a join already, so writing needs no shuffle.
    """

    def __init__(self, df: DataFrame, key: str, dealt: bool = False):
        self.spark, self.name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
        self.path, n = f"{shared_folder(self.spark)}/{self.name}", int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        rows = df if dealt else df.repartition(n, key)
        rows.write.bucketBy(n, key).sortBy(key).option("path", self.path).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        """The table and its files go."""
        self.spark.sql(f"DROP TABLE IF EXISTS `{self.name}`")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
