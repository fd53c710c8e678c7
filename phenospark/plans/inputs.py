"""The engine's inputs made of the driver's tables, whole."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cell, v, label."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("cell"), F.col("embedding").cast("array<double>").alias("v"), "label")


def expression(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Bulk and cell columns of the embeddings: genes are dimensions, every tenth vector is a bulk sample.

    Bulk lacks the genes from 60 on, cells those below 4.
    """
    flat = vectors(spark, sf_dir).select(F.col("cell").alias("col"), F.posexplode("v").alias("g", "value"))
    named = flat.select(F.format_string("g%02d", "g").alias("gene"), "col", "value", "g")
    bulk = named.where((F.col("col") % 10 == 0) & (F.col("g") < 60)).drop("g")
    cells = named.where((F.col("col") % 10 != 0) & (F.col("g") >= 4)).drop("g")
    return bulk, cells


def patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """col, time, status of the bulk samples, with ties."""
    v = vectors(spark, sf_dir).where(F.col("cell") % 10 == 0)
    return v.select(F.col("cell").alias("col"), (1 + (F.col("cell") * 7919) % 37).cast("double").alias("time"), (F.col("label") % 2).cast("int").alias("status"))


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).where(F.col("cell") % 10 == 0)
    return v.select(F.col("cell").alias("col"), F.when(F.col("label") < 5, 1.0).otherwise(0.0).alias("label"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger survival table: days from a customer's first order to the last, event if the last is filled."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("col"), F.to_date("o_orderdate").alias("day"), "o_orderkey", "o_orderstatus")
    last = F.max(F.struct("day", "o_orderkey", "o_orderstatus"))
    g = o.groupBy("col").agg(F.min("day").alias("first"), last.alias("last"))
    return g.select("col", F.datediff("last.day", "first").cast("double").alias("time"), F.when(F.col("last.o_orderstatus") == "F", 1).otherwise(0).alias("status"))


def parts_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Edges between parts of one order, weighted by their number, with loops; and all parts as cells."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").cast("long").alias("p"))
    other = items.select("l_orderkey", F.col("p").alias("q"))
    edges = items.join(other, "l_orderkey").groupBy(F.col("p").alias("src"), F.col("q").alias("dst")).agg(F.count("*").cast("double").alias("w"))
    return edges, table(spark, sf_dir, "part").select(F.col("p_partkey").cast("long").alias("cell"))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gene (a part), col (a supplier), value: quantities."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("gene"), F.col("l_suppkey").cast("long").alias("col"))
    return g.agg(F.sum(F.col("l_quantity").cast("double")).alias("value"))


def tied(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Bulk (orders' priorities) and cells (ship modes and return flags) over months, mostly tied counts."""
    item = table(spark, sf_dir, "lineitem").select(F.date_format(F.to_date("l_shipdate"), "MM").alias("gene"), F.col("l_suppkey").cast("long").alias("s"), F.col("l_linenumber").cast("long").alias("n"))
    bulk = item.groupBy("gene", F.col("n").alias("col")).agg((F.floor(F.count("*") / 100)).cast("double").alias("value"))
    cells = item.groupBy("gene", F.col("s").alias("col")).agg((F.floor(F.count("*") / 10)).cast("double").alias("value"))
    genes = item.select("gene").distinct()
    fill = lambda t: t.select("col").distinct().crossJoin(genes).join(t, ["col", "gene"], "left").select("gene", "col", F.coalesce("value", F.lit(0.0)).alias("value"))  # noqa: E731  twelve genes
    return fill(bulk), fill(cells)


def sparse(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Counts with their zeros left out: every fifth supplier is a bulk sample, the rest are cells.

    Bulk lacks the gene p1, and a supplier of no part is no column.
    """
    all_counts = counts(spark, sf_dir)
    return all_counts.where("col % 5 = 0 AND gene <> 'p1'"), all_counts.where("col % 5 <> 0")
