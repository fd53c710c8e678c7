"""Running sums over all rows in an order, by range partitions and carries.

Rows are dealt once by ranges of their keys and order, and written; a window then runs
within a partition alone. What a partition has to add from those before it (or behind it)
comes from one row of totals for each partition and group, over which a second, small
window runs. No task sees all rows, and a group that holds most rows is many partitions.

Keys mustn't be null (rows with a null key are lost in the joins); the order has to be total.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phenospark.sources.tables import cut

#: How values are put together, and what none of them are.
KINDS = {"sum": (F.sum, 0.0), "product": (F.product, 1.0)}


def dealt(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], partitions: int | None = None) -> DataFrame:
    """The rows with the number of their range partition, as a table."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*keys, *order]
    return cut(df.repartitionByRange(n, *by).withColumn("part", F.spark_partition_id()), "dealt")


def running(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column], kind: str = "sum", backwards: bool = False) -> DataFrame:
    """Adds, for each name, the sum (product) of its values up to the row, or from it on (backwards)."""
    combine, none = KINDS[kind]
    local = Window.partitionBy("part", *keys).orderBy(*(F.desc(c) if backwards else F.asc(c) for c in order)).rowsBetween(Window.unboundedPreceding, 0)
    totals = rows.groupBy("part", *keys).agg(*(combine(v).alias(f"_{name}") for name, v in values.items()))
    over = Window.partitionBy(*keys).orderBy(F.desc("part") if backwards else F.asc("part")).rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition and group
    carried = totals.select("part", *keys, *(F.coalesce(combine(f"_{name}").over(over), F.lit(none)).alias(f"_{name}") for name in values))
    joined = rows.join(carried, ["part", *keys])
    put = {name: (combine(v).over(local) * F.col(f"_{name}") if kind == "product" else combine(v).over(local) + F.col(f"_{name}")) for name, v in values.items()}
    return joined.withColumns(put).drop(*(f"_{name}" for name in values))


def following(rows: DataFrame, keys: Sequence[str], order: Sequence[str], column: str, name: str) -> DataFrame:
    """Adds the column's value in the next row of the order, null in a group's last one."""
    local = Window.partitionBy("part", *keys).orderBy(*order)
    first = rows.groupBy("part", *keys).agg(F.min(F.struct(*order, F.col(column).alias("_value")))["_value"].alias("_first"))
    after = first.select("part", *keys, F.lead("_first").over(Window.partitionBy(*keys).orderBy("part")).alias("_first"))  # a row for each partition and group
    return rows.join(after, ["part", *keys]).withColumn(name, F.coalesce(F.lead(column).over(local), F.col("_first"))).drop("_first")
