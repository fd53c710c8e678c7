"""The jobs as queries: each runs twice into one new folder, and what lies there then is read back."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs import cohorts, term_layer
from phenospark.plans.oracle import km, ranked, sql
from phenospark.sources.tables import shared_folder


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def job1_term_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The layer of all documents; the second run finds nothing new."""
    folder = new_folder(spark, "job1")
    for _ in range(2):
        term_layer.run(spark, f"{sf_dir}/documents.parquet", f"{folder}/out", f"{folder}/checkpoint")
    return term_layer.table(spark, f"{folder}/out", "layer").select("lang", "gene", "col", F.round("value", 6).alias("value"))


def job2_cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phenotypes of all cohorts."""
    folder = new_folder(spark, "job2")
    for _ in range(2):
        cohorts.run(spark, f"{sf_dir}/customer.parquet", f"{sf_dir}/orders.parquet", folder)
    return cohorts.table(spark, folder, "phenotype").select("cohort", "col", "time", "status", *(F.round(c, 6).alias(c) for c in ("survival_rate", "rank", "s")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (job1_term_layer, job2_cohorts)}

ORACLE = {
    "job1_term_layer": r"""
WITH w AS MATERIALIZED (SELECT lang, doc_id AS col, unnest(regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+')) AS gene FROM documents WHERE doc_id IS NOT NULL),
c AS MATERIALIZED (SELECT lang, gene, col, count(*)::DOUBLE AS value FROM w GROUP BY ALL)
SELECT lang, gene, col, round(ln(1 + value / sum(value) OVER (PARTITION BY col) * 10000), 6) AS value FROM c
""",
    "job2_cohorts": sql(
        "SELECT cohort, col, time, status, round(r, 6) AS survival_rate, round(rank, 6) + 0.0 AS rank, round(1 - rank, 6) + 0.0 AS s FROM ranks", "customers_of",
        more="people AS MATERIALIZED (SELECT c.col, c.time, c.status, k.c_mktsegment AS cohort FROM customers_of c JOIN customer k ON k.c_custkey = c.col), " + km("people", "cohort") + ", " + ranked("cohort"),
    ),
}
