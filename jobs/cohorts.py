"""Job 2: survival phenotypes of cohorts, ready for a model's penalty matrix.

Reads patients (customers) and their visits (orders), and ranks the patients of each cohort
among themselves: ``phenotype/cohort=`` has col, time (days from the first visit to the
last), status (1 if the last visit is closed), survival_rate, rank and s = 1 - rank, which
:func:`phenospark.operators.factorise.fit` takes; ``summary/cohort=`` has n, events, mean_time
(the area under the cohort's survival curve) and concordance of the patients' balance with time.

A run replaces the cohorts it makes and no others, so a second one gives the same tables.
A full run (``only`` empty) replaces all, also those of cohorts that are no more. Patients
without a visit have no time and are left out; a null cohort is a cohort.

    python -m jobs.cohorts --patients P --visits V --output O [--config jobs/cohorts.toml]
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, settings
from phenospark.operators import survival
from phenospark.sources.tables import cut

log = logging.getLogger("cohorts")

SCHEMAS = {
    "phenotype": "col long, time double, status int, survival_rate double, rank double, s double, cohort string",
    "summary": "n long, events long, mean_time double, concordance double, cohort string",
}


@dataclass(frozen=True)
class Config:
    cohort: str = "c_mktsegment"
    only: tuple[str, ...] = ()


def table(spark: SparkSession, output: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{output}/{name}")


def followed(patients: DataFrame, visits: DataFrame, config: Config) -> DataFrame:
    """cohort, col, time, status, score of the patients with a visit."""
    day = F.to_date("o_orderdate")
    last = F.max(F.struct(day.alias("day"), "o_orderkey", "o_orderstatus"))
    seen = visits.groupBy(F.col("o_custkey").alias("col")).agg(F.min(day).alias("first"), last.alias("last"))
    seen = seen.select("col", F.datediff("last.day", "first").cast("double").alias("time"), F.when(F.col("last.o_orderstatus") == "F", 1).otherwise(0).alias("status"))
    known = patients.select(F.col("c_custkey").alias("col"), F.col(config.cohort).cast("string").alias("cohort"), F.col("c_acctbal").alias("score"))
    if config.only:
        known = known.where(F.col("cohort").isin(*config.only))
    return known.join(seen.where("time IS NOT NULL"), "col")


def summary(people: DataFrame, ranked: DataFrame) -> DataFrame:
    """cohort, n, events, mean_time, concordance; people have score, ranked survival_rate."""
    area = survival.future_time(ranked, by=("cohort",))
    # everybody is there until the first time
    means = area.groupBy("cohort").agg(F.count("*").alias("n"), F.sum("status").alias("events"), (F.min("time") + F.max("future_time")).alias("mean_time"))
    return means.join(survival.concordance(people, by=("cohort",)).select("cohort", "concordance"), "cohort", "left")


def run(spark: SparkSession, patients: str, visits: str, output: str, config: Config = Config()) -> dict[str, int]:
    """Makes the tables; how many patients and cohorts were written."""
    people = followed(spark.read.parquet(patients), spark.read.parquet(visits), config)
    for path in (patients, visits):
        log.info("read %d rows of %s", spark.read.parquet(path).count(), path)
    # keys can't be null in the library's joins, so a cohort goes by a name until it is written
    people = cut(people.withColumn("cohort", F.coalesce(F.concat(F.lit("="), "cohort"), F.lit("0"))), "people")
    ranked = cut(survival.guanrank(people.drop("score"), by=("cohort",)), "ranked")
    made = {"phenotype": ranked.withColumn("s", 1 - F.col("rank")), "summary": cut(summary(people, ranked), "summary")}
    mode = "dynamic" if config.only else "static"
    for name, df in made.items():
        plain = F.when(F.col("cohort") != "0", F.substring("cohort", 2, 1 << 20)).alias("cohort")
        columns = [c.split()[0] for c in SCHEMAS[name].split(", ") if c != "cohort string"]
        df.select(*columns, plain).write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy("cohort").parquet(f"{output}/{name}")
    wrote = {"patients": ranked.count(), "cohorts": made["summary"].count()}
    log.info("wrote %d rows to %s/phenotype, %d to %s/summary", wrote["patients"], output, wrote["cohorts"], output)
    return wrote


def main() -> None:
    spark, args = command_line("cohorts", __doc__.splitlines()[0], {"patients": "Parquet files of c_custkey, c_acctbal and the cohort's column", "visits": "Parquet files of o_custkey, o_orderkey, o_orderdate, o_orderstatus", "output": "folder of the tables"})
    try:
        run(spark, args.patients, args.visits, args.output, settings(spark, args.config, Config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
