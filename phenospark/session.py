"""A session with the settings that the engine's plans are made for."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Each may be set otherwise on the builder afterwards.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",  # joins and partitions are planned again from real sizes
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def builder(app: str = "phenospark", threads: int = 1) -> SparkSession.Builder:
    """A builder; NumPy in a task gets ``threads`` threads, so tasks don't compete for a worker's cores."""
    if threads < 1:
        raise ValueError("threads has to be 1 at least")
    made = SparkSession.builder.appName(app)
    for key, value in SETTINGS.items():
        made = made.config(key, value)
    for name in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        made = made.config(f"spark.executorEnv.{name}", str(threads))
    return made.config("spark.task.cpus", str(threads))
