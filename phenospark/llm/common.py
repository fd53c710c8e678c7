"""Small helpers that several operators share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a temporary one only for a
    local master without a name, where driver and executors are one process."""
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = context.getConf().get("spark.checkpoint.dir", None)
        if not named:
            if not context.master.startswith("local"):
                raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
            named = tempfile.mkdtemp(prefix="phenospark-")
        context.setCheckpointDir(named)
    return context.getCheckpointDir()


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a Parquet table in the shared folder: lineage ends, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bytes up to which a side of a join is broadcast.
SIDE_BYTES = 16 << 20


def side(table: DataFrame) -> DataFrame:
    """Rows of a written table, as the side of a join with whole texts: broadcast if they take SIDE_BYTES at most,
    so that the texts stay where they are; beyond it Spark deals both sides by the key."""
    texts = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in table.schema if f.dataType.typeName() == "string"]
    size = table.agg(F.sum(sum(texts, F.lit(64)).cast("long"))).first()[0] or 0
    return F.broadcast(table) if size <= SIDE_BYTES else table


#: Python workers give back at once what a batch took: arrays of 1 MB or more are mapped each for itself, Arrow's too.
WORKER_ENV = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_ARENA_MAX": "2", "MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_TRIM_THRESHOLD_": "1048576"}


def lean_workers(spark: SparkSession) -> None:
    """Workers started from now on have WORKER_ENV, but for what the session names itself. Idle workers of earlier
    steps count as an executor's memory too."""
    env = spark.sparkContext.environment
    for key, value in WORKER_ENV.items():
        env.setdefault(key, value)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, name: str) -> str:
    """The name, with underscores behind it while df has such a column."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def crc_of_id(column: str = "doc_id"):
    """crc32 of the id as text."""
    return F.crc32(F.col(column).cast("string").cast("binary"))
