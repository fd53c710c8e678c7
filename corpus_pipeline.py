"""From documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame; its rows are
written as Parquet in the shared folder and read again as the next one's docs.

All stages take what the operators take: null and empty texts (kept by the first
four; one end token in the last), very long texts whole, repeated rows, null ids (in
no group of copies, removing nothing), extra columns of any name (kept by the first
four), and empty tables, which give empty tables.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phenospark.llm.chosen_path import keep_one
from phenospark.llm.chunks import drop_chunks
from phenospark.llm.common import documents, lean_workers, written
from phenospark.llm.kn_toxicity import learn, reject
from phenospark.llm.packing import pack_documents
from phenospark.llm.pii import sanitise
from phenospark.llm.queries import vocabulary
from phenospark.llm.recompress import remove_repeats

#: The toxicity model has no SQL form. Copies, passages and packing are tested against brute force; toxicity by
#: planted words, its models against a plain Kneser-Ney, and personal data by its patterns and planted terms.
ORACLE_SQL = None


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def _lean(stage: Stage) -> Stage:
    """The stage, whose Python workers keep no memory for later ones."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        lean_workers(spark)
        return stage(spark, docs, sf_dir)

    return run


def _measured(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


@_lean
def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that class-conditional Kneser-Ney models call toxic (0.7 or more) go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return reject(docs, learn(docs, labels), cut=0.7)


@_lean
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: that of the smallest doc_id."""
    return keep_one(docs, threshold=0.8, n=5, recall=0.999)


@_lean
def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 13 words or more that start in an earlier document go."""
    return _measured(remove_repeats(docs).select(*docs.columns))


@_lean
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and the terms that reveal it are generalised to their kind."""
    return _measured(sanitise(docs))


@_lean
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens in sequences."""
    return pack_documents(docs, vocabulary(), capacity=4096, end_id=2)


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
        drop_chunks(spark)  # what the stage packed isn't read any more
    return docs
