"""The thin queries opN_<name>, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from phenospark.llm.common import documents


def vocabulary() -> str:
    """The public vocabulary's file on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phenospark.llm.pii import digest

    return digest(documents(spark, sf_dir))


def op2_ring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phenospark.llm.ring import shard

    return shard(documents(spark, sf_dir), shards=16)


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phenospark.llm.kn_toxicity import judged

    return judged(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), parts=3, part=1, cut=0.7)


def op4_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phenospark.llm.maxscore import search

    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=20, k=20)


def op5_block_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phenospark.llm.block_ann import search

    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=100, k=10)


def op6_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phenospark.llm.backoff_lm import score

    return score(documents(spark, sf_dir), parts=7, part=2)


def op7_chosen_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phenospark.llm.chosen_path import near_duplicates

    return near_duplicates(documents(spark, sf_dir), threshold=0.8, n=5, recall=0.999)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phenospark.llm.packing import pack_documents

    return pack_documents(documents(spark, sf_dir), vocabulary(), capacity=4096, end_id=2)


def op9_recompress(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phenospark.llm.recompress import digest

    return digest(documents(spark, sf_dir))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phenospark.llm.bpe_codec import digest

    return digest(documents(spark, sf_dir), vocabulary())


def op11_robust_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phenospark.llm.outliers import judged

    return judged(documents(spark, sf_dir))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from phenospark.llm.whitening import whiten

    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), k=8, oversample=8, passes=4)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_pii, op2_ring, op3_kneser_ney, op4_maxscore, op5_block_join, op6_backoff, op7_chosen_path, op8_packing, op9_recompress, op10_bpe, op11_robust_outliers, op12_whitening)}


def oracle_sql() -> dict[str, str]:
    from phenospark.llm.sql import ORACLE

    return dict(ORACLE)
