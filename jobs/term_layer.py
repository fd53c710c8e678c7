"""Job 1: an expression layer that grows with the documents that arrive.

Documents are the cells, their terms (lower-case runs of letters and digits) the genes.
A file stream takes the files of ``documents`` that no earlier run has taken, in batches;
each batch gives, in folders of its own under ``output``,

* ``layer/batch=/lang=``: gene, col, value, the log-normalised counts,
* ``parts/batch=``: gene, c, m, s, from which statistics over all batches are put together,
* ``columns/batch=``: col, the documents that the batch took.

After the last batch ``variable`` (gene, mean, variance, score) is made anew from all parts:
the terms whose dispersion over all columns is largest.

The checkpoint is what was taken. A batch that is run again, since the run before ended
amid it, has the same files and replaces its own folders alone, so every run ends in the
same tables. A document whose id an earlier batch took is left out; rows of one id within
a batch are one column, their words together. Rows without an id are left out, a null or
empty text is a column without rows, a null lang comes back as null, and so does an
empty one, as partitions can't tell them apart.

    python -m jobs.term_layer --documents D --output O --checkpoint C [--config jobs/term_layer.toml]
"""

from __future__ import annotations

import logging
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobs.common import command_line, settings
from phenospark.operators import preprocess

log = logging.getLogger("term_layer")

#: Tables under the output, and their columns.
SCHEMAS = {
    "layer": "gene string, col long, value double, batch long, lang string",
    "parts": "gene string, c long, m double, s double, batch long",
    "columns": "col long, batch long",
    "variable": "gene string, mean double, variance double, score double",
}
TERM = r"[\p{L}\p{N}]+"


@dataclass(frozen=True)
class Config:
    scale: float = 10_000.0
    files_per_batch: int = 64
    variable: int = 3000


def table(spark: SparkSession, output: str, name: str) -> DataFrame:
    """A table of the job's output, of all batches."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{output}/{name}")


def replace(df: DataFrame, output: str, name: str, *by: str) -> None:
    """Writes the rows; of the partitions that are there, those that df has are replaced and no others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{output}/{name}")


def term_counts(documents: DataFrame) -> DataFrame:
    """lang, gene, col, value: how often each term is in a document."""
    terms = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(TERM), F.lit(0))
    return documents.select("lang", "col", F.explode(terms).alias("gene")).groupBy("lang", "gene", "col").agg(F.count("*").cast("double").alias("value"))


def take(batch: DataFrame, number: int, output: str, config: Config) -> int:
    """One batch's tables, and how many rows it has; a second call for the number replaces what the first wrote."""
    spark = batch.sparkSession
    before = table(spark, output, "columns").where(F.col("batch") < number).select("col")
    new = batch.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("col"), "lang", "text").join(before, "col", "left_anti")
    tag, own = F.lit(number).cast("long").alias("batch"), F.col("batch") == number
    values = preprocess.log_normalize(term_counts(new), config.scale)
    replace(values.select("gene", "col", "value", tag, "lang"), output, "layer", "batch", "lang")
    layer = table(spark, output, "layer").where(own)
    replace(preprocess.gene_parts(layer).select("*", tag), output, "parts", "batch")
    # last: columns that are here have all their rows
    replace(new.select("col", tag).distinct(), output, "columns", "batch")
    read = batch.count()  # of the files' footers, as those below
    log.info("batch %d: %d rows read, %d documents new, %d rows to %s/layer", number, read, table(spark, output, "columns").where(own).count(), layer.count(), output)
    return read


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, config: Config = Config()) -> dict[str, int]:
    """Takes what is new in ``documents`` and makes ``variable`` anew; how many rows were read, and columns and terms there are."""
    schema = spark.read.parquet(documents).schema
    for name in ("layer", "parts", "columns"):  # the folders are there, whether anything is new or not
        spark.createDataFrame([], SCHEMAS[name]).write.mode("append").partitionBy("batch").parquet(f"{output}/{name}")
    # the last letter as a class of one: a path with a pattern may be a folder or a single file
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", config.files_per_batch).parquet(f"{documents.rstrip('/')[:-1]}[{documents.rstrip('/')[-1]}]")
    taken: list[int] = []
    stream = files.writeStream.foreachBatch(lambda batch, number: taken.append(take(batch, number, output, config))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        stream.awaitTermination()
    finally:
        stream.stop()
    log.info("read %d rows of %s", sum(taken), documents)
    n = table(spark, output, "columns").count()
    stats = preprocess.merged_stats(table(spark, output, "parts"), n)
    chosen = preprocess.variable_genes(None, n, config.variable, "disp", stats).join(stats, "gene").select("gene", "mean", "variance", "score")
    chosen.coalesce(1).write.mode("overwrite").parquet(f"{output}/variable")
    terms = table(spark, output, "variable").count()
    log.info("%d columns; %d terms to %s/variable", n, terms, output)
    return {"read": sum(taken), "columns": n, "variable": terms}


def main() -> None:
    spark, args = command_line("term_layer", __doc__.splitlines()[0], {"documents": "Parquet files of doc_id, text, lang", "output": "folder of the tables", "checkpoint": "folder of the stream's checkpoint"})
    try:
        run(spark, args.documents, args.output, args.checkpoint, settings(spark, args.config, Config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
