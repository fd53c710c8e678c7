"""Documents as packed chunks, and exchanges of hashes between chunks.

A chunk holds the texts of consecutive rows (about two megabytes, compressed)
with all other columns as one Arrow message. Chunks are written once to the shared
folder, bucketed by their number into tables of which a task reads TASK_BYTES of
text, so that what other tasks find out about a chunk joins it again without moving
a text. An exchange deals hashes to buckets, in one packed row for each chunk and
bucket; there are as many buckets as the text asks for and as many partitions as
buckets, so neither a bucket nor a task grows with the input.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenospark.llm.common import partitions, shared_dir
from phenospark.llm.textkernel import Slice, slices

#: Bytes of text in a chunk; phenospark.chunkBytes in the session's settings goes before it.
CHUNK_BYTES = 2 << 20
#: Bytes of text for each bucket of an exchange; phenospark.bucketBytes goes before it.
BUCKET_BYTES = 16 << 20
#: Bytes of text whose chunks share a partition of their table.
TASK_BYTES = 64 << 20

CHUNKED = "chunk long, bytes long, offs binary, texts binary, others binary"

#: The tables that this process has made, and where they are.
_made: list[tuple[str, str]] = []


def drop_chunks(spark) -> None:
    """Drops the chunk tables of this process with their files; for when no DataFrame made of them is needed any more."""
    while _made:
        name, path = _made.pop()
        spark.sql(f"DROP TABLE IF EXISTS `{name}`")
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def press(x: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(x).tobytes() if isinstance(x, np.ndarray) else x)


def expand(x: bytes, kind=np.uint8) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


@dataclass
class Chunks:
    """table: CHUNKED; parts: its partitions; buckets: those of an exchange."""

    table: DataFrame
    parts: int
    buckets: int


def chunked(docs: DataFrame, text_col: str) -> Chunks:
    """The chunks of docs as a table bucketed by chunk, in the shared folder."""
    spark = docs.sparkSession
    others = [c for c in docs.columns if c != text_col]
    most, per_bucket = (int(spark.conf.get(f"phenospark.{name}", str(size))) for name, size in (("chunkBytes", CHUNK_BYTES), ("bucketBytes", BUCKET_BYTES)))
    total = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    parts, buckets = max(8, partitions(spark), -(-total // TASK_BYTES)), max(12, -(-total // per_bucket))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            rest = batch.select(others)
            for s in slices(batch.column(batch.schema.get_field_index(text_col)), most):
                own = rest.slice(s.lo, s.rows)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, own.schema) as writer:
                    writer.write_batch(own)
                # an IPC message of a slice holds that slice alone
                values = [number, int(len(s.data)), press(s.offs.astype(np.int64)), press(s.data), press(sink.getvalue().to_pybytes())]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)], ["chunk", "bytes", "offs", "texts", "others"])
                number += 1

    name = f"chunks_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    packed = docs.withColumn(text_col, F.col(text_col).cast("string")).mapInArrow(run, CHUNKED)
    packed.write.bucketBy(parts, "chunk").option("path", path).saveAsTable(name)
    _made.append((name, path))
    return Chunks(spark.table(name), parts, buckets)


def opened(row: dict) -> Slice:
    offs = expand(row["offs"], np.int64)
    return Slice(0, len(offs) - 1, expand(row["texts"]), offs)


def others(row: dict) -> pa.RecordBatch:
    return pa.ipc.open_stream(expand(row["others"]).tobytes()).read_all().combine_chunks().to_batches()[0] if len(expand(row["offs"], np.int64)) > 1 else None


def by_bucket(sent: DataFrame, buckets: int) -> DataFrame:
    """Rows with a bucket, in a partition for each bucket."""
    return sent.repartitionById(buckets, F.col("bucket"))


def joined(chunks: Chunks, to: DataFrame, answers: DataFrame, name: str, columns: tuple[str, ...]) -> DataFrame:
    """to (rows with a chunk, in the chunks' partitions) with the list of its answers, as column ``name``."""
    told = answers.repartition(chunks.parts, "chunk").groupBy(F.col("chunk").alias(f"chunk_{name}")).agg(F.collect_list(F.struct(*columns)).alias(name))
    return to.join(told.hint("shuffle_hash"), F.col("chunk") == F.col(f"chunk_{name}"), "left").drop(f"chunk_{name}")


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    """By the upper bits, so the lower bits stay to tell keys apart."""
    return ((keys >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def dealt(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """An order of sorted keys by bucket, and where each bucket begins in it."""
    bucket = bucket_of(keys, buckets)
    order = np.argsort(bucket, kind="stable")
    return order, np.searchsorted(bucket[order], np.arange(buckets + 1))


SENT = "bucket int, chunk long, keys binary, more binary"
ANSWER = "chunk long, bucket int, bits binary"


def send(chunk: int, keys: np.ndarray, buckets: int, more: np.ndarray | None = None) -> pa.RecordBatch:
    """Rows of SENT for sorted distinct keys; more: a column of numbers that goes with them."""
    order, first = dealt(keys, buckets)
    full = np.flatnonzero(np.diff(first))
    parts = [order[first[b] : first[b + 1]] for b in full.tolist()]
    return pa.RecordBatch.from_arrays(
        [
            pa.array(full.astype(np.int32)),
            pa.array(np.full(len(full), chunk, np.int64)),
            pa.array([keys[p].tobytes() for p in parts], pa.binary()),
            pa.array([b"" if more is None else press(more[p]) for p in parts], pa.binary()),
        ],
        ["bucket", "chunk", "keys", "more"],
    )


def answers(sent: DataFrame, buckets: int, judge: Callable[[np.ndarray, list[bytes]], np.ndarray]) -> DataFrame:
    """ANSWER: one bit for each hash sent. judge(all keys of a bucket, more of each row) gives a truth for each key."""

    def run(table: pa.Table) -> pa.Table:
        raws = [x.as_py() for x in table.column("keys")]
        keys = np.frombuffer(b"".join(raws), np.uint64)
        truth = judge(keys, [x.as_py() for x in table.column("more")])
        ends = np.cumsum([len(r) // 8 for r in raws])
        bits = [np.packbits(x).tobytes() for x in np.split(truth, ends[:-1])]
        return pa.table({"chunk": table.column("chunk").cast(pa.int64()), "bucket": table.column("bucket").cast(pa.int32()), "bits": pa.array(bits, pa.binary())})

    return by_bucket(sent, buckets).groupBy("bucket").applyInArrow(run, ANSWER)


def told(found: list[dict] | None, keys: np.ndarray, buckets: int) -> np.ndarray:
    """The truths for the keys that were sent."""
    order, first = dealt(keys, buckets)
    out = np.zeros(len(keys), bool)
    for x in found or ():
        a, b = first[x["bucket"]], first[x["bucket"] + 1]
        out[order[a:b]] = np.unpackbits(np.frombuffer(x["bits"], np.uint8), count=b - a).astype(bool)
    return out
