"""Packing of tokenised documents into sequences (operator 8).

A document is its ids and an end id. It is cut into full sequences and one
remainder; the remainders are packed first-fit decreasing, each group of
documents on its own. Groups come from a hash of the document and of its row, so
all pieces of a document are in one group, repeated documents are spread, and groups
are random, even in size and independent; a group holds about ``group_size``
pieces whatever the input, so no task grows with it (the pieces of one document are
as many as its tokens / ``capacity``). First fit is found in a
tournament tree over the free room of the group's sequences: each inner node
has the largest room below it, and the descent takes the leftmost that fits.

Null and empty texts are the end id alone. Repeated rows are packed as often as
they come; rows of one doc_id are told apart by their text only, so equal rows
give equal pieces at different places. Empty table: no rows. Other columns are not
read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenospark.llm.common import written
from phenospark.llm.textkernel import slices
from phenospark.llm.tokens import WordEncoder, encoder

#: row: a number of the document's row, unique in a table of pieces.
PIECES = "row long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Tournament:
    """Free room of sequences 0, 1, ...; finds the first with enough of it."""

    def __init__(self, capacity: int, bins: int):
        self.size = 1 << max(0, (bins - 1).bit_length())
        self.room = [capacity] * (2 * self.size)
        self.capacity = capacity

    def place(self, length: int) -> tuple[int, int]:
        """The first sequence with room, and the offset in it; the room is taken."""
        room, at = self.room, 1
        while at < self.size:
            at *= 2
            if room[at] < length:
                at += 1
        offset = self.capacity - room[at]
        room[at] -= length
        found = at - self.size
        while at > 1:
            at //= 2
            most = max(room[2 * at], room[2 * at + 1])
            if room[at] == most:
                break
            room[at] = most
        return found, offset


def first_fit_decreasing(lengths: np.ndarray, ties: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each length (1 to capacity); equal lengths in the order of ties."""
    order = np.lexsort((ties, -lengths))
    tree = Tournament(capacity, max(1, len(lengths)))
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    for i, n in zip(order.tolist(), lengths[order].tolist(), strict=True):
        sequence[i], offset[i] = tree.place(n)
    return sequence, offset


def pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """The pieces of each document: full sequences from its start, then the remainder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, row = encoder(WordEncoder, path), TaskContext.get().partitionId() << 33
        for batch in batches:
            keys = batch.column(0).to_pylist()
            for s in slices(batch.column(1)):
                first, slot = coder.slots_of(s)
                ids, begin = coder.ids(slot)
                bounds, small = begin[first].tolist(), ids.astype("<u4")
                rows: list[tuple] = []
                for i in range(s.rows):
                    own = np.append(small[bounds[i] : bounds[i + 1]], np.uint32(end_id))
                    total, raw = len(own), own.tobytes()
                    for a in range(0, total, capacity):
                        b = min(total, a + capacity)
                        rows.append((row + i, keys[s.lo + i], a, b - a, zlib.crc32(raw[4 * a : 4 * b]), total))
                row += s.rows
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["row", "doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PIECES)


def pack(items: DataFrame, capacity: int = 4096, group_size: int = 16384) -> DataFrame:
    """sequence_id and offset for the rows of a written table of :func:`pieces`.

    sequence_id is unique over all groups: the group's number times 2^32 plus
    the sequence's number in it. Groups number about rows / group_size.
    """
    groups = max(1, round(items.count() / group_size))
    dealt = items.withColumn("pack_group", F.pmod(F.xxhash64(F.lit(17), "doc_id", "row"), F.lit(groups)))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("row", "ascending"), ("start", "ascending")], null_placement="at_start")
        table = table.take(order)
        sequence, offset = first_fit_decreasing(table.column("length").to_numpy(), np.arange(table.num_rows), capacity)
        kept = table.select([f.split()[0] for f in PIECES.split(", ")[1:]])
        return kept.append_column("sequence_id", pa.array((key[0].as_py() << 32) + sequence)).append_column("offset", pa.array(offset))

    return dealt.groupBy("pack_group").applyInArrow(run, f"{PIECES.removeprefix('row long, ')}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 2, group_size: int = 16384) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset for each piece."""
    # written: tokenising happens once, for the count and for the packing
    return pack(written(pieces(docs, path, capacity, end_id), "pieces"), capacity, group_size)
