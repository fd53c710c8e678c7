"""BPE encoding and decoding of whole texts (operator 10, tree concatenation).

``encode`` gives each text's ids and ``decode`` the text of ids as the
tokenizers library has them (no truncation, no padding, no special tokens
added, none skipped). White space ends every piece of this vocabulary, so the
ids of a text are those of its words: each distinct word is encoded once per
worker. A text with a word of more than ``long_bytes`` bytes is taken apart: the
leaves of the word's tree (:mod:`bpe_tree`) are dealt to tasks, which encode them
side by side; rounds join runs of FAN neighbours, each join in a growing window
until both sides agree, until one node is left; and the text's ids are put
together from its parts. Other texts take one pass and aren't shuffled.

Null and empty texts have no ids and decode to "". Repeated rows give repeated
rows. Ids of rows may be null or repeat. Empty table: no rows. Columns other than
those named are not read. Memory of a worker is bounded but for one text's ids.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenospark.llm.common import partitions, written
from phenospark.llm.textkernel import Slice, slices
from phenospark.llm.tokens import LONG_BYTES, WordEncoder, encoder, has_long

#: Neighbours that a task joins in one round.
FAN = 64


class _TextEncoder(WordEncoder):
    """Also keeps each word's ids and tokens as text."""

    def reset(self) -> None:
        super().reset()
        self.names = {i: t.encode() for i, t in self.tree.strings.items()} | {i: t.encode() for t, i in self.tree.specials}
        self.id_text: list[bytes] = []
        self.token_text: list[bytes] = []

    def added(self, flat, lengths) -> None:
        ends = np.cumsum(lengths).tolist()
        ids, tokens, a = list(map(b"%d".__mod__, flat.tolist())), list(map(self.names.__getitem__, flat.tolist())), 0
        for b in ends:
            self.id_text.append(b" ".join(ids[a:b]))
            self.token_text.append(b" ".join(tokens[a:b]))
            a = b


def _coded(docs: DataFrame, id_col: str, text_col: str, path: str, kind: type[WordEncoder], code: Callable[[WordEncoder, Slice], list[pa.Array]], whole: Callable[[list[int], object], tuple], columns: str, long_bytes: int) -> DataFrame:
    """id_col and the columns that ``code`` gives for the rows of a slice, and ``whole`` for the ids of a text that
    was put together."""
    names = [c.strip().split(" ")[0] for c in columns.split(", ")]
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {id_type}, {columns}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, number = encoder(kind, path), TaskContext.get().partitionId() << 33
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1)
            for s in slices(texts):
                number += s.rows
                long = has_long(s, long_bytes)
                own, rows = keys.slice(s.lo, s.rows), [s]
                if long.any():
                    some = pa.array(long)
                    apart = texts.slice(s.lo, s.rows).filter(some)
                    got = [pa.nulls(len(apart), t) for t in out_types]
                    yield pa.RecordBatch.from_arrays([own.filter(some), *got, pa.array(number - s.rows + np.flatnonzero(long)), apart.cast(pa.string())], [id_col, *names, "row", "apart"])
                    own = own.filter(pa.array(~long))
                    rows = list(slices(texts.slice(s.lo, s.rows).filter(pa.array(~long)), 1 << 40, 1 << 40))
                for r in rows:
                    yield pa.RecordBatch.from_arrays([own, *code(coder, r), pa.nulls(r.rows, pa.int64()), pa.nulls(r.rows, pa.string())], [id_col, *names, "row", "apart"])

    out_types = [{"ids": pa.list_(pa.int32()), "n_tokens": pa.int64()}.get(n, pa.string()) for n in names]
    # written: whether there are texts to take apart is known before they are
    first = written(docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, f"{schema}, row long, apart string"), "coded")
    apart = first.where("apart is not null")
    if apart.isEmpty():
        return first.select(id_col, *names)
    ids = _assembled(apart.select("row", "apart"), path, long_bytes)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        for batch in batches:
            rows = [whole(x or [], tokenizer) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(out_types))], [id_col, *names])

    long = apart.select("row", id_col).join(ids, "row", "left").select(id_col, "ids").mapInArrow(finish, schema)
    return first.where("apart is null").select(id_col, *names).unionByName(long)


PART = "row long, part int, leaf int, leaves int, symbols string, ids array<int>"


def _assembled(texts: DataFrame, path: str, long_bytes: int) -> DataFrame:
    """row, ids of texts(row, apart): their parts are encoded apart, then joined and put together."""
    wide = partitions(texts.sparkSession)

    def record(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], [f.split()[0] for f in PART.split(", ")])

    def take_apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(WordEncoder, path)
        coder.tree.load()
        for batch in batches:
            for row, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                part, rows = 0, []
                raw, at = text.encode(), 0
                for long in long_words(long_bytes).finditer(raw):
                    rows.append((row, part, 0, 1, None, _plain(coder, raw[at : long.start()])))
                    for p in coder.tree.parts(long[0].decode()):
                        part += 1
                        if isinstance(p, int):
                            rows.append((row, part, 0, 1, None, [p]))
                        else:
                            leaves = coder.tree.leaves(p)
                            rows += [(row, part, k, len(leaves), x, None) for k, x in enumerate(leaves)]
                    part, at = part + 1, long.end()
                rows.append((row, part, 0, 1, None, _plain(coder, raw[at:])))
                for lo in range(0, len(rows), 4096):
                    yield record(rows[lo : lo + 4096])

    def leaf_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = encoder(WordEncoder, path).tree
        tree.load()
        for batch in batches:
            rows = batch.to_pylist()
            if rows:
                yield record([(r["row"], r["part"], r["leaf"], r["leaves"], None, tree.leaf_ids(r["symbols"], r["leaf"] + 1 == r["leaves"])) for r in rows])

    def join(table: pa.Table) -> pa.Table:
        tree = encoder(WordEncoder, path).tree
        tree.load()
        rows = sorted(table.to_pylist(), key=lambda r: r["leaf"])
        one = rows[0]
        ids = tree.joined([r["ids"] for r in rows], rows[-1]["leaf"] + 1 == one["leaves"])
        return pa.Table.from_batches([record([(one["row"], one["part"], one["leaf"] // FAN, -(-one["leaves"] // FAN), None, ids)])])

    def put_together(table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["part"])
        ids = [x for r in rows for x in r["ids"]]
        return pa.table({"row": pa.array([rows[0]["row"]], pa.int64()), "ids": pa.array([ids], pa.list_(pa.int32()))})

    parts = written(texts.repartition(wide, "row").mapInArrow(take_apart, PART), "parts")
    nodes = parts.where("symbols is not null").repartition(wide, "row", "part", "leaf").mapInArrow(leaf_ids, PART)
    most = parts.agg(F.max("leaves")).first()[0] or 1
    while most > 1:
        nodes = nodes.withColumn("run", F.floor(F.col("leaf") / FAN)).groupBy("row", "part", "run").applyInArrow(lambda t: join(t.drop(["run"])), PART)
        most = -(-most // FAN)
    return parts.where("symbols is null").unionByName(nodes).groupBy("row").applyInArrow(put_together, "row long, ids array<int>")


def long_words(limit: int) -> re.Pattern:
    """Words of more than ``limit`` bytes."""
    return re.compile(rb"[^\x20\x09-\x0D]{%d,}" % (limit + 1))


def _plain(coder: WordEncoder, text: bytes) -> list[int]:
    """The ids of a stretch without long words."""
    out: list[int] = []
    for s in slices(pa.array([text.decode()])):
        _, slot = coder.slots_of(s)
        out += coder.ids(slot)[0].tolist()
    return out


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", long_bytes: int = LONG_BYTES) -> DataFrame:
    """id_col, ids array<int>: the ids of each whole text."""

    def code(coder: WordEncoder, s: Slice) -> list[pa.Array]:
        first, slot = coder.slots_of(s)
        ids, begin = coder.ids(slot)
        return [pa.ListArray.from_arrays(pa.array(begin[first], pa.int32()), pa.array(ids, pa.int32()))]

    return _coded(docs, id_col, text_col, path, WordEncoder, code, lambda ids, _: (ids,), "ids array<int>", long_bytes)


def decode(ids: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id_col, text: the library's decode(ids, skip_special_tokens=False); null ids give ""."""
    id_type = ids.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        for batch in batches:
            texts = tokenizer.decode_batch([x or [] for x in batch.column(1).to_pylist()], skip_special_tokens=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return ids.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {id_type}, text string")


def digest(docs: DataFrame, path: str, long_bytes: int = LONG_BYTES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each whole text."""

    def code(coder: _TextEncoder, s: Slice) -> list[pa.Array]:
        first, slot = coder.slots_of(s)
        count = coder.counts(slot)
        n = np.diff(np.concatenate([[0], np.cumsum(count)])[first])
        some = count > 0
        if not some.all():  # units without ids leave no space behind
            first, slot = np.concatenate([[0], np.cumsum(some)])[first], slot[some]
        id_text, token_text, bounds = coder.id_text, coder.token_text, first.tolist()
        at, a, b = slot.tolist(), [], []
        for i in range(s.rows):
            own = at[bounds[i] : bounds[i + 1]]
            a.append(hashlib.sha256(b" ".join([id_text[j] for j in own])).hexdigest())
            b.append(hashlib.sha256(b" ".join([token_text[j] for j in own])).hexdigest())
        return [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]

    def whole(ids: list[int], tokenizer) -> tuple:
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        return len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), decoded))

    docs = docs.select(F.col("doc_id").cast("long"), "text")
    return _coded(docs, "doc_id", "text", path, _TextEncoder, code, whole, "n_tokens long, ids_sha256 string, decoded_sha256 string", long_bytes)
