"""Removal of passages that repeat across documents, by recompression (operator 9).

The words of all documents are renamed in rounds. A round first names each run
of equal symbols, then each pair whose left symbol has coin 0 and whose right
one has coin 1. Names and coins are hashes of what they stand for, so every task
gives the same name to the same thing without a shared table, and equal stretches
of words get equal symbols but for a few at their ends.

Finding: after two rounds, a symbol and its two neighbours depend on the words
from one before the left neighbour to one after the right one. A window of 13
words has the smallest such triple that lies inside it as its key, or its own
hash if none does (within long runs). So equal windows have equal keys wherever
they stand, and neighbouring windows mostly share one: about one key for four
words is sent. A key that two chunks, or two documents of one, have is shared.

Verifying: only windows with a shared key are compared themselves, by 64 bits from
each of two independent hashes of their words; each gets the smallest doc_id in which it starts.

Every exchange sends a key once for a chunk whatever its copies, so a passage of
a third of all documents costs each bucket one entry a chunk. Texts are written
once and never shuffled (see :mod:`chunks`).

Null text: no words. Null doc_id: such a row removes nothing and loses nothing.
Rows with one doc_id don't remove each other's words. Texts below 13 words stay.
Repeated rows come back as often as they came. Very long texts are one chunk each.
Empty table: no rows. Other columns come back as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from phenospark.llm.chunks import SENT, answers, chunked, expand, joined, opened, others, send, told
from phenospark.llm.common import free_name
from phenospark.llm.textkernel import Slice, Words, mix, span_hash, words

NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def _round(name: np.ndarray, begin: np.ndarray, row: np.ndarray, seed: int):
    """One round over all rows of a chunk: names, first words and rows of the new symbols."""
    n = len(name)
    if not n:
        return name, begin, row
    new = np.ones(n, bool)
    new[1:] = (name[1:] != name[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, n))
    base, begin, row = name[at], begin[at], row[at]
    coin = (mix(base ^ np.uint64(seed)) & np.uint64(1)).astype(bool)
    name = np.where(length > 1, mix(base + length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), base)
    pair = np.zeros(len(at), bool)
    pair[:-1] = ~coin[:-1] & coin[1:] & (row[:-1] == row[1:])
    second = np.zeros(len(at), bool)
    second[1:] = pair[:-1]
    i = np.flatnonzero(pair)
    name[i] = mix(name[i] * np.uint64(0xA0761D6478BD642F) + (name[i + 1] ^ np.uint64(0xE7037ED1A0B428DB)))
    return name[~second], begin[~second], row[~second]


def window_keys(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts of all windows of n words, and their keys."""
    size = len(w.hash)
    row = w.row
    last = np.repeat(w.first[1:], np.diff(w.first))
    start = np.flatnonzero(np.arange(size) + n <= last)
    if not len(start):
        return start, np.zeros(0, np.uint64)
    name1, begin1, row1 = _round(w.hash, np.arange(size), row, 0x51)
    name2, begin2, _ = _round(name1, begin1, row1, 0xA7)
    # the symbols of round 1 on either side, as they decide the round 2 symbol's ends
    first1 = np.searchsorted(begin1, begin2)
    after1 = np.append(first1[1:], len(begin1))
    edge = np.concatenate([[0], begin1, [size, size + n]])  # edge[i + 1]: begin of symbol i
    lo = edge[first1] - 1  # begin of the one before, less a word
    hi = edge[after1 + 2] + 1  # end of the one behind, and a word
    lo[first1 == 0] = -1
    wide = np.concatenate([[NONE], name1, [NONE]])
    key = mix((wide[first1] * np.uint64(3)) ^ mix(name2 + np.uint64(7)) ^ (wide[after1 + 1] * np.uint64(5)))
    from_, to = np.searchsorted(lo, start), np.searchsorted(hi, start + n, "right")
    best = np.full(len(start), NONE)
    padded = np.append(key, NONE)
    most = int((to - from_).max(initial=0))
    for j in range(max(0, most)):
        at = from_ + j
        best = np.minimum(best, np.where(at < to, padded[np.minimum(at, len(key))], NONE))
    bare = np.flatnonzero(to <= from_)
    if len(bare):
        best[bare] = _window_hash(w.hash, start[bare], n, 0x3C)
    return start, best


def _window_hash(hashes: np.ndarray, start: np.ndarray, n: int, seed: int) -> np.ndarray:
    got = np.full(len(start), np.uint64(seed), np.uint64)
    for j in range(n):
        got = (got ^ hashes[start + j]) * np.uint64(0x9FB21C651E98DF25)
        got ^= got >> np.uint64(29)
    return mix(got)


def _ids(rest: pa.RecordBatch, id_col: str) -> tuple[np.ndarray, np.ndarray]:
    column = rest.column(rest.schema.get_field_index(id_col))
    known = ~np.asarray(column.is_null())
    return np.asarray(column.fill_null(0).cast(pa.int64())), known


class _Chunk:
    """A chunk's windows of rows with an id, and their distinct keys."""

    def __init__(self, row: dict, id_col: str, n: int):
        self.slice: Slice = opened(row)
        self.rest = others(row)
        self.words = words(self.slice)
        ids, known = _ids(self.rest, id_col)
        self.start, self.key = window_keys(self.words, n)
        of = np.searchsorted(self.words.first, self.start, "right") - 1
        keep = known[of] if len(of) else np.zeros(0, bool)
        self.start, self.key, self.doc = self.start[keep], self.key[keep], ids[of[keep]] if len(of) else np.zeros(0, np.int64)
        self.keys, self.inverse = np.unique(self.key, return_inverse=True)

    def shared(self, found, buckets: int, n: int):
        """Of the windows with a shared key: index, distinct 128-bit hashes, smallest doc_id of each, which is whose."""
        low = np.full(len(self.keys), np.iinfo(np.int64).max)
        high = np.full(len(self.keys), np.iinfo(np.int64).min)
        np.minimum.at(low, self.inverse, self.doc)
        np.maximum.at(high, self.inverse, self.doc)
        hot = told(found, self.keys, buckets) | (low < high)
        at = np.flatnonzero(hot[self.inverse])
        # 64 bits from each of two hashes of the words, which have nothing in common
        other = span_hash(self.slice, self.words.start, self.words.end, seed=0x77) if len(at) else self.words.hash
        a, b = (_window_hash(x, self.start[at], n, seed) for x, seed in ((self.words.hash, 0x11), (other, 0x22)))
        order = np.lexsort((self.doc[at], b, a))
        sa, sb = a[order], b[order]
        new = np.ones(len(order), bool)
        new[1:] = (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1])
        which = np.empty(len(order), np.int64)
        which[order] = np.cumsum(new) - 1
        return at, sa[new], sb[new], self.doc[at][order][new], which


def _twice(keys: np.ndarray, _more: list[bytes]) -> np.ndarray:
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    same = np.zeros(len(s), bool)
    same[1:] = s[1:] == s[:-1]
    same[:-1] |= same[1:]
    out = np.empty(len(s), bool)
    out[order] = same
    return out


def _smaller_elsewhere(keys: np.ndarray, more: list[bytes]) -> np.ndarray:
    """Whether a smaller doc_id than the sender's has the window."""
    sent = [expand(m, np.int64).reshape(-1, 2) for m in more]
    low, doc = (np.concatenate([x[:, k] for x in sent]) if sent else np.zeros(0, np.int64) for k in (0, 1))
    order = np.lexsort((doc, low, keys))
    k, l, d = keys[order], low[order], doc[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (l[1:] != l[:-1])
    least = d[np.flatnonzero(new)][np.cumsum(new) - 1] if len(k) else d
    out = np.empty(len(k), bool)
    out[order] = least < d
    return out


def kept_bytes(s: Slice, w: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the kept words of each row joined by one space, and where each row begins."""
    n = len(s.data)
    change = np.zeros(n + 2, np.int8)
    start, end = w.start[keep], w.end[keep]
    first = np.concatenate([[0], np.cumsum(keep)])[w.first]
    # each kept word and one byte behind it; a row's last needs none
    full = np.flatnonzero(np.diff(first))
    tail = np.ones(len(start), bool)
    tail[first[full + 1] - 1] = False
    stop = end + tail
    np.add.at(change, start, 1)
    np.subtract.at(change, stop, 1)
    mask = np.cumsum(change[:n]).astype(bool)
    data = s.data.copy()
    data[end[tail]] = 0x20
    count = np.zeros(n + 1, np.int64)
    np.cumsum(mask, out=count[1:])
    return data[mask], count[s.offs]


def remove_repeats(docs: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """docs with the repeated words taken out of text_col, and dedup_words, dedup_removed
    (with underscores behind them if docs has such columns).

    A word goes if a window of n consecutive words covers it whose words also
    start in a row with a smaller id. What stays is joined by single spaces.
    digest: kept_sha256 of it in place of the text.
    """
    chunks = chunked(docs, text_col)
    buckets = chunks.buckets

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield send(row["chunk"], _Chunk(row, id_col, n).keys, buckets)

    found = answers(chunks.table.mapInArrow(find, SENT), buckets, _twice)
    known = joined(chunks, chunks.table, found, "shared", ("bucket", "bits"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                _, a, b, doc, _ = _Chunk(row, id_col, n).shared(row["shared"], buckets, n)
                yield send(row["chunk"], a, buckets, np.stack([b.view(np.int64), doc], 1))

    judged = joined(chunks, known, answers(known.mapInArrow(verify, SENT), buckets, _smaller_elsewhere), "earlier", ("bucket", "bits"))
    kept_name = "kept_sha256" if digest else text_col
    total_name, removed_name = free_name(docs, "dedup_words"), free_name(docs, "dedup_removed")
    out = T.StructType([f for f in docs.schema if f.name != text_col])
    out = T.StructType([*out.fields, T.StructField(kept_name, T.StringType()), T.StructField(total_name, T.LongType()), T.StructField(removed_name, T.LongType())])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = _Chunk(row, id_col, n)
                at, a, _, doc, which = c.shared(row["shared"], buckets, n)
                twin = told(row["earlier"], a, buckets)
                goes = (c.doc[at] > doc[which]) | twin[which] if len(at) else np.zeros(0, bool)
                step = np.zeros(len(c.words.hash) + n + 1, np.int64)
                np.add.at(step, c.start[at[goes]], 1)
                np.subtract.at(step, c.start[at[goes]] + n, 1)
                gone = np.cumsum(step)[: len(c.words.hash)] > 0
                total = np.diff(c.words.first)
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[c.words.first])
                data, offs = kept_bytes(c.slice, c.words, ~gone)
                raw = data.tobytes()
                if digest:
                    bounds = offs.tolist()
                    kept = pa.array([hashlib.sha256(raw[i:j]).hexdigest() for i, j in zip(bounds, bounds[1:], strict=False)], pa.string())
                else:
                    kept = pa.StringArray.from_buffers(len(offs) - 1, pa.py_buffer(offs.astype(np.int32)), pa.py_buffer(raw))
                yield pa.RecordBatch.from_arrays([*c.rest.columns, kept, pa.array(total.astype(np.int64)), pa.array(removed.astype(np.int64))], [*c.rest.schema.names, kept_name, total_name, removed_name])

    return judged.mapInArrow(remove, out)


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256."""
    found = remove_repeats(docs.select(F.col("doc_id").cast("long"), "text"), digest=True)
    return found.select("doc_id", F.col("dedup_words").alias("n_words"), F.col("dedup_removed").alias("n_removed"), "kept_sha256")
