"""Exact top-k inner-product search with MaxScore (operator 4).

Each dimension is a term. A shard (a block of candidates) keeps of each term a
posting list: the rows whose component isn't 0, with their components, and the
largest and the smallest of them, which bound what the term can add to a query's
score. A query's terms are sorted by that bound. The weakest, whose bounds
together stay below the k-th best score so far, are non-essential: a row that is
in no essential list can't come in. The essential lists are traversed, one after
the other, into an accumulator. A row whose accumulated score and the bounds of
the remaining terms reach the k-th best score is still competitive; it is probed
in the non-essential terms, strongest first, and dropped as soon as its score and
what is left can't reach it any more. The k-th best score starts from the shard's
first rows. Spark merges the shards' best k. Bounds only skip work: the result is
exact. ``work`` tells how many products were taken.

A list that holds most of a shard's rows is kept as a column (a gap is a 0), as
there is nothing to skip in it; one that holds few is kept as rows and values.

Scores are whole numbers, exact whatever their size: where products may pass 2^53
in a double, components of such rows are multiplied as Python's integers. A score
outside of a long comes back as the nearest long; rows are ordered by scores of up
to 37 digits, which also larger ones are cut to. Ties go to the smaller id. Rows
with the query's id are its own and are left out. Repeated rows of an id and a
vector count once; an id with several vectors is a query with each of them and may
be found with each, so it can take several ranks. Fewer candidates than k: all of
them. Unusable vectors (see :mod:`vectors`) take no part. Empty table: no rows.
Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phenospark.llm.vectors import clean, foremost, tiles, widened

#: Rows of a shard, and its first ones, which every query is compared with.
SHARD, HEAD = 8192, 256
#: Share of a shard's rows from which a posting list is kept as a column.
FULL = 0.25
LONG = 2**63 - 1
WIDEST = 10**37


@dataclass
class Postings:
    """The posting lists of a shard of whole numbers (rows x terms)."""

    rows: int
    high: np.ndarray
    low: np.ndarray
    columns: np.ndarray
    slot: np.ndarray
    lists: dict[int, tuple[np.ndarray, np.ndarray]] = field(default_factory=dict)

    @classmethod
    def of(cls, shard: np.ndarray) -> Postings:
        n, terms = shard.shape
        filled = np.count_nonzero(shard, 0)
        full = np.flatnonzero(filled >= FULL * n) if n else np.zeros(0, int)
        slot = np.full(terms, -1)
        slot[full] = np.arange(len(full))
        out = cls(n, shard.max(0, initial=0), shard.min(0, initial=0), np.ascontiguousarray(shard[:, full].T), slot)
        for t in np.flatnonzero((filled > 0) & (slot < 0)).tolist():
            at = np.flatnonzero(shard[:, t])
            out.lists[t] = (at, shard[at, t])
        return out

    def components(self, term: int, rows: np.ndarray) -> np.ndarray:
        """A term's components of some rows (in order), 0 where the list hasn't them."""
        if self.slot[term] >= 0:
            return self.columns[self.slot[term]][rows]
        at, values = self.lists.get(term, (np.zeros(0, int), np.zeros(0)))
        if not len(at):
            return np.zeros(len(rows))
        place = np.minimum(np.searchsorted(at, rows), len(at) - 1)
        return np.where(at[place] == rows, values[place], 0)


@dataclass
class Work:
    """Products taken, and those of comparing all rows in all terms."""

    products: int = 0
    brute: int = 0


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if len(scores) > 4 * k:
        least = np.partition(scores, -k)[-k]
        some = np.flatnonzero(scores >= least)
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def shard_top(query: np.ndarray, query_id: int, postings: Postings, ids: np.ndarray, head: np.ndarray, k: int, work: Work | None = None) -> tuple[np.ndarray, np.ndarray]:
    """ids and scores of a query's best k in a shard; head: its scores of the shard's first rows."""
    own = np.flatnonzero(ids == query_id)
    first = np.delete(head, own[own < len(head)])
    floor = np.partition(first, -k)[-k] if len(first) >= k else -np.inf
    bound = np.maximum(np.maximum(query * postings.high, query * postings.low), 0)
    order = np.argsort(-bound, kind="stable")  # strongest first
    order = order[query[order] != 0]
    # what the terms from each place on can add at most
    left = np.append(np.cumsum(bound[order][::-1])[::-1], 0.0)
    # terms from here on can't reach the floor by themselves: a row in none of the earlier ones has at most left[essential]
    essential = int(np.argmax(left < floor)) if (left < floor).any() else len(order)
    total = np.zeros(postings.rows)
    essentials = order[:essential]
    dense = essentials[postings.slot[essentials] >= 0]
    touched = len(dense) * postings.rows
    if len(dense):
        total += query[dense] @ postings.columns[postings.slot[dense]]
    for t in essentials[postings.slot[essentials] < 0].tolist():
        at, values = postings.lists.get(t, (np.zeros(0, int), np.zeros(0)))
        total[at] += query[t] * values
        touched += len(at)
    # a row in none of these lists has 0 so far: it stays where the floor lets it, as with scores of 0 and less
    alive = total + left[essential] >= floor
    alive[own] = False
    rows = np.flatnonzero(alive)
    score = total[rows]
    for place in range(essential, len(order)):
        if not len(rows):
            break
        score = score + query[order[place]] * postings.components(order[place], rows)
        touched += len(rows)
        keep = score + left[place + 1] >= floor
        rows, score = rows[keep], score[keep]
    if work is not None:
        work.products += touched
        work.brute += postings.rows * len(query)
    top = best_of(score, ids[rows], k)
    return ids[rows][top], score[top]


def exact_integers(row: np.ndarray, scale: float) -> list[int]:
    """floor(scale * x) of each component, of any size."""
    return [math.floor(Fraction(float(x)) * Fraction(scale)) for x in row]


def tile_top(q: np.ndarray, q_ids: np.ndarray, c: np.ndarray, c_ids: np.ndarray, k: int, scale: float, work: Work | None = None) -> Iterator[tuple[int, np.ndarray, list[int]]]:
    """(query id, ids, scores) of each query row in one shard, from the vectors as they are."""
    # below this all sums are whole numbers that a double holds
    most = math.sqrt(2.0**52 / max(1, q.shape[1])) / scale - 1
    plain_q, plain_c = np.abs(q).max(1, initial=0) < most, np.abs(c).max(1, initial=0) < most
    whole, ids = np.floor(c[plain_c] * scale), c_ids[plain_c]
    postings = Postings.of(whole)
    vast = [(int(i), exact_integers(row, scale)) for i, row in zip(c_ids[~plain_c], c[~plain_c], strict=True)]
    head = np.floor(q * scale) @ whole[:HEAD].T if plain_q.any() else np.zeros((len(q), 0))
    if work is not None:
        work.products += int(plain_q.sum()) * min(HEAD, len(whole)) * q.shape[1]
    for i in range(len(q)):
        found: list[tuple[int, int]] = []
        if plain_q[i]:
            near, score = shard_top(np.floor(q[i] * scale), int(q_ids[i]), postings, ids, head[i], k, work)
            found = [(-int(s), int(n)) for s, n in zip(score.tolist(), near.tolist(), strict=True)]
        if vast or not plain_q[i]:
            own = exact_integers(q[i], scale)
            others = vast if plain_q[i] else vast + [(int(n), [int(x) for x in row]) for n, row in zip(ids, whole, strict=True)]
            found += [(-sum(a * b for a, b in zip(own, row, strict=True)), n) for n, row in others if n != q_ids[i]]
        found = sorted(found)[:k]
        yield int(q_ids[i]), np.array([n for _, n in found], np.int64), [-s for s, _ in found]


def top_k(queries: DataFrame, candidates: DataFrame, k: int, scale: float = 1.0) -> DataFrame:
    """queries, candidates: id, v. query_id, rank, vec_id, score of the inner products of floor(scale * v)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in batch.to_pylist():
                width = max(t["q_dims"], t["c_dims"])
                q_ids, c_ids = (np.frombuffer(t[f"{s}_ids"], np.int64) for s in "qc")
                q, c = (widened(np.frombuffer(t[f"{s}_data"]).reshape(len(n), t[f"{s}_dims"]), width) for s, n in (("q", q_ids), ("c", c_ids)))
                got = list(tile_top(q, q_ids, c, c_ids, k, scale))
                scores = [s for _, _, own in got for s in own]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.repeat([i for i, _, _ in got], [len(n) for _, n, _ in got]).astype(np.int64)),
                        pa.array(np.concatenate([n for _, n, _ in got])),
                        pa.array([min(LONG, max(-LONG - 1, s)) for s in scores], pa.int64()),
                        pa.array([None if -LONG <= s <= LONG else str(min(WIDEST, max(-WIDEST, s))) for s in scores], pa.string()),
                    ],
                    ["query_id", "vec_id", "score", "beyond"],
                )

    found = tiles(queries.distinct(), candidates, SHARD, lambda m: m.tobytes()).mapInArrow(run, "query_id long, vec_id long, score long, beyond string")
    whole = F.coalesce(F.col("beyond").cast("decimal(38,0)"), F.col("score").cast("decimal(38,0)"))
    best = Window.partitionBy("query_id").orderBy(F.desc(whole), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search(embeddings: DataFrame, every: int = 20, k: int = 20, scale: float = 64.0) -> DataFrame:
    """Components become floor(scale * x); queries are rows whose vec_id ``every`` divides."""
    vectors = clean(embeddings, "vec_id", "embedding")
    return top_k(vectors.where(F.col("id") % every == 0), foremost(vectors, k), k, scale)
