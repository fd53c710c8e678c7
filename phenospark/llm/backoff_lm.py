"""Language-model scores from a weighted backoff automaton (operator 6).

Tokens are white-space separated words (A-Z as a-z) and one end a text; all
words that training lacks are one unknown token. States are contexts: the last
two tokens, the last one, none. An arc of a state takes a token of an n-gram that
training has, with its smoothed probability, to the state of the longest context
that ends in it. A token without an arc takes the state's failure arc, with its
weight, to the state of the next shorter context, and is tried again there; the
state of no context has an arc for every token. One left-to-right pass over a text
carries the state and adds up the log-probabilities of arcs and failure arcs:

    P3(w | u v) = share3 * c(u v w) / c(u v) + (1 - share3) * P2(w | v)
    P2(w | v)   = share2 * c(v w) / c(v)     + (1 - share2) * P1(w)
    P1(w)       = (max(c(w) - discount, 0) + discount * V / (V + 1)) / N

so an arc weighs P3 (P2, P1) of its n-gram, and the failure arcs of two and of one
token weigh 1 - share3 and 1 - share2. A context that training never saw has no
state. At every state the probabilities of the V known tokens and the unknown one
sum to one.

All training texts are counted, whole, with no cut-off. What grows with the
corpus is never broadcast or collected: each chunk of documents sends its
distinct tokens, pairs and triples to buckets, which count them over the corpus
and answer each chunk's own. From these a task builds the part of the automaton
that its chunk's texts pass through (see :mod:`chunks`). Keys have 50 bits beside
those that name the bucket (64 at most), and a bucket's keys don't grow with the
input: the chance that one of its keys has a false count is some 2e-9.

A text is walked in stretches of STRETCH tokens, all stretches of a chunk side by
side, so a very long text costs no more than many short ones. A stretch begins two
tokens early, without adding up: after two tokens the state is that of the whole
text, whatever it was before.

Null and empty texts are the end alone. A null doc_id counts as training. Repeated
rows are scored, and counted, as often as they come. Empty table: no rows. Extra
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenospark.llm.chunks import by_bucket, chunked, expand, joined, opened, others, press
from phenospark.llm.common import written
from phenospark.llm.textkernel import Words, mix, words

DISCOUNT = 0.75
SHARE2, SHARE3 = 0.3, 0.5
#: Keys of the text's two borders.
START, END = np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)
#: Tokens of a text that are walked one after the other.
STRETCH = 128


def held_out(ids: list, parts: int, part: int) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % parts == part for i in ids], bool)


class _Words:
    """The distinct words of a chunk, and which each of its words is."""

    def __init__(self, row: dict):
        self.words = words(opened(row), lower=True)
        self.key, self.inverse = np.unique(self.words.hash, return_inverse=True)
        rest = others(row)
        self.ids = rest.column(0).to_pylist() if rest is not None else []


class _Sequence:
    """All texts of a chunk with their borders, and its distinct pairs and triples of tokens.

    key: their hashes, sorted; first: the position of the last token of each one's
    first occurrence; inverse: which each position's pair, then each one's triple, is.
    """

    def __init__(self, w: Words):
        n, rows = len(w.hash), len(w.first) - 1
        self.begin = w.first[:-1] + 2 * np.arange(rows)  # of each text's start
        token = np.full(n + 2 * rows, END, np.uint64)
        token[self.begin] = START
        self.word_at = np.arange(n) + 2 * w.row + 1
        token[self.word_at] = w.hash
        self.row = np.repeat(np.arange(rows), np.diff(w.first) + 2)
        place = np.arange(len(token)) - self.begin[self.row]
        self.two, self.three = np.flatnonzero(place >= 1), np.flatnonzero(place >= 2)
        a, b = token[self.two - 1], token[self.two]
        pair = mix(a * np.uint64(0x9FB21C651E98DF25) + b)
        triple = mix(mix(token[self.three - 2] * np.uint64(0xD6E8FEB86659FD93) + token[self.three - 1]) * np.uint64(0xA0761D6478BD642F) + token[self.three] + np.uint64(3))
        self.key, first, self.inverse = np.unique(np.concatenate([pair, triple]), return_index=True, return_inverse=True)
        self.is_pair = first < len(self.two)
        self.first = np.concatenate([self.two, self.three])[first]
        self.size = len(token)

    def counts(self, learns: np.ndarray) -> np.ndarray:
        rows = np.concatenate([self.row[self.two], self.row[self.three]])
        return np.bincount(self.inverse, learns[rows], len(self.key)).astype(np.int64)


class Automaton:
    """The states and arcs that a chunk's texts pass through.

    Tokens are the chunk's words by number, then the end and the start. State 0 has
    no context, 1 + t that of token t, and those behind have two tokens.
    """

    def __init__(self, w: _Words, q: _Sequence, ones: np.ndarray, more: np.ndarray, ends: int, n: int, v: int, discount: float, share2: float, share3: float):
        """ones, more: the corpus counts of the chunk's words and of its pairs and triples."""
        many = len(ones)
        self.tokens = many + 2
        self.token = np.full(q.size, many)
        self.token[q.begin] = many + 1
        self.token[q.word_at] = w.inverse
        self.count = np.concatenate([ones, [ends, ends]])
        p1 = (np.maximum(self.count - discount, 0) + discount * v / (v + 1)) / n if n else np.ones(self.tokens)
        p1[many + 1] = 1.0  # the start is no token
        pair_at = np.full(q.size, -1)
        pair_at[q.two] = q.inverse[: len(q.two)]
        state2 = 1 + self.tokens + np.arange(len(q.key))
        seen = more > 0
        two, three = np.flatnonzero(q.is_pair & seen), np.flatnonzero(~q.is_pair & seen)
        left, right = self.token[q.first[two] - 1], self.token[q.first[two]]
        p2 = np.zeros(len(q.key))
        p2[two] = share2 * more[two] / self.count[left] + (1 - share2) * p1[right]
        before, after = pair_at[q.first[three] - 1], pair_at[q.first[three]]
        p3 = share3 * more[three] / more[before] + (1 - share3) * p2[after]
        every = np.arange(self.tokens)
        key = np.concatenate([every, (1 + left) * self.tokens + right, state2[before] * self.tokens + self.token[q.first[three]]])
        order = np.argsort(key)
        self.arc = key[order]
        self.to = np.concatenate([np.where(self.count > 0, 1 + every, 0), state2[two], state2[after]])[order]
        self.log = np.log10(np.concatenate([p1, p2[two], p3]))[order]
        self.fail_to = np.zeros(1 + self.tokens + len(q.key), np.int64)
        self.fail_to[state2[two]] = 1 + right
        self.fail_log = np.full(len(self.fail_to), np.log10(1 - share3))
        self.fail_log[: 1 + self.tokens] = np.log10(1 - share2)

    def step(self, state: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next states, and the logs of the arcs and failure arcs on the way."""
        state, log = state.copy(), np.zeros(len(state))
        todo = np.arange(len(state))
        while len(todo):
            key = state[todo] * self.tokens + token[todo]
            at = np.minimum(np.searchsorted(self.arc, key), len(self.arc) - 1)
            hit = self.arc[at] == key
            log[todo[hit]] += self.log[at[hit]]
            state[todo[hit]] = self.to[at[hit]]
            todo = todo[~hit]
            log[todo] += self.fail_log[state[todo]]
            state[todo] = self.fail_to[state[todo]]
        return state, log

    def walk(self, begin: np.ndarray) -> np.ndarray:
        """The log-probability of each text; begin: the positions of their starts."""
        stop = np.append(begin[1:], len(self.token))
        pieces = -(-(stop - begin - 1) // STRETCH)
        row = np.repeat(np.arange(len(begin)), pieces)
        turn = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        low = begin[row] + 1 + turn * STRETCH
        high = np.minimum(low + STRETCH, stop[row])
        order = np.argsort(low - high, kind="stable")  # longest first
        low, high, row = low[order], high[order], row[order]
        state, total = np.zeros(len(row), np.int64), np.zeros(len(row))
        for back in (2, 1):  # the two tokens before, as far as the text has them
            some = np.flatnonzero(low - back >= begin[row])
            state[some], _ = self.step(state[some], self.token[low[some] - back])
        length = high - low
        for k in range(int(length.max(initial=0))):
            live = int(np.searchsorted(-length, -k, "left"))
            state[:live], log = self.step(state[:live], self.token[low[:live] + k])
            total[:live] += log
        return np.bincount(row, total, len(begin))


SENT = "bucket int, chunk long, keys binary, counts binary"
COUNTED = "chunk long, bucket int, totals binary, tokens long, types long"


def _bits(buckets: int) -> int:
    """Bits of a key that travel: 50 besides those that name the bucket."""
    return min(64, 50 + (buckets - 1).bit_length())


def _cuts(key: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys cut to their bits, the buckets' least keys, and where each bucket's keys begin."""
    bits = _bits(buckets)
    least = np.array([-(-(b << bits) // buckets) for b in range(buckets)], np.uint64)
    key = key >> np.uint64(64 - bits)
    return key, least, np.append(np.searchsorted(key, least), len(key))


def _send(chunk: int, key: np.ndarray, count: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Sorted distinct keys with their counts in the chunk; a bucket's keys travel as steps from one
    to the next, byte by byte of all steps, as their upper bytes are 0."""
    key, least, first = _cuts(key, buckets)
    full = np.flatnonzero(np.diff(first))
    keys, counts = [], []
    for b in full.tolist():
        own = slice(first[b], first[b + 1])
        keys.append(press(np.diff(key[own], prepend=least[b : b + 1]).view(np.uint8).reshape(-1, 8).T))
        counts.append(press(count[own]))
    return pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(np.full(len(full), chunk, np.int64)), pa.array(keys, pa.binary()), pa.array(counts, pa.binary())], ["bucket", "chunk", "keys", "counts"])


def _counted(sent: DataFrame, buckets: int) -> DataFrame:
    """COUNTED: the corpus counts of what each chunk sent; a bucket's first row has its sums."""
    bits = _bits(buckets)

    def run(table: pa.Table) -> pa.Table:
        least = np.uint64(-(-(table.column("bucket")[0].as_py() << bits) // buckets))
        counts = [expand(x.as_py(), np.int64) for x in table.column("counts")]
        keys = [np.cumsum(np.ascontiguousarray(expand(raw.as_py()).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64) + least for raw in table.column("keys")]
        ends = np.cumsum([len(x) for x in counts])
        key = np.concatenate(keys)
        del keys
        order = np.argsort(key)
        key = key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        del key
        total = np.add.reduceat(np.concatenate(counts)[order], np.flatnonzero(new))
        got = np.empty(len(order), np.int64)
        got[order] = total[np.cumsum(new) - 1]
        sums = [[int(x)] + [0] * (table.num_rows - 1) for x in (total.sum(), (total > 0).sum())]
        return pa.table({"chunk": table.column("chunk").cast(pa.int64()), "bucket": table.column("bucket").cast(pa.int32()), "totals": pa.array([press(x) for x in np.split(got, ends[:-1])], pa.binary()), "tokens": pa.array(sums[0], pa.int64()), "types": pa.array(sums[1], pa.int64())})

    return by_bucket(sent, buckets).groupBy("bucket").applyInArrow(run, COUNTED)


def _told(found: list[dict] | None, key: np.ndarray, buckets: int) -> np.ndarray:
    _, _, first = _cuts(key, buckets)
    out = np.zeros(len(key), np.int64)
    for x in found or ():
        out[first[x["bucket"]] : first[x["bucket"] + 1]] = expand(x["totals"], np.int64)
    return out


def score(docs: DataFrame, parts: int = 7, part: int = 2, discount: float = DISCOUNT, share2: float = SHARE2, share3: float = SHARE3) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each row of docs(doc_id, text)."""
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    chunks = chunked(docs, "text")
    buckets = chunks.buckets
    many = 2 * buckets

    def send_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = _Words(row)
                learns = np.repeat(~held_out(c.ids, parts, part), np.diff(c.words.first))
                yield _send(row["chunk"], c.key, np.bincount(c.inverse, learns, len(c.key)).astype(np.int64), buckets)

    def send_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = _Words(row)
                got = _Sequence(c.words)
                yield _send(row["chunk"], got.key, got.counts(~held_out(c.ids, parts, part)), many)

    singles = written(_counted(chunks.table.mapInArrow(send_words, SENT), buckets), "words")
    sums = singles.agg(F.sum("tokens"), F.sum("types")).first()
    ends = docs.where(F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts != part, F.lit(True))).count()
    n, v = (sums[0] or 0) + ends, (sums[1] or 0) + (ends > 0)
    base_size = float(n + v + 1)
    known = joined(chunks, chunks.table, singles, "ones", ("bucket", "totals"))
    known = joined(chunks, known, _counted(chunks.table.mapInArrow(send_ngrams, SENT), many), "more", ("bucket", "totals"))

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                c = _Words(row)
                q = _Sequence(c.words)
                walker = Automaton(c, q, _told(row["ones"], c.key, buckets), _told(row["more"], q.key, many), ends, n, v, discount, share2, share3)
                count = walker.count[walker.token]
                totals = []
                for x in (np.log10((count + 1) / base_size), (count > 0).astype(float)):
                    x[q.begin] = 0  # the start is no token
                    whole = np.concatenate([[0], np.cumsum(x)])
                    totals.append(whole[np.append(q.begin[1:], q.size)] - whole[q.begin])
                tokens = np.diff(c.words.first) + 1
                out = [pa.array(c.ids, pa.int64()), pa.array(held_out(c.ids, parts, part)), pa.array(tokens.astype(np.int64)), pa.array(np.rint(totals[1]).astype(np.int64)), pa.array(np.full(len(tokens), n, np.int64)), pa.array(totals[0]), pa.array(walker.walk(q.begin))]
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return known.mapInArrow(add_up, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
