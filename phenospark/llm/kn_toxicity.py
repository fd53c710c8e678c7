"""Toxicity by class-conditional Kneser-Ney models (operator 3).

Two bigram models, of toxic and of ordinary texts, are fitted on labelled rows.
Both back off in the same way: a bigram to its word, weighted by the discounted
mass of its context, a word to one shared continuation distribution over the
words of both classes. All words and pairs of the labelled rows count, by
documents and less the discount; the words' shared pairs stand between a class's
pairs and the words, so rare evidence is weighed by smoothing and not cut off.
Beside that comparison stands a second one, of the telling n-grams alone (document
frequencies that differ by more than chance, G-squared), as many faint
differences drown a few strong ones. Words that neither class has say nothing.
Copies of a text are one document of the fit.

A text is scored in windows of ``window`` words (the last one begins earlier if
it would be short) and as a whole: the length-normalised toxic less the
length-normalised ordinary log-likelihood. Of both comparisons the largest window
and the mean of the text, and the number of windows (the maximum of many windows is larger by chance)
go into a logistic curve. The models are fitted on all labelled rows; the curve
sees each row through models that were fitted without its part of the rows.

The fit takes ``sample`` labelled rows a class at most (those with the smallest
hash of doc_id): the documented bound of the classifier, and so of the model
that is broadcast. Scoring reads every text whole, in one pass.

Words are runs of ASCII letters and digits and bytes above 127, A-Z as a-z. A
text without words has a score of its own from the curve at no evidence. Null
text: as empty. Labels that are null are no labels; a doc_id with several rows or
labels is used as often as it has them, within the sample. Repeated rows are scored
as often as they come. Very long texts are scored whole. Empty table: no rows. Extra
columns are not read. Nothing but the text enters a score.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenospark.llm.common import crc_of_id
from phenospark.llm.textkernel import IS_BREAK, Slice, Words, mix, slices, words

#: Labelled rows of each class that the models are fitted on, at most.
SAMPLE = 1500
WINDOW = 24
SHORT = 8
DISCOUNT = 0.9
#: Least G-squared of a telling n-gram; chance gives it to one in a million.
EVIDENCE = 24.0
FEATURES = 6
#: Parts of the labelled rows, for the curve.
PARTS = 4


def _pairs(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of words with one before them in their text, and the pairs' hashes."""
    follows = np.ones(len(h), bool)
    follows[first[:-1][first[:-1] < len(h)]] = False
    at = np.flatnonzero(follows)
    return at, mix(h[at - 1] * np.uint64(0x9FB21C651E98DF25) + h[at])


@dataclass
class Ratios:
    """Log-likelihood differences, toxic less ordinary: of words, of the backoff weights
    of words as contexts, and of pairs beyond both."""

    word_key: np.ndarray
    word_log: np.ndarray
    left_log: np.ndarray
    pair_key: np.ndarray
    pair_log: np.ndarray

    def log_ratio(self, h: np.ndarray, first: np.ndarray) -> np.ndarray:
        if not len(self.word_key):
            return np.zeros(len(h))
        place = np.minimum(np.searchsorted(self.word_key, h), len(self.word_key) - 1)
        known = self.word_key[place] == h
        out = np.where(known, self.word_log[place], 0.0)
        at, pair = _pairs(h, first)
        # a pair of the models has words of theirs
        both = known[at - 1] & known[at]
        out[at] += np.where(known[at - 1], self.left_log[place[at - 1]], 0.0)
        out[at[both]] += _look(self.pair_key, self.pair_log, pair[both])
        return out


@dataclass
class Model:
    """The telling and all n-grams; the curve."""

    telling: Ratios
    complete: Ratios
    curve: np.ndarray
    middle: np.ndarray
    spread: np.ndarray

    def features(self, s: Slice, window: int = WINDOW) -> np.ndarray:
        """Of each row: the best window, the mean, log of the windows, whether it has words; best and mean of all n-grams."""
        w = words(s, lower=True, breaks=IS_BREAK)
        n = np.diff(w.first)
        some = n > 0
        out = np.zeros((s.rows, FEATURES))
        out[:, 2] = np.log1p(n / window)
        out[:, 3] = some
        # windows that begin at each word, up to the one that ends the text
        last = np.repeat(np.maximum(w.first[1:] - window, w.first[:-1]), n)
        start = np.arange(len(w.hash))
        start = start[start <= last]
        row = np.searchsorted(w.first, start, "right") - 1
        stop = np.minimum(start + window, w.first[row + 1])
        for ratios, at in ((self.telling, 0), (self.complete, 4)):
            whole = np.concatenate([[0], np.cumsum(ratios.log_ratio(w.hash, w.first))])
            best = np.full(s.rows, -np.inf)
            # the rows' windows follow each other; a text of fewer words than SHORT counts as SHORT, as a word or two prove little
            level, heads = (whole[stop] - whole[start]) / np.maximum(stop - start, SHORT), np.flatnonzero(np.diff(row, prepend=-1))
            if len(heads):
                best[row[heads]] = np.maximum.reduceat(level, heads)
            out[:, at] = np.where(some, best, 0)
            out[:, at + 1] = np.where(some, (whole[w.first[1:]] - whole[w.first[:-1]]) / np.maximum(n, 1), 0)
        return out

    def score(self, s: Slice) -> np.ndarray:
        x = (self.features(s) - self.middle) / self.spread
        return 1 / (1 + np.exp(-np.clip(x @ self.curve[1:] + self.curve[0], -500, 500)))


def _look(keys: np.ndarray, values: np.ndarray, h: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(h))
    at = np.searchsorted(keys, h)
    at[at == len(keys)] = 0
    return np.where(keys[at] == h, values[at], 0.0)


def _slice(texts: list[str]) -> list[Slice]:
    """All texts as one slice."""
    return list(slices(pa.array(texts, pa.large_string()), 1 << 40, 1 << 40))


@dataclass
class _Table:
    """Sorted n-grams of a class with counts and document frequencies; of pairs also their two words."""

    key: np.ndarray
    n: np.ndarray
    docs: np.ndarray
    one: np.ndarray | None = None
    two: np.ndarray | None = None

    def of(self, column: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """The column's values of the keys, 0 where there are none."""
        return _look(self.key, column.astype(float), keys)


def _counts(texts: list[str]) -> tuple[_Table, _Table]:
    """The words and the pairs of a class."""
    w = Words(np.zeros(0, int), np.zeros(0, int), np.zeros(0, np.uint64), np.zeros(1, int))
    for s in _slice(texts):  # one slice, whatever its size
        w = words(s, lower=True, breaks=IS_BREAK)
    row = w.row
    at, pair = _pairs(w.hash, w.first)

    def table(key: np.ndarray, rows: np.ndarray, place: np.ndarray | None) -> _Table:
        names, where, inverse, n = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
        in_docs = np.unique(inverse * max(1, len(texts)) + rows) // max(1, len(texts))
        docs = np.bincount(in_docs, minlength=len(names))
        return _Table(names, n, docs) if place is None else _Table(names, n, docs, w.hash[place[where] - 1], w.hash[place[where]])

    return table(w.hash, row, None), table(pair, row[at], at)


def _telling(one: _Table, other: _Table, n_one: int, n_other: int, evidence: float) -> np.ndarray:
    """The n-grams whose document frequencies differ by more than chance."""
    keys = np.union1d(one.key, other.key)
    a, b = one.of(one.docs, keys), other.of(other.docs, keys)
    share = (a + b) / (n_one + n_other)
    g = np.zeros(len(keys))
    for seen, n in ((a, n_one), (b, n_other)):
        for x, mean in ((seen, n * share), (n - seen, n * (1 - share))):
            g += 2 * x * np.log(np.maximum(x, 1e-9) / np.maximum(mean, 1e-9))
    return keys[g >= evidence]


def _telling_ratios(classes: list[tuple[_Table, _Table]], sizes: list[int], discount: float, evidence: float = EVIDENCE) -> Ratios:
    """The comparison by telling n-grams alone."""
    # the shared continuation counts: in how many distinct pairs of either class a word comes second
    _, where = np.unique(np.concatenate([c[1].key for c in classes]), return_index=True)
    base_key, base_n = np.unique(np.concatenate([c[1].two for c in classes])[where], return_counts=True)
    total = base_n.sum() + len(base_n) + 1
    base = lambda h: (_look(base_key, base_n.astype(float), h) + 1) / total
    known = _telling(classes[0][0], classes[1][0], *sizes, evidence)
    pairs = _telling(classes[0][1], classes[1][1], *sizes, evidence)
    first, second = np.zeros(len(pairs), np.uint64), np.zeros(len(pairs), np.uint64)
    for _, t in classes:
        if len(t.key):
            at = np.minimum(np.searchsorted(t.key, pairs), len(t.key) - 1)
            hit = t.key[at] == pairs
            first[hit], second[hit] = t.one[at[hit]], t.two[at[hit]]
    _, group = np.unique(first, return_inverse=True)
    word_p, pair_p, left_p = [], [], []
    for singles, twos in classes:
        own = np.maximum(singles.of(singles.n, known) - discount, 0) / max(1, singles.n.sum())
        left = 1 - own.sum()
        # what is left goes to the shared counts; a word that isn't telling has the same share of it in both classes
        word_p.append(own + left * base(known))
        arc = np.maximum(twos.of(twos.n, pairs) - discount, 0) / np.maximum(singles.of(singles.n, first), 1)
        mass = np.bincount(group, arc, len(pairs))[group] if len(pairs) else arc
        pair_p.append(arc + (1 - mass) * (_look(known, own, second) + left * base(second)))
        left_p.append(left)
    level = np.log(left_p[0]) - np.log(left_p[1])
    word_log = np.log(word_p[0]) - np.log(word_p[1]) - level
    pair_log = np.log(pair_p[0]) - np.log(pair_p[1]) - level - _look(known, word_log, second)
    return Ratios(known, word_log, np.zeros(len(known)), pairs, pair_log)


def _all_ratios(classes: list[tuple[_Table, _Table]], discount: float) -> Ratios:
    """The comparison by all n-grams, counted by documents: a text that repeats itself is one event."""
    # the shared continuation counts, and the words of each pair
    pairs, where = np.unique(np.concatenate([c[1].key for c in classes]), return_index=True)
    first, second = (np.concatenate([getattr(c[1], side) for c in classes])[where] for side in ("one", "two"))
    base_key, base_n = np.unique(second, return_counts=True)
    known = np.union1d(classes[0][0].key, classes[1][0].key)
    base = (_look(base_key, base_n.astype(float), known) + 1) / (base_n.sum() + len(base_n) + 1)
    one, two = np.searchsorted(known, first), np.searchsorted(known, second)

    def rate(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Discounted shares of the pairs in their contexts; the contexts' backoff weights, 1 for one without pairs."""
        arc = np.maximum(n - discount, 0) / np.maximum(np.bincount(one, n, len(known)), 1)[one]
        return arc, 1 - np.bincount(one, arc, len(known))

    of_pairs = [twos.of(twos.docs, pairs) for _, twos in classes]
    arc, left = rate(of_pairs[0] + of_pairs[1])
    shared = arc + left[one] * base[two]
    word, pair, weight = [], [], []
    for (singles, _), n in zip(classes, of_pairs, strict=True):
        own = np.maximum(singles.of(singles.docs, known) - discount, 0) / max(1, singles.docs.sum())
        # a word that neither class has gets what its class leaves; less that, it says nothing
        word.append(np.log(own / (1 - own.sum()) + base))
        arc, left = rate(n)
        weight.append(np.log(left))
        pair.append(np.log(arc + left[one] * shared))
    word_log, left_log = word[0] - word[1], weight[0] - weight[1]
    # a pair of neither class backs off to its word by its context's weights
    return Ratios(known, word_log, left_log, pairs, pair[0] - pair[1] - word_log[two] - left_log[one])


def _models(toxic: list[str], ordinary: list[str], discount: float) -> Model:
    """The two models, without a curve."""
    classes = [_counts(x) for x in (toxic, ordinary)]
    sizes = [max(1, len(x)) for x in (toxic, ordinary)]
    return Model(_telling_ratios(classes, sizes, discount), _all_ratios(classes, discount), np.zeros(FEATURES + 1), np.zeros(FEATURES), np.ones(FEATURES))


def fit(toxic: list[str], ordinary: list[str], discount: float = DISCOUNT, parts: int = PARTS) -> Model:
    """The two models on all rows; the curve on each part's rows by the models of the other parts."""
    classes = [list(dict.fromkeys(x)) for x in (toxic, ordinary)]
    model = _models(*classes, discount)
    x, y = [np.zeros((0, FEATURES))], [np.zeros(0)]
    for part in range(parts if min(map(len, classes)) > 1 else 0):
        rest = _models(*([t for i, t in enumerate(c) if i % parts != part] for c in classes), discount)
        for label, c in zip((1.0, 0.0), classes, strict=True):
            got = [rest.features(s) for s in slices(pa.array(c[part::parts], pa.large_string()))]
            x += got
            y += [np.full(len(g), label) for g in got]
    x, y = np.concatenate(x), np.concatenate(y)
    if len(x) and 0 < y.sum() < len(y):
        model.middle, model.spread = x.mean(0), np.maximum(x.std(0), 1e-6)
        model.curve = _logistic((x - model.middle) / model.spread, y)
    return model


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method; both classes weigh the same."""
    x = np.column_stack([np.ones(len(x)), x])
    weight = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    b = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        step = np.linalg.solve(hess, x.T @ (weight * (y - p)) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


def learn(docs: DataFrame, labels: DataFrame, parts: int = 3, part: int = 1, sample: int = SAMPLE) -> Model:
    """A model from labelled rows whose crc32(doc_id) mod parts is not part; ``sample`` a class at most.

    The fit is one task over the sample; the driver gets the model alone."""
    known = labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).where((crc_of_id() % parts != part) & F.col("toxic").isin(0, 1))
    turn = F.xxhash64(F.lit(3), "doc_id")
    order = [turn, F.col("doc_id"), F.xxhash64("text")]
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    classes = []
    for toxic in (1, 0):
        own = known.where(F.col("toxic") == toxic).orderBy(turn, "doc_id").limit(sample)
        # at most ``sample`` ids, so this side is small whatever the input
        classes.append(texts.join(F.broadcast(own), "doc_id").orderBy(*order).limit(sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: dict[int, list[str]] = {1: [], 0: []}
        for batch in batches:
            for toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows[toxic].append(text or "")
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit(rows[1], rows[0]))], pa.binary())], ["model"])

    chosen = classes[0].unionByName(classes[1]).repartition(1).sortWithinPartitions(F.col("toxic").desc(), *order)
    got = chosen.select("toxic", "text").mapInArrow(run, "model binary").collect()
    return pickle.loads(got[0].model) if got else fit([], [])


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score for each row of docs(doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, s.rows), pa.array(shared.value.score(s))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def judged(docs: DataFrame, labels: DataFrame, parts: int = 3, part: int = 1, cut: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    scored = score(docs, learn(docs, labels, parts, part))
    return scored.select("doc_id", F.coalesce(crc_of_id() % parts == part, F.lit(False)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def reject(docs: DataFrame, model: Model, cut: float = 0.7) -> DataFrame:
    """docs without the rows whose text scores ``cut`` or more; in one pass, nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [shared.value.score(s) for s in slices(batch.column(place))]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0), *scores]) < cut))

    return docs.mapInArrow(run, docs.schema)
