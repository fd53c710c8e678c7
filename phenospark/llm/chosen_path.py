"""Similarity join on word n-grams by chosen paths (operator 7).

A text is the set of its five-word shingles (A-Z as a-z; a text of one to four
words is one shingle; an empty one has none and links to nothing). Equal sets
are one class from the start. Each set is embedded as 128 tokens: the smallest
hash of each of 128 ranges of the hash space, an empty range taking the token of
another. Two sets share a token with the probability of their Jaccard
similarity.

A run is a tree of buckets. At each of its nodes a token's place is drawn by the
node's own path, so that sets which went other ways are split at other places, and
the sets of the node are dealt by their token there. A bucket of more than
``small`` sets is split further, up to ``depth`` tokens; then buckets are compared by brute force, in blocks where one is still
large. Pairs at the threshold share all tokens of a path with probability
threshold^depth at least, so ``runs`` are repeated until the chance that none
catches such a pair is below 1 - recall (11 runs for 0.999; most buckets are
small after one token, where it is below 1e-7).

A pair counts in the first run in which its bucket is common, so links count
once and no pair is sent on. It is screened by its tokens (128 x 0.8 less five
deviations) and then decided by its whole shingle sets. Buckets report links by
set and local roots; components come from :mod:`components`.

Null text: as empty. Null doc_id: its row comes back with no class and no links.
Repeated rows come back as often as they came.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenospark.llm.common import free_name, partitions, side, written
from phenospark.llm.components import components
from phenospark.llm.textkernel import Slice, grams, mix, slices, words

TOKENS = 128
SMALL = 1024
DEPTH = 3


def shingle_sets(s: Slice, n: int = 5) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each row."""
    w = words(s, lower=True)
    got, ok = grams(w, n, 5)
    first = w.first.tolist()
    out = []
    for i in range(s.rows):
        a, b = first[i], first[i + 1]
        if b - a >= n:
            out.append(np.unique(got[a : b - n + 1]))
        elif b > a:
            h = np.array([b - a], np.uint64)
            for x in w.hash[a:b]:
                h = mix(h ^ x) * np.uint64(0x9FB21C651E98DF25)
            out.append(mix(h))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def set_name(s: np.ndarray) -> bytes:
    """128 bits of a set."""
    return np.array([mix(s).sum(dtype=np.uint64), mix(s ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64) + np.uint64(len(s))], np.uint64).tobytes()


def tokens(sets: list[np.ndarray]) -> np.ndarray:
    """A row of TOKENS 32-bit tokens for each set; empty sets have zeros."""
    edges = np.arange(1, TOKENS, dtype=np.uint64) * np.uint64((1 << 64) // TOKENS)
    value = np.zeros((len(sets), TOKENS), np.uint64)
    full = np.zeros((len(sets), TOKENS), bool)
    for i, s in enumerate(sets):
        if len(s):
            at = np.concatenate([[0], np.searchsorted(s, edges), [len(s)]])
            full[i] = at[:-1] < at[1:]
            value[i] = s[np.minimum(at[:-1], len(s) - 1)]
    todo = ~full & full.any(1)[:, None]
    places = np.arange(TOKENS, dtype=np.uint64)
    turn = 1
    while todo.any():
        donor = (mix(places + np.uint64(turn * 1009)) % np.uint64(TOKENS)).astype(np.int64)
        can = todo & full[:, donor]
        value = np.where(can, value[:, donor] + np.uint64(turn), value)
        todo &= ~can
        turn += 1
    return np.where(full.any(1)[:, None], mix(value), 0).astype(np.uint32)


def run_count(threshold: float, depth: int, recall: float) -> int:
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - threshold**depth)))


def _embed(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, text_key, name, n, tokens of docs(doc_id, text, text_key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(1)):
                sets = shingle_sets(s, n)
                rows = tokens(sets)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(s.lo, s.rows), batch.column(2).slice(s.lo, s.rows), pa.array([set_name(x) for x in sets], pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "text_key", "name", "n", "tokens"])

    return docs.mapInArrow(run, "doc_id long, text_key long, name binary, n long, tokens binary")


def _paths(sets: DataFrame, runs: int, depth: int) -> DataFrame:
    """name, run, p1 ... p(depth): the path's hash after each token."""
    names = [f"p{k + 1}" for k in range(depth)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint32).reshape(-1, TOKENS).astype(np.uint64)
            for r in range(runs):
                path, cols = np.full(len(t), np.uint64(r + 1)), []
                for k in range(depth):
                    # drawn by the path: sets that are together so far look at the same place
                    place = (mix(path + np.uint64(0x632BE59BD9B4E019)) % np.uint64(TOKENS)).astype(np.int64)
                    path = mix(path * np.uint64(0x9E3779B97F4A7C15) + t[np.arange(len(t)), place])
                    cols.append(pa.array(path.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(t), r, np.int32)), *cols], ["name", "run", *names])

    return sets.select("name", "tokens").mapInArrow(run, "name binary, run int, " + ", ".join(f"{p} long" for p in names))


def _leaves(paths: DataFrame, small: int, depth: int) -> DataFrame:
    """name, run, leaf, size for buckets of two sets or more."""
    now, found = paths, None
    for k in range(1, depth + 1):
        p = f"p{k}"
        counts = now.groupBy(p).agg(F.count("*").alias("size")).where("size > 1")
        joined = written(now.join(counts, p), "paths")
        done = (joined if k == depth else joined.where(F.col("size") <= small)).select("name", "run", F.col(p).alias("leaf"), "size")
        found = done if found is None else found.unionByName(done)
        now = joined.where(F.col("size") > small).drop("size")
    return found


class _Groups:
    """Whole groups of rows out of sorted Arrow batches."""

    def __init__(self, batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]):
        self.batches, self.keys = batches, keys

    def __iter__(self) -> Iterator[pa.Table]:
        """Tables that hold one or more whole groups."""
        rest: pa.Table | None = None
        for batch in self.batches:
            table = pa.Table.from_batches([batch])
            if rest is not None:
                table = pa.concat_tables([rest, table])
            if not table.num_rows:
                continue
            k = [table.column(c).to_numpy() for c in self.keys]
            differs = np.flatnonzero(np.any([x != x[-1] for x in k], 0))
            cut = int(differs[-1]) + 1 if len(differs) else 0
            if cut:
                yield table.slice(0, cut)
            rest = table.slice(cut)
        if rest is not None and rest.num_rows:
            yield rest


def _candidates(table: pa.Table, runs: int, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of row numbers that may reach the threshold and first meet here, in bounded portions."""
    k = [table.column(c).to_numpy() for c in ("leaf", "i", "k")]
    block, run, n = table.column("block").to_numpy(), table.column("run").to_numpy(), table.column("n").to_numpy()
    keys = np.frombuffer(b"".join(table.column("keys").to_pylist()), np.int64).reshape(-1, runs)
    sketch = np.frombuffer(b"".join(table.column("sketch").to_pylist()), np.uint8).reshape(-1, TOKENS)
    new = np.ones(len(n), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in k], 0)
    start = np.flatnonzero(new)
    stop = np.append(start[1:], len(n))
    end = np.repeat(stop, stop - start)
    least = threshold * TOKENS - 5 * math.sqrt(TOKENS * threshold * (1 - threshold))
    each = end - np.arange(len(n)) - 1  # partners behind each row
    ahead = np.concatenate([[0], np.cumsum(each)])
    lo = 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(ahead, ahead[lo] + 200_000, "right")) - 1)
        a = np.repeat(np.arange(lo, hi), each[lo:hi])
        b = a + 1 + np.arange(len(a)) - np.repeat(ahead[lo:hi] - ahead[lo], each[lo:hi])
        ok = (k[1][a] == k[2][a]) | (block[a] != block[b])  # two blocks: only across
        ok &= np.minimum(n[a], n[b]) >= threshold * np.maximum(n[a], n[b])
        a, b = a[ok], b[ok]
        if len(a):
            r = run[a]
            met = (keys[a] == keys[b]) & (keys[a] != 0)
            ok = met.argmax(1) == r
            a, b = a[ok], b[ok]
            ok = (sketch[a] == sketch[b]).sum(1) >= least
            a, b = a[ok], b[ok]
        if len(a):
            yield a, b
        lo = hi


#: Rows whose intersections are counted in one square of numbers (16 MB).
ACROSS = 2048


def _common(sets: list[np.ndarray], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the pairs."""
    rows, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    if len(rows) > ACROSS:  # pairs of many buckets: partners stand near each other
        half = len(a) // 2
        return np.concatenate([_common(sets, a[:half], b[:half]), _common(sets, a[half:], b[half:])])
    ia, ib = inverse[: len(a)], inverse[len(a) :]
    if len(a) < 4 * len(rows):
        return np.array([len(np.intersect1d(sets[x], sets[y], assume_unique=True)) for x, y in zip(a.tolist(), b.tolist(), strict=True)], np.int64)
    flat = np.concatenate([sets[r] for r in rows])
    owner = np.repeat(np.arange(len(rows)), [len(sets[r]) for r in rows])
    _, column, times = np.unique(flat, return_inverse=True, return_counts=True)
    keep = times[column] > 1
    number = np.cumsum(times > 1) - 1
    column, owner = number[column[keep]], owner[keep]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    width = max(64, min(8192, (8 << 20) // len(rows)))
    together = np.zeros((len(rows), len(rows)), np.float32)
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, width):
        x, y = np.searchsorted(column, [lo, lo + width])
        part = np.zeros((len(rows), width), np.float32)
        part[owner[x:y], column[x:y] - lo] = 1
        together += part @ part.T
    return together[ia, ib].astype(np.int64)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest row of each row's local component."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


MEMBER = "leaf long, i int, k int, block int, run int, name binary, n long, copies long, keys binary, sketch binary"


def near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """doc_id, class_id, n_links, n_set_links for each row of docs(doc_id, text).

    class_id: the smallest doc_id that links lead to, copies included. n_links:
    other rows with a similarity of threshold or more; n_set_links: other
    shingle sets with one. how: as of :func:`classes`.
    """
    return classes(docs, **how).select("doc_id", "class_id", "n_links", "n_set_links")


def classes(docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.999, small: int = SMALL, depth: int = DEPTH) -> DataFrame:
    """near_duplicates, with text_key (xxhash64 of the text) and root, the class of the row's text; an
    id with several texts may be in several classes. root is null for a null doc_id and an empty text."""
    spark = docs.sparkSession
    runs = run_count(threshold, depth, recall)
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("text_key"))
    every = written(_embed(docs, n), "sets")
    known = every.where("doc_id is not null and n > 0")
    sets = written(known.groupBy("name").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("tokens").alias("tokens")), "sets")
    leaves = written(_leaves(_paths(sets, runs, depth), small, depth), "leaves")

    # every set that meets another: its leaf in each run (0: alone), and a byte of each token
    of_run = [F.coalesce(F.max(F.when(F.col("run") == r, F.col("leaf"))), F.lit(0)) for r in range(runs)]
    met = leaves.groupBy("name").agg(F.array(*of_run).alias("leaf_of"), F.array(*[F.coalesce(F.max(F.when(F.col("run") == r, F.col("size"))), F.lit(0)) for r in range(runs)]).alias("size_of"))
    met = met.join(sets.select("name", "n", "copies", "tokens"), "name")
    member = "leaf long, blocks int, block int, run int, name binary, n long, copies long, keys binary, sketch binary"

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 2048):
                part = batch.slice(lo, 2048)
                leaf = np.asarray(part.column("leaf_of").flatten()).reshape(-1, runs)
                size = np.asarray(part.column("size_of").flatten()).reshape(-1, runs)
                sketch = (np.frombuffer(b"".join(part.column("tokens").to_pylist()), np.uint32).reshape(-1, TOKENS) & 0xFF).astype(np.uint8)
                sketches, keys = [x.tobytes() for x in sketch], [x.tobytes() for x in leaf]
                own = np.frombuffer(b"".join(part.column("name").to_pylist()), np.uint64)[::2]
                row, run = np.nonzero(leaf)
                blocks = -(-size[row, run] // small)
                block = (own[row] % blocks.astype(np.uint64)).astype(np.int32)
                row_list = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(leaf[row, run]), pa.array(blocks.astype(np.int32)), pa.array(block), pa.array(run.astype(np.int32)), part.column("name").take(row_list), part.column("n").take(row_list), part.column("copies").take(row_list), pa.array([keys[x] for x in row.tolist()], pa.binary()), pa.array([sketches[x] for x in row.tolist()], pa.binary())], [f.split()[0] for f in member.split(", ")])

    placed = met.select("name", "n", "copies", "leaf_of", "size_of", "tokens").mapInArrow(place, member)
    # a bucket larger than small is compared block by block
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    placed = placed.select("leaf", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("k"), "block", "run", "name", "n", "copies", "keys", "sketch")
    wide = max(12, partitions(spark))

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _Groups(batches, ("leaf", "i", "k")):
            live = np.zeros(table.num_rows, bool)
            for a, b in _candidates(table, runs, threshold):
                live[a] = live[b] = True
            if live.any():
                yield from table.filter(pa.array(live)).combine_chunks().to_batches()

    at = ["leaf", "i", "k"]
    involved = written(placed.repartition(wide, *at).sortWithinPartitions(*at).mapInArrow(screen, MEMBER), "involved")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(0)):
                got = shingle_sets(s, n)
                yield pa.RecordBatch.from_arrays([pa.array([set_name(x) for x in got], pa.binary()), pa.array([x.tobytes() for x in got], pa.binary())], ["name", "shingles"])

    wanted = sets.join(involved.select("name").distinct(), "name", "left_semi").select(F.col("first_doc").alias("doc_id")).distinct()
    whole = docs.join(wanted, "doc_id", "left_semi").select("text").mapInArrow(again, "name binary, shingles binary")
    whole = whole.groupBy("name").agg(F.first("shingles").alias("shingles"))

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _Groups(batches, ("leaf", "i", "k")):
            sets_of = [np.frombuffer(x, np.uint64) for x in table.column("shingles").to_pylist()]
            size, copies = table.column("n").to_numpy(), table.column("copies").to_numpy()
            links, set_links = np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
            us, vs = [], []
            for a, b in _candidates(table, runs, threshold):
                common = _common(sets_of, a, b)
                ok = common >= threshold * (size[a] + size[b] - common) - 1e-9
                a, b = a[ok], b[ok]
                np.add.at(links, a, copies[b])
                np.add.at(links, b, copies[a])
                np.add.at(set_links, a, 1)
                np.add.at(set_links, b, 1)
                us.append(a)
                vs.append(b)
            if not sum(map(len, us)):
                continue
            root = _roots(len(size), np.concatenate(us), np.concatenate(vs))
            some = np.flatnonzero(set_links)
            name = table.column("name").combine_chunks()
            yield pa.RecordBatch.from_arrays([name.take(pa.array(some)), name.take(pa.array(root[some])), pa.array(links[some]), pa.array(set_links[some])], ["name", "root", "links", "set_links"])

    linked = involved.join(whole, "name").select(*[f.split()[0] for f in MEMBER.split(", ")], "shingles")
    verified = written(linked.repartition(wide, *at).sortWithinPartitions(*at).mapInArrow(verify, "name binary, root binary, links long, set_links long"), "links")
    counts = verified.groupBy("name").agg(F.sum("links").alias("links"), F.sum("set_links").alias("set_links"))
    # the set of an edge that stays alone in its star is its own root
    rooted = components(verified.select(F.col("name").alias("u"), F.col("root").alias("v")))
    heads = sets.select("name", "first_doc", "copies")
    labelled = heads.join(rooted, F.col("name") == F.col("node"), "left").withColumn("root", F.coalesce("root", "name")).drop("node")
    labelled = written(labelled, "labelled")  # each plan stays small, and so does the driver
    least = labelled.groupBy("root").agg(F.min("first_doc").alias("class_id"))
    of_set = written(labelled.join(least, "root").join(counts, "name", "left").select("name", "root", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("set_links", F.lit(0)).alias("set_links")), "of_set")
    rows = every.select("doc_id", "text_key", F.when(F.col("doc_id").isNotNull() & (F.col("n") > 0), F.col("name")).alias("name"))
    out = rows.join(of_set, "name", "left")
    return out.select("doc_id", "text_key", "root", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce(F.col("links") + F.col("copies") - 1, F.lit(0)).cast("long").alias("n_links"), F.coalesce("set_links", F.lit(0)).cast("long").alias("n_set_links"))


def keep_one(docs: DataFrame, **how) -> DataFrame:
    """docs with one row of each class: that of the smallest doc_id, of that id the text of the least hash.

    Rows with a null doc_id or an empty text are in no class and all stay.
    """
    doc, key = free_name(docs, "dup_id"), free_name(docs, "dup_key")
    rows = written(classes(docs, **how).where("root is not null").groupBy("root", "doc_id", "text_key").agg(F.count("*").alias("rows")), "classes")
    first = rows.groupBy("root").agg(F.min(F.struct("doc_id", "text_key")).alias("first"))
    judged = rows.join(first, "root").withColumn("stays", F.struct("doc_id", "text_key") == F.col("first"))
    judged = written(judged.where(~F.col("stays") | (F.col("rows") > 1)).select(F.col("doc_id").alias(doc), F.col("text_key").alias(key), "stays"), "losers")
    losers, repeated = (side(judged.where(c).select(doc, key)) for c in (~F.col("stays"), F.col("stays")))
    is_one = (docs["doc_id"].cast("long") == F.col(doc)) & (F.xxhash64(docs["text"].cast("string")) == F.col(key))
    kept = docs.join(losers, is_one, "left_anti")
    if repeated.isEmpty():
        return kept
    return kept.join(repeated, is_one, "left_anti").unionByName(kept.join(repeated, is_one, "left_semi").dropDuplicates(["doc_id", "text"]))
