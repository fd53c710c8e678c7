"""Rows that bounds leave at a score of 0 or less, and words built to share sums modulo 2^64."""

import hashlib

import numpy as np
import pyarrow as pa
import pytest

from phenospark.llm import bpe_codec, chosen_path, maxscore, recompress
from phenospark.llm.queries import vocabulary
from phenospark.llm.textkernel import slices, words
from tests.llm.test_operators import top_products


def twins(n=1024):
    """The Thue-Morse word of letters a and b, and its complement."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


@pytest.mark.parametrize("size", [1024, 4096])
@pytest.mark.parametrize("lower", [False, True])
def test_built_words_differ(size, lower):
    s = next(slices(pa.array([" ".join(twins(size)) + " short short"])))
    a, b, c, d = words(s, lower=lower).hash
    assert a != b and c == d


def test_long_words_in_lower_case_are_equal():
    word = twins()[0]
    s = next(slices(pa.array([f"{word} {word.upper()}"])))
    a, b = words(s, lower=True).hash
    assert a == b and len(set(words(s).hash)) == 2


def test_built_words_through_operators(spark):
    from tokenizers import Tokenizer

    one, two = twins()
    frame = spark.createDataFrame([(1, one), (2, two)], "doc_id long, text string")
    tokenizer = Tokenizer.from_file(vocabulary())
    got = {r.doc_id: r.ids for r in bpe_codec.encode(frame, vocabulary()).collect()}
    assert got == {1: tokenizer.encode(one, add_special_tokens=False).ids, 2: tokenizer.encode(two, add_special_tokens=False).ids}
    head = " ".join(f"w{i}" for i in range(12))
    frame = spark.createDataFrame([(1, f"{head} {one}"), (2, f"{head} {two}")], "doc_id long, text string")
    kept = {r.doc_id: r for r in recompress.digest(frame).collect()}
    assert kept[2].n_removed == 0 and kept[2].kept_sha256 == hashlib.sha256(f"{head} {two}".encode()).hexdigest()
    frame = spark.createDataFrame([(1, " ".join([one] * 9)), (2, " ".join([two] * 9))], "doc_id long, text string")
    assert chosen_path.keep_one(frame).count() == 2


def scores_of(vectors):
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    return rows, sorted((q, r + 1, int(n), int(s)) for q in range(0, len(rows), 20) for r, (n, s) in enumerate(zip(*next(maxscore.tile_top(np.array([rows[q][1]]), np.array([q]), np.array([v for _, v in rows]), np.arange(len(rows)), 20, 64.0))[1:], strict=True)))


@pytest.mark.parametrize("kind", ["zero query", "two filled, signed", "two filled, above 0", "all below 0", "all small"])
def test_no_row_is_lost_at_floors_of_0_and_less(kind):
    rng = np.random.default_rng(8)
    for _ in range(5):
        v = rng.normal(size=(300, 64))
        if kind == "zero query":
            v[::20] = 0
        elif kind.startswith("two"):
            v[np.arange(64) != rng.integers(64, size=(300, 1))] = 0
            v[np.arange(300), rng.integers(64, size=300)] += 1
            v = np.abs(v) if kind.endswith("0") else v
        elif kind == "all below 0":
            v = np.abs(v)
            v[::20] *= -1
        else:
            v = np.abs(v) / 1000
        rows, got = scores_of(v)
        assert got == top_products(rows)


def test_few_rows_share_a_term(spark):
    vectors = np.zeros((90, 8))
    vectors[np.arange(90), np.arange(90) % 8] = np.where(np.arange(90) % 3, 1.0, -1.0)
    vectors[::20] = 0
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(vectors)]
    frame = spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], "vec_id long, embedding array<double>, id string, rank int, v string")
    assert sorted(map(tuple, maxscore.search(frame).collect())) == top_products(rows)


def test_intersections_of_many_buckets_in_bounded_squares():
    """Pairs of thousands of small buckets: no square over all their rows is made."""
    import tracemalloc

    rng = np.random.default_rng(9)
    sets = [np.unique(rng.integers(0, 60, 30)).astype(np.uint64) for _ in range(30_000)]
    a, b = (np.array(x) for x in zip(*((10 * g + i, 10 * g + j) for g in range(3000) for i in range(10) for j in range(i + 1, 10)), strict=True))
    tracemalloc.start()
    got = chosen_path._common(sets, a, b)
    assert tracemalloc.get_traced_memory()[1] < 300e6
    tracemalloc.stop()
    some = rng.choice(len(a), 500)
    assert all(got[i] == len(set(sets[a[i]].tolist()) & set(sets[b[i]].tolist())) for i in some)
