"""The array kernels against plain Python."""

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from phenospark.llm import pii
from phenospark.llm.bpe_tree import TreeEncoder
from phenospark.llm.packing import first_fit_decreasing
from phenospark.llm.recompress import window_keys
from phenospark.llm.ring import overflow
from phenospark.llm.textkernel import slices, words

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    from phenospark.llm.queries import vocabulary

    return Tokenizer.from_file(vocabulary())


def test_words_are_those_of_the_pattern():
    random.seed(1)
    texts = ["".join(random.choice("ab é\n\t\x0b\x1f 中") for _ in range(random.randint(0, 40))) for _ in range(300)] + [None, "", "x" * 5000]
    got, names = [], {}
    for s in slices(pa.array(texts), 100):
        w = words(s)
        for i in range(s.rows):
            own = [s.data[a:b].tobytes() for a, b in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]], strict=True)]
            got.append(own)
            for x, h in zip(own, w.hash[w.first[i] : w.first[i + 1]].tolist(), strict=True):
                assert names.setdefault(h, x) == x
    assert got == [WORD.findall((t or "").encode()) for t in texts]
    assert len(set(names.values())) == len(names)


@pytest.mark.parametrize("alphabet", [1, 2, 3, 50])
def test_equal_windows_have_equal_keys(alphabet):
    """Runs, periods and borders too: the key depends on the window alone."""
    rng = np.random.default_rng(alphabet)
    base = [str(x) for x in rng.integers(0, alphabet, 200)]
    texts = []
    for _ in range(60):
        a = int(rng.integers(0, 150))
        texts.append(" ".join([*map(str, rng.integers(0, alphabet, rng.integers(0, 20))), *base[a : a + 40], *map(str, rng.integers(0, alphabet, rng.integers(0, 9)))]))
    texts += ["a " * 60, "a b " * 40, "c a b a b a b a b a b a b a b a b a b a b"]
    seen = {}
    for s in slices(pa.array(texts)):
        w = words(s)
        start, key = window_keys(w, 13)
        content = [s.data[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)]
        assert len(start) == sum(max(0, len(t.split()) - 12) for t in texts)
        for i, k in zip(start.tolist(), key.tolist(), strict=True):
            assert seen.setdefault(tuple(content[i : i + 13]), k) == k


def test_tree_encoder_is_exact(tokenizer):
    tree = TreeEncoder(tokenizer, leaf=8, window=1)
    random.seed(2)
    alphabets = ["ab", "thean", "abcdefghijklmnopqrstuvwxyz", "!?.=-", "0123456789", "éèaçn", "中文字abc", "a'reb", "😂❤a!", "́e≠"]
    for _ in range(1500):
        a = random.choice(alphabets)
        t = "".join(random.choice(a) for _ in range(random.randint(0, 120)))
        if random.random() < 0.2:
            t = t[:50] + "<|endoftext|>" + t[50:]
        assert tree.encode(t) == tokenizer.encode(t, add_special_tokens=False).ids, t


def test_first_fit_decreasing_is_that_of_a_scan():
    rng = np.random.default_rng(3)
    for n in (1, 2, 50, 300):
        lengths = rng.integers(1, 101, n)
        sequence, offset = first_fit_decreasing(lengths, np.arange(n), 100)
        free, want = [], {}
        for i in np.lexsort((np.arange(n), -lengths)):
            j = next((j for j, f in enumerate(free) if f >= lengths[i]), len(free))
            if j == len(free):
                free.append(100)
            want[i] = (j, 100 - free[j])
            free[j] -= lengths[i]
        assert [(sequence[i], offset[i]) for i in range(n)] == [want[i] for i in range(n)]


def test_overflow_fills_every_room_once():
    rng = np.random.default_rng(4)
    for _ in range(50):
        shards, arcs = 5, 40
        owner = rng.integers(0, shards, arcs).tolist()
        counts = (rng.integers(0, 30, arcs) * (rng.random(arcs) < 0.7)).tolist()
        counts[0] += 300  # a hot group
        total = sum(counts)
        room = [total // shards + (s < total % shards) for s in range(shards)]
        parts = overflow(counts, owner, room)
        assert sorted((a, r) for a, lo, hi, _, _ in parts for r in range(lo, hi)) == [(a, r) for a in range(arcs) for r in range(counts[a])]
        slots = {}
        for _, lo, hi, s, first in parts:
            slots.setdefault(s, []).extend(range(first, first + hi - lo))
        assert all(sorted(slots.get(s, [])) == list(range(room[s])) for s in range(shards))


def brute_spans(t):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def keeps(kind, x):
        digits = re.sub("[^0-9]", "", x)
        if kind == "ip":
            return all(int(y) <= 255 for y in x.split("."))
        if kind == "card":
            total = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits)))
            return 13 <= len(digits) <= 19 and total % 10 == 0
        return kind != "phone" or 9 <= len(digits) <= 15

    return [(k, len(t[: m.start()].encode()), len(t[: m.end()].encode())) for k, p in kinds.items() for m in re.finditer(p, t) if keeps(k, m[0])]


def test_base_spans_are_those_of_the_patterns():
    random.seed(5)
    for _ in range(5000):
        t = "".join(random.choice(random.choice(["0123456789", "a.b@-", "+ ().-", " ", "1.2", "é4"])) for _ in range(random.randint(0, 60)))
        assert brute_spans(t) == pii.base_spans(t.encode()), t


def test_base_spans_are_linear_in_long_runs():
    for t in (b"1" * 300_000, b"a" * 300_000, b"1." * 150_000, b"a@" * 150_000, b"+1" * 150_000, b"1 " * 150_000, b"a." * 150_000 + b"@"):
        pii.base_spans(t)


def test_luhn():
    assert pii.luhn(b"4111111111111111") and not pii.luhn(b"4111111111111112")


def test_crc_of_ids_is_that_of_zlib():
    from phenospark.llm.backoff_lm import held_out

    assert held_out([5, None, -3], 7, 2).tolist() == [zlib.crc32(b"5") % 7 == 2, False, zlib.crc32(b"-3") % 7 == 2]
