"""Operator 11: counts against plain Python, estimates against the same steps in NumPy, planted outliers."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from phenospark.llm import outliers as op

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, cells long, size long, start int, cell long, w string, n long"


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, 1, 2, 3, 4, "w", 5) for i, t, lang, source in rows], SCHEMA).repartition(3)


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    often, covered = Counter(grams), set()
    for i, g in enumerate(grams):
        if often[g] > 1:
            covered |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    marks = sum(33 <= ord(c) < 127 and not c.isalnum() for c in text) - symbols
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), len(lines), sum(c.isupper() for c in text), marks


def vector(c):
    n, chars, symbols, dup, rep, lines, capitals, marks = c
    share = lambda a, b: math.log1p(20 * a / b)
    z = (math.log(chars / n), share(symbols, n), share(dup, lines), share(rep, n), share(capitals, chars), share(marks, chars))
    return [int(math.floor(v * 1024 + 0.5)) for v in z]


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(5)
    vocab = ["".join(rng.choice(list("abcdefghij"), rng.integers(1, 9))) for _ in range(300)]

    def prose(n):
        words = rng.choice(vocab, n).tolist()
        return "".join(w.capitalize() if i % 9 == 0 else w + (".\n" if i % 9 == 8 else " ") for i, w in enumerate(words))

    out = [(i, prose(int(rng.integers(60, 200))), ["en", "fr", None][i % 3], f"s{i % 6 // 3 if i % 3 else 0}") for i in range(450)]
    out += [(900, None, "en", "s0"), (901, "", "en", "s0"), (902, " \n\t ", "xx", None), (None, prose(80), "en", None), (903, "a b c a b c", "en", "s0"), (904, "one", "fr", "s9")]
    out += [(905, "x " * 4000 + "end of it", "en", "s1"), (906, "q" * 50_000 + " " + prose(70), "fr", "s0"), (907, "same line here\n" * 30, "en", "s0"), (908, "𝒳 é ü 𝒳 é ü 𝒳", "en", "s0")]
    out += [(910 + i, " ".join(w + "***" for w in rng.choice(vocab, 90)), ["en", "fr", None][i % 3], "s0") for i in range(6)]
    out += [(920 + i, " ".join(w.upper() + "!!" for w in rng.choice(vocab, 90)), ["en", "fr", None][i % 3], "s0") for i in range(6)]
    return out + [out[3]] * 40


def test_counts(spark, rows):
    got = {(r.doc_id, r.n_words, r.n_symbols, r.n_repeat_words): r for r in op.counted(table(spark, rows)).collect()}
    for i, text, _, _ in rows:
        c = counts(text)
        r = got[i, c[0], c[2], c[4]]
        assert tuple(r[n] for n in op.BASE) == c[:5]
        assert r.base_failed == (c[0] < 50 or 100 * c[4] > 50 * c[0])
        assert [r[n] for n in op.NAMES] == (vector(c) if c[0] else [None] * op.P)


def steps(z, share=0.75):
    """The same concentration in NumPy, over the rows of a group (in whole numbers)."""
    z = z / op.UNIT
    floor2 = np.diag(np.square(list(op.FLOORS.values())))
    q = np.quantile(z, [0.25, 0.5, 0.75], axis=0)
    med, w = q[1], np.maximum((q[2] - q[0]) / 1.349, list(op.FLOORS.values()))
    u = (z - med) / w
    direction = u / np.maximum(np.linalg.norm(u, axis=1), 1e-300)[:, None]
    t = np.tanh(u)
    c = np.cov(t.T, bias=True)
    d = np.maximum(np.outer(np.diag(c), np.diag(c)), 1e-12) ** 0.5
    ww = np.outer(w, w)
    begin = [(med, np.diag(w**2)), (med + u.mean(0) * w, np.cov(u.T, bias=True) * ww + floor2), (med, c / d * ww + floor2), (med, op.P * direction.T @ direction / len(u) * ww + floor2)]
    best = None
    for m, v in begin:
        last = np.inf
        while True:
            d2 = np.einsum("ij,jk,ik->i", z - m, np.linalg.inv(v), z - m)
            bucket = np.floor(np.log(np.maximum(d2, 1e-9)) * op.BUCKETS)
            near = bucket <= np.sort(bucket)[math.ceil(len(z) * share) - 1]
            m2, v2 = z[near].mean(0), np.cov(z[near].T, bias=True).reshape(op.P, op.P) + floor2
            det = np.linalg.slogdet(v2)[1]
            if det >= last - 1e-6:
                break
            m, v, last = m2, v2, det
        if best is None or last < best[0]:
            best = last, m, v
    _, m, v = best
    d2 = np.einsum("ij,jk,ik->i", z - m, np.linalg.inv(v), z - m)
    near = d2 <= op.consistency(share) * op.chi2_quantile(0.975, op.P)
    m, v = z[near].mean(0), np.cov(z[near].T, bias=True) * op.consistency(0.975) + floor2
    return np.einsum("ij,jk,ik->i", z - m, np.linalg.inv(v), z - m)


def groups_of(rows, least):
    keyed = [("0" if lang is None else "=" + lang, "0" if s is None else "=" + s) for _, t, lang, s in rows]
    has = [bool(counts(t)[0]) for _, t, _, _ in rows]
    n = Counter(k for k, h in zip(keyed, has, strict=True) if h)
    small = Counter()
    for k, v in n.items():
        if v < least:
            small[k[0]] += v
    return [k if n[k] >= least else ((k[0] if small[k[0]] >= least else "*"), "*") for k in keyed], has


def test_distances_are_those_of_plain_steps(spark, rows, monkeypatch):
    monkeypatch.setattr(op, "CELL_ROWS", 20)  # every group is several cells
    got = {}
    for r in op.scored(table(spark, rows), least=60).collect():
        got.setdefault(r.doc_id, []).append(r.d2)
    group, has = groups_of(rows, 60)
    assert len(set(group)) >= 4 and ("*", "*") in group
    want = {}
    for g in set(group):
        at = [i for i, k in enumerate(group) if k == g and has[i]]
        for i, d2 in zip(at, steps(np.array([vector(counts(rows[i][1])) for i in at], float)), strict=True):
            want[i] = d2
    for i, (doc, _, _, _) in enumerate(rows):
        own = got[doc]
        assert len(own) == sum(r[0] == doc for r in rows)
        if i in want:
            assert np.allclose(own, want[i], rtol=1e-6, atol=1e-9)
        else:
            assert own == [None]


def test_planted_outliers_go_and_clean_documents_stay(spark, rows):
    judged = op.judged(table(spark, rows))
    assert set(judged.columns) == {"doc_id", *op.BASE, "base_failed", "kept", "distance"}
    got = judged.collect()
    assert len(got) == len(rows)
    kept = {r.doc_id: r.kept for r in got}
    assert not any(kept[i] for i in [*range(900, 906), 907, 908, *range(910, 916), *range(920, 926)])
    assert sum(not kept[i] for i in range(450)) <= 4


def test_quantiles():
    # tabulated: 0.95 of 2, 6 and 8 degrees of freedom
    assert [round(op.chi2_quantile(0.95, f), 3) for f in (2, 6, 8)] == [5.991, 12.592, 15.507]


def test_small_and_empty_tables(spark):
    assert op.judged(table(spark, [])).count() == 0
    assert [r.kept for r in op.judged(table(spark, [(1, None, None, None)])).collect()] == [False]
    one = op.judged(table(spark, [(1, "word " * 20 + " ".join(f"w{i}" for i in range(60)), "en", "s")])).collect()
    assert one[0].distance == 0 and one[0].kept
