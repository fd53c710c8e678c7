"""Each operator on tables with nulls, empty and long texts, ties, repeated rows and clashing columns, against brute force."""

import hashlib
import math
import re
import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from phenospark.llm import backoff_lm, block_ann, bpe_codec, chosen_path, components, kn_toxicity, maxscore, packing, pii, recompress, ring
from phenospark.llm.queries import vocabulary
from phenospark.llm.textkernel import slices, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, chunk long, name string, size int, n long, rank int, dup_id long, pii_spans string, dedup_words long, found string"


def lower(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(7)
    vocab = [f"w{i}" for i in range(400)]
    text = lambda n: " ".join(rng.choice(vocab, n))
    passage, near = text(60), text(120).split()
    out = [(0, None), (1, ""), (2, "  \n "), (3, "one"), (4, "two words"), (5, passage), (None, passage), (None, None)]
    out += [(10 + i, f"{text(30)} {passage}\n{text(20)}") for i in range(5)]
    for i in range(12):
        words = list(near)
        for j in rng.choice(120, 2, replace=False) if i else []:
            words[j] = f"x{i}"
        out.append((20 + i, " ".join(words)))
    out += [(40, text(50)), (40, text(50)), (41, out[10][1]), (41, out[10][1]), (42, text(9000)), (43, "a" * 40_000 + "é" + "b " * 50), (44, "the " * 500)]
    out += [(50, "Mail jo.do+x@mail.example.com or 10.0.0.1, not 300.1.1.1; card 4111 1111 1111 1111 call +1 (555) 123-4567 ü x@y.zz"), (51, "Éa@b.cc <|endoftext|> İ ≠ = ̸")]
    out += [(60 + i, f"{text(20)} secretname agent007 bob@corp.example.com agent007 {text(20)}") for i in range(4)]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, "n", 2, 3, 4, 5, "p", 6, "f") for i, t in rows], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def key(row):
    return (row[0] is None, row[0] or 0, *map(str, row[1:]))


def test_pii(docs, rows):
    kinds = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    got = pii.digest(docs).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    r = next(x for x in got if x.doc_id == 50)
    text = dict(rows)[50]
    spans = [(k, m.start(), m.end()) for k, p in kinds.items() for m in re.finditer(p, text) if (k, m[0]) != ("ip", "300.1.1.1") and (k != "card" or len(re.sub("[^0-9]", "", m[0])) > 12)]
    assert r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in spans) and (r.n_email, r.n_ip, r.n_card, r.n_phone) == (2, 1, 1, 1)
    assert r.base_sha256 == hashlib.sha256(r.spans.encode()).hexdigest()
    r = next(x for x in got if x.doc_id == 60)  # terms that foretell the address in all four documents
    text = dict(rows)[60]
    assert {text[int(a) : int(b)] for k, a, b in (x.split(":") for x in r.spans.split(",")) if k == "term"} >= {"secretname", "agent007"}
    assert all(x.spans == "" for x in got if x.doc_id is not None and x.doc_id < 43)


def test_sanitise(docs, rows, empty):
    got = pii.sanitise(docs)
    assert got.columns == docs.columns and got.count() == len(rows)
    texts = {r.doc_id: r.text for r in got.collect()}
    assert "<email>" in texts[50] and "<card>" in texts[50] and "@" not in texts[50] and "agent007" not in texts[61]
    assert texts[42] == dict(rows)[42]
    assert pii.sanitise(empty).count() == 0 and pii.digest(empty).count() == 0
    assert pii.rewritten("abcdef", "email:1:3,term:2:4", False) == "a<email>ef" and pii.rewritten("abcdef", "email:1:3", True) == "adef"


def test_pii_whole_documents(spark):
    """A term is revealing however far it stands from its address, and is masked there and where no address is."""
    far = " ".join(f"p{i}" for i in range(30))
    fill = [" ".join(f"q{i}x{j}" for j in range(30)) for i in range(4)]
    texts = [f"secretname x{i} {fill[i]} bob@corp.example.com {far} y{i} Secretname" for i in range(4)]
    texts += ["é secretname alone, secretname", far, *[f"{far} z{i}" for i in range(60)]]
    # near the address in three rows, but in five rows without it: 3 of 8 is too little
    texts += [f"{far} often ann@corp.example.com" for _ in range(3)] + [f"often {far}" for _ in range(5)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.digest(docs).collect()}
    terms = {i: [texts[i][int(a) : int(b)] for k, a, b in (x.split(":") for x in r.spans.split(",") if x) if k == "term"] for i, r in got.items()}
    assert all(terms[i] == ["secretname", "Secretname"] and got[i].n_term == 2 for i in range(4))
    assert terms[4] == ["secretname"] * 2 and not any(terms[i] for i in range(5, len(texts)))
    # what copies and near copies have in common tells nothing
    copies = [f"{far} alone{i} rarename {fill[0]} {fill[1]} cy@corp.example.com {fill[2]}" for i in range(3)] + [f"{far} {i}" for i in range(40)]
    assert not any(r.n_term for r in pii.digest(spark.createDataFrame(list(enumerate(copies)), "doc_id long, text string")).collect())
    masked = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert masked[4] == "é <term> alone, <term>" and masked[5] == far and "ecretname" not in masked[0]


def test_ring(docs, rows, empty):
    got = ring.shard(docs, shards=4, vnodes=8).collect()
    assert sorted((key((r.doc_id, r.text_crc32, r.size)) for r in got)) == sorted(key((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 1)) for i, t in rows)
    sizes = Counter(r["shard"] for r in got)
    assert set(sizes) == set(range(4)) and max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(4):
        assert sorted(r.slot for r in got if r["shard"] == s) == list(range(sizes[s]))
    assert ring.shard(empty).count() == 0


@pytest.mark.parametrize("cell_rows", [20_000, 100])
def test_ring_splits_a_hot_group_and_keeps_small_ones(spark, cell_rows):
    """Only groups at a cut of an arc are split; the hot group has cells of its own in one of the two cases."""
    hot = spark.range(3000).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 1500, F.lit("same")).otherwise(F.concat(F.lit("t"), (F.col("id") % 300).cast("string"))).alias("text"))
    got = ring.shard(hot, shards=8, vnodes=4, cell_rows=cell_rows).toPandas()
    counts = got["shard"].value_counts()
    assert counts.max() - counts.min() <= 1 and all(sorted(g["slot"]) == list(range(len(g))) for _, g in got.groupby("shard"))
    groups = got[got["doc_id"] >= 1500].assign(t=lambda f: f["doc_id"] % 300).groupby("t")["shard"].nunique()
    # eight shards fill up, and the arcs of each are cut but once for every shard that they overflow to
    assert (groups > 1).sum() <= 16


def test_ring_is_that_of_a_walk(spark):
    """Row by row: arcs fill their own shards first, what is left goes on clockwise."""
    rows = [(i, f"t{i % 70}" if i % 3 else "same") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = ring.placed(docs, 5, 6).toPandas().sort_values(["place", "doc_id"])
    points = ring.ring_points(spark, 5, 6)
    room = {s: 400 // 5 for s in range(5)}
    arc_of = lambda place: next((k for k, (p, _) in enumerate(points) if p >= place), 0)
    of = {a: g for a, g in got.assign(arc=got["place"].map(arc_of)).groupby("arc")}
    want, over = Counter(), []
    for a in sorted(of):
        n = min(len(of[a]), room[points[a][1]])
        room[points[a][1]] -= n
        want[a, points[a][1]] += n
        over += [(a, len(of[a]) - n)]
    for a, n in over:
        at = a
        while n:
            at = (at + 1) % len(points)
            k = min(n, room[points[at][1]])
            room[points[at][1]] -= k
            want[a, points[at][1]] += k
            n -= k
    assert Counter((a, s) for a, g in of.items() for s in g["shard"]) == +want


def test_ring_moves_few_rows(spark):
    """One more shard takes a 17th of the rows; the sinking bounds move some more, but far from all."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), F.col("id").cast("string")).alias("text"))
    rows, n = ring.moved(docs, 16).first()
    assert rows == 4000 and 4000 // 17 <= n < 4000 * 0.4


def test_toxicity(spark, empty):
    rng = np.random.default_rng(1)
    bad, vocab = ["vile", "rotten", "awful"], [f"w{i}" for i in range(300)]
    out, marks = [], []
    for i in range(400):
        words = list(rng.choice(vocab, 60))
        if toxic := int(i % 3 == 0):
            for j in rng.choice(60, 4, replace=False):
                words[j] = str(rng.choice(bad))
        out.append((i, " ".join(words)))
        marks.append((i, toxic))
    docs = spark.createDataFrame([*out, (1000, None), (1001, ""), (None, "x")], "doc_id long, text string")
    labels = spark.createDataFrame([*marks, (1000, None), (None, 1)], "doc_id long, toxic int")
    got = {r.doc_id: r for r in kn_toxicity.judged(docs, labels).collect()}
    truth, held = dict(marks), [i for i, _ in marks if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(got) == 403 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in got.values())
    assert all(got[i].held_out for i in held)
    assert np.mean([got[i].predicted == truth[i] for i in held]) > 0.97
    assert kn_toxicity.judged(empty, labels).count() == 0
    model = kn_toxicity.learn(docs, labels.where("false"))
    assert kn_toxicity.reject(docs, model).count() == 403  # nothing is learnt, nothing goes


def test_toxicity_of_rare_expressions():
    """Each expression is in about 8 of 200 toxic rows: too few to stand out alone, together enough."""
    rng = np.random.default_rng(3)
    vocab, bad = [f"w{i}" for i in range(300)], [f"bad{i}" for i in range(100)]

    def text(toxic):
        words = list(rng.choice(vocab, 60))
        for j in rng.choice(60, 4, replace=False) if toxic else []:
            words[j] = str(rng.choice(bad))
        return " ".join(words)

    model = kn_toxicity.fit(*([text(toxic) for _ in range(200)] for toxic in (True, False)))
    held = [np.concatenate([model.score(s) for s in kn_toxicity._slice([text(toxic) for _ in range(200)])]) for toxic in (True, False)]
    assert (held[0] >= 0.7).mean() > 0.95 and (held[1] >= 0.7).mean() < 0.02
    # an unseen pair has its context's backoff weights
    known = kn_toxicity._models(["a b", "a b f", "a c"], ["a d e"], 0.9).complete
    h = {x: kn_toxicity.words(kn_toxicity._slice([x])[0], lower=True, breaks=kn_toxicity.IS_BREAK).hash[0] for x in "abe"}
    ratio = known.log_ratio(np.array([h["a"], h["e"]]), np.array([0, 2]))
    alone = known.log_ratio(np.array([h["e"]]), np.array([0, 1]))[0]
    assert np.isclose(ratio[1] - alone, np.log(1 - (1.1 + 0.1) / 3) - np.log(1 - 0.1 / 1))  # a b twice, a c once; a d once


def vectors(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 16)).round(1)
    v[100:140] = v[0]  # ties
    out = [(i, [float(x) for x in row]) for i, row in enumerate(v)]
    return out, spark.createDataFrame([*out, (400, None), (401, [1.0, None]), (402, [float("nan")]), (403, [float("inf")]), (None, [1.0]), (404, [0.0] * 16)], "vec_id long, embedding array<double>").withColumn("label", F.lit(1))


def top_products(rows, every=20, k=20):
    """(query, rank, id, score) of all pairs, in Python's integers."""
    whole = sorted({(i, tuple(math.floor(Fraction(x) * 64) for x in v)) for i, v in rows})
    want = []
    for q in sorted({i for i, _ in whole if i % every == 0}):
        top = sorted((-sum(a * b for a, b in zip(x, y)), i) for own, x in whole if own == q for i, y in whole if i != q)[:k]
        want += [(q, r + 1, i, max(-(2**63), min(2**63 - 1, -s))) for r, (s, i) in enumerate(top)]
    return want


def test_maxscore(spark):
    out, frame = vectors(spark)
    assert sorted(map(tuple, maxscore.search(frame).collect())) == top_products([*out, (404, [0.0] * 16)])
    assert maxscore.search(frame.where("false")).count() == 0


def test_maxscore_of_large_and_repeated_vectors(spark):
    """Components beyond 2^31, a score beyond a long, an id with two vectors and one vector of many rows."""
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in rng.normal(size=3)]) for i in range(60)]
    rows += [(100, [4e7, 1.0, 0.0]), (101, [3e9, -2e9, 1.0]), (120, [1e20, 0.0, 5.0]), (102, [-4e7, 1e11, 2.0])]
    rows += [(2, [9.0, 9.0, 9.0]), (2, [9.0, 9.0, 9.0]), (140, [8.0, 8.0, 8.0]), (140, [-8.0, 1.0, 0.0])]
    rows += [(i, [1.5, 1.5, 1.5]) for i in range(200, 400)] + [(401, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(map(tuple, maxscore.search(frame).collect()))
    want = top_products([(i, v + [0.0] * (3 - len(v))) for i, v in rows])
    assert got == want and any(r[2] == 101 for r in got if r[0] == 100)


@pytest.mark.parametrize("kind", ["sparse", "dense"])
def test_maxscore_skips_work(kind):
    """Posting lists of few rows are traversed alone, and weak terms are probed for competitive rows alone."""
    rng = np.random.default_rng(6)
    weight = 1 / np.arange(1, 65) ** 0.7
    shard = np.floor(64 * rng.normal(size=(8192, 64)) * weight * (rng.random((8192, 64)) < (0.1 if kind == "sparse" else 1)))
    ids = rng.permutation(8192)
    work = maxscore.Work()
    for i in range(0, 400, 10):
        got = next(maxscore.tile_top(shard[i : i + 1] / 64, ids[i : i + 1], shard / 64, ids, 20, 64.0, work))
        score = shard @ shard[i]
        score[i] = -np.inf
        want = np.lexsort((ids, -score))[:20]
        assert got[1].tolist() == ids[want].tolist() and got[2] == score[want].tolist()
    assert work.products < (0.2 if kind == "sparse" else 0.9) * work.brute


def test_block_join(spark):
    out, frame = vectors(spark)
    want = []
    for q in range(0, 300, 100):
        d = sorted((math.sqrt(sum((a - b) ** 2 for a, b in zip(out[q][1], v, strict=True))), i) for i, v in out if i != q)[:10]
        want += [(q, k + 1, i, round(s, 9)) for k, (s, i) in enumerate(d)]
    assert sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in block_ann.search(frame).collect()) == sorted(want)
    assert block_ann.search(frame.where("vec_id < 5")).count() == 4  # fewer candidates than k
    odd = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (100, [5.0, 5.0]), (100, [-5.0, 5.0]), (7, [1e200, 1.0]), (8, [1e-200, 1e-200])] + [(i, [3.0, 3.0]) for i in range(20, 60)]
    got = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in block_ann.search(spark.createDataFrame(odd, "vec_id long, embedding array<double>")).collect())
    want = []
    for q in (0, 100):
        d = sorted((math.dist(x, y), i) for own, x in sorted(set((i, tuple(v)) for i, v in odd)) if own == q for i, y in set((i, tuple(v)) for i, v in odd) if i != q)[:10]
        want += [(q, k + 1, i, s) for k, (s, i) in enumerate(d)]
    assert got == [(*x[:3], pytest.approx(x[3])) for x in want]
    assert block_ann.search(frame.where("false")).count() == 0


def test_backoff(docs, rows, empty):
    got = sorted((tuple(r) for r in backoff_lm.score(docs).collect()), key=key)
    assert len(got) == len(rows)
    one, two, three, ends = Counter(), Counter(), Counter(), 0
    learns = lambda i: i is None or zlib.crc32(str(i).encode()) % 7 != 2
    chain = lambda t: ["<s>", *WORD.findall(lower(t or "")), "</s>"]
    for i, t in rows:
        if learns(i):
            c, ends = chain(t), ends + 1
            one.update(c)
            two.update(zip(c, c[1:], strict=False))
            three.update(zip(c, c[1:], c[2:], strict=False))
    n, v = sum(one.values()) - ends, len(one) - 1
    want = []
    for i, t in rows:
        c, base, log = chain(t), 0.0, 0.0
        for k in range(1, len(c)):
            base += math.log10((one[c[k]] + 1) / (n + v + 1))
            p = (max(one[c[k]] - 0.75, 0) + 0.75 * v / (v + 1)) / n
            if one[c[k - 1]]:
                p = 0.3 * two[c[k - 1], c[k]] / one[c[k - 1]] + 0.7 * p
            if k > 1 and two[c[k - 2], c[k - 1]]:
                p = 0.5 * three[c[k - 2], c[k - 1], c[k]] / two[c[k - 2], c[k - 1]] + 0.5 * p
            log += math.log10(p)
        want.append((i, not learns(i), len(c) - 1, sum(one[x] > 0 for x in c[1:]), n, base, log))
    for a, b in zip(got, sorted(want, key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:], rel=1e-9)
    assert backoff_lm.score(empty).count() == 0


def test_backoff_states_sum_to_one():
    """At every state of a chunk's automaton the known tokens and the unknown one have all of the probability."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice([f"w{i}" for i in range(12)], rng.integers(0, 400))) for _ in range(12)]
    held = ["u1 w1 u2 w2 w3 w1 w1 w2 u1", "w1 " * 400]
    w = backoff_lm._Words.__new__(backoff_lm._Words)
    for s in slices(pa.array(texts + held), 1 << 30):
        w.words = words(s, lower=True)
    w.key, w.inverse = np.unique(w.words.hash, return_inverse=True)
    q = backoff_lm._Sequence(w.words)
    learns = np.arange(14) < 12
    ones = np.bincount(w.inverse, np.repeat(learns, np.diff(w.words.first)), len(w.key)).astype(int)
    ends, n, v = 12, int(ones.sum()) + 12, int((ones > 0).sum()) + 1
    a = backoff_lm.Automaton(w, q, ones, q.counts(learns), ends, n, v, 0.75, 0.3, 0.5)
    known = np.flatnonzero(a.count[:-1] > 0)
    unknown = np.flatnonzero(a.count == 0)[:1]
    states = np.unique(a.to)
    assert len(states) > 60 and len(unknown)
    # a text's end has no way on, so its state and those behind it aren't asked
    last = np.isin(states, np.append(a.to[a.arc % a.tokens == len(ones)], 0))
    for state in states[~last].tolist() + [0]:
        _, log = a.step(np.full(len(known) + 1, state), np.append(known, unknown))
        assert (10**log).sum() == pytest.approx(1)
    # stretches of a text are walked as the whole is
    whole = a.walk(q.begin)
    state, total = np.zeros(1, np.int64), 0.0
    for k, t in enumerate(a.token[q.begin[-1] :]):
        state, log = a.step(state, np.array([t]))
        total += log[0] if k else 0
    assert whole[-1] == pytest.approx(total)


def brute_links(rows):
    sets = []
    for i, t in rows:
        w = WORD.findall(lower(t or ""))
        sets.append((i, frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w and i is not None else frozenset()))
    links = [{b for b, (_, y) in enumerate(sets) if b != a and x and y and len(x & y) >= 0.8 * len(x | y)} for a, (_, x) in enumerate(sets)]
    label = [i for i, _ in sets]
    for _ in sets:
        label = [min([label[a], *(label[b] for b in links[a])]) if sets[a][0] is not None else None for a in range(len(sets))]
    return [(i, label[a], len(links[a]), len({sets[b][1] for b in links[a]} - {s})) for a, (i, s) in enumerate(sets)]


@pytest.mark.parametrize("small,depth", [(1024, 3), (4, 2)])
def test_chosen_path(docs, rows, empty, small, depth):
    got = [tuple(r) for r in chosen_path.near_duplicates(docs, small=small, depth=depth).collect()]
    assert sorted(got, key=key) == sorted(brute_links(rows), key=key)
    assert chosen_path.near_duplicates(empty).count() == 0


def test_chosen_path_recall_at_the_threshold(spark):
    """Pairs just above the threshold, none lost."""
    rng = np.random.default_rng(9)
    rows = []
    for i in range(150):
        words = [f"v{x}" for x in rng.integers(0, 5000, 104)]
        other = list(words)
        other[50] = "changed"  # 5 of 100 shingles on either side
        other[90] = "changed"
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
    got = chosen_path.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert (got["n_links"] == 1).all()


def test_keep_one(docs, rows, empty):
    kept = chosen_path.keep_one(docs)
    assert kept.columns == docs.columns
    ids = Counter(r.doc_id for r in kept.collect())
    classes = {i: c for i, c, _, _ in brute_links(rows) if i is not None}
    assert set(ids) - {None} == {i for i, c in classes.items() if i == c} and ids[None] == 2
    assert chosen_path.keep_one(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 200)] + [(300, i) for i in range(301, 340)]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert all(got[i] == 0 for i in range(1, 41)) and got[101] == got[102] == 100 and got[339] == 300 and 200 not in got
    assert components.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    ids = {}
    for i, t in rows:
        own = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        ids.setdefault((i, len(own)), []).append(own)
    got = packing.pack_documents(docs, vocabulary(), group_size=16).toPandas()
    for (i, n), own in ids.items():
        mine = got[(got["doc_id"].isna() if i is None else got["doc_id"] == i) & (got["doc_tokens"] == n)]
        assert mine["length"].sum() == n * len(own)
        assert sorted(mine["ids_crc32"]) == sorted(zlib.crc32(x[a : a + 4096].tobytes()) for x in own for a in range(0, n, 4096))
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *np.cumsum(g["length"])[:-1]] and g["length"].sum() <= 4096
    assert packing.pack_documents(empty, vocabulary()).count() == 0


def test_recompress(docs, rows, empty):
    first = {}
    split = [(i, WORD.findall(t or "")) for i, t in rows]
    for i, w in split:
        for k in range(len(w) - 12):
            if i is not None:
                g = tuple(w[k : k + 13])
                first[g] = min(first.get(g, i), i)
    want = []
    for i, w in split:
        gone = {k + j for k in range(len(w) - 12) if i is not None and first[tuple(w[k : k + 13])] < i for j in range(13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    assert sorted((tuple(r) for r in recompress.digest(docs).collect()), key=key) == sorted(want, key=key)
    spark = docs.sparkSession
    spark.conf.set("phenospark.chunkBytes", "2000")  # many small chunks and buckets
    spark.conf.set("phenospark.bucketBytes", "1000")
    assert sorted((tuple(r) for r in recompress.digest(docs).collect()), key=key) == sorted(want, key=key)
    spark.conf.unset("phenospark.chunkBytes")
    spark.conf.unset("phenospark.bucketBytes")
    whole = recompress.remove_repeats(docs)
    assert whole.columns[-3:] == ["text", "dedup_words_", "dedup_removed"]  # dedup_words was there
    assert sorted((hashlib.sha256(r.text.encode()).hexdigest() for r in whole.collect())) == sorted(x[3] for x in want)
    assert recompress.digest(empty).count() == 0


def test_bpe(docs, rows, empty, monkeypatch):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t in rows:
        e = tokenizer.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(e), sha(" ".join(map(str, e))), sha(tokenizer.decode(e, skip_special_tokens=False))))
    assert sorted((tuple(r) for r in bpe_codec.digest(docs, vocabulary()).collect()), key=key) == sorted(want, key=key)
    # words of more than 40 bytes are taken apart: their leaves go to tasks and are joined in rounds
    monkeypatch.setattr(bpe_codec, "FAN", 2)
    assert sorted((tuple(r) for r in bpe_codec.digest(docs, vocabulary(), 40).collect()), key=key) == sorted(want, key=key)
    cut = {r.doc_id: r.ids for r in bpe_codec.encode(docs.where("doc_id = 43"), vocabulary(), long_bytes=40).collect()}
    assert cut[43] == tokenizer.encode(dict(rows)[43], add_special_tokens=False).ids
    odd = [(i, f"x {w} y <|endoftext|>{w}") for i, w in enumerate(["ab" * 3000, "thean" * 900 + "!" * 2000, "é中" * 1500, "0123456789" * 500, "a<|endoftext|>b" * 300])]
    got = bpe_codec.encode(docs.sparkSession.createDataFrame(odd, "doc_id long, text string"), vocabulary()).collect()
    assert all(r.ids == tokenizer.encode(odd[r.doc_id][1], add_special_tokens=False).ids for r in got) and len(got) == 5
    back = bpe_codec.decode(bpe_codec.encode(docs, vocabulary()), vocabulary())
    assert sorted(sha(r.text) for r in back.collect()) == sorted(x[3] for x in want)
    assert bpe_codec.digest(empty, vocabulary()).count() == 0 and bpe_codec.encode(empty, vocabulary()).count() == 0


def test_pipeline(spark, docs, rows, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(20, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "personal_data", "packing"]
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns or sorted(now.columns) == sorted(docs.columns), name
    ids = {r.doc_id for r in now.collect()}
    assert ids == {i for i, c, _, _ in brute_links(rows) if i is None or i == c}
    assert set(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == ids
