"""Personal data, and the terms that reveal it (operator 1).

Base spans, of e-mail addresses, IP addresses, card and phone numbers, follow
fixed patterns over whole texts. Each distinct value is a protected entity. A
term t reveals an entity e as far as it foretells it: with documents as events,

    PMI(e; t) = log2 p(e, t) / (p(e) p(t))   and   IC(e) = -log2 p(e),

t discloses e when PMI(e; t) >= IC(e) - tolerance bits, that is p(e | t) >=
2^-tolerance, and they occur together in ``least`` documents or more that aren't all
copies or near copies of each other (a term seen once foretells everything, and so
would each rare word that copies share). Near copies are told by SKETCHES least
hashes of their terms: two documents with a Jaccard similarity of 0.8 have one in
common but for one case in 600. What this leaves out: terms of an entity that stands
in one text only, with its copies; there the corpus can't tell names from rare words.
A term counts for a document wherever it stands
outside the base spans; digits alone are no term. Every occurrence of a term that
discloses some entity becomes a span of kind ``term``: in all documents with base
spans, and in those without if the pair is more than chance, that is if fewer than
CHANCE of all pairs of such an entity and a term beside one would be expected to
meet so often by chance (a word seen four times meets an entity three times by
chance in a small corpus). In the text spans are generalised to the name of their
kind, or removed.

Counts cover all documents, copies too. Texts are read three times and never
shuffled: for the entities and the terms beside them, for the documents of those
terms, and for the spans. Only bit maps of SLOTS slots are broadcast, which spare
rows that no join would keep.
Matching is linear in the text, for long runs of digits or letters too.

Null and empty texts have no spans. Empty table: no rows. Extra columns are not read
by the search and come back from :func:`sanitise` as they are. Offsets are code points, ends exclusive.
Repeated rows each come back; rows of one doc_id with other texts stay apart.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phenospark.llm.common import free_name, side, written
from phenospark.llm.textkernel import IS_BREAK, Slice, Words, mix, slices, words

KINDS = ("email", "ip", "card", "phone")
TOLERANCE = 1.0
LEAST = 2
#: Least hashes of a document's terms that tell near copies.
SKETCHES = 4
#: Pairs expected by chance, of all that are tried, up to which a pair counts where no base span is.
CHANCE = 0.05
#: Slots of a bit map of terms.
SLOTS = 1 << 22

# fixed values: the patterns of the base spans
_LOCAL = re.compile(rb"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(rb"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(rb"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(rb"[^0-9]+")


def emails(text: bytes) -> Iterator[tuple[int, int]]:
    """Each run of local characters is looked at once; what follows its @ doesn't depend on where it began."""
    at = 0
    while m := _LOCAL.search(text, at):
        at = m.end()
        if text[at : at + 1] == b"@":
            d = _DOMAIN.match(text, at + 1)
            at = d.end() if d else at + 1
            if d:
                yield m.start(), at


def ips(text: bytes) -> Iterator[tuple[int, int]]:
    """A chain of dotted numbers gives a match for each four of them from its start."""
    for m in _DOTTED.finditer(text):
        parts = m[0].split(b".")
        if len(parts) < 4:
            continue
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip(b"0")) <= 3 and int(p.lstrip(b"0") or b"0") <= 255 for p in four):
                yield at, end
            at = end + 1


def luhn(digits: bytes) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d -= 48
        total += d if k % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def cards(text: bytes) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _NOT_DIGIT.sub(b"", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def phones(text: bytes) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_NOT_DIGIT.sub(b"", m[0])) <= 15:
            yield m.span()


#: Bytes that a kind can't do without, and its finder.
FINDERS = {"email": (b"@", emails), "ip": (b"0123456789", ips), "card": (b"0123456789", cards), "phone": (b"+", phones)}


def base_spans(text: bytes, has: dict[str, bool] | None = None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes, by kind as listed, then start."""
    return [(kind, a, b) for kind in KINDS if has is None or has[kind] for a, b in FINDERS[kind][1](text)]


def _marks(s: Slice) -> dict[str, np.ndarray]:
    """For each kind, whether each row has a byte that it can't do without."""
    out = {}
    for kind, (need, _) in FINDERS.items():
        table = np.zeros(256, bool)
        table[list(need)] = True
        at = np.flatnonzero(table[s.data])
        out[kind] = np.diff(np.searchsorted(at, s.offs)) > 0
    return out


def _spans_of(s: Slice) -> dict[int, list[tuple[str, int, int]]]:
    """The base spans of the rows that have some."""
    marks = _marks(s)
    out = {}
    for i in np.flatnonzero(np.any([*marks.values()], 0)).tolist():
        if found := base_spans(s.text(i), {k: bool(v[i]) for k, v in marks.items()}):
            out[i] = found
    return out


def _terms_of(s: Slice, spans: dict[int, list[tuple[str, int, int]]]) -> tuple[Words, np.ndarray]:
    """The words, and which of them are terms: those that no base span covers and that aren't digits alone."""
    w = words(s, lower=True, breaks=IS_BREAK)
    other = np.zeros(len(s.data) + 1, np.int64)
    np.cumsum((s.data < 48) | (s.data > 57), out=other[1:])
    ok = other[w.end] > other[w.start]
    if spans:
        covered = np.zeros(len(s.data) + 1, np.int32)
        for i, found in spans.items():
            for _, a, b in found:
                covered[s.offs[i] + a] += 1
                covered[s.offs[i] + b] -= 1
        ok &= np.cumsum(covered)[w.start] == 0
    return w, ok


def _bits(terms: DataFrame) -> np.ndarray:
    """A bit map in which each term's slot is set; SLOTS / 64 rows at most come to the driver."""
    place = F.col("term").bitwiseAND(F.lit(SLOTS - 1))
    got = terms.groupBy(F.shiftright(place, 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(term & 63 AS int)))").alias("bits")).collect()
    out = np.zeros(SLOTS // 64, np.int64)
    out[[r["at"] for r in got]] = [r["bits"] for r in got]
    return out


def _table(bits: np.ndarray) -> np.ndarray:
    return np.unpackbits(bits.view(np.uint8), bitorder="little").view(bool)


def entity_documents(docs: DataFrame) -> DataFrame:
    """sketch, entities, terms: the distinct ones of each row that has entities."""
    seeds = mix(np.arange(1, SKETCHES + 1, dtype=np.uint64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for s in slices(batch.column(0)):
                keys, entities, terms = [], [], []
                spans = _spans_of(s)
                for i, found in spans.items():
                    text = s.text(i)
                    w, ok = _terms_of(Slice(0, 1, np.frombuffer(text, np.uint8), np.array([0, len(text)])), {0: found})
                    entities.append(sorted({int.from_bytes(hashlib.blake2b(kind.encode() + b":" + text[a:b].lower(), digest_size=8).digest(), "little", signed=True) for kind, a, b in found}))
                    terms.append(np.unique(w.hash[ok]).view(np.int64))
                    own = np.array(terms[-1]).view(np.uint64)
                    keys.append([int(mix(own ^ seed).min()) >> 1 if len(own) else 0 for seed in seeds])
                if spans:
                    many = pa.list_(pa.int64())
                    yield pa.RecordBatch.from_arrays([pa.array(keys, many), pa.array(entities, many), pa.array(terms, many)], ["sketch", "entities", "terms"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "sketch array<long>, entities array<long>, terms array<long>")


def term_documents(docs: DataFrame, bits: np.ndarray, most: int = 1 << 20) -> DataFrame:
    """term, n: in how many rows of the corpus each term is, of those in the bit map; tasks add up before they send."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts, held = [], [], 0
        table = _table(shared.value)

        def total() -> tuple[np.ndarray, np.ndarray]:
            t, inverse = np.unique(np.concatenate([np.zeros(0, np.int64), *terms]), return_inverse=True)
            return t, np.bincount(inverse, np.concatenate([np.zeros(0, np.int64), *counts]), len(t)).astype(np.int64)

        for batch in batches:
            for s in slices(batch.column(0)):
                w, ok = _terms_of(s, _spans_of(s))
                ok &= table[w.hash & np.uint64(SLOTS - 1)]
                h, r = w.hash[ok], w.row[ok]
                order = np.lexsort((r, h))
                h, r = h[order], r[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
                t, n = np.unique(h[new], return_counts=True)
                terms.append(t.view(np.int64))
                counts.append(n)
                held += len(t)
                if held > 2 * most:
                    t, n = total()
                    terms, counts, held = [t], [n], len(t)
                    if held > most:
                        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(n)], ["term", "n"])
                        terms, counts, held = [], [], 0
        t, n = total()
        yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(n)], ["term", "n"])

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _log_chance(both: np.ndarray, n: np.ndarray, df: np.ndarray, rows: int) -> np.ndarray:
    """Natural log of the expected number of sets of ``both`` rows, of a term's n, that all have an entity of df rows."""
    log = np.vectorize(lambda b, n, d: math.lgamma(n + 1) - math.lgamma(n - b + 1) - math.lgamma(b + 1) + math.lgamma(d + 1) - math.lgamma(d - b + 1) - math.lgamma(rows + 1) + math.lgamma(rows - b + 1), otypes=[float])
    return log(both, n, df)


def revealing_terms(docs: DataFrame, tolerance: float = TOLERANCE, least: int = LEAST) -> DataFrame:
    """term, sure: those that disclose an entity, and whether by more than chance."""
    beside = written(entity_documents(docs), "beside")
    often = beside.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count("*").alias("df")).where(F.col("df") >= least)
    # rows are numbered once they are written, as other runs may number them otherwise
    each = written(beside.select(F.monotonically_increasing_id().alias("rid"), "sketch", "entities", "terms"), "beside")
    pairs = written(each.select("rid", "sketch", F.explode("entities").alias("entity")).join(often, "entity"), "pairs")
    inside = each.join(pairs.select("rid").distinct(), "rid", "left_semi").select("rid", F.explode("terms").alias("term"))
    # both <= m, the rows with some entity of those and the term: m bounds p(e | t) for every e
    near = written(inside.groupBy("term").agg(F.count("*").alias("m")), "near")
    might = near.where(F.col("m") >= least)
    # p(e | t) = p(e, t) / p(t): PMI(e; t) - IC(e) = log2(both / n)
    known = written(might.join(term_documents(docs, _bits(might)), "term").where(F.log2(F.col("m") / F.col("n")) >= -tolerance).select("term", "n"), "known")
    # in none of the sketches all documents are one
    apart = reduce(lambda x, y: x & y, (F.min(F.col("sketch")[j]) < F.max(F.col("sketch")[j]) for j in range(SKETCHES)))
    together = inside.join(known, "term").join(pairs, "rid").groupBy("entity", "term").agg(F.count("*").alias("both"), F.first("n").alias("n"), F.first("df").alias("df"), apart.alias("apart"))
    rows, tried = docs.count(), max(1, near.count()) * max(1, pairs.select("entity").distinct().count())

    @F.pandas_udf("boolean")
    def sure(both: pd.Series, n: pd.Series, df: pd.Series) -> pd.Series:
        return pd.Series(_log_chance(both, n, df, rows) + math.log(tried) <= math.log(CHANCE))

    found = together.where(F.col("apart") & (F.col("both") >= least) & (F.log2(F.col("both") / F.col("n")) >= -tolerance))
    return written(found.select("term", sure("both", "n", "df").alias("sure")).groupBy("term").agg(F.bool_or("sure").alias("sure")), "revealing")


FOUND = "rid long, doc_id long, text_key long, n_email long, n_ip long, n_card long, n_phone long, base string, at array<struct<term:long,start:int,stop:int>>"


def find(docs: DataFrame, bits: np.ndarray) -> DataFrame:
    """FOUND for each row: the base spans, and where terms of the bit map stand."""
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rid = TaskContext.get().partitionId() << 33
        table = _table(shared.value)
        any_term = table.any()
        for batch in batches:
            for s in slices(batch.column(2)):
                n = s.rows
                spans = _spans_of(s)
                term, start, stop, per_row = np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(n, int)
                point = np.zeros(len(s.data) + 1, np.int64)
                if spans or any_term:
                    np.cumsum((s.data & 0xC0) != 0x80, out=point[1:])
                if any_term:
                    w, ok = _terms_of(s, spans)
                    ok &= table[w.hash & np.uint64(SLOTS - 1)]
                    row, before = w.row[ok], point[s.offs[:-1]]
                    term, start, stop = w.hash[ok].view(np.int64), (point[w.start[ok]] - before[row]).astype(np.int32), (point[w.end[ok]] - before[row]).astype(np.int32)
                    per_row = np.bincount(row, minlength=n)
                counts, base = np.zeros((n, 4), np.int64), [""] * n
                for i, found in spans.items():
                    for kind, _, _ in found:
                        counts[i, KINDS.index(kind)] += 1
                    lo = s.offs[i]
                    base[i] = ",".join(f"{k}:{point[lo + a] - point[lo]}:{point[lo + b] - point[lo]}" for k, a, b in found)
                at = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(per_row)]), pa.int32()), pa.StructArray.from_arrays([pa.array(term), pa.array(start), pa.array(stop)], ["term", "start", "stop"]))
                columns = [pa.array(rid + np.arange(n)), batch.column(0).slice(s.lo, n), batch.column(1).slice(s.lo, n), *(pa.array(counts[:, k]) for k in range(4)), pa.array(base, pa.string()), at]
                rid += n
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in FOUND.split(", ")])

    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), F.col("text").cast("string")).mapInArrow(run, FOUND)


def spans(docs: DataFrame, tolerance: float = TOLERANCE, least: int = LEAST) -> DataFrame:
    """FOUND without at, and terms: the revealing terms' spans as text, joined like base."""
    revealing = revealing_terms(docs, tolerance, least)
    found = written(find(docs, _bits(revealing)), "found")
    near = found.where(F.size("at") > 0).select("rid", "base", F.explode("at").alias("c")).select("rid", "base", "c.*")
    shown = near.join(revealing, "term").where(F.col("sure") | (F.col("base") != "")).groupBy("rid").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("at"))
    shown = shown.select(F.col("rid").alias("r"), F.concat_ws(",", F.transform("at", lambda x: F.concat(F.lit("term:"), x["start"].cast("string"), F.lit(":"), x["stop"].cast("string")))).alias("terms"))
    return found.drop("at").join(shown, F.col("rid") == F.col("r"), "left").drop("r", "rid").withColumn("terms", F.coalesce("terms", F.lit("")))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_term for each row."""
    got = spans(docs)
    every = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.col("terms") != "", F.col("terms")))
    return got.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2(F.col("base"), 256).alias("base_sha256"), every.alias("spans"), F.when(F.col("terms") == "", F.lit(0)).otherwise(F.size(F.split("terms", ","))).cast("long").alias("n_term"))


def rewritten(text: str, listed: str, remove: bool) -> str:
    """The text with its spans generalised to <kind>, or removed; overlapping spans become one of the first kind."""
    out, at = [], 0
    parts = sorted((int(a), -int(b), k) for k, a, b in (x.split(":") for x in listed.split(",")))
    for a, b, kind in parts:
        a, b = max(a, at), -b
        if b <= at:
            continue
        if a > at or not out:
            out.append(text[at:a])
            if not remove:
                out.append(f"<{kind}>")
        at = b
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, remove: bool = False, tolerance: float = TOLERANCE, least: int = LEAST) -> DataFrame:
    """docs with the spans of text generalised, or removed; rows without spans as they were."""
    doc, key, found = (free_name(docs, x) for x in ("pii_doc", "pii_key", "pii_spans"))
    got = spans(docs.select("doc_id", "text"), tolerance, least)
    listed = F.concat_ws(",", F.when(F.col("base") != "", F.col("base")), F.when(F.col("terms") != "", F.col("terms")))
    # a table of its own, so that the plan that moves the texts has one join
    got = written(got.where(listed != "").groupBy(F.col("doc_id").alias(doc), F.col("text_key").alias(key)).agg(F.max(listed).alias(found)), "listed")
    joined = docs.join(side(got), F.col("doc_id").cast("long").eqNullSafe(F.col(doc)) & (F.xxhash64("text") == F.col(key)), "left")

    @F.arrow_udf("string")
    def rewrite(text: pa.Array, listed: pa.Array) -> pa.Array:
        # one text at a time is a Python string
        return pa.array((None if not x.is_valid else rewritten(t.as_py(), x.as_py(), remove) for t, x in zip(text, listed, strict=True)), pa.string())

    hit = F.col(found).isNotNull()
    # the texts of rows without spans stay in the JVM
    return joined.withColumn("text", F.when(hit, rewrite(F.when(hit, F.col("text").cast("string")), found)).otherwise(F.col("text"))).select(*docs.columns)
