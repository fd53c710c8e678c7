"""Vectorised word kernel over Arrow text columns.

Texts are read straight from Arrow buffers: words, their 64-bit hashes and
their document boundaries come from whole-array NumPy passes, so no Python
object is made for a word. All work goes in slices of about half a megabyte, which
bounds a worker's memory whatever the batch holds (a longer text is one slice).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Bytes of text handled at once; a single longer text is handled whole.
SLICE_BYTES = 1 << 19

#: Longest stretch, in bytes, hashed by sums modulo 2^64; there, longer texts can be built whose sums are equal whatever
#: the bytes' values, so they are hashed one by one.
SHORT = 64

_rng = np.random.default_rng(20260101)
#: A random 64-bit value for each byte, and an odd base with its inverse.
BYTE_VALUE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))

_byte = np.arange(256)
#: ASCII white space: 0x20 and 0x09 to 0x0D.
IS_SPACE = (_byte == 0x20) | ((_byte >= 0x09) & (_byte <= 0x0D))
#: A-Z to a-z, other bytes as they are.
LOWER = np.where((_byte >= 65) & (_byte <= 90), _byte + 32, _byte).astype(np.uint8)
#: Not part of a term: ASCII other than letters and digits.
IS_BREAK = (_byte < 128) & ~(((LOWER >= 97) & (LOWER <= 122)) | ((_byte >= 48) & (_byte <= 57)))

_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + (1 << 16))
        step = np.full(size, BASE if kind == "up" else INVERSE, np.uint64)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if size <= 4 * SLICE_BYTES:
            _powers[kind] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values so that every bit depends on all of them."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Slice:
    """Consecutive rows of a batch: their bytes and where each row begins."""

    lo: int
    hi: int
    data: np.ndarray
    offs: np.ndarray

    @property
    def rows(self) -> int:
        return self.hi - self.lo

    def text(self, i: int) -> bytes:
        return self.data[self.offs[i] : self.offs[i + 1]].tobytes()


@dataclass
class Words:
    """start, end (exclusive) in the slice's bytes, hash; first[i] is row i's first word."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def row(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def slices(texts: pa.Array, most: int = SLICE_BYTES, rows: int = 1 << 16) -> Iterator[Slice]:
    """The rows of a string column; null counts as an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offs = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = texts.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    lo, n = 0, len(texts)
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, "right")) - 1)
        hi = min(hi, n, lo + rows)
        yield Slice(lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


def words(s: Slice, lower: bool = False, breaks: np.ndarray = IS_SPACE, hashes: bool = True) -> Words:
    """The maximal runs of bytes that ``breaks`` doesn't mark, within each row."""
    data, offs = s.data, s.offs
    n = len(data)
    inside = ~breaks[data]
    begin = np.zeros(n + 1, bool)
    begin[offs[:-1]] = True
    before = np.empty(n, bool)
    if n:
        before[0] = False
        before[1:] = inside[:-1]
    start = np.flatnonzero(inside & (~before | begin[:n]))
    begin[n] = True
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    end = np.flatnonzero(inside & (~after | begin[1:])) + 1
    first = np.searchsorted(start, offs)
    return Words(start, end, span_hash(s, start, end, lower) if hashes else np.zeros(0, np.uint64), first)


def span_hash(s: Slice, start: np.ndarray, end: np.ndarray, lower: bool = False, seed: int = 0) -> np.ndarray:
    """Hashes of stretches of bytes (start below the slice's length), A-Z as a-z if lower; another seed
    gives each byte another value."""
    n = len(s.data)
    value = mix(BYTE_VALUE + np.uint64(seed)) if seed else BYTE_VALUE
    value = value[LOWER] if lower else value
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(value[s.data] * _power("up", n), out=total[1:])
    # the length enters too
    got = mix((total[end] - total[start]) * _power("down", n)[start] + (end - start).astype(np.uint64))
    far = np.flatnonzero(end - start > SHORT)
    if len(far):
        data = LOWER[s.data] if lower else s.data
        got[far] = [byte_hash(data[x:y], seed) for x, y in zip(start[far].tolist(), end[far].tolist(), strict=True)]
    return got


def byte_hash(data: np.ndarray, seed: int = 0) -> int:
    return xxhash.xxh3_64_intdigest(data.tobytes(), seed & (1 << 64) - 1)


def grams(w: Words, n: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n consecutive words from each word on, and whether all n lie in its row."""
    size = len(w.hash)
    got = np.full(size, np.uint64(seed * 2 + 1), np.uint64)
    last = np.repeat(w.first[1:], np.diff(w.first))
    ok = np.arange(size) + n <= last
    if size >= n:
        m = size - n + 1
        for j in range(n):
            got[:m] = (got[:m] ^ w.hash[j : j + m]) * np.uint64(0x9FB21C651E98DF25)
            got[:m] ^= got[:m] >> np.uint64(32)
    return mix(got), ok
