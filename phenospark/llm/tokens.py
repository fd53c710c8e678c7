"""Word-wise use of a public BPE vocabulary whose pieces never span white space.

``word_bpe`` files drop white space before the merges, so the ids of a text are
the ids of its white-space separated words, one after the other. A word is cut
once more before a tail of ``.,;:!?`` if a letter stands before it, since letters
and symbols never share a piece, and letters are looked up without case, since
the vocabulary has none. Each distinct unit is encoded once for as long as a
worker's cache holds it; the rest is array work.
"""

from __future__ import annotations

import os
import re

import numpy as np

from phenospark.llm.bpe_tree import TreeEncoder
from phenospark.llm.textkernel import IS_SPACE, Slice, span_hash, words

#: Distinct units that a worker keeps; beyond it the cache starts anew.
CACHE_UNITS = 1 << 19
#: Units of more bytes are encoded by halves.
LONG_BYTES = 2048

_byte = np.arange(256)
IS_TAIL = np.isin(_byte, np.frombuffer(b".,;:!?", np.uint8))
IS_LETTER = ((_byte | 32) >= 97) & ((_byte | 32) <= 122) & (_byte < 128)
#: Second bytes of U+00C0 to U+00FF that aren't letters.
NOT_LATIN = (0x97, 0xB7)

#: Letters of ASCII and U+00C0 to U+00FF.
PLAIN = re.compile(rb"(?:[A-Za-z]|\xC3[\x80-\x96\x98-\xB6\xB8-\xBF])+").fullmatch

_kept: dict[tuple, WordEncoder] = {}


def encoder(kind: type[WordEncoder], path: str) -> WordEncoder:
    """This worker's encoder; a worker that runs several tasks keeps it."""
    if (kind, path) not in _kept:
        _kept[kind, path] = kind(path)
    return _kept[kind, path]


def has_long(s: Slice, limit: int) -> np.ndarray:
    """Whether each row has a unit of more than ``limit`` bytes."""
    out = np.zeros(s.rows, bool)
    # rows' ends can only shorten what lies between two spaces
    if (np.diff(np.flatnonzero(IS_SPACE[s.data]), prepend=-1, append=len(s.data)) > limit + 1).any():
        w = words(s, hashes=False)
        out[np.searchsorted(w.first, np.flatnonzero(w.end - w.start > limit), "right") - 1] = True
    return out


class _Growing:
    """A growing array of int32 with room to spare."""

    def __init__(self, size: int = 1 << 16):
        self.data, self.n = np.zeros(size, np.int32), 0

    def extend(self, x: np.ndarray) -> None:
        while self.n + len(x) > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(len(self.data), np.int32)])
        self.data[self.n : self.n + len(x)] = x
        self.n += len(x)


class WordEncoder:
    """Ids of units by their hash, in a direct-mapped cache of slots."""

    def __init__(self, path: str, units: int = CACHE_UNITS, long_bytes: int = LONG_BYTES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.tree = TreeEncoder(self.tokenizer)
        self.units, self.long_bytes = units, long_bytes
        self.mask = np.uint64((1 << (2 * units - 1).bit_length()) - 1)
        self.ends_piece = np.zeros(max(self.tree.strings, default=0) + 1, bool)
        for i, t in self.tree.strings.items():
            self.ends_piece[i] = t.endswith("</w>")
        self.reset()

    def reset(self) -> None:
        self.table_key = np.zeros(int(self.mask) + 1, np.uint64)
        self.table_slot = np.zeros(int(self.mask) + 1, np.int32)
        self.starts, self.flat = _Growing(), _Growing()
        self.starts.extend(np.zeros(1, np.int32))

    def encode_units(self, raws: list[bytes]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """An order of the units, the ids of each in that order, and how many each has.

        Units of plain letters go through the library many at a time: each is
        one piece, whose last token alone has the word-end mark.
        """
        plain, other, limit = [], [], self.long_bytes
        for i, r in enumerate(raws):
            (plain if PLAIN(r) and len(r) <= limit else other).append(i)
        order, flat, lengths = [], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
        groups = [plain[a : a + 256] for a in range(0, len(plain), 256)]
        joined = self.tokenizer.encode_batch_fast([b" ".join([raws[i] for i in g]).decode() for g in groups], add_special_tokens=False)
        for g, e in zip(groups, joined, strict=True):
            ids = np.array(e.ids, np.int32)
            ends = np.flatnonzero(self.ends_piece[ids]) + 1
            if len(ends) != len(g):  # a unit of several pieces
                other += g
                continue
            order += g
            flat.append(ids)
            lengths.append(np.diff(ends, prepend=0))
        short = [i for i in other if len(raws[i]) <= limit]
        found = [e.ids for e in self.tokenizer.encode_batch_fast([raws[i].decode("utf-8", "replace") for i in short], add_special_tokens=False)]
        long = [i for i in other if len(raws[i]) > limit]
        found += [self.tree.encode(raws[i].decode("utf-8", "replace")) for i in long]
        flat.append(np.array([x for f in found for x in f], np.int32))
        lengths.append(np.fromiter(map(len, found), np.int64, len(found)))
        return order + short + long, np.concatenate(flat), np.concatenate(lengths)

    def slots_of(self, s: Slice) -> tuple[np.ndarray, np.ndarray]:
        """Where each row's units begin, and the slot of each unit."""
        w = words(s, hashes=False)
        data, start, end = s.data, w.start, w.end
        if not len(start):
            return w.first, np.zeros(0, np.int32)
        head = end.copy()
        for _ in range(3):
            head -= IS_TAIL[data[head - 1]] & (head - 1 > start)
        last, before = data[head - 1], data[np.maximum(head - 2, 0)]
        letter = IS_LETTER[last] | ((before == 0xC3) & (last >= 0x80) & ~np.isin(last, NOT_LATIN) & (head - 2 >= start))
        cut = (head < end) & letter
        at = np.arange(len(start)) + np.concatenate([[0], np.cumsum(cut)[:-1]])
        first = np.append(at, len(start) + int(cut.sum()))[w.first]
        a, b = np.empty(len(start) + int(cut.sum()), np.int64), np.empty(len(start) + int(cut.sum()), np.int64)
        a[at], b[at] = start, np.where(cut, head, end)
        a[at[cut] + 1], b[at[cut] + 1] = head[cut], end[cut]
        key = span_hash(s, a, b, lower=True)
        if (bar := np.flatnonzero(data == 0x7C)).size:  # special tokens hold a bar, and they have case
            odd = np.unique(np.clip(np.searchsorted(a, bar, "right") - 1, 0, None))
            key[odd] = span_hash(s, a[odd], b[odd]) ^ np.uint64(0x5BD1E995)
        place = (key & self.mask).astype(np.int64)
        miss = np.flatnonzero(self.table_key[place] != key)
        slot = self.table_slot[place]
        if len(miss):
            distinct, where, inverse = np.unique(key[miss], return_index=True, return_inverse=True)
            if self.starts.n + len(distinct) > self.units and self.starts.n > 1:
                self.reset()
                return self.slots_of(s)
            i = miss[where]
            raws = [data[x:y].tobytes() for x, y in zip(a[i].tolist(), b[i].tolist(), strict=True)]
            order, flat, lengths = self.encode_units(raws)
            new = np.empty(len(raws), np.int32)
            new[order] = self.starts.n - 1 + np.arange(len(raws))
            self.flat.extend(flat)
            self.starts.extend(self.starts.data[self.starts.n - 1] + np.cumsum(lengths))
            self.added(flat, lengths)
            slot[miss] = new[inverse]
            to = (distinct & self.mask).astype(np.int64)
            self.table_key[to], self.table_slot[to] = distinct, new
        return first, slot

    def added(self, flat: np.ndarray, lengths: np.ndarray) -> None:
        """Called with the ids, and how many each has, of the units that got the next slots."""

    def counts(self, slot: np.ndarray) -> np.ndarray:
        return (self.starts.data[slot + 1] - self.starts.data[slot]).astype(np.int64)

    def ids(self, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the slots in order, and where each slot's ids begin."""
        lengths = self.counts(slot)
        begin = np.concatenate([[0], np.cumsum(lengths)])
        index = np.arange(int(begin[-1]), dtype=np.int64)
        index += np.repeat(self.starts.data[slot] - begin[:-1], lengths)
        return self.flat.data[index], begin
