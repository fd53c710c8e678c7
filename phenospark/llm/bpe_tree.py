"""BPE of long unsplit text by tree concatenation.

A long word (no white space inside) is normalised and cut into pre-tokens by the
vocabulary's own rules. A pre-token that is longer than a leaf is halved until
its parts are leaves; the leaves are encoded on their own, as no leaf needs another
(:mod:`bpe_codec` deals them to tasks); then neighbours are joined pairwise up the
tree. At a join, a window of tokens on
both sides is encoded again and grows until both seams agree.

Why the result is exact: a sequence of tokens is the BPE encoding of its text if
and only if each neighbouring pair of tokens is the encoding of the pair's text.
All pairs within a part or within a window come from an encoding; the two pairs
at the seams are checked. A piece that isn't the end of its pre-token is encoded
with a guard character behind it, of which no byte merges with anything before
it, so that no piece gets the word-end mark by mistake.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

#: Characters of a pre-token that are encoded at once.
LEAF = 512
#: Tokens on either side of a join in its first window.
WINDOW = 4


class TreeEncoder:
    """Encodes text exactly as ``tokenizer`` does; works on a shared Tokenizer."""

    def __init__(self, tokenizer, leaf: int = LEAF, window: int = WINDOW):
        self.tokenizer, self.leaf, self.window = tokenizer, leaf, window
        added = tokenizer.get_added_tokens_decoder()
        self.specials = [(t.content, i) for i, t in sorted(added.items())]
        self.strings = {i: t for t, i in tokenizer.get_vocab(with_added_tokens=False).items()}
        self.loaded = False

    def _load(self) -> None:
        """The merges on their own, and the guard; only long words need them."""
        from tokenizers import models

        spec = json.loads(self.tokenizer.to_str())["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["merges"]]
        right_starts = {right[0] for _, right in merges}
        self.model = models.BPE(vocab=spec["vocab"], merges=merges, end_of_word_suffix=spec["end_of_word_suffix"]) if spec["end_of_word_suffix"] else None
        # a byte symbol that no merge has at the start of its right side can never merge leftwards
        self.guard = next((c for c in sorted(spec["vocab"]) if len(c) == 1 and c not in right_starts), None)
        self.loaded = True

    def load(self) -> None:
        if not self.loaded:
            self._load()

    def encode(self, text: str) -> list[int]:
        """The ids of ``text``; special tokens' strings become their ids, as in the library."""
        self.load()
        out: list[int] = []
        for p in self.parts(text):
            out.extend([p] if isinstance(p, int) else self.piece(p))
        return out

    def parts(self, text: str) -> Iterator[str | int]:
        """The symbols of each pre-token in order, and the ids of special tokens between them."""
        split: list[str | int] = [text]
        for content, number in self.specials:
            pieces = [p.split(content) if isinstance(p, str) else [p] for p in split]
            split = [x for own in pieces for k, y in enumerate(own) for x in ([number, y] if k else [y])]
        for p in split:
            if isinstance(p, int):
                yield p
            elif p:
                normal = self.tokenizer.normalizer.normalize_str(p) if self.tokenizer.normalizer else p
                for symbols, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(normal):
                    yield symbols

    def leaves(self, symbols: str) -> list[str]:
        """A pre-token's halves' halves, down to leaves."""
        n = len(symbols)
        if n <= self.leaf or self.guard is None or self.model is None:
            return [symbols]
        cuts = [0, n]
        while max(b - a for a, b in zip(cuts, cuts[1:], strict=False)) > self.leaf:
            cuts = sorted({*cuts, *((a + b) // 2 for a, b in zip(cuts, cuts[1:], strict=False))})
        return [symbols[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def leaf_ids(self, symbols: str, last: bool) -> list[int]:
        """A leaf on its own; last: it ends its pre-token."""
        if self.guard is None or self.model is None:
            return [t.id for t in (self.model or self.tokenizer.model).tokenize(symbols)]
        return self._tokens(symbols, last)

    def joined(self, nodes: list[list[int]], last: bool) -> list[int]:
        """Neighbours joined pairwise up the tree; last: they end their pre-token."""
        while len(nodes) > 1:
            nodes = [self._join(nodes[i], nodes[i + 1], last and i + 2 >= len(nodes)) if i + 1 < len(nodes) else nodes[i] for i in range(0, len(nodes), 2)]
        return nodes[0]

    def _tokens(self, symbols: str, last: bool) -> list[int]:
        """The BPE of the symbols of one pre-token, or of a part that isn't its end."""
        if not symbols:
            return []
        if last:
            return [t.id for t in self.model.tokenize(symbols)]
        return [t.id for t in self.model.tokenize(symbols + self.guard)][:-1]

    def piece(self, symbols: str) -> list[int]:
        """The BPE of one pre-token, by halves if it is long."""
        leaves = self.leaves(symbols)
        return self.joined([self.leaf_ids(x, k + 1 == len(leaves)) for k, x in enumerate(leaves)], True)

    def _join(self, left: list[int], right: list[int], last: bool) -> list[int]:
        """last: the right part ends its pre-token."""
        k = self.window
        while True:
            a, b = left[-k:], right[:k]
            ends = last and k >= len(right)
            middle = self._tokens(self._text_of(a, False) + self._text_of(b, ends), ends)
            ok_left = k >= len(left) or self._agrees(left[-k - 1], middle[0], ends and len(middle) == 1)
            ok_right = k >= len(right) or self._agrees(middle[-1], right[k], last and k + 1 == len(right))
            if ok_left and ok_right:
                return left[: max(0, len(left) - k)] + middle + right[k:]
            k *= 2

    def _text_of(self, tokens: list[int], ends: bool) -> str:
        got = "".join(self.strings[t] for t in tokens)
        return got.removesuffix("</w>") if ends else got

    def _agrees(self, x: int, y: int, ends: bool) -> bool:
        """Whether the two tokens are the encoding of their own text."""
        return self._tokens(self._text_of([x], False) + self._text_of([y], ends), ends) == [x, y]
