"""Tokenizer results remembered per piece of text.

Many tokenizers never join characters across certain places, so a text's ids are those of its pieces in a row.  Words repeat
a lot; each worker keeps the ids of pieces it has met and asks the tokenizer only for new ones, many at a time.  A word with
punctuation after it is its letters and its punctuation, each looked up by itself.  What is kept is bounded: past `HELD`
pieces or `HELD_BYTES` it starts anew.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np

HELD, HELD_BYTES = 600_000, 32 << 20
JOINED = 512  # words handed to a tokenizer as one text
# Latin letters up to U+024F, without U+0130, whose lower case is two characters; the same as UTF-8 bytes
LETTER = "[A-Za-zÀ-ÖØ-öø-įı-ɏ]"
LETTER_BYTES = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|[\xc5-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])"
WORD, WORD_BYTES = re.compile(f" {LETTER}+"), re.compile(LETTER_BYTES + b"+")
LAST, LAST_BYTES = re.compile(LETTER), re.compile(rb".?" + LETTER_BYTES, re.DOTALL)
MARKS = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum())  # ASCII punctuation


class Memo:
    """The results of pieces, kept by piece.

    `encode(pieces)` gives the results by piece.  With `join`, a piece that is something ending in a Latin letter with ASCII
    punctuation behind it is looked up as these two, and their results are joined, but for pieces in which `special` is found.
    """

    def __init__(self, encode: Callable[[list], dict], join: Callable | None = None, special: re.Pattern | None = None):
        self.encode, self.join, self.special, self.known, self.size = encode, join, special, {}, 0

    def __call__(self, texts: Sequence[list]) -> list[list]:
        """The results of the pieces of each text."""
        if len(self.known) > HELD or self.size > HELD_BYTES:
            self.known, self.size = {}, 0
        flat = list(chain.from_iterable(texts))
        found = list(map(self.known.get, flat))
        missing = [i for i, x in enumerate(found) if x is None]
        if missing:
            self._learn({flat[i] for i in missing})
            for i in missing:
                found[i] = self.known[flat[i]]
        at, out = 0, []
        for pieces in texts:
            out.append(found[at : at + len(pieces)])
            at += len(pieces)
        return out

    def _learn(self, new: set) -> None:
        known, halves = self.known, []
        if self.join:
            # a letter's last two bytes, or its one byte and any before it, or one character
            marks, last, width = (MARKS.encode(), LAST_BYTES, 2) if isinstance(next(iter(new)), bytes) else (MARKS, LAST, 1)
            for piece in new:
                stem = piece.rstrip(marks)
                if len(stem) < len(piece) and last.fullmatch(stem[-width:]) and not (self.special and self.special.search(piece)):
                    halves.append((piece, stem, piece[len(stem) :]))
        asked = list(new.difference(h[0] for h in halves).union(h[1] for h in halves).union(h[2] for h in halves).difference(known))
        known.update(self.encode(asked))
        for piece, stem, tail in halves:
            known[piece] = self.join(known[stem], known[tail])
        self.size += sum(map(len, asked))


def parts(ids: Sequence[int], edge: np.ndarray, last: bool, kind: str) -> list[bytes]:
    """Ids of a joined text cut into words, as bytes: `edge` marks the ids that begin, or with `last` end, a word."""
    numbers = np.array(ids, kind)
    at = np.flatnonzero(edge[numbers]) + last
    cuts = [0, *at.tolist()] if last else [*at.tolist(), len(numbers)]
    raw, width = numbers.tobytes(), numbers.itemsize
    return [raw[x * width : y * width] for x, y in zip(cuts, cuts[1:], strict=False)]
