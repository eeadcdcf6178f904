"""Cutting a text where any byte-level tokenizer of this family cuts it, and remembering what the cuts encode to.

A single space between two characters that are not white space always starts a new match of the
public pattern, so a text is its space-separated pieces, each encoded by itself (but the first with
its space). Pieces repeat; a bounded memo holds what they encode to. A text in which a
space touches other white space goes through the pattern as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

MEMO = 400_000


class Memo(dict):
    """What ``make`` returns by key. At most two generations of ``most`` keys stay; keys of more than 64 characters do not."""

    def __init__(self, make: Callable[[str], object], most: int = MEMO):
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key: str):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Pieces:
    """Texts to lists of encoded pieces, by a function that encodes any string and one that joins two encodings.

    The pattern also cuts between letters and the last mark of a piece such as ``word,``, so its letters are
    looked up alone.
    """

    MARKS = frozenset(".,;:!?")

    def __init__(self, encode: Callable[[str], object], join: Callable[[object, object], object], most: int = MEMO):
        self.encode, self.join = encode, join
        self.after_space = Memo(self._after_space, most)
        self.first = Memo(encode, most // 8)

    def _after_space(self, piece: str):
        if piece[-1] in self.MARKS and piece[:-1].isalpha():
            return self.join(self.after_space[piece[:-1]], self.first[piece[-1]])
        return self.encode(" " + piece)

    def of(self, text: str) -> Iterable:
        if not text:
            return []
        parts = text.split(" ")
        if "" in parts or list(map(str.strip, parts)) != parts:
            return [self.encode(text)]
        out = [self.first[parts[0]]]
        out += map(self.after_space.__getitem__, parts[1:])
        return out
