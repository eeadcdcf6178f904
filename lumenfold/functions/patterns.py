"""What a regular expression cannot match without: runs of three characters, for an index to look up."""

from __future__ import annotations

import re
import warnings
from re import _constants as op
from re import _parser

#: A pattern with more alternatives than this counts as one that needs nothing where it has them.
WAYS = 32
#: So many runs of an alternative are looked up at most; any of them are needed, so fewer only let more chunks through.
RUNS = 12


class _Way:
    """One alternative so far: whole literals, and the one that may go on."""

    def __init__(self, done: frozenset[str] = frozenset(), now: str = ""):
        self.done, self.now = done, now

    def cut(self) -> _Way:
        return _Way(self.done | {self.now}, "")

    def add(self, code: int) -> _Way:
        return _Way(self.done, self.now + chr(code).lower()) if 9 <= code < 127 else self.cut()


def _walk(items, ways: list[_Way]) -> list[_Way]:
    for kind, what in items:
        if kind is op.LITERAL:
            ways = [w.add(what) for w in ways]
        elif kind is op.IN and len(what) <= 4 and all(k is op.LITERAL for k, _ in what):
            ways = [w.add(c) for w in ways for c in sorted({c for _, c in what})]
        elif kind is op.SUBPATTERN:
            ways = _walk(what[-1], ways)
        elif kind is op.ATOMIC_GROUP:
            ways = _walk(what, ways)
        elif kind is op.BRANCH:
            ways = [w for branch in what[1] for w in _walk(branch, ways)]
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            least, most, inner = what
            if least:
                ways = _walk(inner, ways)
            if (least, most) != (1, 1):
                ways = [w.cut() for w in ways]
        elif kind not in (op.AT, op.ASSERT, op.ASSERT_NOT):  # those take no characters
            ways = [w.cut() for w in ways]
        if len(ways) > WAYS:
            # what all of them have is needed whatever comes
            ways = [_Way(frozenset.intersection(*(w.done for w in ways)))]
    return ways


def needed(pattern: str) -> list[list[str]] | None:
    """Alternatives, each with runs of three characters in small letters that a match by it has; None: a match may have none.

    Only patterns that Python reads too are looked into, and only their ASCII characters; everything else counts as any text.
    """
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")  # sets within sets mean something else to Java
            parsed = _parser.parse(pattern)
    except (re.error, OverflowError, RecursionError, Warning):
        return None
    out = []
    for way in _walk(parsed, [_Way()]):
        runs = sorted({s[i : i + 3] for s in way.cut().done for i in range(len(s) - 2)})
        if not runs:
            return None
        step = max(1, len(runs) // RUNS)
        out.append(runs[::step][:RUNS])
    return out
