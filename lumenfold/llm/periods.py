"""Runs of words that repeat with a period, by recompression.

Recompression alternates two steps until one symbol is left: blocks of one symbol become a symbol of their own, then
symbols are parted in two classes and every pair of one of the first and one of the second becomes a symbol. Equal symbols stand for equal
words, and equal passages are cut alike but at their ends, so how far two places agree is found by climbing
from level to level while both stand at a symbol's beginning, and by going down again into the symbols that differ.

A run of period q has, q words apart, equal words over at least q places in a row, so one of them is a multiple of q: for each q these places are
tried (n log n in all), and extended exactly in both directions by the grammar of the text and that of the reversed text. Places whose neighbourhood
of ``GRAM`` words does not come again q words on are no part of a run of ``least`` words, and need no extension.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.shared import mix, text_bytes

#: Words on either side that must be equal q words apart; runs of at least 2 * GRAM + GRAM words have as many.
GRAM = 4
#: About so many bytes of texts share a grammar, and so many places are tried at once.
TOGETHER, PLACES = 1 << 20, 1 << 21


class Grammar:
    """A run-length grammar of a sequence of numbers from 0; ``common`` tells how far two places agree.

    ``levels``: the symbols of each level, and for all but the first whether it is of blocks, of each symbol its first child and of each child its
    parent.
    """

    def __init__(self, symbols: np.ndarray):
        symbols = symbols.astype(np.int64)
        self.levels = [(symbols, False, None, None)]
        self.next, seed = int(symbols.max(initial=0)) + 1, 0
        while len(symbols) > 1:
            symbols = self._blocks(symbols)
            symbols = self._pairs(symbols, np.uint64(seed := seed + 1))

    def _level(self, symbols: np.ndarray, starts: np.ndarray, merged: np.ndarray, keys: np.ndarray, blocks: bool) -> np.ndarray:
        """A level whose symbols begin at ``starts``; those of ``merged`` are named by ``keys``, equal keys alike."""
        first = np.flatnonzero(starts)
        up = np.cumsum(starts) - 1
        names, which = np.unique(keys, return_inverse=True)
        new = symbols[first]
        new[merged] = self.next + which
        self.next += len(names)
        self.levels.append((new, blocks, first, up))
        return new

    def _blocks(self, symbols: np.ndarray) -> np.ndarray:
        starts = np.concatenate(([True], symbols[1:] != symbols[:-1]))
        if starts.all():
            return symbols
        first = np.flatnonzero(starts)
        length = np.diff(np.append(first, len(symbols)))
        merged = np.flatnonzero(length > 1)
        return self._level(symbols, starts, merged, symbols[first[merged]] << 32 | length[merged], True)

    def _pairs(self, symbols: np.ndarray, seed: np.uint64) -> np.ndarray:
        right = mix(symbols.view(np.uint64) + (seed << np.uint64(40))) & np.uint64(1) == 1
        ways = ~right[:-1] & right[1:], right[:-1] & ~right[1:]
        pair = max(ways, key=np.count_nonzero)
        if not pair.any():
            return symbols
        at = np.flatnonzero(pair)
        starts = np.concatenate(([True], ~pair))
        return self._level(symbols, starts, (np.cumsum(starts) - 1)[at], symbols[at] << 32 | symbols[at + 1], False)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each two different places of the sequence, how many symbols from there on are equal. Both must differ somewhere before the end."""
        x, y, height = a.copy(), b.copy(), np.zeros(len(a), np.int64)
        climbing = np.arange(len(a))
        for level, (_, blocks, first, up) in enumerate(self.levels[1:], 1):
            symbols = self.levels[level - 1][0]
            i, j = x[climbing], y[climbing]
            inside = np.flatnonzero((first[up[i]] != i) | (first[up[j]] != j))
            stay = np.zeros(len(climbing), bool)
            if len(inside):
                p, q = i[inside], j[inside]
                differ = symbols[p] != symbols[q]
                if blocks:
                    ends = np.append(first, len(symbols))
                    left, other = ends[up[p] + 1] - p, ends[up[q] + 1] - q
                    step = np.where(differ, 0, np.minimum(left, other))
                    differ |= left != other
                else:
                    step = (~differ).astype(np.int64)
                i[inside] += step
                j[inside] += step
                stay[inside] = differ
            stopped = climbing[stay]
            x[stopped], y[stopped], height[stopped] = i[stay], j[stay], level - 1
            climbing = climbing[~stay]
            x[climbing], y[climbing] = up[i[~stay]], up[j[~stay]]
            if not len(climbing):
                break
        order = np.argsort(-height, kind="stable")
        upto = np.searchsorted(-height[order], -np.arange(len(self.levels)), "right")
        for level in range(int(height.max(initial=0)), 0, -1):
            on = order[: upto[level]]
            _, blocks, first, _ = self.levels[level]
            symbols = self.levels[level - 1][0]
            p, q = first[x[on]], first[y[on]]
            same = symbols[p] == symbols[q]
            if blocks:
                ends = np.append(first, len(symbols))
                step = np.where(same, np.minimum(ends[x[on] + 1] - p, ends[y[on] + 1] - q), 0)
            else:
                step = same.astype(np.int64)
            x[on], y[on] = p + step, q + step
        return x - a


def _places(size: np.ndarray, base: np.ndarray):
    """Of sequences of these sizes and beginnings, for each period up to half of one the multiples: (place, period), at most about PLACES at once."""
    for n, at in zip(size.tolist(), base.tolist()):
        low = 1
        while low <= n // 2:
            q = np.arange(low, min(n // 2, low + PLACES) + 1)
            times = n // q - 1
            upto = np.cumsum(times)
            q = q[: max(1, int(np.searchsorted(upto, PLACES, "right")))]
            times = times[: len(q)]
            low += len(q)
            period = np.repeat(q, times)
            nth = np.arange(1, len(period) + 1) - np.repeat(upto[: len(q)] - times, times)
            yield at + nth * period - 1, period


def _candidates(symbols: np.ndarray, size: np.ndarray, base: np.ndarray):
    """Places and periods whose neighbourhood comes again a period on. Sequences lie apart by symbols that occur once."""
    own = symbols.astype(np.uint64)
    gram = np.zeros(len(own), np.uint64)
    for i in range(GRAM):
        gram[: len(own) - GRAM + 1] = mix(gram[: len(own) - GRAM + 1]) * np.uint64(0x9E3779B97F4A7C15) + own[i : len(own) - GRAM + 1 + i]
    of = np.searchsorted(base, np.arange(len(own)), "right").astype(np.uint64)
    keys = mix(gram + mix(of))
    order = np.argsort(keys)
    again = np.flatnonzero(keys[order][1:] == keys[order][:-1])
    texts = np.unique(of[order[again]].astype(np.int64)) - 1
    texts = texts[texts >= 0]
    held, waiting = [], 0
    for place, period in _places(size[texts], base[texts]):
        on = (gram[place] == gram[place + period]) | (gram[place - GRAM + 1] == gram[place + period - GRAM + 1])
        held.append((place[on], period[on]))
        waiting += len(held[-1][0])
        if waiting > PLACES:
            yield tuple(map(np.concatenate, zip(*held)))
            held, waiting = [], 0
    if waiting:
        yield tuple(map(np.concatenate, zip(*held)))


def _apart(sequences: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The sequences one after another between symbols that occur nowhere else, and where each begins."""
    new = max((int(s.max(initial=0)) for s in sequences), default=0) + 1
    parts = [np.arange(new, new + GRAM)]
    for i, s in enumerate(sequences):
        parts += [s, np.array([new + GRAM + i])]
    parts.append(np.arange(new, new + GRAM) + GRAM + len(sequences))
    size = np.array([len(s) for s in sequences], np.int64)
    return np.concatenate(parts), GRAM + np.cumsum(size + 1) - size - 1


def runs(sequences: list[np.ndarray], least: int = 3 * GRAM) -> list[np.ndarray]:
    """Of each sequence of numbers from 0 its runs: rows of start, length and smallest period, by start and period.

    A run has at least ``least`` (12 or more) and two periods' symbols, and no neighbouring one continues it.
    """
    if least < 3 * GRAM:
        raise ValueError(f"runs of at least {3 * GRAM} words only")
    size = np.array([len(s) for s in sequences], np.int64)
    symbols, base = _apart(sequences)
    found = [np.zeros((0, 3), np.int64)]
    for place, period in _candidates(symbols, size, base):
        # only sequences with candidates are compressed
        of = np.searchsorted(base, place, "right") - 1
        some, of = np.unique(of, return_inverse=True)
        own, start = _apart([sequences[i] for i in some.tolist()])
        x = place - base[some[of]] + start[of]
        ahead = Grammar(own).common(x, x + period)
        before = Grammar(own[::-1]).common(len(own) - x, len(own) - x - period)
        on = ahead + before + period >= np.maximum(least, 2 * period)
        found.append(np.unique(np.stack([place - before, place + period + ahead, period], 1)[on], axis=0))
    every = np.unique(np.concatenate(found), axis=0)  # by start, end and period: of equal stretches the smallest period comes first
    new = np.ones(len(every), bool)
    new[1:] = (every[1:, :2] != every[:-1, :2]).any(1)
    every = every[new]
    every = every[np.lexsort((every[:, 2], every[:, 0]))]
    of = np.searchsorted(base, every[:, 0], "right") - 1
    cut = np.searchsorted(of, np.arange(len(size) + 1))
    every[:, 1] -= every[:, 0]
    every[:, 0] -= base[of]
    return [every[a:b] for a, b in zip(cut[:-1], cut[1:])]


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def _found(least: int):
    def judged(texts: list[bytes]) -> tuple[pa.Array, list[bytes]]:
        names = defaultdict(count().__next__)
        split = [t.split() for t in texts]  # bytes are cut at the six ASCII spaces
        of = runs([np.fromiter(map(names.__getitem__, w), np.int64, len(w)) for w in split], least)
        kept = []
        for w, own in zip(split, of):
            if len(own):
                edge = np.zeros(len(w) + 1, np.int64)
                np.add.at(edge, own[:, 0] + own[:, 2], 1)
                np.add.at(edge, own[:, 0] + own[:, 1], -1)
                w = [w[i] for i in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]
            kept.append(b" ".join(w))
        flat = np.concatenate([*of, np.zeros((0, 3), np.int64)])
        ends = np.cumsum([0, *map(len, of)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(c) for c in flat.T], fields=list(_RUN))), kept

    def run(batches):
        for batch in batches:
            texts, start, waiting = batch.column("text").to_pylist(), 0, 0
            for i, t in enumerate(texts):
                waiting += len(t)
                if waiting >= TOGETHER or i + 1 == len(texts):
                    found, kept = judged(texts[start : i + 1])
                    yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(start, i + 1 - start), pa.array(kept, pa.binary()).cast(pa.string()), found], ["doc_id", "text", "runs"])
                    start, waiting = i + 1, 0

    return run


def periodic_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """Of every row of ``docs`` (doc_id, text) the runs of its words and the text without what they repeat: doc_id, text, runs.

    Words are ``[^\\x20\\x09-\\x0D]+``, numbered from 0. A run is a stretch with smallest period q (words q apart are equal) of at least
    ``least`` and 2 * q words that no neighbouring word continues; runs are ordered by start and period. A word goes if a run has it after its
    first q words; the words that stay are joined by one space.

    Null and empty texts have no words, no runs and an empty text. Repeated rows and null doc_ids keep their rows; other columns are ignored; an
    empty table gives no rows.
    """
    kind = dict(docs.select("doc_id").dtypes)["doc_id"]
    return docs.select(*text_bytes()).mapInArrow(_found(least), f"doc_id {kind}, text string, runs array<struct<start bigint, length bigint, period bigint>>")


def with_planted_periods(docs: DataFrame) -> DataFrame:
    """doc_id, text: documents of which a crc32 of the doc_id picks a tenth to be made periodic from some word on; null doc_ids are left alone.

    With h the crc32 of the decimal doc_id, g = h div 10 and n words, where h is a multiple of 10 each word i from a = g mod n on becomes word
    a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8).
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")
    picked = docs.select("doc_id", "text", F.expr("crc32(cast(cast(doc_id as string) as binary)) div 10").alias("g"), F.when(h % 10 == 0, words).alias("w"))
    picked = picked.withColumn("n", F.size("w")).withColumn("a", F.when(F.col("n") > 0, (F.col("g") % F.col("n")).cast("int")))
    picked = picked.withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    made = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p"))))
    return picked.select("doc_id", F.when(F.col("n") > 0, F.array_join(made, " ")).otherwise(F.col("text")).alias("text"))
