"""Inverted files in blocks: a task numbers the texts of a block, and each term of the block has one row with the numbers of its texts, as gaps in bytes.

So a posting takes one or two bytes wherever it goes, not a row with a term and ids. What the numbers stand for is in one more row of the block, its directory.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What begins the term of a block's directory; no word and no run of characters has it.
DIRECTORY = "\0"
ROWS = "term string, block string, spots binary, counts binary, ids array<string>, entries array<string>, sizes array<int>"
_ROWS = pa.schema([("term", pa.string()), ("block", pa.string()), ("spots", pa.binary()), ("counts", pa.binary()), *((c, pa.list_(pa.string())) for c in ("ids", "entries")), ("sizes", pa.list_(pa.int32()))])
#: Texts of a block at most, and bits for their numbers.
TEXTS, BITS = 10_000, 20


def packed(values: np.ndarray, starts: np.ndarray) -> pa.Array:
    """Numbers from 0 in bytes, as many arrays as there are ``starts``: a 255 says that 255 and the next one are added."""
    times, rest = np.divmod(values, 255)
    ends = np.cumsum(times + 1)
    data = np.full(ends[-1] if len(ends) else 0, 255, np.uint8)
    data[ends - 1] = rest
    bounds = np.append(0, ends)[np.append(starts, len(values))].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])


def unpacked(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8).astype(np.int64)
    ends = np.flatnonzero(b != 255)
    return np.add.reduceat(b, np.append(0, ends[:-1] + 1)) if len(ends) else b[:0]


def spots_of(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data))


Found = tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]


def _found(names: Callable[[np.ndarray], pa.Array], both: np.ndarray, times: np.ndarray) -> Found:
    """Of pairs of a term's number and a text's, in order: the terms, where each begins, the texts' numbers and the counts."""
    term, spot = both >> BITS, both & ((1 << BITS) - 1)
    starts = np.flatnonzero(np.diff(term, prepend=-1))
    return names(term[starts]), starts, spot, times


def words(texts: pa.Array) -> Found:
    """Runs of a-z and apostrophes in texts of small letters."""
    known: dict[str, int] = defaultdict(count().__next__)
    own = [np.fromiter(map(known.__getitem__, re.findall("[a-z']+", t)), np.int64) for t in texts.to_pylist()]
    row = np.repeat(np.arange(len(own)), [len(x) for x in own])
    both, times = np.unique(np.concatenate(own) << BITS | row, return_counts=True)
    terms = pa.array(list(known), pa.string())
    return _found(lambda numbers: terms.take(pa.array(numbers)), both, times)


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Where each text begins and ends, and all bytes from the first on."""
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return ends, np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)


def grams(texts: pa.Array) -> Found:
    """Runs of three characters from tab to tilde, without counts."""
    ends, b = _bytes(texts)
    row, ok = np.repeat(np.arange(len(texts), dtype=np.int32), np.diff(ends)), (b >= 9) & (b <= 126)
    at = np.flatnonzero(ok[:-2] & ok[1:-1] & ok[2:] & (row[:-2] == row[2:]))
    both = b[at].astype(np.int64)
    for more, bits in ((b[1:], 7), (b[2:], 7), (row, BITS)):
        both <<= bits
        both |= more[at]
    del at, row, ok
    both.sort()
    both = both[np.flatnonzero(np.diff(both, prepend=-1))]

    def names(codes: np.ndarray) -> pa.Array:
        letters = np.stack([codes >> 14, codes >> 7 & 127, codes & 127], 1).astype(np.uint8)
        return pa.Array.from_buffers(pa.string(), len(codes), [None, pa.py_buffer(np.arange(0, 3 * len(codes) + 1, 3, dtype=np.int32)), pa.py_buffer(letters.ravel())])

    return _found(names, both, np.zeros(0, np.int64))


def _blocks(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """Cut so that the texts of each have ``most`` bytes, or there is one."""
    size, first, held = pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False), 0, 0
    for i, n in enumerate(size):
        if i > first and (held + n > most or i - first >= TEXTS):
            yield batch.slice(first, i - first)
            first, held = i, 0
        held += int(n)
    if first < len(size):
        yield batch.slice(first)


def inverted(texts: DataFrame, version: int, find: Callable[[pa.Array], Found], most: int, counted: bool) -> DataFrame:
    """The rows of ROWS of texts (id, entry_id, size, text): blocks of at most ``most`` bytes, with how often each text has the term if ``counted``."""

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for own in _blocks(batch, most):
                text = own.column("text").cast(pa.string())
                name = hashlib.blake2b(digest_size=12)
                for column in ("id", "text"):
                    ends, data = _bytes(own.column(column).cast(pa.string()))
                    name.update(np.diff(ends).tobytes())
                    name.update(data.tobytes())
                block = f"{version}:{name.hexdigest()}"
                terms, starts, spots, times = find(text)
                gaps = np.diff(spots, prepend=0)
                gaps[starts] = spots[starts]
                k = len(starts)
                none = lambda name, n: pa.nulls(n, _ROWS.field(name).type)
                columns = [terms, pa.array([block] * k, pa.string()), packed(gaps, starts), packed(times, starts) if counted else none("counts", k), *(none(c, k) for c in ("ids", "entries", "sizes"))]
                yield pa.RecordBatch.from_arrays(columns, schema=_ROWS)
                lists = [pa.array([own.column(c).to_pylist()], _ROWS.field(to).type) for c, to in (("id", "ids"), ("entry_id", "entries"), ("size", "sizes"))]
                yield pa.RecordBatch.from_arrays([pa.array([DIRECTORY + block]), pa.array([block]), none("spots", 1), none("counts", 1), *lists], schema=_ROWS)

    # in one order, so that a task that is run again makes the same blocks
    rows = texts.select("id", "entry_id", "size", "text").sortWithinPartitions("entry_id", "id", "text")
    return rows.mapInArrow(made, ROWS).withColumn("version", F.lit(version).cast("bigint"))
