"""Best-fit packing of tokenised texts into sequences, by best-two-fit on the histogram of lengths.

How many pieces there are of each length (at most ``capacity`` numbers, whatever the corpus) decides the
packing, so only that goes to the driver. A bin is filled greedily from the longest length down;
then its smallest piece is replaced by two unpacked ones that fill the larger gap more tightly.
The bin's pattern is used as often as the counts allow. Pieces then find their place by their
rank among those of their length, which Spark numbers within salted groups.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.llm.pieces import Pieces
from lumenfold.llm.shared import partitions, tidy, written

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


@lru_cache(1)
def _worker(path: str, pattern: str) -> Pieces:
    import tiktoken

    from lumenfold.llm.bpe import read_ranks

    encode = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={}).encode_ordinary
    return Pieces(lambda piece: array("I", encode(piece)).tobytes(), bytes.__add__)


@lru_cache(1)
def _added(path: str) -> dict[str, int]:
    """The tokens beside the ranks that the vocabulary's json, if there is one, has; they are looked for before anything is split."""
    try:
        with open(re.sub(r"\.tiktoken$", ".json", path), encoding="utf-8") as f:
            tokens = json.load(f)["added_tokens"]
    except FileNotFoundError:
        return {}
    odd = [t["content"] for t in tokens if t["single_word"] or t["lstrip"] or t["rstrip"]]
    if odd:
        raise ValueError(f"added tokens of a kind that is not known here: {odd}")
    return {t["content"]: t["id"] for t in tokens}


def _encoded(text: str, pieces: Pieces, added: dict[str, int]) -> list[bytes]:
    """The ids of a text, in which added tokens are one id each; of several at one place the longest."""
    if not any(t in text for t in added):
        return [*pieces.of(text)]
    out = []
    for part in re.split("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")", text):
        out += [array("I", [added[part]]).tobytes()] if part in added else pieces.of(part)
    return out


def tokenised(docs: DataFrame, ranks_path: str, pattern: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """The pieces of every text: its ids and then ``end_id``, cut only if longer than ``capacity``; the first piece takes what is over.

    Added tokens, such as <|endoftext|>, in a text are the ids that the json beside ``ranks_path`` gives them.
    """

    def run(batches):
        pieces, added, end = _worker(ranks_path, pattern), _added(ranks_path), array("I", [end_id]).tobytes()
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                ids = memoryview(b"".join([*_encoded(text, pieces, added), end]))
                n = len(ids) // 4
                cut, k = 0, 0
                while cut < n:
                    to = cut + ((n - 1) % capacity + 1 if k == 0 else capacity)
                    row.append(i)
                    piece.append(k)
                    start.append(cut)
                    length.append(to - cut)
                    crc.append(zlib.crc32(ids[4 * cut : 4 * to]))
                    cut, k = to, k + 1
            ints = [pa.array(x, t) for x, t in ((piece, pa.int32()), (start, pa.int64()), (length, pa.int64()), (crc, pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row, pa.int64())), *ints], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, PIECES)


def best_two_fit(counts: dict[int, int], capacity: int) -> list[tuple[list[int], int]]:
    """(lengths in one bin, how many such bins) from the count of each length.

    Each round uses a pattern as often as the counts allow, after which the count of some length in it
    is below what the pattern takes; so the patterns stay within a few times ``capacity``.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] += n
    out = []
    while left.any():
        took = np.zeros(capacity + 1, np.int64)
        bin_, gap = [], capacity
        while True:
            fits = np.flatnonzero((left - took)[: gap + 1] > 0)
            if not len(fits):
                break
            bin_.append(int(fits[-1]))
            took[bin_[-1]] += 1
            gap -= bin_[-1]
        if gap and len(bin_) > 1:  # exchange the smallest for the two that fill its place and the gap best
            small = bin_[-1]
            took[small] -= 1
            free, room = left - took, gap + small
            best = None
            for a in np.flatnonzero(free[: room + 1] > 0)[::-1]:
                other = free.copy()
                other[a] -= 1
                b = np.flatnonzero(other[: min(a, room - a) + 1] > 0)
                if len(b) and a + b[-1] > small and (best is None or a + b[-1] > sum(best)):
                    best = int(a), int(b[-1])
                if 2 * a <= (sum(best) if best else small) or best and sum(best) == room:
                    break
            bin_[-1:] = best or (small,)
            took = np.bincount(bin_, minlength=capacity + 1)
        used = np.flatnonzero(took)
        times = int((left[used] // took[used]).min())
        left -= times * took
        out.append((bin_, times))
    return out


def _places(patterns: list[tuple[list[int], int]]) -> np.ndarray:
    """Rows of length, first rank, first sequence, offset: ranks from there on lie in the sequences from there on."""
    rows, taken, sequence = [], {}, 0
    for bin_, times in patterns:
        offset = 0
        for length in bin_:
            rows.append((length, taken.get(length, 0), sequence, offset))
            taken[length] = taken.get(length, 0) + times
            offset += length
        sequence += times
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


@tidy
def packed(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id and offset, gapless from 0 in each sequence.

    Equal lengths are told apart by salted row numbers, so ties and repeated rows get places of their own. No rows: no rows.
    """
    spark = pieces.sparkSession
    salts = 4 * partitions(spark)
    salted = written(pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "start", "ids_crc32"), F.lit(salts)).cast("int")), "pieces")
    # repeated rows differ in nothing else, so they share a salt; their order within it does not matter
    by_salt = written(salted.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("salt").rowsBetween(W.unboundedPreceding, -1))), "salts")
    counts = {r.length: r.n for r in by_salt.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(_places(best_two_fit(counts, capacity)))
    ranked = salted.join(by_salt.select("length", "salt", F.coalesce("before", F.lit(0)).alias("before")), ["length", "salt"])
    ranked = ranked.withColumn("rank", F.col("before") + F.row_number().over(W.partitionBy("length", "salt").orderBy("doc_id", "piece", "start", "ids_crc32")) - 1)
    names = [c for c in pieces.columns]

    def run(batches):
        table = places.value
        span = 1 << 40
        keys = table[:, 0] * span + table[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = table[np.searchsorted(keys, length * span + rank, "right") - 1] if len(length) else table[:0]
            more = pa.array(at[:, 2] + rank - at[:, 1], pa.int64()), pa.array(at[:, 3], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *more], [*names, "sequence_id", "offset"])

    kinds = ", ".join(f"{c} {t}" for c, t in pieces.dtypes)
    return ranked.select(*names, "rank").mapInArrow(run, f"{kinds}, sequence_id bigint, offset bigint")


def pack(docs: DataFrame, ranks_path: str, pattern: str, end_id: int = 0, capacity: int = 2048) -> DataFrame:
    """One row per piece of each row of ``docs``: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of ``end_id`` alone. Texts of more than ``capacity`` ids are cut, however
    long. Repeated rows and null ids are packed like others; other columns are ignored; an empty table gives no rows.
    """
    return packed(tokenised(docs, ranks_path, pattern, end_id, capacity), capacity)
