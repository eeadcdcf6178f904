"""Document fingerprints by Order MinHash.

A text's k-mers are runs of ``K`` words, each numbered by how often it occurred before. For each of ``REPEATS``
hash functions the ``TUPLE`` k-mers with the smallest hashes are selected, put back in the order they have in the
text, and hashed as a tuple. Two texts agree in a component about as often as they select the same k-mers in the same
order, which moving a passage breaks as well as changing it: so the likeness falls with the edit distance.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.shared import mix, partitions, shingle_hashes, word_hashes

K, TUPLE, REPEATS = 2, 2, 64
#: About so many characters of texts are fingerprinted together.
TOGETHER = 1 << 17
_SEEDS = mix(np.arange(1, REPEATS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def fingerprints(texts: list[bytes]) -> np.ndarray:
    """32 bits for each repeat of each text. A text without words has the fingerprint of no k-mers, all 0."""
    out = np.zeros((len(texts), REPEATS), np.uint32)
    bounds = np.cumsum([0, *map(len, texts)])
    h, before = word_hashes(np.frombuffer(b"".join(texts), np.uint8), bounds)
    if not len(h):
        return out
    n_words = np.diff(before)
    of = np.repeat(np.arange(len(texts)), n_words)
    at = np.flatnonzero(np.arange(len(h)) + K <= before[of + 1])
    few = np.flatnonzero((n_words > 0) & (n_words < K))
    kmers = np.concatenate([shingle_hashes(h, K)[at] if len(at) else at.astype(np.uint64), *(shingle_hashes(h[before[t] : before[t + 1]], K) for t in few)])
    owner = np.concatenate([of[at], few])
    order = np.argsort(owner, kind="stable")
    kmers, owner = kmers[order], owner[order]
    # each k-mer is numbered by how often its text had it before
    order = np.lexsort((kmers, owner))
    run, whose = kmers[order], owner[order]
    first = np.flatnonzero(np.concatenate(([True], (run[1:] != run[:-1]) | (whose[1:] != whose[:-1]))))
    number = np.empty(len(run), np.uint64)
    number[order] = np.arange(len(run)) - np.repeat(first, np.diff(np.append(first, len(run))))
    numbered = mix(kmers + number * np.uint64(0xD1B54A32D192ED03))

    there = np.unique(owner)
    cut = np.searchsorted(owner, there)
    size = np.diff(np.append(cut, len(owner)))
    # the lowest bits of a hash give way to the k-mer's place, so that the least hash tells it
    bits = np.uint64(max(1, int(size.max() - 1).bit_length()))
    place = (np.arange(len(owner)) - np.repeat(cut, size)).astype(np.uint64)
    none = np.iinfo(np.uint64).max
    for some in np.array_split(np.arange(REPEATS), min(REPEATS, max(1, len(numbered) * REPEATS >> 18))):
        hashed = numbered * _SEEDS[some, None]
        hashed ^= hashed >> np.uint64(32)
        hashed *= np.uint64(0xFF51AFD7ED558CCD)
        hashed = hashed >> bits << bits | place
        picks = []
        for i in range(TUPLE):
            least = np.minimum.reduceat(hashed, cut, axis=1)
            picks.append(np.where(i < size, least & (np.uint64(1) << bits) - np.uint64(1), none))
            hashed[hashed == np.repeat(least, size, axis=1)] = none
        picks, total = np.sort(picks, axis=0), np.zeros((len(some), len(there)), np.uint64)
        for i in range(TUPLE):
            on = np.broadcast_to(i < size, total.shape)
            value = numbered[np.where(on, picks[i], 0).astype(np.int64) + cut]
            total = np.where(on, mix(total * np.uint64(3) + value), total)
        out[there[:, None], some] = (mix(total + _SEEDS[some, None]) >> np.uint64(32)).astype(np.uint32).T
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


OUT = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())])


def _rows(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), batch.column("bucket").to_pylist(), batch.column("only_next").to_pylist())


def _judged(jobs: list[tuple[int, str, str]]) -> pa.RecordBatch:
    """Rows for (doc_id, text, next text); where the next text is that of the following job, it is fingerprinted once."""
    edited, texts, following = [], [own for _, own, _ in jobs], []
    for i, (_, own, nxt) in enumerate(jobs):
        n = len(own) // 3
        edited.append(own[: len(own) - n] + nxt[:n])
        if i + 1 < len(jobs) and jobs[i + 1][1] is nxt:
            following.append(i + 1)
        else:
            following.append(len(texts))
            texts.append(nxt)
    prints = fingerprints([t.encode() for t in texts + edited])
    own, new, nxt = prints[: len(jobs)], prints[len(texts) :], prints[following]
    columns = [d for d, _, _ in jobs], [len(t) for _, t, _ in jobs], [hashlib.sha256(t.encode()).hexdigest() for t in edited], [p.tobytes().hex() for p in own], [p.tobytes().hex() for p in new], [*map(likeness, own, new)], [*map(likeness, own, nxt)]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, OUT.types)], schema=OUT)


def _compare(batches):
    """Rows come by bucket, in the order of the texts, then the first text of the next bucket."""
    jobs, waiting, before = [], 0, None
    for doc_id, text, bucket, only_next in _rows(batches):
        if before is not None and before[2] == bucket:
            jobs.append((before[0], before[1], text))
            waiting += len(before[1])
            if waiting >= TOGETHER:
                yield _judged(jobs)
                jobs, waiting = [], 0
        before = None if only_next else (doc_id, text, bucket)
    if jobs:
        yield _judged(jobs)


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness; one row per row of ``docs``.

    The next document has the next smaller doc_id (null: after all others; equal ids: by text); after the last comes the
    first. The edited text has the last floor(n_chars / 3) code points replaced by the first as many, or all, of the
    next document. Null texts are empty. Equal texts have equal fingerprints; a single row is its own next
    document. Other columns are ignored; an empty table gives no rows.

    Texts are dealt into ranges of ids with about equally many rows and read in order within a range; only the first
    text of each range is needed in another one.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = 4 * partitions(spark)
    cuts = rows.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000).alias("q")).first().q or []
    cuts = sorted(set(cuts), reverse=True)
    # 0: ids above the first cut; one range more for null ids. Every bucket holds the cut that ends it.
    edges = np.array(cuts[::-1], np.int64)

    @F.pandas_udf("int")
    def above(ids: pd.Series) -> pd.Series:
        return pd.Series(len(edges) - np.searchsorted(edges, ids.to_numpy(), "right"))

    rows = rows.withColumn("bucket", F.when(F.col("doc_id").isNull(), len(cuts) + 1).otherwise(above(F.coalesce("doc_id", F.lit(0)))).cast("int"))
    starts = rows.groupBy("bucket").agg(F.max("doc_id").alias("top")).collect()
    if not starts:
        return spark.createDataFrame([], "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
    order = sorted(starts, key=lambda r: r.bucket)
    follows = F.broadcast(spark.createDataFrame([(r.top, r.bucket, order[i - 1].bucket) for i, r in enumerate(order)], "top bigint, own int, bucket int"))
    lead = rows.join(follows, (rows.bucket == follows.own) & rows.doc_id.eqNullSafe(follows.top)).groupBy("own").agg(F.min("text").alias("text"), F.max("doc_id").alias("doc_id"), F.max(follows.bucket).alias("bucket"))
    dealt = rows.withColumn("only_next", F.lit(False)).unionByName(lead.select("doc_id", "text", "bucket").withColumn("only_next", F.lit(True)))
    dealt = dealt.repartition(n, "bucket").sortWithinPartitions("bucket", "only_next", F.desc_nulls_last("doc_id"), "text")
    out = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return dealt.select("doc_id", "text", "bucket", "only_next").mapInArrow(_compare, out)
