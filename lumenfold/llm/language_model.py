"""A word bigram model in a log-frequency Bloom filter, and exact unigram scores beside it.

Counting: tasks count hashed words and bigrams of their texts, in sorted arrays dealt by the hash's leading
bits into shards, several for each shuffle partition; each shard is merged by itself. Words keep all 64
bits of their hash. A bigram keeps its shard and 40 bits: it shares them with another with a chance of
(bigrams of a shard) / 2**40, the same at every size.

The filter: a count c has the level 1 + floor(2 * log2 c), and an n-gram is entered once for each
level up to its own, so a reader probes level after level until one is missing. Each shard fills
a segment of its own, with BITS_EACH bits for each entry, whatever the corpus.

Reading: a filter that grows with the corpus has no bound under which it could always be broadcast. One of at most ``broadcast_bytes``, its
words' exact counts included, is; a larger one stays in its segments: the distinct n-grams of each chunk of texts go to the
task that holds their segments, and their levels, and words' exact counts, come back to the chunk. Both ways read the same bits.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.shared import arrow_rows, mix, partitions, slices, text_bytes, word_hashes, tidy, written

END, BEGIN = np.uint64(0x51ED270B7A3C9E15), np.uint64(0x2545F4914F6CDD1D)
BITS_EACH, PROBES = 8, 3
#: A shard's arrays leave a task when so many tokens are waiting; a shard is for the n-grams of about so many bytes of text.
FLUSH, SHARD_BYTES = 2_000_000, 4 << 20
#: Bytes of the texts that ask for levels together, and how many shards' segments are read in one place (as a power of two).
CHUNK, NEAR = 8 << 20, 3
#: Weight of the bigram's part.
BIGRAM = 0.4

SHARD = "gram int, shard int, once binary, more binary, counts binary"
MERGED = "gram int, shard int, size bigint, segment binary, keys binary, counts binary, words bigint, tokens bigint"
SCORED = "doc_id bigint, n_tokens bigint, n_known bigint, base_score double, score double"


def level(c: np.ndarray) -> np.ndarray:
    return (1 + np.floor(2 * np.log2(c))).astype(np.int64)


def value(q: np.ndarray) -> np.ndarray:
    """The middle of a level's counts; level 1 is a count of 1."""
    return np.where(q <= 1, q, 2.0 ** ((q - 0.5) / 2))


def bigrams(before: np.ndarray, after: np.ndarray, bits: int) -> np.ndarray:
    """``bits`` for the shard and 40 more."""
    return mix(mix(before) * np.uint64(0x9E3779B97F4A7C15) + after) >> np.uint64(24 - bits)


def shards(keys: np.ndarray, gram: int, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits if gram == 1 else 40)).astype(np.int64)


def tokens(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts: each token's hash (every text's words, then its end), the token before it, and each text's first token."""
    all_now, all_prev, all_first, at = [], [], [np.zeros(1, np.int64)], 0
    for _, _, data, bounds in slices(batch, "text"):
        h, before = word_hashes(data, bounds)
        first = before + np.arange(len(before))
        now = np.empty(len(h) + len(before) - 1, np.uint64)
        ends = np.zeros(len(now), bool)
        ends[first[1:] - 1] = True
        now[~ends], now[ends] = h, END
        prev = np.empty_like(now)
        prev[1:] = now[:-1]
        prev[first[:-1]] = BEGIN
        all_now.append(now)
        all_prev.append(prev)
        all_first.append(first[1:] + at)
        at += len(now)
    none = np.zeros(0, np.uint64)
    return np.concatenate(all_now or [none]), np.concatenate(all_prev or [none]), np.concatenate(all_first)


def squeezed(numbers: np.ndarray) -> bytes:
    """64-bit numbers as planes of their bytes, compressed: the high bytes of sorted or small ones take hardly any room."""
    planes = np.ascontiguousarray(numbers.astype(np.uint64).view(np.uint8).reshape(-1, 8).T)
    return len(numbers).to_bytes(8, "little") + (pa.compress(planes.tobytes(), "zstd", asbytes=True) if len(numbers) else b"")


def unsqueezed(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[:8], "little")
    planes = np.frombuffer(pa.decompress(raw[8:], 8 * n, "zstd") if n else b"", np.uint8)
    return np.ascontiguousarray(planes.reshape(8, n).T).reshape(-1).view(np.uint64)


def _counter(bits: int):
    """Rows of gram size, shard, keys that were met once, other keys, their counts."""
    schema = pa.schema([("gram", pa.int32()), ("shard", pa.int32()), ("once", pa.binary()), ("more", pa.binary()), ("counts", pa.binary())])

    def count(found: list[np.ndarray], gram: int):
        keys, n = np.unique(np.concatenate(found), return_counts=True)
        cut = np.searchsorted(shards(keys, gram, bits), np.arange((1 << bits) + 1))
        for s in np.flatnonzero(np.diff(cut)):
            k, c = keys[cut[s] : cut[s + 1]], n[cut[s] : cut[s + 1]]
            yield gram, int(s), squeezed(k[c == 1]), squeezed(k[c > 1]), squeezed(c[c > 1])

    def flush(one: list, two: list):
        rows = []
        for gram, found in ((1, one), (2, two)):
            for row in count(found, gram):
                rows.append(row)
                if len(rows) == 64:
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
            found.clear()
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), schema)], schema=schema)

    def run(batches):
        one, two, waiting = [], [], 0
        for batch in batches:
            for a, b, _, _ in slices(batch, "text", CHUNK):
                now, prev, _ = tokens(batch.slice(a, b - a))
                one += [now, np.full(b - a, BEGIN)]
                two.append(bigrams(prev, now, bits))
                waiting += len(now)
                if waiting >= FLUSH:
                    yield from flush(one, two)
                    waiting = 0
        if one:
            yield from flush(one, two)

    return run


def _spots(keys: np.ndarray, q: int, size: np.ndarray | int):
    """Bits, within a segment of ``size`` bits, of keys entered at level ``q``."""
    g = mix(keys + np.uint64(0xD1B54A32D192ED03 * q & (1 << 64) - 1))
    a, b = g & np.uint64(0xFFFFFFFF), g >> np.uint64(32)
    for i in range(PROBES):
        yield ((a + np.uint64(i) * b & np.uint64(0xFFFFFFFF)) * np.asarray(size).astype(np.uint64) >> np.uint64(32)).astype(np.int64)


def segment(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The bits of one shard's keys."""
    q = level(counts)
    bits = np.zeros(8 * max(1, BITS_EACH * int(q.sum()) // 8), bool)
    for at in range(1, int(q.max(initial=0)) + 1):
        for spot in _spots(keys[q >= at], at, len(bits)):
            bits[spot] = True
    return bits


def _merged(table: pa.Table) -> pa.Table:
    """One shard's arrays added up: its segment, and of words the exact counts."""
    gram, shard = table["gram"][0].as_py(), table["shard"][0].as_py()
    keys, counts = [], []
    for once, more, c in zip(*(table[x].to_pylist() for x in ("once", "more", "counts"))):
        keys += [unsqueezed(once), unsqueezed(more)]
        counts += [np.ones(len(keys[-2]), np.uint64), unsqueezed(c)]
    keys, counts = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    keys, counts = keys[first], np.add.reduceat(counts, first)
    bits = segment(keys, counts)
    real = (keys != BEGIN) & (gram == 1)
    row = gram, shard, len(bits), np.packbits(bits, bitorder="little").tobytes(), squeezed(keys[real]), squeezed(counts[real]), int(real.sum()), int(counts[real].sum())
    kinds = pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()
    return pa.table([pa.array([x], t) for x, t in zip(row, kinds)], [c.split()[0] for c in MERGED.split(", ")])


class Segments:
    """Of one gram size, the filter's segments of some shards, and of words the exact counts."""

    def __init__(self, rows: pa.Table, gram: int, bits: int):
        rows = rows.sort_by("shard")
        self.gram, self.bits = gram, bits
        self.shard, self.size = rows["shard"].to_numpy().astype(np.int64), rows["size"].to_numpy().astype(np.int64)
        self.start = np.concatenate(([0], np.cumsum(self.size)))
        self.raw = np.frombuffer(b"".join(rows["segment"].to_pylist()), np.uint8)
        none = [np.zeros(0, np.uint64)]
        self.keys, self.counts = (np.concatenate([*map(unsqueezed, rows[c].to_pylist())] or none) for c in ("keys", "counts"))

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """By probing level after level, until one is missing."""
        q = np.zeros(len(keys), np.int64)
        if not len(self.shard):
            return q
        shard = shards(keys, self.gram, self.bits)
        at = np.minimum(np.searchsorted(self.shard, shard), len(self.shard) - 1)
        on, now = np.flatnonzero(self.shard[at] == shard), 1
        while len(on) and now < 130:
            hit = np.ones(len(on), bool)
            for spot in _spots(keys[on], now, self.size[at[on]]):
                spot += self.start[at[on]]
                hit &= (self.raw[spot >> 3] >> (spot & 7).astype(np.uint8) & 1).astype(bool)
            on = on[hit]
            q[on] = now
            now += 1
        return q

    def exact(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.zeros(len(keys), np.uint64)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.counts[at], np.uint64(0))


def _chunked(batches):
    """Rows of about CHUNK bytes of whole texts: the number of the first (which names the chunk), their ids, bounds, and bytes, compressed."""
    task, row = TaskContext.get().partitionId() << 33, 0
    for batch in batches:
        for a, b, data, bounds in slices(batch, "text", CHUNK):
            ids = pa.ListArray.from_arrays(pa.array([0, b - a], pa.int32()), batch.column("doc_id").slice(a, b - a))
            small = pa.compress(data.tobytes(), "zstd", asbytes=True)
            yield pa.RecordBatch.from_arrays([pa.array([task + row], pa.int64()), ids, pa.array([bounds.tobytes()]), pa.array([small])], ["chunk", "ids", "bounds", "data"])
            row += b - a


def _texts(bounds: bytes, data: bytes) -> pa.RecordBatch:
    at = np.frombuffer(bounds, np.int64)
    raw = pa.decompress(data, int(at[-1]), "zstd")
    return pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(bounds), raw])], ["text"])


def _questions(bits: int):
    """Rows of chunk, gram size, part (shards in a row) and the distinct keys of the chunk in it."""

    def run(batches):
        for batch in batches:
            for chunk, bounds, data in zip(*(batch.column(c).to_pylist() for c in ("chunk", "bounds", "data"))):
                now, prev, _ = tokens(_texts(bounds, data))
                for gram, keys in ((1, np.append(now, BEGIN)), (2, bigrams(prev, now, bits))):
                    keys = np.unique(keys)
                    cut = np.searchsorted(shards(keys, gram, bits) >> NEAR, np.arange((1 << max(0, bits - NEAR)) + 1))
                    parts = np.flatnonzero(np.diff(cut))
                    sent = [squeezed(keys[cut[p] : cut[p + 1]]) for p in parts]
                    n = len(parts)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(n, chunk)), pa.array(np.full(n, gram, np.int32)), pa.array(parts.astype(np.int32)), pa.array(sent, pa.binary())], ["chunk", "gram", "part", "keys"])

    return run


def _answers(bits: int):
    """For the keys that chunks ask for, from the segments of one part: levels, and words' exact counts."""

    def run(key, asked: pa.Table, held: pa.Table) -> pa.Table:
        gram = key[0].as_py()
        own, levels, counts = Segments(held, gram, bits), [], []
        for sent in asked["keys"].to_pylist():
            keys = unsqueezed(sent)
            levels.append(own.levels(keys).astype(np.uint8).tobytes())
            counts.append(squeezed(own.exact(keys)) if gram == 1 else b"")
        return pa.table({"chunk": asked["chunk"], "gram": asked["gram"], "part": asked["part"], "levels": pa.array(levels, pa.binary()), "counts": pa.array(counts, pa.binary())})

    return run


def _scores(batch: pa.RecordBatch, ids: pa.Array, bits: int, n: int, v: int, read) -> pa.RecordBatch:
    """``read`` (gram size, distinct keys in order) gives their levels and, of words, exact counts."""
    now, prev, first = tokens(batch)
    texts = len(first) - 1
    word, at = np.unique(np.append(now, BEGIN), return_inverse=True)
    levels, exact = read(1, word)
    smooth = n + 0.1 * (v + 1)
    c = value(levels)
    uni = (c + 0.1) / smooth
    c_prev = np.empty(len(now))
    c_prev[1:] = c[at[:-2]]
    c_prev[first[:-1]] = c[at[-1]]
    at = at[:-1]
    pair, where = np.unique(bigrams(prev, now, bits), return_inverse=True)
    both = value(read(2, pair)[0])
    p = (1 - BIGRAM) * uni[at] + BIGRAM * np.minimum(1, both[where] / np.maximum(c_prev, 1))
    text = np.repeat(np.arange(texts), np.diff(first))
    base = np.bincount(text, (np.log10(exact.astype(np.float64) + 0.1) - np.log10(smooth))[at], texts)
    known = np.bincount(text, (exact > 0)[at], texts).astype(np.int64)
    return pa.RecordBatch.from_arrays([ids, pa.array(np.diff(first)), pa.array(known), pa.array(base), pa.array(np.bincount(text, np.log10(p), texts))], [c.split()[0] for c in SCORED.split(", ")])


@tidy
def score(docs: DataFrame, learn=None, broadcast_bytes: int = 4 << 20, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_tokens, n_known, train_tokens, base_score, score.

    Tokens are the words ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, and one end for every text; the rows where
    ``learn``, a condition on doc_id, holds (default: all) are counted. With c the token's count, N all and V the
    distinct tokens counted, base_score sums log10((c + 0.1) / (N + 0.1 * (V + 1))); n_known counts tokens with c > 0.
    score sums log10 of (1 - BIGRAM) * unigram + BIGRAM * bigram probability, all counts read from the filter. ``broadcast_bytes``
    decides how the filter is read, not what it says. N-grams are dealt into shards for about ``shard_bytes`` of text each, however many partitions the
    session has, so that no task holds more as the corpus grows.

    Null and empty texts are an end alone. Repeated rows count as often as they come, and keep their rows, as null
    ids do (which teach nothing where ``learn`` is not true of them). With nothing to learn from, N and V are 0.
    Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text")
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(24, max((4 * partitions(spark)).bit_length(), (size // shard_bytes).bit_length()))
    taught = rows.where(learn) if learn is not None else rows
    counted = taught.select(*text_bytes()).mapInArrow(_counter(bits), SHARD)
    grams = written(counted.groupBy("gram", "shard").applyInArrow(_merged, MERGED), "grams")
    total = grams.agg(F.sum("words").alias("v"), F.sum("tokens").alias("n"), F.sum(F.col("size") / 8 + 16 * F.col("words")).alias("held")).first()
    n, v = total.n or 0, total.v or 0

    if (total.held or 0) <= broadcast_bytes:
        model = spark.sparkContext.broadcast(grams.toArrow())

        def near(batches):
            held = {g: Segments(model.value.filter(pa.compute.equal(model.value["gram"], g)), g, bits) for g in (1, 2)}
            for batch in batches:
                for a, b, _, _ in slices(batch, "text", CHUNK):
                    yield _scores(batch.slice(a, b - a), batch.column("doc_id").slice(a, b - a), bits, n, v, lambda g, keys: (held[g].levels(keys), held[g].exact(keys)))

        scored = rows.select(*text_bytes()).mapInArrow(near, SCORED)
    else:

        def far(key, texts: pa.Table, answers: pa.Table) -> pa.Table:
            batch, answers = _texts(texts["bounds"][0].as_py(), texts["data"][0].as_py()), answers.sort_by("part")
            told = {}
            for g in (1, 2):
                own = answers.filter(pa.compute.equal(answers["gram"], g))
                counts = [unsqueezed(x) for x in own["counts"].to_pylist()] if g == 1 else []
                told[g] = np.frombuffer(b"".join(own["levels"].to_pylist()), np.uint8).astype(np.int64), np.concatenate(counts) if counts else None
            return pa.Table.from_batches([_scores(batch, texts["ids"].combine_chunks().flatten(), bits, n, v, lambda g, keys: told[g])])

        chunks = written(rows.select(*text_bytes()).mapInArrow(_chunked, "chunk bigint, ids array<bigint>, bounds binary, data binary"), "chunks")
        asked = chunks.select("chunk", "bounds", "data").mapInArrow(_questions(bits), "chunk bigint, gram int, part int, keys binary")
        held = grams.withColumn("part", F.shiftright("shard", NEAR))
        answers = asked.groupBy("gram", "part").cogroup(held.groupBy("gram", "part")).applyInArrow(_answers(bits), "chunk bigint, gram int, part int, levels binary, counts binary")
        with arrow_rows(spark, 64):  # a chunk is a row of megabytes
            scored = written(chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(far, SCORED), "scored")
    return scored.select("doc_id", "n_tokens", "n_known", F.lit(int(n)).cast("bigint").alias("train_tokens"), "base_score", "score")
