"""Toxicity by bags of subwords: embeddings of character n-grams, averaged into a linear softmax, trained together.

N-grams of 3 to 5 bytes lie within a word and its edges, so a misspelling that training never saw shares most of
its vectors with the word. After training, an n-gram counts only through its embedding's part in the
difference of the two logits, so workers hold one number for each bucket, and a text's score is the mean of its n-grams'.

The classifier is fitted on at most ``sample`` labelled texts of each class, weighted to the counts of
the classes among all training labels, in one task: its input is bounded by the sample, and a lost executor only repeats it. Every text is
scored whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.shared import _LOWER, _SPACE, Spans, mix, slices, text_bytes, words

BITS = 17
GRAMS = (3, 4, 5)
DIM = 8
#: A mean over hundreds of n-grams is small; this brings the logits to the size that training expects.
SCALE = 64.0
#: So many n-grams without any leaning count beside a text's own, lest a few decide a short text.
NEUTRAL = 150
#: Weight of the squared embeddings in the loss.
DECAY = 3e-5
#: N-grams of less leaning to a class are not learned from.
LEAN = 2.5

_PLAIN = _LOWER.copy()
_PLAIN[_SPACE] = 32


def grams(data: np.ndarray, bounds: np.ndarray):
    """For each n: the bucket of every n-gram within one text and one word (edges included), and its text's number.

    A word that a text repeats counts once, so that repetition outweighs nothing.
    """
    starts, ends, before = words(data, bounds)
    low = _PLAIN[data]
    blank = np.concatenate(([0], np.cumsum(low == 32)))
    of_word = np.repeat(np.arange(len(before) - 1), np.diff(before))
    _, once = np.unique(mix(Spans(low).of(starts, ends) + mix(of_word.astype(np.uint64))), return_index=True)
    edge = np.zeros(len(low) + 1, np.int8)
    edge[starts[once]] += 1
    edge[ends[once]] -= 1
    chosen = np.cumsum(edge[:-1], dtype=np.int8) > 0
    text = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    for n in GRAMS:
        if len(low) < n:
            continue
        m = len(low) - n + 1
        inside = blank[n - 1 : n - 1 + m] == blank[1 : 1 + m]
        at = np.flatnonzero(inside & chosen[1 : 1 + m] & (text[:m] == text[n - 1 :]))
        gram = np.full(len(at), n, np.uint64)
        for i in range(n):
            gram = gram << np.uint64(8) | low[at + i].astype(np.uint64)
        yield (mix(gram) >> np.uint64(64 - BITS)).astype(np.int64), text[at].astype(np.int64)


def _bags(batches):
    for batch in batches:
        keys, shares = [], []
        for _, _, data, bounds in slices(batch, "text"):
            found = list(grams(data, bounds))
            key, count = np.unique(np.concatenate([row << BITS | b for b, row in found] or [np.zeros(0, np.int64)]), return_counts=True)
            cut = np.searchsorted(key >> BITS, np.arange(len(bounds)))
            for a, b in zip(cut[:-1], cut[1:]):
                keys.append((key[a:b] & ((1 << BITS) - 1)).astype(np.int32))
                shares.append((count[a:b] / (NEUTRAL + count[a:b].sum())).astype(np.float32))
        yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array(keys, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], ["toxic", "buckets", "shares"])


def fit(y: np.ndarray, cut: np.ndarray, keys: np.ndarray, shares: np.ndarray, totals: dict[int, int], lean: float = LEAN, steps: int = 600, epochs: int = 8, batch: int = 64, rate: float = 0.15, seed: int = 7) -> tuple[np.ndarray, float]:
    """A number for each bucket, and the bias: log-odds of label 1 = bias + their mean over a text's n-grams.

    Text i has the label y[i], and in keys[cut[i] : cut[i + 1]] its buckets with their shares. Adagrad on the weighted
    cross-entropy, at least ``epochs`` times through the texts and ``steps`` steps. N-grams that texts of both classes have about equally often, by ``leaning`` below
    ``lean``, have no embedding: with few labels they would only tell the texts apart. The others are numbered anew, so that a step's work goes with them.
    """
    rng = np.random.default_rng(seed)
    emb = (rng.random((1 << BITS, DIM), np.float32) - 0.5) / DIM
    out = np.zeros((DIM, 2), np.float32)
    bias = base_rate(totals)
    have = np.bincount(y, minlength=2)
    if have.min() == 0:
        return np.zeros(1 << BITS), float(bias[1] - bias[0])
    chosen = np.flatnonzero(leaning(y, cut, keys) >= lean)
    emb, place = emb[chosen], np.full(1 << BITS, -1)
    place[chosen] = np.arange(len(chosen))
    on = place[keys] >= 0
    cut = np.concatenate(([0], np.cumsum(on)))[cut]
    keys, shares = place[keys[on]], shares[on]
    weight = np.array([totals[c] / have[c] for c in (0, 1)])[y]
    weight = (weight / weight.mean()).astype(np.float32)
    sq_emb, sq_out = np.full_like(emb, 1e-6), np.full_like(out, 1e-6)
    for _ in range(max(epochs, -(-steps * batch // len(y)))):
        for some in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            sizes = cut[some + 1] - cut[some]
            at = np.concatenate([np.arange(cut[i], cut[i + 1]) for i in some])
            key, share = keys[at], shares[at] * np.float32(SCALE)
            row = np.repeat(np.arange(len(some)), sizes)
            hidden = np.stack([np.bincount(row, share * emb[key, d], len(some)) for d in range(DIM)], 1).astype(np.float32)
            logit = hidden @ out + bias
            p = np.exp(logit - logit.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(some)), y[some]] -= 1
            p *= weight[some, None] / len(some)
            g_out, g_hidden = hidden.T @ p, p @ out.T
            g = np.stack([np.bincount(key, share * g_hidden[row, d], len(emb)) for d in range(DIM)], 1).astype(np.float32)
            g += np.float32(DECAY) * emb
            sq_emb += g * g
            emb -= rate * g / np.sqrt(sq_emb)
            sq_out += g_out * g_out
            out -= rate * g_out / np.sqrt(sq_out)
            bias -= np.float32(0.02) * p.sum(0)
    values = np.zeros(1 << BITS)
    values[chosen] = SCALE * (emb @ (out[:, 1] - out[:, 0]))
    return values, float(bias[1] - bias[0])


def leaning(y: np.ndarray, cut: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Of each bucket how surely one class has it more often: the root of the likelihood ratio statistic of its texts in both."""
    of = np.repeat(y, np.diff(cut))
    n = np.bincount(y, minlength=2)
    have = [np.bincount(keys[of == c], minlength=1 << BITS) for c in (0, 1)]

    def likelihood(x, total, share):
        share = np.clip(share, 1e-12, 1 - 1e-12)
        return x * np.log(share) + (total - x) * np.log1p(-share)

    both = (have[0] + have[1]) / len(y)
    ratio = sum(likelihood(have[c], n[c], have[c] / n[c]) - likelihood(have[c], n[c], both) for c in (0, 1))
    return np.where(have[0] + have[1] > 0, np.sqrt(2 * np.maximum(ratio, 0)), -1)


def base_rate(totals: dict[int, int]) -> np.ndarray:
    """Logits of the two classes, by their counts."""
    return np.log(np.array([totals.get(0, 0) + 1.0, totals.get(1, 0) + 1.0]) / (sum(totals.values()) + 2.0)).astype(np.float32)


def _fitted(totals: dict[int, int], lean: float, steps: int):
    def run(batches):
        y, keys, shares = [], [], []
        for batch in batches:
            y += batch.column("toxic").to_pylist()
            keys += [np.array(x.values) for x in batch.column("buckets")]
            shares += [np.array(x.values) for x in batch.column("shares")]
        if y:
            # the order in which rows arrive is no input of the fit
            order = sorted(range(len(y)), key=lambda i: (y[i], len(keys[i]), xxhash.xxh3_128_digest(keys[i]), xxhash.xxh3_128_digest(shares[i])))
            cut = np.concatenate(([0], np.cumsum([len(keys[i]) for i in order])))
            values, bias = fit(np.array(y)[order], cut, np.concatenate([keys[i] for i in order]), np.concatenate([shares[i] for i in order]), totals, lean, steps)
            yield pa.RecordBatch.from_arrays([pa.array([values.tobytes()]), pa.array([bias])], ["vals", "bias"])

    return run


def learned(docs: DataFrame, labels: DataFrame, learn=None, sample: int = 2500, lean: float = LEAN, steps: int = 600):
    """A function of an Arrow array of texts (UTF-8 bytes) that gives their scores; workers read one number for each bucket."""
    spark = docs.sparkSession
    known = labels.where("toxic in (0, 1) and doc_id is not null")
    known = (known.where(learn) if learn is not None else known).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    totals = {r.toxic: r.n for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    taught = F.broadcast(known.where("toxic = 0").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).union(known.where("toxic = 1").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)))
    one = docs.select("doc_id", "text").join(taught, "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    bags = one.select(*text_bytes(), "toxic").mapInArrow(_bags, "toxic int, buckets array<int>, shares array<float>")
    fitted = bags.repartition(1).mapInArrow(_fitted(totals, lean, steps), "vals binary, bias double").first()
    values = np.frombuffer(fitted.vals) if fitted else np.zeros(1 << BITS)
    bias = fitted.bias if fitted else float(np.diff(base_rate(totals))[0])
    model = spark.sparkContext.broadcast(values)

    def scores(texts: pa.Array) -> np.ndarray:
        table, parts = model.value, [np.zeros(0)]
        for a, b, data, bounds in slices(pa.RecordBatch.from_arrays([texts], ["text"]), "text"):
            total, n = np.zeros(b - a), np.zeros(b - a)
            for bucket, row in grams(data, bounds):
                total += np.bincount(row, table[bucket], b - a)
                n += np.bincount(row, minlength=b - a)
            parts.append(1 / (1 + np.exp(-np.clip(bias + total / (NEUTRAL + n), -500, 500))))
        return np.concatenate(parts)

    return scores


def score(docs: DataFrame, labels: DataFrame, learn=None, sample: int = 2500, lean: float = LEAN, steps: int = 600) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, score from 0 to 1 (higher: label 1 likelier).

    ``labels`` (doc_id, toxic) teach where ``learn``, a condition on doc_id, holds (default: all). Null labels
    teach nothing; of several labels of one id the largest counts, of several texts the least one. Null and empty texts, and those without any n-gram, get the
    base rate. Without labels of both classes every score is the base rate. ``sample`` bounds the labelled texts of each class that are fitted,
    ``lean`` and ``steps`` are those of ``fit``. Labels, languages and sources are no inputs of a
    score. Other columns are ignored; repeated rows and null ids keep their rows; an empty table gives no rows.
    """
    scores = learned(docs, labels, learn, sample, lean, steps)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores(batch.column("text")))], ["doc_id", "score"])

    return docs.select(*text_bytes()).mapInArrow(run, "doc_id bigint, score double")


def without_toxic(docs: DataFrame, labels: DataFrame, least: float = 0.3, **fitting) -> DataFrame:
    """The rows of ``docs`` with a score below ``least``, with all their columns, whatever their names.

    Each row is judged by its own text: null ids, repeated rows and other texts under the same id do not touch one another. Null
    and empty texts have the base rate of label 1 as score, and stay unless that reaches ``least``. An empty table gives no rows.
    """
    scores = learned(docs, labels, **fitting)

    def run(batches):
        for batch in batches:
            texts = batch.column("text").fill_null("").cast(pa.binary())
            yield batch.filter(pa.array(scores(texts) < least))

    return docs.mapInArrow(run, docs.schema)
