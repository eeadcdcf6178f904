"""Small models that stand where no larger one is given: emotions of words by their letters, and verbs' tenses by a tagger. Both are trained where they run.

A worker trains or loads a model once and keeps it; texts go through it in batches, as arrays.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import count, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenfold.functions.lexicons import EMOTIONS, Lexicon, lexicon

#: Words that the emotion model learns from.
SEEDS = lexicon(
    admiration="admire admired admirable impressive brilliant wonderful",
    amusement="amused amusing funny hilarious laughed joke",
    anger="angry anger furious rage outraged hate",
    annoyance="annoyed annoying irritated irritating bothered nuisance",
    approval="approve approved agree agreed acceptable fine",
    caring="care caring comfort support protect cherish",
    confusion="confused confusing puzzled unclear baffled lost",
    curiosity="curious curiosity wonder wondering interested explore",
    desire="desire want wish crave longing yearn",
    disappointment="disappointed disappointing disappointment letdown failed",
    disapproval="disapprove wrong unacceptable object refuse against",
    disgust="disgust disgusted disgusting gross revolting nasty",
    embarrassment="embarrassed embarrassing awkward ashamed humiliated",
    excitement="excited exciting excitement thrilled eager",
    fear="afraid fear fearful scared terrified frightened",
    gratitude="grateful gratitude thankful thanks thank appreciated",
    grief="grief grieving mourning mourned bereaved funeral",
    joy="joy joyful happy happiness delighted cheerful",
    love="love loved loving adore beloved affection",
    nervousness="nervous anxious anxiety worried uneasy tense",
    optimism="hope hopeful optimistic optimism confident promising",
    pride="proud pride accomplished achievement triumph",
    realization="realized realize realization understood discovered",
    relief="relief relieved reassured calm",
    remorse="sorry remorse regret regretted guilty apologized",
    sadness="sad sadness unhappy crying tears lonely",
    surprise="surprised surprise surprising unexpected astonished",
    neutral="the a and or of to in on at with from by this that it is was are were be have day time people work house went came said",
)


#: What CRC-32 makes of a byte.
CRC = np.array([zlib.crc32(bytes([b ^ 255])) ^ 0xFF000000 for b in range(256)], np.uint32)


class EmotionModel:
    """A softmax over labels for each word, from the word and its runs of 3 to 5 letters, learned from seed words; a text has the mean of its words'.

    Letters that no seed has say nothing, so unknown words are neutral, and other forms of a seed are near it.
    """

    BUCKETS, STEPS, RATE, KEEP, PIECE, BLANKS = 2048, 150, 4.0, 100_000, 5_000, 30

    def __init__(self, seeds: Lexicon = SEEDS, labels: Sequence[str] = EMOTIONS):
        self.labels = tuple(labels)
        words = [(w, self.labels.index(name)) for name, own in seeds.items() for w in own]
        x = np.stack([*(self._features(w) for w, _ in words), *np.zeros((self.BLANKS, self.BUCKETS))])
        y = np.eye(len(self.labels))[[*(i for _, i in words), *[self.labels.index("neutral")] * self.BLANKS]]
        # the weights are sums of the words' features, so each step only needs the words' likeness to one another
        alike, parts, self.bias = x @ x.T, np.zeros_like(y), np.zeros(len(self.labels))
        for _ in range(self.STEPS):
            off = self.RATE / len(self.labels) * (self._softmax(alike @ parts + self.bias) - y)
            parts -= off
            self.bias -= off.mean(0)
        self.weights = x.T @ parts
        self.known, self.rows = self._none(), np.zeros((self.KEEP, len(self.labels)))  # the rows of words seen lately, and the scores there

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        z = np.exp(z - z.max(-1, keepdims=True))
        return z / z.sum(-1, keepdims=True)

    def _features(self, word: str) -> np.ndarray:
        out, marked = np.zeros(self.BUCKETS), f"<{word}>"
        for part in {marked, *(marked[i : i + n] for n in (3, 4, 5) for i in range(len(marked) - n + 1))}:
            out[zlib.crc32(part.encode()) % self.BUCKETS] += 1
        return out / np.linalg.norm(out)

    def words(self, words: Sequence[str]) -> np.ndarray:
        """A row of label scores for each of these words, as ``_features`` has them. A word is in a few buckets only, so only those are added up."""
        marked = [f"<{w}>".encode() for w in words]
        size = np.array([len(m) for m in marked])
        text, row = np.frombuffer(b"".join(marked), np.uint8), np.repeat(np.arange(len(marked)), size)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(text))  # letters from here to the word's end
        # all runs of n letters at once: the run itself, to count each once in a word, and its CRC-32
        run, crc, found = np.zeros(len(text), np.int64), np.full(len(text), 0xFFFFFFFF, np.uint32), []
        for n in range(1, 6):
            end = len(text) - n + 1
            run, crc = run[:end] << 8 | text[n - 1 :], CRC[(crc[:end] ^ text[n - 1 :]) & 255] ^ crc[:end] >> 8
            if n > 2:
                at = np.flatnonzero(left[:end] >= n)
                _, first = np.unique(row[at] << 40 | run[at], return_index=True)
                at = at[first]
                found.append(row[at] * self.BUCKETS + ~crc[at] % self.BUCKETS)
        long = np.flatnonzero(size > 5)  # shorter ones are runs themselves
        found.append(long * self.BUCKETS + np.array([zlib.crc32(marked[i]) % self.BUCKETS for i in long], np.int64))
        spots, n = np.unique(np.concatenate(found), return_counts=True)
        row, bucket = spots // self.BUCKETS, spots % self.BUCKETS
        own = n / np.sqrt(np.bincount(row, n * n))[row]
        return self._softmax(np.add.reduceat(self.weights[bucket] * own[:, None], np.flatnonzero(np.diff(row, prepend=-1))) + self.bias)

    def word(self, word: str) -> np.ndarray:
        return self.words([word])[0]

    @staticmethod
    def _none() -> dict[str, int]:
        """No words yet; one that is asked for gets the next number."""
        return defaultdict(count().__next__)

    def _sums(self, texts: list[tuple[int, list[str]]], out: np.ndarray) -> None:
        """Add the scores of each text's words to its row of ``out``."""
        every = [w for _, own in texts for w in own]
        had = len(self.known)
        at = np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))
        if len(self.known) > self.KEEP:
            self.known, had = self._none(), 0
            at = np.fromiter(map(self.known.__getitem__, every), np.int64, len(every))
        if new := list(islice(reversed(self.known), len(self.known) - had)):
            self.rows[had : len(self.known)] = self.words(new[::-1])
        size = np.cumsum([len(own) for _, own in texts])
        out[[i for i, _ in texts]] += np.add.reduceat(self.rows[at], [0, *size[:-1]])

    def scores(self, texts: Sequence[str | None]) -> np.ndarray:
        """A row of label scores, which add up to 1, for each text; one without words is neutral.

        The words of a few texts are held at a time, about ``PIECE``; a text with more goes in pieces of its own.
        """
        out, size, held, n = np.zeros((len(texts), len(self.labels))), np.zeros(len(texts), np.int64), [], 0
        for i, text in enumerate(texts):
            words = re.findall("[a-z']+", (text or "").lower())
            size[i] = len(words)
            if not words:
                out[i, self.labels.index("neutral")] = size[i] = 1
            elif len(words) > self.PIECE:
                for low in range(0, len(words), self.PIECE):
                    self._sums([(i, words[low : low + self.PIECE])], out)
            else:
                if n + len(words) > self.PIECE:
                    self._sums(held, out)
                    held, n = [], 0
                held.append((i, words))
                n += len(words)
        if held:
            self._sums(held, out)
        return out / size[:, None]


@lru_cache(1)
def emotion_model() -> EmotionModel:
    return EmotionModel()


@F.arrow_udf(T.MapType(T.StringType(), T.DoubleType()))
def emotions(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Label scores of each text, by the model that a worker trains once."""
    model = emotion_model()
    labels = pa.array(model.labels)
    for texts in batches:
        scores = model.scores(texts.to_pylist())
        n, k = scores.shape
        yield pa.MapArray.from_arrays(np.arange(n + 1, dtype=np.int32) * k, labels.take(np.tile(np.arange(k), n)), scores.ravel())


#: Sentences with a tag for each word: P past, S present and F future verbs, B other verbs, N nouns, D what goes before them, A other words.
TAGGED = """
i/N walked/P to/A the/D sea/N and/A it/N was/P cold/A
we/N were/P tired/A after/A the/D long/D day/N
she/N said/P that/A he/N had/P gone/B home/N
they/N went/P out/A and/A came/P back/A late/A
he/N wrote/P a/D letter/N and/A sent/P it/N
i/N thought/P about/A my/D work/N and/A felt/P calm/A
the/D rain/N stopped/P when/A we/N arrived/P
you/N did/P not/A see/B the/D red/D house/N
my/D friend/N called/P me/N and/A we/N talked/P for/A hours/N
i/N am/S happy/A and/A the/D garden/N is/S green/A
we/N are/S here/A now/A and/A they/N know/S it/N
she/N walks/S to/A work/N and/A sings/S
he/N has/S a/D new/D book/N that/A he/N likes/S
i/N think/S that/A you/N need/S rest/N
they/N want/S to/A sleep/B and/A we/N do/S too/A
it/N makes/S me/N sad/A when/A the/D days/N are/S short/A
you/N say/S little/A but/A you/N mean/S much/A
the/D child/N plays/S and/A laughs/S
i/N can/S see/B the/D hills/N from/A my/D window/N
i/N will/F go/B home/N tomorrow/A
we/N shall/F meet/B in/A the/D spring/N
she/N will/F not/A forget/B the/D long/D road/N
they/N will/F have/B time/N and/A i/N will/F write/B
i/N am/S going/F to/A rest/B and/A read/B
he/N is/S gonna/F call/B me/N
it/N will/F be/B a/D good/D year/N
we/N are/S going/F to/A build/B a/D house/N
to/A learn/B is/S to/A change/B
reading/N and/A walking/N help/S me/N
i/N stayed/P in/A bed/N all/D morning/N
yesterday/A we/N cooked/P and/A ate/P together/A
he/N looked/P tired/A but/A he/N smiled/P
i/N used/P to/A run/B every/D day/N
she/N took/P the/D early/D train/N and/A got/P there/A first/A
nothing/N happened/P and/A nobody/N cared/P
i/N feel/S better/A because/A i/N slept/P well/A
the/D old/D man/N tells/S stories/N and/A we/N listen/S
they/N made/P plans/N that/A will/F change/B
"""
TENSE_OF = {"P": "past", "S": "present", "F": "future"}


class TenseTagger:
    """Viterbi's best tags under a first-order model, whose tables are counted in tagged sentences. Unknown words go by their last letters.

    Sentences are tagged together, position by position; one of more than ``MOST`` words is tagged in pieces.
    """

    MOST, SMOOTH = 200, 0.1

    def __init__(self, tagged: str = TAGGED):
        sentences = [[tuple(x.rsplit("/", 1)) for x in line.split()] for line in tagged.split("\n") if line.strip()]
        self.tags = sorted({t for s in sentences for _, t in s})
        at, k = {t: i for i, t in enumerate(self.tags)}, len(self.tags)
        start, step, self.totals = np.full(k, self.SMOOTH), np.full((k, k), self.SMOOTH), np.zeros(k)
        self.endings: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(k))
        for s in sentences:
            start[at[s[0][1]]] += 1
            for (_, a), (_, b) in zip(s, s[1:]):
                step[at[a], at[b]] += 1
            for word, t in s:
                self.totals[at[t]] += 1
                for n in (0, 1, 2, 3):  # 0: the word itself
                    self.endings[self._ending(word, n)][at[t]] += 1
        self.endings = dict(self.endings)
        self.start, self.step = np.log(start / start.sum()), np.log(step / step.sum(1, keepdims=True))

    @staticmethod
    def _ending(word: str, n: int) -> str:
        return f"-{word[-n:]}" if n else word

    def emission(self, word: str) -> np.ndarray:
        """log of p(tag | word or its longest known ending) / p(tag), which is log p(word | tag) but for a constant."""
        prior = self.totals / self.totals.sum()
        for n in (0, 3, 2, 1):
            counts = self.endings.get(self._ending(word, n))
            if counts is not None and (n == 0 or len(word) > n):
                return np.log((counts + self.SMOOTH * prior) / (counts.sum() + self.SMOOTH) / prior)
        return np.zeros(len(self.tags))

    def sentences(self, text: str | None) -> list[list[str]]:
        out = []
        for part in re.split(r"[.!?\n]+", (text or "").lower()):
            words = re.findall("[a-z']+", part)
            out += [words[i : i + self.MOST] for i in range(0, len(words), self.MOST)]
        return out

    def best(self, sentences: list[list[str]]) -> list[list[str]]:
        """The tags of each sentence; long and short ones go in groups of like length."""
        out: list[list[str]] = [[] for _ in sentences]
        order = sorted((i for i, s in enumerate(sentences) if s), key=lambda i: len(sentences[i]))
        memo: dict[str, np.ndarray] = {}
        for low in range(0, len(order), 512):
            some = order[low : low + 512]
            size = np.array([len(sentences[i]) for i in some])
            emit = np.zeros((len(some), size[-1], len(self.tags)))
            for row, i in enumerate(some):
                for j, w in enumerate(sentences[i]):
                    if w not in memo:
                        memo[w] = self.emission(w)
                    emit[row, j] = memo[w]
            score, back = self.start + emit[:, 0], np.zeros((len(some), size[-1], len(self.tags)), np.int8)
            for j in range(1, size[-1]):
                ways = score[:, :, None] + self.step
                back[:, j] = ways.argmax(1)
                score = np.where((j < size)[:, None], ways.max(1) + emit[:, j], score)
            for row, i in enumerate(some):
                tag, tags = int(score[row].argmax()), []
                for j in range(size[row] - 1, -1, -1):
                    tags.append(self.tags[tag])
                    tag = int(back[row, j, tag])
                out[i] = tags[::-1]
        return out

    def tenses(self, texts: Sequence[str | None]) -> list[list[str]]:
        """Past, present or future for each verb that shows it, in order."""
        cut = [self.sentences(t) for t in texts]
        tags = iter(self.best([s for own in cut for s in own]))
        return [[TENSE_OF[t] for _ in own for t in next(tags) if t in TENSE_OF] for own in cut]


@lru_cache(1)
def tense_tagger() -> TenseTagger:
    return TenseTagger()


@F.pandas_udf(T.ArrayType(T.StringType()))
def tenses(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The tenses of each text's verbs, by the tagger that a worker trains once."""
    tagger = tense_tagger()
    for texts in batches:
        yield pd.Series(tagger.tenses(texts.tolist()), index=texts.index)
