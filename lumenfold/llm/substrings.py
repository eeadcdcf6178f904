"""Substring dedup by content-defined chunking with a gear rolling hash.

The gear hash rolls over words: h = (h << 8) + gear(word) modulo 2**32, so it remembers ``CONTEXT`` words. Of any ``w`` positions in a row the
one with the least value is a cut, the last of equal ones; what lies between two cuts is a chunk, of 1 to w words, told by them and by the words that
the first cut comes from, as a few words alone are met everywhere. Cuts inside
a passage are the same wherever it stands, and of 2 * w positions in a row two windows without a common position have two cuts, so a whole
chunk lies in any words + 1 words: w is (words - 2) // 2.

Chunks are deduplicated by digest. A passage's chunks are all met elsewhere too, so only texts with runs of words + 1
words for which that holds go on. Of each such chunk the earliest text is found; a run's partner is the latest of its chunks' earliest
texts, as no earlier one can have all of them. Partners are compared, and every passage that they share is returned to its last byte. A run
that no comparison explains, though each of its chunks has an earlier text, is looked for by itself, and meets the earliest text that
has the whole run, whichever texts have its parts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.shared import Spans, arrow_rows, drop, identity, mix, slices, text_bytes, words as words_of, tidy, written

CONTEXT = 4
PLACE = "struct<last boolean, doc_id bigint, k bigint, k2 bigint>"


def gear(h: np.ndarray) -> np.ndarray:
    """The rolling hash at each word, of the word and the CONTEXT - 1 before it."""
    own = (mix(h) >> np.uint64(32)).astype(np.uint32)
    out = own.copy()
    for i in range(1, CONTEXT):
        out[i:] += own[:-i] << np.uint32(8 * i)
    return out


def window(words: int) -> int:
    if words < 8:
        raise ValueError("passages of at least 8 words only")
    return (words + 2 - CONTEXT) // 2


def _picks(h: np.ndarray, w: int) -> np.ndarray:
    """For each ``w`` positions in a row, by their first: the last of those with the least gear value."""
    if len(h) < w:
        return np.zeros(0, np.int64)
    least = gear(h).astype(np.int64) << 31 | np.arange(len(h) - 1, -1, -1)
    have = 1
    while have < w:
        step = min(have, w - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return len(h) - 1 - (least & 0x7FFFFFFF)


class Text:
    """One text's words and chunks. Chunk i, from 1, is the words after cuts[i - 1] up to cuts[i], and its digest also of the CONTEXT words before; run i is the words from i on."""

    def __init__(self, raw: bytes, words: int):
        self.raw, self.words, self.w = raw, words, window(words)
        self.data = np.frombuffer(raw, np.uint8)
        self.starts, self.ends, _ = words_of(self.data, np.array([0, len(raw)]))
        self.spans = Spans(self.data)
        self.n = max(0, len(self.starts) - words)  # runs of words + 1 words
        pick = _picks(self.spans.of(self.starts, self.ends), self.w)
        self.cuts = np.unique(pick[CONTEXT - 1 :])
        self.digests = np.concatenate([[0], self.spans.of(self.starts[self.cuts[:-1] - CONTEXT + 1], self.ends[self.cuts[1:]]).view(np.int64)]) if len(self.cuts) else np.zeros(0, np.int64)
        # the first and the last cut inside each run
        self.first = np.searchsorted(self.cuts, pick[CONTEXT - 1 : CONTEXT - 1 + self.n])
        self.last = np.searchsorted(self.cuts, pick[self.words + 1 - self.w :][: self.n])

    def within(self, known: np.ndarray) -> np.ndarray:
        """Which runs have only chunks of ``known``."""
        upto = np.cumsum(~np.isin(self.digests, known))
        return upto[self.last] == upto[self.first] if self.n else np.zeros(0, bool)

    def chunks(self, runs: np.ndarray) -> np.ndarray:
        """The distinct digests of the chunks in some runs."""
        edge = np.zeros(len(self.cuts) + 2, np.int64)
        np.add.at(edge, self.first[runs] + 1, 1)
        np.add.at(edge, self.last[runs] + 1, -1)
        return np.unique(self.digests[np.cumsum(edge)[: len(self.cuts)] > 0])

    def latest(self, known: np.ndarray, ranks: np.ndarray) -> np.ndarray:
        """Of each run the largest rank of its chunks; ``ranks`` go with ``known``, which is in order."""
        if not (self.n and len(known)):
            return np.zeros(self.n, np.int64)
        at = np.minimum(np.searchsorted(known, self.digests), len(known) - 1)
        rank = np.append(np.where(known[at] == self.digests, ranks[at], -1), -1)
        return np.maximum.reduceat(rank, np.stack([self.first + 1, self.last + 1], 1).ravel())[::2]


def _chunks(words: int):
    """Each text, compressed, the digests of its chunks in order, and the ranges of chunks that its runs have."""
    w = window(words)

    def run(batches):
        for batch in batches:
            digests, ranges, small = [], [], []
            for _, _, data, bounds in slices(batch, "text"):
                starts, ends, before = words_of(data, bounds)
                spans = Spans(data)
                pick = _picks(spans.of(starts, ends), w)
                edge = np.zeros(len(starts) + 1, np.int64)
                low, high = before[:-1] + CONTEXT - 1, before[1:] - w + 1
                on = high > low
                np.add.at(edge, low[on], 1)
                np.add.at(edge, high[on], -1)
                cut = np.unique(pick[np.cumsum(edge)[: len(pick)] > 0])
                of = np.searchsorted(before, cut, "right") - 1
                same = np.flatnonzero(of[1:] == of[:-1])
                h = spans.of(starts[cut[same] - CONTEXT + 1], ends[cut[same + 1]]).view(np.int64)
                at = np.searchsorted(of[same], np.arange(len(bounds)))
                digests += [h[a:b] for a, b in zip(at[:-1], at[1:])]
                # runs lie within one text; of neighbours with one range the first
                begin = np.flatnonzero(np.arange(len(starts)) + words < before[1:][np.searchsorted(before, np.arange(len(starts)), "right") - 1])
                text = np.searchsorted(before, begin, "right") - 1
                first, last = (np.searchsorted(cut, pick[begin + d]) for d in (CONTEXT - 1, words + 1 - w))
                new = np.flatnonzero(np.concatenate(([True], (first[1:] != first[:-1]) | (last[1:] != last[:-1])))) if len(begin) else begin
                text, base = text[new], np.searchsorted(of, text[new])
                pairs = np.stack([first[new] - base, last[new] - base], 1).astype(np.int32)
                at = np.searchsorted(text, np.arange(len(bounds)))
                ranges += [pairs[a:b].ravel() for a, b in zip(at[:-1], at[1:])]
                small += [pa.compress(data[a:b].tobytes(), "zstd", asbytes=True) for a, b in zip(bounds[:-1], bounds[1:])]
            more = pa.array(small, pa.binary()), pa.array(digests, pa.list_(pa.int64())), pa.array(ranges, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*map(batch.column, _NAMES), *more], [*_NAMES, "small", "digests", "ranges"])

    return run


_NAMES = ["doc_id", "k", "k2", "size"]


def _texts(batch: pa.RecordBatch, words: int):
    for size, small in zip(batch.column("size").to_pylist(), batch.column("small").to_pylist()):
        yield Text(pa.decompress(small, size, "zstd", asbytes=True), words)


def _candidates(batches):
    """Of the runs whose chunks are all met elsewhere, the ranges, and the distinct chunks."""
    for batch in batches:
        found, ranges = [], []
        for digests, own, met in zip(batch.column("digests"), batch.column("ranges"), batch.column("met")):
            digests, own = np.array(digests.values), np.array(own.values, np.int64).reshape(-1, 2)
            upto = np.concatenate(([0], np.cumsum(~np.isin(digests, np.array(met.values)))))
            own = own[upto[own[:, 1]] == upto[own[:, 0]]]
            edge = np.zeros(len(digests) + 1, np.int64)
            np.add.at(edge, own[:, 0], 1)
            np.add.at(edge, own[:, 1], -1)
            found.append(np.unique(digests[np.cumsum(edge)[:-1] > 0]))
            ranges.append(own.ravel().astype(np.int32))
        names = ["doc_id", "k", "k2", "digests"]
        yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(ranges, pa.list_(pa.int32())), pa.array(found, pa.list_(pa.int64()))], [*names, "ranges", "found"])


def _partners(batches):
    """Of each text its runs' partners with their ranks, and the chunks that have an earlier text, with its rank.

    ``fd``, ``fk``, ``fk2``, ``fid``: of each chunk the digest, and the earliest text's hashes and id, in the order of these texts.
    """
    others = pa.struct([("rank", pa.int32()), ("k", pa.int64()), ("k2", pa.int64()), ("doc_id", pa.int64())])
    for batch in batches:
        picked, known, ranks, at_end = [], [], [], [0]
        whole = {c: batch.column(c) for c in ("fd", "fk", "fk2", "fid", "digests", "ranges")}
        for i, (k, k2) in enumerate(zip(batch.column("k").to_pylist(), batch.column("k2").to_pylist())):
            fd, fk, fk2, digests, own = (np.array(whole[c][i].values) for c in ("fd", "fk", "fk2", "digests", "ranges"))
            rank = np.concatenate(([0], np.cumsum((fk[1:] != fk[:-1]) | (fk2[1:] != fk2[:-1]))))
            mine = rank[(fk == k) & (fk2 == k2)]
            mine = mine[0] if len(mine) else len(fd)
            order = np.argsort(fd)
            at = np.minimum(np.searchsorted(fd[order], digests), len(fd) - 1)
            of = np.append(np.where(fd[order][at] == digests, rank[order][at], -1), -1)
            top = np.unique(np.maximum.reduceat(of, own)[::2])
            top = top[top < mine]
            first = np.searchsorted(rank, top)  # ranks are in order
            picked.append(pa.StructArray.from_arrays([pa.array(top.astype(np.int32)), pa.array(fk[first]), pa.array(fk2[first]), whole["fid"][i].values.take(pa.array(first))], fields=list(others)))
            at_end.append(at_end[-1] + len(top))
            early = order[rank[order] < mine]
            known.append(fd[early])
            ranks.append(rank[early].astype(np.int32))
        lists = pa.ListArray.from_arrays(pa.array(at_end, pa.int32()), pa.concat_arrays(picked) if picked else pa.array([], others))
        yield pa.RecordBatch.from_arrays([*map(batch.column, ("doc_id", "k", "k2")), pa.array(known, pa.list_(pa.int64())), pa.array(ranks, pa.list_(pa.int32())), lists], ["doc_id", "k", "k2", "known", "ranks", "others"])


def _grams(words: int):
    """Hashes of the runs of words + 1 words whose chunks are all asked for."""

    def run(batches):
        for batch in batches:
            out = []
            for text, asked in zip(_texts(batch, words), batch.column("met")):
                on = np.flatnonzero(text.within(np.array(asked.values)))
                out.append(np.unique(text.spans.of(text.starts[on], text.ends[on + words])).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "k", "k2")), pa.array(out, pa.list_(pa.int64()))], ["doc_id", "k", "k2", "grams"])

    return run


def _common(a: np.ndarray, b: np.ndarray) -> int:
    n = min(len(a), len(b))
    differ = np.flatnonzero(a[:n] != b[:n])
    return int(differ[0]) if len(differ) else n


def _passage(own: Text, run: int, other: bytes):
    """(start, end, words), in bytes, of the longest passage of ``own`` around a run that ``other`` has, where it has the run first; None where it has not."""
    raw, at, stop = own.raw, int(own.starts[run]), int(own.ends[run + own.words])
    there = other.find(raw[at:stop])
    if there < 0:
        return None
    theirs = np.frombuffer(other, np.uint8)
    first = at - _common(own.data[:at][::-1], theirs[:there][::-1])
    end = stop + _common(own.data[stop:], theirs[there + stop - at :])
    # only whole words: a word that goes on beyond the match is not repeated
    if first and first < at and not raw[first - 1 : first].isspace():
        first = int(own.starts[np.searchsorted(own.starts, first)])
    if end < len(raw) and end > stop and not raw[end : end + 1].isspace():
        end = int(own.ends[np.searchsorted(own.ends, end, "right") - 1])
    return first, end, len(raw[first:end].split())


FOUND = "doc_id bigint, passages array<struct<start bigint, stop bigint, n_words bigint, first_doc_id bigint>>, asks array<bigint>"


def _compare(words: int, every: bool):
    """Rows come by text: which of its chunks have an earlier text, the text itself, its partners one after another, with their ranks.

    A run of known chunks is looked for in its partner, or in ``every`` text. Returns the passages, and the chunks of the runs that none explains though each of their chunks has
    an earlier text.
    """
    kinds = pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("n_words", pa.int64()), ("first_doc_id", pa.int64())])), pa.list_(pa.int64())

    def done(own: Text, left: np.ndarray, found: list):
        points = np.concatenate(([0], np.cumsum(own.data & 0xC0 != 0x80))) if found else None
        asks = own.chunks(np.flatnonzero(left)) if left.any() and not every else []
        return [{"start": int(points[a]), "stop": int(points[b]), "n_words": n, "first_doc_id": d} for a, b, n, d in found], asks

    def rows(batches):
        for batch in batches:
            lists = [batch.column(c) for c in ("known", "ranks")]
            for i, row in enumerate(zip(*(batch.column(c).to_pylist() for c in ("doc_id", "k", "k2", "kind", "rank", "size", "small", "first_doc_id")))):
                yield *row, *((np.array(x[i].values) for x in lists) if row[3] == 0 else (None, None))

    def run(batches):
        out, key, own = [], None, None
        for doc_id, k, k2, kind, rank, size, small, first_doc_id, known_, ranks_ in rows(batches):
            if kind == 0:
                if own is not None:
                    out.append((key[0], *done(own, left, found)))
                    if len(out) == 200:
                        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["doc_id", "passages", "asks"])
                        out = []
                key, own, known, ranks, found = (doc_id, k, k2), None, known_, ranks_, []
            elif key == (doc_id, k, k2) and kind == 1:
                own = Text(pa.decompress(small, size, "zstd", asbytes=True), words)
                left = own.within(known)
                latest = None if every else own.latest(known, ranks)
            elif key == (doc_id, k, k2):
                todo = left if every else left & (latest == rank)
                other = pa.decompress(small, size, "zstd", asbytes=True) if todo.any() else b""
                for i in np.flatnonzero(todo):
                    if left[i] and (passage := _passage(own, i, other)):
                        found.append((*passage, first_doc_id))
                        left &= (own.starts[: own.n] < passage[0]) | (own.ends[words:] > passage[1])
        if own is not None:
            out.append((key[0], *done(own, left, found)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), kinds)], ["doc_id", "passages", "asks"])

    return run


def _place():
    return F.struct(F.isnull("doc_id").alias("last"), "doc_id", "k", "k2").alias("place")


LINKED = "doc_id bigint, k bigint, k2 bigint, known array<bigint>, ranks array<int>, others array<struct<rank int, k bigint, k2 bigint, doc_id bigint>>"


def _compared(linked: DataFrame, held: DataFrame, words: int, every: bool = False) -> DataFrame:
    """``linked``: doc_id, k, k2, known (digests) and their ranks, others (rank, hashes and id). Each text is held against one other at a time."""
    nothing = lambda t: F.lit(None).cast(t)
    order = ["doc_id", "k", "k2", "kind", "rank", "size", "small", "known", "ranks", "first_doc_id"]
    lists = {"known": nothing("array<bigint>"), "ranks": nothing("array<int>")}
    marks = linked.select("doc_id", "k", "k2", "known", "ranks").withColumns({"kind": F.lit(0), "rank": nothing("int"), "size": nothing("int"), "small": nothing("binary"), "first_doc_id": nothing("bigint")})
    own = held.join(linked.select("k", "k2"), ["k", "k2"], "left_semi").select("doc_id", "k", "k2", "size", "small").withColumns({"kind": F.lit(1), "rank": nothing("int"), "first_doc_id": nothing("bigint")} | lists)
    pairs = linked.select("doc_id", "k", "k2", F.explode("others").alias("o")).select("doc_id", "k", "k2", "o.rank", F.col("o.doc_id").alias("first_doc_id"), F.col("o.k").alias("ok"), F.col("o.k2").alias("ok2"))
    theirs = held.select(F.col("k").alias("ok"), F.col("k2").alias("ok2"), "size", "small")
    others = pairs.join(theirs, ["ok", "ok2"]).select("doc_id", "k", "k2", "rank", "size", "small", "first_doc_id").withColumns({"kind": F.lit(2)} | lists)
    rows = marks.select(*order).union(own.select(*order)).union(others.select(*order))
    rows = rows.repartition("k", "k2").sortWithinPartitions("k", "k2", "kind", "rank")
    with arrow_rows(held.sparkSession, 200):
        return written(rows.mapInArrow(_compare(words, every), FOUND), "found")


@tidy
def repeated_passages(docs: DataFrame, words: int = 50) -> DataFrame:
    """Passages of more than ``words`` words that an earlier document has: doc_id, start, stop, n_words, first_doc_id.

    Earlier: smaller doc_id, null last, then two hashes of id and text. start and stop are code points (stop exclusive) of whole words;
    the passage is as long as the two texts agree, and first_doc_id is an earlier document with all of it, mostly the earliest with some
    words + 1 words of it. One row for each passage and earlier document that was needed to explain it; documents without any have no row. Every
    run of words + 1 words that an earlier document has, byte for byte, lies in a row.

    Null and empty texts have no passages. Repetition within one document is not looked for. Rows equal in doc_id and text
    are one document; other columns are ignored; an empty table gives no rows.
    """
    rows = docs.select("doc_id", "text", *identity("text", "doc_id"), F.octet_length("text").alias("size")).where(F.length("text") > 2 * words)
    texts = written(rows.select(*text_bytes("doc_id", "text", "k", "k2", "size")).mapInArrow(_chunks(words), "doc_id bigint, k bigint, k2 bigint, size int, small binary, digests array<bigint>, ranges array<int>"), "chunks")
    chunk = texts.select("k", F.explode(F.array_distinct("digests")).alias("digest"))
    # a text has a digest once here, so counts find the few that texts share
    shared = written(chunk.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1").select("digest"), "shared")
    met = chunk.join(shared, "digest").groupBy("k").agg(F.collect_set("digest").alias("met"))
    # equal rows are one; the join has dealt them by k already
    some = texts.select("doc_id", "k", "k2", "digests", "ranges").join(met, "k").dropDuplicates(["k", "k2"])
    kept = "doc_id bigint, k bigint, k2 bigint, digests array<bigint>, ranges array<int>, found array<bigint>"
    some = written(some.mapInArrow(_candidates, kept).where("size(ranges) > 0"), "candidates")
    held = texts.select("doc_id", "k", "k2", "size", "small").join(some.select("k", "k2"), ["k", "k2"], "left_semi").dropDuplicates(["k", "k2"])
    held = written(held, "held")
    drop(texts, shared)

    each = some.select(_place(), F.explode("found").alias("digest"))
    earliest = written(each.groupBy("digest").agg(F.min("place").alias("other")), "earliest")
    flat = F.struct(*(F.col(f"other.{c}").alias(c) for c in ("last", "doc_id", "k", "k2")), "digest")
    firsts = each.join(earliest, "digest").groupBy("place.k", "place.k2").agg(F.array_sort(F.collect_list(flat)).alias("f"))
    firsts = firsts.select("k", "k2", F.col("f.digest").alias("fd"), F.col("f.k").alias("fk"), F.col("f.k2").alias("fk2"), F.col("f.doc_id").alias("fid"))
    with arrow_rows(docs.sparkSession, 1000):
        first = written(some.select("doc_id", "k", "k2", "digests", "ranges").join(firsts, ["k", "k2"]).mapInArrow(_partners, LINKED).where("size(others) > 0"), "linked")
    found = _compared(first, held, words)
    asked = written(found.select(F.explode("asks").alias("digest")).distinct(), "asked")
    if not asked.isEmpty():
        asks = some.select("k", "k2", F.explode("found").alias("digest")).join(asked, "digest", "left_semi").groupBy("k", "k2").agg(F.collect_set("digest").alias("met"))
        # by chunks alone: only texts with a run of asked chunks go on
        needed = some.drop("found").join(asks, ["k", "k2"]).mapInArrow(_candidates, kept).where("size(ranges) > 0").select("k", "k2", F.col("found").alias("met"))
        with arrow_rows(docs.sparkSession, 1000):
            held = written(held.join(written(needed, "needed"), ["k", "k2"]), "asked_texts")
            grams = written(held.mapInArrow(_grams(words), "doc_id bigint, k bigint, k2 bigint, grams array<bigint>"), "grams")
        run = grams.select(_place(), F.explode("grams").alias("gram"))
        source = written(run.groupBy("gram").agg(F.min("place").alias("other")), "sources")
        more = run.join(source, "gram").where("place <> other").groupBy("place").agg(F.array_sort(F.collect_set("other")).alias("o"))
        more = more.select("place.*", F.transform("o", lambda x, i: F.struct(i.alias("rank"), x["k"].alias("k"), x["k2"].alias("k2"), x["doc_id"].alias("doc_id"))).alias("others"))
        more = more.join(held.select("k", "k2", F.col("met").alias("known")), ["k", "k2"]).select("doc_id", "k", "k2", "known", F.expr("cast(array() as array<int>)").alias("ranks"), "others")
        found = found.union(_compared(written(more, "linked"), held, words, True))
    return found.select("doc_id", F.explode("passages").alias("x")).select("doc_id", "x.start", "x.stop", "x.n_words", "x.first_doc_id").distinct()
