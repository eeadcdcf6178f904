"""What is kept up with a store from its changes alone: an inverted index with its statistics, cells of vectors, the signals of passes, and their rollup."""

from __future__ import annotations

import re
import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import blocks, patterns
from lumenfold.functions import columns as C
from lumenfold.operators import corpus, retrieval, signals, themes
from lumenfold.sources.snapshots import BROADCAST_KEYS, Snapshots

#: The index is built anew once the entries that went, or came again, are this share of its entries.
WASTE = 0.5


class Follower:
    """Something made of a store's chunks that is kept up with it. Its rows carry the store's commit as ``version`` and are only added.

    An entry that goes, or comes again, is noted with the commit, and rows of earlier ones are passed over. That note is the last commit of a round, and its mark says
    how far this is: a round that was broken off is done again, and may write rows a second time.
    """

    def __init__(self, spark: SparkSession, folder: str, most: int):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.gone = Snapshots(spark, f"{folder}/gone", "entry_id string, version bigint", most=most)

    def mark(self) -> dict | None:
        """How far this is: n, the store's commit, and more. None: nothing is there yet."""
        return self.gone.state().mark

    def _whole(self, chunks: DataFrame, n: int) -> dict:
        """Make it anew of all chunks; what the mark says."""
        raise NotImplementedError

    def _more(self, added: DataFrame, gone: DataFrame, n: int, mark: dict) -> tuple[DataFrame, dict]:
        """Take in the chunks that came; the entries with rows that are no longer right, and what the mark says."""
        raise NotImplementedError

    def rebuild(self, store: Snapshots) -> None:
        """All of it anew from the store's present state."""
        n = store.state().n
        said = self._whole(store.read(n), n)
        self.gone.write(self.gone.read().where("false"), {"n": n} | said)

    def follow(self, store: Snapshots) -> None:
        """Bring it up to the store's present state, from its changes since; nothing else of the store is read."""
        mark = self.mark()
        if mark and mark["n"] == store.state().n:
            return
        change = store.changes(mark["n"]) if mark else None
        if change is None or change.reset or self.gone.state().rows() > WASTE * max(1000, mark["entries"]):
            return self.rebuild(store)
        dead, said = self._more(change.added, change.gone.select("entry_id").distinct(), change.upto, mark)
        self.gone.replace(dead.withColumn("version", F.lit(change.upto).cast("bigint")), mark={"n": change.upto} | said)

    def _alive(self, rows: DataFrame) -> DataFrame:
        state = self.gone.state()
        dead = self.gone.rows(state).withColumnRenamed("version", "since")
        return rows.join(F.broadcast(dead) if state.rows() <= BROADCAST_KEYS else dead, "entry_id", "left").where("since is null or version >= since").drop("since")


class Inverted(Follower):
    """What terms a store's chunks have, as ``functions.blocks`` writes it: in buckets by term, sorted by it, so that a search opens its terms' files only."""

    #: Bytes of text that a block has at most.
    BYTES = 8 << 20

    def __init__(self, spark: SparkSession, folder: str, most: int, rows: int):
        super().__init__(spark, f"{folder.rstrip('/')}/blocks", most)
        self.postings = Snapshots(spark, f"{self.folder}/terms", f"{blocks.ROWS}, version bigint", "term", most=rows)

    def _find(self, terms: list[str]) -> DataFrame:
        keys = self.spark.createDataFrame([(t,) for t in terms], "term string")
        return self.postings.of(keys).where(F.col("term").isin(*terms))

    def _named(self, hits: DataFrame) -> DataFrame:
        """``hits`` (block, spot, version and more) of entries that are as they were then, with id, entry_id and size."""
        hits = self.postings.stage(hits)
        keys = hits.select(F.concat(F.lit(blocks.DIRECTORY), "block").alias("term"))
        names = self.postings.of(keys).where(F.col("term").startswith(blocks.DIRECTORY))
        names = names.select("block", F.posexplode(F.arrays_zip("ids", "entries", "sizes")).alias("spot", "x"))
        names = names.select("block", "spot", F.col("x.ids").alias("id"), F.col("x.entries").alias("entry_id"), F.col("x.sizes").alias("size"))
        return self._alive(hits.join(names, ["block", "spot"]))


def _bytes(chunks: DataFrame, *columns: str) -> int:
    return chunks.agg(F.coalesce(F.sum(sum((F.coalesce(F.octet_length(c), F.lit(0)) for c in columns), F.lit(0).cast("bigint"))), F.lit(0))).first()[0]


class Index(Inverted):
    """The postings of a store's chunks.

    The mark also says how many chunks, words and entries there are; that comes from the lengths of chunks, which are kept by entry.
    """

    def __init__(self, spark: SparkSession, folder: str, most: int = 200_000):
        super().__init__(spark, folder, most, 20 * most)
        self.lengths = Snapshots(spark, f"{self.folder}/lengths", "id string, entry_id string, dl int", most=most)

    def _postings(self, chunks: DataFrame, n: int) -> DataFrame:
        entry = F.regexp_replace("id", "::[0-9]+$", "")  # as to_chunks makes ids
        text = F.coalesce("text", F.lit(""))
        return blocks.inverted(chunks.select("id", entry.alias("entry_id"), F.size(C.tokens(text)).alias("size"), F.lower(text).alias("text")), n, blocks.words, self.BYTES, True)

    def _sums(self, lengths: DataFrame) -> list[int]:
        r = lengths.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0)), F.countDistinct("entry_id")).first()
        return [int(x) for x in r]

    def _said(self, sums: list[int]) -> dict:
        return dict(zip(("chunks", "words", "entries"), sums)) | {"lengths": self.lengths.state().n}

    def _whole(self, chunks: DataFrame, n: int) -> dict:
        self.postings.write(self._postings(chunks, n), rows=_bytes(chunks, "text") // 45)  # blocks have a row for about 63 bytes; the rest is room for what comes
        lengths = self.lengths.stage(retrieval.lengths(chunks, "id", "entry_id"))
        sums = self._sums(lengths)
        self.lengths.write(lengths, rows=sums[0])
        return self._said(sums)

    def _more(self, added: DataFrame, gone: DataFrame, n: int, mark: dict) -> tuple[DataFrame, dict]:
        before = self.lengths.of(gone, at=mark["lengths"])
        self.postings.append(self._postings(added, n))
        lengths = self.lengths.stage(retrieval.lengths(added, "id", "entry_id"))
        sums = [mark[c] + new - old for c, new, old in zip(("chunks", "words", "entries"), self._sums(lengths), self._sums(before))]
        dead = self.gone.stage(before.select("entry_id").distinct())
        self.lengths.replace(lengths, gone)
        return dead, self._said(sums)

    def of(self, terms: list[str]) -> DataFrame:
        """The postings of these terms: term, id, dl, tf."""

        def opened(batches):
            for batch in batches:
                for term, block, spots, counts, version in zip(*(c.to_pylist() for c in batch.columns)):
                    own = blocks.spots_of(spots)
                    columns = [[term] * len(own), [block] * len(own), own.astype(np.int32), blocks.unpacked(counts).astype(np.int32), [version] * len(own)]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int64()))], ["term", "block", "spot", "tf", "version"])

        found = self._find(terms).select("term", "block", "spots", "counts", "version")
        rows = self._named(found.mapInArrow(opened, "term string, block string, spot int, tf int, version bigint"))
        return rows.groupBy("term", "id").agg(F.max("size").alias("dl"), F.max("tf").alias("tf"))  # a round may have been done twice

    def best(self, query: str, k: int = 40, allowed: DataFrame | None = None) -> DataFrame:
        """Best matches by BM25 with their rank from 0, among the ids of ``allowed`` (default: all); id, score, rank."""
        mark, terms = self.mark() or {"chunks": 0, "words": 0}, retrieval.query_terms(self.spark, query)
        whole = self.spark.createDataFrame([(mark["chunks"], mark["words"] / max(1, mark["chunks"]))], "n bigint, avgdl double")
        return retrieval.bm25_of(self.of(terms), whole, query, k, allowed)


class Cells(Follower):
    """The vectors of a store's chunks in cells around centres: an inverted file, for searches that need not look at every vector.

    The centres are fitted on ``sample`` vectors at most, picked by a hash of their ids; every vector lies in the cell of its nearest centre. There are about as many cells
    as the root of the number of vectors, 1,024 at most. The centres with their cells' radii are read by the driver.
    """

    def __init__(self, spark: SparkSession, folder: str, sample: int = 20_000, most: int = 200_000):
        super().__init__(spark, folder, most)
        self.sample = sample
        self.rows = Snapshots(spark, f"{folder}/cells", "cell int, id string, entry_id string, date string, vector array<float>, version bigint", "cell", most=most)

    def _dealt(self, chunks: DataFrame, centres: np.ndarray, n: int) -> DataFrame:
        def cells(batches):
            for batch in batches:
                if batch.num_rows:
                    x = themes.numbers(batch)
                    cell = ((centres**2).sum(1) - 2 * x @ centres.T).argmin(1)
                    far = np.sqrt(((x - centres[cell]) ** 2).sum(1))
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), *map(batch.column, ("id", "entry_id", "date", "vector")), pa.array(far)], ["cell", "id", "entry_id", "date", "vector", "far"])

        found = chunks.where("vector is not null").select("id", "entry_id", "date", "vector")
        found = found.mapInArrow(cells, "cell int, id string, entry_id string, date string, vector array<float>, far double")
        return self.rows.stage(found.withColumn("version", F.lit(n).cast("bigint")))

    def _radii(self, dealt: DataFrame) -> dict[int, float]:
        return {r.cell: r.far for r in dealt.groupBy("cell").agg(F.max("far").alias("far")).collect()}

    def _keep(self, centres: np.ndarray, radii: list[float]) -> str:
        """Centres and radii in a table of their own, which the mark names."""
        path = f"{self.folder}/centres/{uuid.uuid4().hex}"
        rows = [(i, [float(x) for x in c], float(r)) for i, (c, r) in enumerate(zip(centres, radii))]
        self.spark.createDataFrame(rows, "cell int, centre array<double>, radius double").coalesce(1).write.parquet(path)
        return path

    def _kept(self, mark: dict) -> tuple[np.ndarray, np.ndarray]:
        rows = sorted(self.spark.read.parquet(mark["centres"]).collect(), key=lambda r: r.cell)
        return np.array([r.centre for r in rows]), np.array([r.radius for r in rows])

    def _whole(self, chunks: DataFrame, n: int) -> dict:
        have = chunks.where("vector is not null")
        total, entries = have.agg(F.count("*"), F.countDistinct("entry_id")).first()
        if not total:
            self.rows.write(self.rows.read().where("false"))
            return {"centres": self._keep(np.zeros((0, 0)), []), "entries": 0}
        k = max(1, min(1024, round(total**0.5)))
        some = self.rows.stage(have.select(F.col("id").alias("entry_id"), F.col("vector").cast("array<double>").alias("vector")).orderBy(F.xxhash64("id"), "id").limit(self.sample))
        centres = np.array([r.vector for r in some.orderBy(F.xxhash64(F.lit(1), "entry_id"), "entry_id").limit(k).collect()])
        for _ in range(8):
            centres = themes.moved(some, centres)
        dealt = self._dealt(chunks, centres, n)
        self.rows.write(dealt)
        far = self._radii(dealt)
        return {"centres": self._keep(centres, [far.get(i, 0.0) for i in range(len(centres))]), "entries": entries}

    def _more(self, added: DataFrame, gone: DataFrame, n: int, mark: dict) -> tuple[DataFrame, dict]:
        centres, radii = self._kept(mark)
        if not len(centres):
            raise ValueError("no vectors were there when the cells were made: rebuild them")
        dealt = self._dealt(added, centres, n)
        self.rows.append(dealt)
        far = self._radii(dealt)
        return self.gone.stage(gone), {"centres": self._keep(centres, [max(r, far.get(i, 0.0)) for i, r in enumerate(radii)]), "entries": mark["entries"]}

    def nearest(self, query: list[float], k: int = 40, probes: int = 8, exact: bool = False, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
        """The nearest vectors of the ``probes`` cells around the query, with their rank from 0: id, distance, rank.

        ``exact``: every other cell that may hold a nearer vector than these, as its centre's distance less its radius says, is read too.
        """
        mark = self.mark()
        centres, radii = self._kept(mark) if mark else (np.zeros((0, 0)), np.zeros(0))
        if not len(centres):
            return retrieval.dense_topk(self.rows.read(), query, k)
        far = np.sqrt(((centres - np.array(query)) ** 2).sum(1))
        near = np.argsort(far, kind="stable")

        def among(cells: np.ndarray) -> DataFrame:
            ids = [int(c) for c in cells]
            rows = self.rows.of(self.spark.createDataFrame([(c,) for c in ids], "cell int")).where(F.col("cell").isin(*ids))
            rows = self._alive(corpus.in_range(rows, date_from, date_to))
            return retrieval.dense_topk(rows.dropDuplicates(["id", "version"]), query, k)  # a round may have been done twice

        found = among(near[:probes])
        if not exact or probes >= len(near):
            return found
        known = found.agg(F.count("*").alias("n"), F.max("distance").alias("d")).first()
        most = np.sqrt(known.d + 1e-6) if known.n >= k else np.inf
        return among(near[(far[near] - radii[near] <= most) | (np.arange(len(near)) < probes)])


class Grams(Inverted):
    """The runs of three ASCII characters, in small letters, that a store's chunks and their ids, dates and sources have: an index for patterns.

    What a pattern cannot do without (``patterns.needed``) picks the chunks, which then are tried with the pattern itself. A pattern that needs nothing of that
    length goes through all chunks.
    """

    BYTES = 2 << 20

    def __init__(self, spark: SparkSession, folder: str, most: int = 200_000):
        super().__init__(spark, folder, most, 2 * most)

    def _grams(self, chunks: DataFrame, n: int) -> DataFrame:
        text = F.lower(F.concat_ws("\n", "entry_id", "date", "source", "text"))
        return blocks.inverted(chunks.select("id", "entry_id", F.lit(0).alias("size"), text.alias("text")), n, blocks.grams, self.BYTES, False)

    def _whole(self, chunks: DataFrame, n: int) -> dict:
        self.postings.write(self._grams(chunks, n), rows=_bytes(chunks, "text", "entry_id", "date", "source") // 200)  # blocks have about a row for so many bytes
        return {"entries": chunks.select("entry_id").distinct().count()}

    def _more(self, added: DataFrame, gone: DataFrame, n: int, mark: dict) -> tuple[DataFrame, dict]:
        self.postings.append(self._grams(added, n))
        return self.gone.stage(gone), {"entries": mark["entries"]}

    def candidates(self, pattern: str) -> DataFrame | None:
        """id, entry_id of the chunks that have all that one of the pattern's alternatives needs; None: any chunk may match."""
        ways = patterns.needed(pattern if corpus.as_java(self.spark, pattern) is not None else re.escape(pattern))
        if ways is None:
            return None

        def met(table: pa.Table) -> pa.Table:
            """The texts of one block that have what one of the ways needs."""
            spots: dict[str, np.ndarray] = {}
            for term, data in zip(table["term"].to_pylist(), table["spots"].to_pylist()):
                spots[term] = np.union1d(spots.get(term, np.zeros(0, np.int64)), blocks.spots_of(data))
            found = np.zeros(0, np.int64)
            for own in ways:
                if all(g in spots for g in own):
                    found = np.union1d(found, reduce(np.intersect1d, [spots[g] for g in own]))
            some = [pa.array([table[c][0].as_py()] * len(found), t) for c, t in (("block", pa.string()), ("version", pa.int64()))]
            return pa.Table.from_arrays([some[0], pa.array(found.astype(np.int32)), some[1]], ["block", "spot", "version"])

        rows = self._find(sorted({g for own in ways for g in own})).select("term", "block", "spots", "version")
        hits = rows.groupBy("block").applyInArrow(met, "block string, spot int, version bigint")
        return self._named(hits).select("id", "entry_id").distinct()

    def find(self, store: Snapshots, pattern: str) -> DataFrame:
        """The entries that ``corpus.search_entries`` finds in the store that this follows."""
        some = self.candidates(pattern)
        if some is None:
            return corpus.search_entries(store.read(), pattern)
        some = self.postings.stage(some)
        return corpus.search_entries(store.of(some).join(some.select("id"), "id", "left_semi"), pattern)


def _since(kept: Snapshots, source: Snapshots, key: str):
    """The changes of ``source`` that ``kept`` does not have yet; None: it has all."""
    n = (kept.state().mark or {}).get(key, 0)
    return None if n == source.state().n else source.changes(n)


def follow_signals(entries: Snapshots, store: Snapshots, a_pass: signals.Pass, now: str) -> DataFrame:
    """The pass over the chunks that came since it last followed; the signals of what went go. ``store`` has entry_id as its key, and is of this pass alone.

    A new version of the pass goes over everything.
    """
    key = f"{a_pass.name}:{a_pass.version}"
    change = _since(store, entries, key)
    if change is None:
        return store.read()
    every = change.reset or key not in (store.state().mark or {})
    chunks = entries.read(change.upto) if every else change.added
    todo = signals.to_derive(chunks.select(F.col("id").alias("chunk_id"), "entry_id", "text"), corpus.empty(store.spark, corpus.SIGNALS), a_pass, True)
    new, mark = signals.derived(todo, a_pass, now), {key: change.upto}
    return store.write(new, mark) if every else store.replace(new, change.gone, mark)


def follow_rollup(entries: Snapshots, store: Snapshots, rollup: Snapshots, a_pass: signals.LexicalPass) -> DataFrame:
    """The rollup of stored signals, renewed for the entries whose signals have changed. All three have entry_id as their key."""
    change = _since(rollup, store, "signals")
    if change is None:
        return rollup.read()
    chunk = lambda rows: rows.select(F.col("id").alias("chunk_id"), "entry_id", "date", "date_int", "word_count")
    mark = {"signals": change.upto}
    if change.reset:
        return rollup.write(signals.entry_signals(change.added, chunk(entries.read()), a_pass), mark)
    keys = rollup.stage(change.gone.select("entry_id").distinct())
    return rollup.replace(signals.entry_signals(store.of(keys, change.upto), chunk(entries.of(keys)), a_pass), keys, mark)

