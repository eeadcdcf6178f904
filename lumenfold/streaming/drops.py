"""A watched folder: what came, was edited or went, as a stream with a state for each path.

Each look compares the folder with what was there before and writes the differences as events. The stream keeps the last event of each
path until nothing has come for a while, so a file that is written in several goes is taken once, when it is complete.
"""

from __future__ import annotations

import datetime as dt
import re
import time
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lumenfold.plans import flows
from lumenfold.plans.follow import Index
from lumenfold.plans.providers import Embedder
from lumenfold.sources.snapshots import Snapshots
from lumenfold.sources.texts import _records, from_folder

EVENTS = "path string, modified timestamp, length bigint, gone boolean, look bigint"
_STATE = "look bigint, gone boolean"


def sweep(store: Snapshots, folder: str, embedder: Embedder, today: dt.date, now: str, **chunking) -> DataFrame:
    """All files once more; their content hashes tell which are new or edited."""
    return flows.ingest(store, from_folder(store.spark, folder), embedder, today, now, **chunking)


def settled(events: DataFrame, quiet: float) -> DataFrame:
    """(path, gone) of each path once no event (``EVENTS``) has come for ``quiet`` seconds, as its last event was."""

    def keep(key, frames, state):
        if state.hasTimedOut:
            _, gone = state.get
            state.remove()
            yield pd.DataFrame({"path": [key[0]], "gone": [bool(gone)]})
            return
        last = state.get if state.exists else (-1, False)
        for frame in frames:
            newest = frame.loc[frame["look"].idxmax()]
            last = max(last, (int(newest["look"]), bool(newest["gone"])))
        state.update(last)
        state.setTimeoutDuration(max(1, int(1000 * quiet)))

    return events.groupBy("path").applyInPandasWithState(keep, "path string, gone boolean", _STATE, "update", "ProcessingTimeTimeout")


class Watch:
    """Keeps a store up with the .txt files below a folder.

    ``work`` holds the events, what was seen, and the stream's checkpoint. A watch that starts there again goes on where the last one ended: events are written before
    they count as seen, the stream takes each of its batches until it is done, and a file that was taken already is skipped by its content's hash.

    ``forget``: entries of files that went go too. ``index``: is brought up to the store after each batch.
    """

    def __init__(self, spark: SparkSession, store: Snapshots, folder: str, work: str, embedder: Embedder, *, quiet: float = 1.0, forget: bool = False, index: Index | None = None, clock: Callable[[], dt.datetime] = dt.datetime.now, **ingesting):
        self.spark, self.store, self.folder, self.work, self.embedder = spark, store, folder.rstrip("/"), work.rstrip("/"), embedder
        self.quiet, self.forget, self.index, self.clock, self.ingesting = quiet, forget, index, clock, ingesting
        self.seen = Snapshots(spark, f"{self.work}/seen", "path string, modified timestamp, length bigint", "path")
        self.noted = self.taken = 0
        self.batches: list[dict[str, str]] = []
        self.query: StreamingQuery | None = None
        for name in (self.folder, f"{self.work}/events"):
            path, fs = self._path(name)
            fs.mkdirs(path)

    def _path(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def look(self) -> int:
        """Note what has changed since the last look; how many paths have."""
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").load(self.folder)
        now = files.select("path", F.col("modificationTime").alias("modified"), "length")
        state = self.seen.state()
        was = self.seen.rows(state).toDF("path", "modified_before", "length_before")
        differs = ~(F.col("modified").eqNullSafe(F.col("modified_before")) & F.col("length").eqNullSafe(F.col("length_before")))
        changed = self.seen.stage(now.join(was, "path", "full_outer").where(differs).select("path", "modified", "length", F.isnull("length").alias("gone")))
        n = changed.count()
        if n:
            changed.withColumn("look", F.lit(state.n + 1).cast("bigint")).coalesce(1).write.mode("append").parquet(f"{self.work}/events")
            self.noted += n
            self.seen.replace(changed.where("not gone").drop("gone"), changed.select("path"))
        return n

    def _take(self, batch: DataFrame, _: int) -> None:
        rows = batch.collect()  # paths, as any reader of files has them on the driver
        there = [r.path for r in rows if not r.gone and (lambda p: p[1].exists(p[0]))(self._path(r.path))]
        now = self.clock()
        if there:
            paths = [re.sub(r"([][{}*?\\])", r"\\\1", p) for p in there]
            files = self.spark.read.format("binaryFile").option("ignoreMissingFiles", True).load(paths)
            status = flows.ingest(self.store, _records(files, self.folder), self.embedder, now.date(), now.isoformat(timespec="seconds"), **self.ingesting)
            self.batches.append({r.entry_id: r.status for r in status.collect()})
        gone = [r.path for r in rows if r.gone]
        if gone and self.forget:
            names = _records(self.spark.createDataFrame([(p, dt.datetime(1970, 1, 1), 1, b"x") for p in gone], "path string, modificationTime timestamp, length bigint, content binary"), self.folder)
            self.store.replace(None, names.select("entry_id"))
        if rows and self.index is not None and self.index.mark():
            self.index.follow(self.store)
        self.taken += len(rows)

    def start(self) -> StreamingQuery:
        events = self.spark.readStream.schema(EVENTS).parquet(f"{self.work}/events")
        found = settled(events, self.quiet).writeStream.outputMode("update").foreachBatch(self._take)
        self.query = found.option("checkpointLocation", f"{self.work}/stream").trigger(processingTime=f"{max(1, int(500 * self.quiet))} milliseconds").start()
        return self.query

    def run(self, every: float = 1.0, once: bool = False) -> None:
        """Look and take until the stream is stopped; ``once``: until what one look finds is taken."""
        query = self.query or self.start()
        try:
            self.look()
            while query.isActive and not (once and self.taken >= self.noted):
                time.sleep(every)
                if not once:
                    self.look()
            if query.exception():
                raise query.exception()
        finally:
            self.stop()

    def stop(self) -> None:
        if self.query is not None:
            self.query.stop()
            self.query = None
