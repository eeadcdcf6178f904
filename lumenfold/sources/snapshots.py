"""A mutable table as Parquet: a log of commits, each with the rows that it adds and the keys that it takes away."""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A bucket with more parts is put together; so many keys that went are broadcast at most; after so many commits the log's sum is kept.
PARTS, BROADCAST_KEYS, SUMMED = 8, 200_000, 32
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Conflict(Exception):
    """Another commit has changed what this one was made from."""


@dataclass
class State:
    """What the log adds up to: of each bucket its parts [commit, kind, folder, rows], and the last mark."""

    n: int = 0
    buckets: int = 1
    parts: dict[int, list] = field(default_factory=dict)
    mark: dict | None = None

    def take(self, n: int, record: dict) -> None:
        if record.get("reset"):
            self.parts = {}
        if swap := record.get("swap"):
            for b in swap["drop"]:
                self.parts[b] = [p for p in self.parts.get(b, []) if p[0] > swap["upto"]]
            for b, folder, rows in swap["parts"]:
                self.parts.setdefault(b, []).insert(0, [swap["upto"], "add", folder, rows])
        for b, kind, folder, rows in record.get("parts", []):
            self.parts.setdefault(b, []).append([n, kind, folder, rows])
        self.n, self.buckets, self.mark = n, record["buckets"], record.get("mark") or self.mark

    def rows(self) -> int:
        """At least as many as the table has: those that went count until their bucket is put together."""
        return sum(p[3] for own in self.parts.values() for p in own if p[1] == "add")


@dataclass
class Changes:
    """What commits up to ``upto`` did: rows that are there since, keys that are not what they were. ``reset``: all is new, ``gone`` is None."""

    upto: int
    reset: bool
    added: DataFrame
    gone: DataFrame | None


class Snapshots:
    """A folder of ``data/<id>/<kind>/__bucket=<b>`` and ``log/<n>.json``, the commits. Any number of writers and readers.

    A commit adds rows, and takes away the older rows with the values of ``on`` (default: ``key``) that it names; nothing else is written, and
    readers put both together. Commits are optimistic: number n is taken by putting its record where none is, and whoever comes second looks at
    what came first, and goes on behind it or starts anew.

    Rows lie in buckets by a hash of ``key``. Buckets split one after another as the table grows (linear hashing), so that they hold about
    ``most`` rows; one with many parts is put together. So the work of a commit goes with what it brings, and at most a few buckets.

    The log needs a file system whose rename does not replace, as HDFS's, or the local one. Rows with a null in ``on`` cannot be taken away. What older
    commits wrote stays readable until ``vacuum``.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: str = "entry_id", on: Iterable[str] = (), most: int = 200_000):
        self.spark, self.folder, self.schema, self.key, self.on, self.most = spark, folder.rstrip("/"), schema, key, list(on) or [key], most
        self._empty = spark.createDataFrame([], schema)
        self._keys = ", ".join(f"`{c}` {t}" for c, t in self._empty.select(*self.on).dtypes)

    # --- the log

    def _file(self, name: str):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _get(self, name: str) -> dict | None:
        path, fs = self._file(name)
        if not fs.exists(path):
            return None
        stream = fs.open(path)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, name: str, content: dict) -> bool:
        """Whether the file was put; false if there is one already. Its content is complete when it is seen."""
        jvm = self.spark.sparkContext._jvm
        path, fs = self._file(name)
        draft, _ = self._file(f"log/_{uuid.uuid4().hex}")
        stream = fs.create(draft)
        stream.write(json.dumps(content).encode())
        stream.close()
        if fs.getScheme() != "file":
            done = fs.rename(draft, path)
        else:  # a local rename replaces, a link does not
            try:
                local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
                jvm.java.nio.file.Files.createLink(local(path), local(draft))
                done = True
            except Py4JJavaError as e:
                if "FileAlreadyExists" not in e.java_exception.getClass().getName():
                    raise
                done = False
        fs.delete(draft, False)
        return done

    def _record(self, n: int) -> dict | None:
        return self._get(f"log/{n:012d}.json")

    def state(self, at: int | None = None) -> State:
        """After the last commit, or after commit ``at``."""
        path, fs = self._file("log")
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        sums = [int(x.split(".")[0]) for x in names if x.endswith(".sum.json") and (at is None or int(x.split(".")[0]) <= at)]
        state = State()
        if sums:
            known = self._get(f"log/{max(sums):012d}.sum.json")
            state = State(known["n"], known["buckets"], {int(b): p for b, p in known["parts"].items()}, known["mark"])
        while (at is None or state.n < at) and (record := self._record(state.n + 1)) is not None:
            state.take(state.n + 1, record)
        return state

    # --- rows

    def _bucket(self, buckets: int) -> Column:
        low = 1 << (buckets.bit_length() - 1)
        h = F.xxhash64(self.key)
        wide = F.pmod(h, F.lit(2 * low))
        return F.when(wide < buckets, wide).otherwise(F.pmod(h, F.lit(low))).cast("int")

    def _write(self, df: DataFrame, kind: str, buckets: int) -> list[list]:
        """[bucket, kind, folder, rows] of each bucket that got any. Large buckets become several files."""
        folder = uuid.uuid4().hex
        path, columns = f"{self.folder}/data/{folder}/{kind}", self._empty.columns if kind == "add" else self.on
        own = df.select(*columns, self._bucket(buckets).alias("__bucket")) if self.key in columns else df.select(*columns, F.col("__bucket"))
        with swept(self.spark):
            own.hint("rebalance", "__bucket").sortWithinPartitions("__bucket", *[c for c in (self.key,) if c in columns]).write.partitionBy("__bucket").parquet(path)
        written = self.spark.read.schema(f"{self.schema if kind == 'add' else self._keys}, __bucket int").parquet(path)
        return [[r["__bucket"], kind, folder, r["count"]] for r in written.groupBy("__bucket").count().collect()]

    def _files(self, parts: list[tuple[int, list]], kind: str, schema: str) -> DataFrame:
        """Rows of the parts of a kind, with the commit that they count for."""
        own = [(b, p) for b, p in parts if p[1] == kind]
        rows = self.spark.read.schema(schema).parquet(*(f"{self.folder}/data/{p[2]}/{kind}/__bucket={b}" for b, p in own))
        order = self.spark.createDataFrame(sorted({(p[2], p[0]) for _, p in own}), "__folder string, __n bigint")
        rows = rows.withColumn("__folder", F.regexp_extract("_metadata.file_path", "/data/([0-9a-f]{32})/", 1))
        return rows.join(F.broadcast(order), "__folder").drop("__folder")

    def _merged(self, parts: list[tuple[int, list]]) -> DataFrame:
        """The rows that parts (bucket, part) add and no later one takes away."""
        adds = [(b, p) for b, p in parts if p[1] == "add"]
        if not adds:
            return self._empty
        first: dict[int, int] = {}
        for b, p in adds:
            first[b] = min(p[0], first.get(b, p[0]))
        gone = [(b, p) for b, p in parts if p[1] == "gone" and p[0] > first.get(b, p[0])]
        if not gone:
            return self.spark.read.schema(self.schema).parquet(*(f"{self.folder}/data/{p[2]}/add/__bucket={b}" for b, p in adds))
        last = self._files(gone, "gone", self._keys).groupBy(*self.on).agg(F.max("__n").alias("__gone"))
        if sum(p[3] for _, p in gone) <= BROADCAST_KEYS:
            last = F.broadcast(last)
        rows = self._files(adds, "add", self.schema).join(last, self.on, "left")
        return rows.where("__gone is null or __n >= __gone").select(*self._empty.columns)

    def rows(self, state: State, only: set[int] | None = None) -> DataFrame:
        return self._merged([(b, p) for b, own in sorted(state.parts.items()) if only is None or b in only for p in own])

    def read(self, at: int | None = None) -> DataFrame:
        return self.rows(self.state(at))

    def of(self, keys: DataFrame, at: int | None = None) -> DataFrame:
        """The rows with the values of ``key`` that ``keys`` has; only their buckets are read."""
        state, keys = self.state(at), keys.select(self.key).distinct()
        only = {r.b for r in keys.select(self._bucket(state.buckets).alias("b")).distinct().collect()}
        return self.rows(state, only).join(keys, self.key, "left_semi").select(*self._empty.columns)

    def changes(self, after: int) -> Changes:
        """What later commits than ``after`` did; only what they wrote is read. If a vacuum has taken some of it, all is new."""
        now, parts = self.state(), []
        for n in range(after + 1, now.n + 1):
            record = self._record(n)
            if record.get("reset"):
                return Changes(now.n, True, self.rows(now), None)
            parts += [(b, [n, kind, folder, rows]) for b, kind, folder, rows in record.get("parts", [])]
        for folder in {p[2] for _, p in parts}:
            path, fs = self._file(f"data/{folder}")
            if not fs.exists(path):
                return Changes(now.n, True, self.rows(now), None)
        gone = [x for x in parts if x[1][1] == "gone"]
        keys = self._files(gone, "gone", self._keys).select(*self.on).distinct() if gone else self._empty.select(*self.on)
        return Changes(now.n, False, self._merged(parts), keys)

    # --- commits

    def _commit(self, base: State, record: dict, touched: set[int], alone: bool) -> int:
        """The commit's number. A Conflict if, since ``base``, a bucket of ``touched`` or the whole table was split or, if ``alone``, changed."""
        n = base.n + 1
        while not self._put(f"log/{n:012d}.json", record):
            other = self._record(n)
            swap = other.get("swap") or {"drop": []}
            split = set(swap["drop"]) if other["buckets"] != base.buckets else set()
            changed = {p[0] for p in other.get("parts", [])} if alone else set()
            dealt_anew = other.get("reset") and other["buckets"] != base.buckets
            if touched & (split | changed) or (alone and other.get("reset")) or dealt_anew:
                raise Conflict(f"commit {n} of {self.folder}")
            record = record | {"buckets": max(record["buckets"], other["buckets"])}
            n += 1
        if n % SUMMED == 0:
            state = self.state(n)
            self._put(f"log/{n:012d}.sum.json", {"n": n, "buckets": state.buckets, "parts": state.parts, "mark": state.mark})
        return n

    def stage(self, df: DataFrame) -> DataFrame:
        """``df`` written and read again, so that what is dear is done once however often a commit is tried."""
        return staged(df, f"{self.folder}/data/{uuid.uuid4().hex}/staged")

    def write(self, df: DataFrame, mark: dict | None = None, rows: int = 0) -> DataFrame:
        """A new state of the whole table. ``rows``: about how many it has; buckets are made for them at once, where else all is written again to be split."""
        self._change(lambda _: (df, None), mark, reset=True, rows=rows)
        return self.read()

    def append(self, new: DataFrame, mark: dict | None = None) -> None:
        """``new`` beside what is there."""
        self._change(lambda _: (new, None), mark)

    def replace(self, new: DataFrame | None, keys: DataFrame | None = None, mark: dict | None = None) -> DataFrame:
        """``new`` in the place of the rows with the values of ``on`` that ``keys`` has, whoever wrote them last.

        ``keys`` (default: those of ``new``) must hold all of ``new``'s; given, they spare a dear ``new``, such as a model's answers, from being computed
        twice. ``mark``: what the commit says of itself, such as how far it follows another table.
        """
        self._change(lambda _: (new, keys if keys is not None else new), mark)
        return self.read()

    def update(self, change: Callable[[DataFrame], tuple[DataFrame | None, DataFrame] | None], mark: dict | None = None) -> DataFrame:
        """As ``replace``, with (new, keys) made of the rows that are there. It is made again if others change the same buckets meanwhile; None changes nothing."""
        self._change(lambda state: change(self.rows(state)), mark, alone=True)
        return self.read()

    def _change(self, make, mark: dict | None, alone: bool = False, reset: bool = False, tries: int = 10, rows: int = 0) -> None:
        held: DataFrame | None = None
        for again in range(tries):
            state = self.state()
            made = make(state)
            if made is None:
                return
            (new, keys), parts, buckets = made, [], max(state.buckets, -(-rows // self.most))
            if keys is not None:
                own = keys.select(*dict.fromkeys([*self.on, self.key])).distinct()
                parts = self._write(own.withColumn("__bucket", self._bucket(state.buckets)), "gone", state.buckets)
            # where only the buckets have changed, rows are dealt out anew, not made again
            added = self._write(new if alone or held is None else held, "add", buckets) if new is not None else []
            parts += added
            if not parts and mark is None and not reset:
                return
            touched = {p[0] for p in parts}
            try:
                self._commit(state, {"buckets": buckets, "reset": reset, "parts": parts, "mark": mark}, touched, alone)
                return self._tidy(touched)
            except Conflict:
                if again + 1 == tries:
                    raise
                if added:
                    held = self.spark.read.schema(self.schema).parquet(f"{self.folder}/data/{added[0][2]}/add")
                time.sleep(0.05 * 2**again)

    def _tidy(self, touched: set[int] = frozenset()) -> None:
        """Split buckets until they hold ``most`` rows on average, and put those of ``touched`` together that have many parts. If others were faster, the next commit does it."""
        state = self.state()
        buckets = max(state.buckets, -(-state.rows() // self.most))
        drop = {b for b in touched if len(state.parts.get(b, [])) > PARTS}
        for b in range(state.buckets, buckets):
            while b >= state.buckets:
                b -= 1 << (b.bit_length() - 1)
            drop.add(b)
        if not drop:
            return
        parts = self._write(self.rows(state, drop), "add", buckets)
        record = {"buckets": buckets, "swap": {"upto": state.n, "drop": sorted(drop), "parts": [[b, folder, n] for b, _, folder, n in parts]}}
        try:
            self._commit(state, record, drop, True)
        except Conflict:
            pass

    def vacuum(self, keep_from: int | None = None) -> int:
        """Delete what the present state does not read; how many folders went. Not while others write or read older states.

        What follows the store finds the changes since commit ``keep_from`` (default: the last) and is made anew if it is further behind.
        """
        state = self.state()
        kept = {p[2] for own in state.parts.values() for p in own}
        for n in range((state.n if keep_from is None else keep_from) + 1, state.n + 1):
            kept |= {p[2] for p in self._record(n).get("parts", [])}
        top, fs = self._file("data")
        old = [s.getPath() for s in fs.listStatus(top) if s.getPath().getName() not in kept] if fs.exists(top) else []
        return sum(bool(fs.delete(p, True)) for p in old)


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share: below spark.checkpoint.dir; where that is unset, a temporary one in local mode and an error on a cluster."""
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = tempfile.mkdtemp(prefix="lumenfold-")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"


@contextmanager
def swept(spark: SparkSession) -> Iterator[None]:
    """What runs within leaves no shuffle files behind when it has ended; else they stay until the driver collects its garbage."""
    before = spark.conf.get(SWEEP, None)
    spark.conf.set(SWEEP, "true")
    try:
        yield
    finally:
        spark.conf.set(SWEEP, before) if before is not None else spark.conf.unset(SWEEP)


def staged(df: DataFrame, folder: str) -> DataFrame:
    """``df`` written as Parquet and read again: what is read several times is worked out once, and lost executors cost nothing."""
    with swept(df.sparkSession):
        df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
