"""Small helpers that several operators use."""

from __future__ import annotations

import math
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache, wraps
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; where that is unset, a temporary one in local mode and an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="lumenfold-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


_PATHS: WeakKeyDictionary[DataFrame, str] = WeakKeyDictionary()
_SCOPES = threading.local()


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: cuts the lineage, and survives lost executors.

    What an operator needs no more it takes away with ``drop``, or ``tidy`` does; what its lazy result reads stays until ``clear``.
    """
    path = f"{shared_folder(df.sparkSession)}/lumenfold/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    _PATHS[table] = path
    for scope in getattr(_SCOPES, "open", [])[-1:]:
        scope.append(path)
    return table


def tidy(operator):
    """An operator that returns a DataFrame: of the tables that it has written, those that the result does not read go when it returns."""

    @wraps(operator)
    def run(*args, **more) -> DataFrame:
        scopes = _SCOPES.open = getattr(_SCOPES, "open", [])
        scopes.append([])
        try:
            out = operator(*args, **more)
        finally:
            paths = scopes.pop()
        read = {name for file in out.inputFiles() for name in re.findall(r"/lumenfold/([^/]+)/", file)} if paths else set()
        for path in paths:
            if path.rsplit("/", 1)[1] not in read:
                _delete(out.sparkSession, path)
            elif scopes:
                scopes[-1].append(path)
        return out

    return run


def _delete(spark: SparkSession, path: str) -> None:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def drop(*tables: DataFrame) -> None:
    """Delete tables from ``written``, once no later result reads them."""
    for table in tables:
        if path := _PATHS.pop(table, None):
            _delete(table.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete everything that operators have left in the shared folder, when no result is read any more."""
    _delete(spark, f"{shared_folder(spark)}/lumenfold")


def unused(df: DataFrame, name: str) -> str:
    """``name``, or a longer one, that no column of ``df`` has in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def identity(text: str = "text", *before: str) -> list:
    """Two 64-bit hashes, k and k2, of a text (null: empty) and the columns before it."""
    own = [*before, F.coalesce(F.col(text), F.lit(""))]
    return [F.xxhash64(*own).alias("k"), F.xxhash64(F.lit("second"), *own).alias("k2")]


@contextmanager
def arrow_rows(spark: SparkSession, most: int):
    """What is written inside goes to Python in batches of at most ``most`` rows: for rows that hold whole texts more than once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(id_col: str = "doc_id", text_col: str = "text", *more: str):
    """Columns for the Python side: the id, the text as UTF-8 bytes (null: empty), and ``more``."""
    return [F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias(text_col), *map(F.col, more)]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with about ``most`` bytes each: first row, row after the last, bytes, and each row's bounds in them.

    Whole texts only; a text above ``most`` is a run of its own.
    """
    col = batch.column(column)
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    kind = np.int64 if pa.types.is_large_binary(col.type) else np.int32
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, kind)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(col):
        end = max(row + 1, int(np.searchsorted(at, at[row] + most, "right")) - 1)
        yield row, end, raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


# --- words, hashed without a Python object for each

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True

_P = np.uint64((1 << 31) - 1)
_RND = np.random.default_rng(20240229)
#: Two random bases modulo the prime, and for each a random symbol for every byte.
_BASES = [int(x) for x in _RND.integers(1 << 20, (1 << 31) - 1, 2)]
_SYMBOLS = _RND.integers(1, (1 << 31) - 1, (2, 256), dtype=np.uint64)


def _fold(x: np.ndarray) -> np.ndarray:
    """Below 2**32 and the same modulo the prime, for x below 2**63."""
    return (x & _P) + (x >> np.uint64(31))


@lru_cache(8)
def _powers_of(base: int, size: int) -> np.ndarray:
    """The base's powers modulo the prime, by doubling."""
    out = np.array([1], np.uint64)
    while len(out) < size:
        out = np.concatenate([out, out * np.uint64(pow(base, len(out), int(_P))) % _P])
    return out.astype(np.uint32)


def _powers(base: int, length: int) -> np.ndarray:
    return _powers_of(base, 1 << max(20, math.ceil(math.log2(length + 1))))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; bijective."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


class Spans:
    """Hashes of any spans of bytes, equal where the bytes are, wherever they stand.

    Two polynomials modulo the prime 2**31 - 1 with random bases: different spans of n bytes agree in both with a chance of about (n / 2**31)**2,
    whatever pattern they have (modulo a power of two, some patterns always agree).
    """

    def __init__(self, data: np.ndarray):
        self.n, self.sums = len(data), []
        for base, symbols in zip(_BASES, _SYMBOLS):
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(_fold(symbols[data] * _powers(base, self.n)[: self.n]), out=sums[1:])
            self.sums.append(sums)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        one, two = (_fold(_fold(sums[end] - sums[start])) % _P * _powers(pow(base, -1, int(_P)), self.n)[start] % _P for base, sums in zip(_BASES, self.sums))
        return mix(one << np.uint64(32) | two)


def words(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts in ``data``: starts and ends of the words ``[^\\x20\\x09-\\x0D]+``, and how many words lie before each of ``bounds``."""
    edge = np.zeros(len(data) + 2, bool)
    edge[1:-1] = ~_SPACE[data]
    first = edge[1:-1] & ~edge[:-2]
    cuts = bounds[(bounds > 0) & (bounds < len(data))]
    first[cuts] |= edge[1:-1][cuts]
    last = edge[1:-1] & ~edge[2:]
    last[cuts - 1] |= edge[1:-1][cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, bounds)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z in small letters."""
    return _LOWER[data]


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word, A-Z lower-cased, and how many words lie before each of ``bounds``."""
    starts, ends, before = words(data, bounds)
    return Spans(lowered(data)).of(starts, ends), before


def shingle_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash of each run of ``k`` words of ``h``; fewer words: one hash of the whole sequence, none: no hash."""
    if not len(h):
        return h
    n = max(1, len(h) - k + 1)
    k = min(k, len(h))
    out = h[:n].copy()
    for i in range(1, k):
        out = mix(out) * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
    return mix(out + np.uint64(k))
