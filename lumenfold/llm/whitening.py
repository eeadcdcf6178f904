"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

With A the centred rows over the root of their number, products A v and A' u alternate: A v = alpha u + beta times the u before, A' u = alpha v + beta times
the next v. The v are short and stay with the driver. The u are as long as the table and are kept as what they are made of: each is A y of a short
y, so that a task works its part of all of them out from the rows that it reads, whenever it is run, and nothing as long as the table is
stored. One pass over the rows gives A' u, the length of u, and what u has of all u before; the latter is taken off
(full reorthogonalisation), for which A' of those u is known. Where much had to be taken off, the pass is repeated. The v are orthogonalised
against all others twice.

The small bidiagonal matrix's singular vectors turn the v into components, its singular values are their deviations.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.shared import drop, tidy, written

SCALE, OFFSET = 64, 1_000_000
#: Deviations below this share of the largest are taken for 0.
RANK = 1e-7
#: A component has settled when what is left of it is below this share of the largest deviation.
SETTLED = 1e-13
#: A u is orthogonalised again if more than this share of it was along others.
AGAIN = 1e-6
#: Partitions for sums, of which there are a few for each dimension.
FEW = 8


def _each(batches):
    """Of each batch the ids and a row of numbers for each."""
    for batch in batches:
        if batch.num_rows:
            yield batch.column("vec_id"), batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _summed(rows: DataFrame, part, kind: str) -> list:
    """Sums over all tasks of the numbers that ``part`` makes of a batch, in order; each task sends one row for each number."""

    def run(batches):
        own = None
        for _, x in _each(batches):
            own = part(x) if own is None else own + part(x)
        if own is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(own))), pa.array(own)], ["at", "x"])

    sums = rows.mapInArrow(run, f"at bigint, x {kind}").groupBy("at").agg(F.sum("x").alias("x")).coalesce(FEW)
    return [r.x for r in sorted(sums.collect(), key=lambda r: r.at)]


class Centred:
    """How rows of whole numbers become rows less their mean, exactly."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        near = [s // n for s in sums]
        #: n times what the mean is above ``near``
        self.rest = [s - n * m for s, m in zip(sums, near)]
        self.near, self.above = np.array(near, np.int64), np.array([r / n for r in self.rest])

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.near) - self.above

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sums of (n * x - S) ** 2, exact; null where that is no long."""
        near = x - self.near
        largest = int(np.abs(near).max(initial=0)) * self.n + self.n
        if largest**2 * max(1, len(self.rest)) < 2**63:
            off = near * self.n - np.array(self.rest, np.int64)
            return (off * off).sum(1).tolist()
        exact = [sum((self.n * v - r) ** 2 for v, r in zip(row, self.rest)) for row in near.tolist()]
        return [v if v < 2**63 else None for v in exact]


def centred(rows: DataFrame) -> Centred:
    """From the sums of all ``rows``: of the upper and of the lower 31 bits, which cannot overflow."""
    n, *both = _summed(rows, lambda x: np.concatenate(([len(x)], (x >> 31).sum(0), (x & 0x7FFFFFFF).sum(0))), "bigint")
    half = len(both) // 2
    return Centred(n, [(high << 31) + low for high, low in zip(both[:half], both[half:])])


def products(rows: DataFrame, a: Centred, w: np.ndarray, ys: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
    """With A the centred rows over the root of their number and u = A w: the sum of all squares of A, that of u, A' u, and what u has of each A y."""
    wide = np.column_stack([w, ys])

    def part(x: np.ndarray) -> np.ndarray:
        c = a.rows(x)
        u = c @ wide
        return np.concatenate(([(c * c).sum()], u[:, 0] @ u, c.T @ u[:, 0])) / a.n

    got = np.array(_summed(rows, part, "double"))
    k = wide.shape[1]
    return got[0], got[1], got[1 + k :], got[2 : 1 + k]


def bidiagonalised(rows: DataFrame, a: Centred, most: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Components as columns, their deviations, largest first, and the sum of all variances.

    It ends when the ``most`` first components have settled and what variance is left is less than that of any of them, at the latest with as many
    steps as there are dimensions. A direction that leads nowhere any more is followed by a new one, at a right angle to all.
    """
    rng, dim = np.random.default_rng(411), len(a.sums)
    vs, ys, back = np.zeros((dim, 0)), np.zeros((dim, 0)), np.zeros((dim, 0))
    upper: list[tuple[int, int, float]] = []  # row, column, value of the bidiagonal matrix
    v, beta, total, scale = None, 0.0, 0.0, 0.0

    def apart(x: np.ndarray) -> np.ndarray:
        for _ in range(2):
            x = x - vs @ (vs.T @ x)
        return x

    while vs.shape[1] < dim:
        if v is None:  # the first direction, and a new one where the last led nowhere
            v, beta = apart(rng.standard_normal(dim)), 0.0
            v /= np.linalg.norm(v)
        j, k = vs.shape[1], ys.shape[1]
        vs = np.column_stack([vs, v])
        w = v - beta * ys[:, -1] if k and beta else v
        if k and beta:
            upper.append((k - 1, j, beta))
        while True:
            total, square, p, along = products(rows, a, w, ys)
            w, p = w - ys @ along, p - back @ along
            left = max(0.0, square - float(along @ along))
            if left <= (RANK * 0.1) ** 2 * max(total, 1e-300) or float(along @ along) <= AGAIN**2 * left:
                break
        alpha = left**0.5
        scale = max(scale, alpha, beta)
        if alpha <= RANK * 0.1 * total**0.5 or total == 0:
            v = None
            continue
        upper.append((k, j, alpha))
        ys, back = np.column_stack([ys, w / alpha]), np.column_stack([back, p / alpha])
        r = apart(p / alpha - alpha * v)
        beta = float(np.linalg.norm(r))
        v = r / beta if beta > SETTLED * scale else None
        if len(vs.T) % 8 and len(vs.T) < dim:
            continue
        found = _solved(upper, ys.shape[1], vs.shape[1])
        first = min(most, dim)
        if len(found[1]) >= first and (beta * np.abs(found[0][-1, :first]) <= SETTLED * found[1][0]).all() and total - (found[1] ** 2).sum() < found[1][first - 1] ** 2:
            break
    left, s, right = _solved(upper, ys.shape[1], vs.shape[1])
    on = s > RANK * s[0] if len(s) else np.zeros(0, bool)
    parts, _ = np.linalg.qr(vs @ right.T[:, : len(s)][:, on]) if on.any() else (np.zeros((dim, 0)), None)
    return parts[:, :most], s[on][:most], total


def _solved(upper: list[tuple[int, int, float]], rows: int, columns: int):
    b = np.zeros((rows, columns))
    for i, j, x in upper:
        b[i, j] = x
    return np.linalg.svd(b, full_matrices=False)


OUT = "component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


@tidy
def whitened(vectors: DataFrame, most: int = 32) -> DataFrame:
    """The whitened coordinates of ``vectors`` (vec_id, embedding): vec_id, component, n, deviation, whitened, explained, identity_error.

    Each entry c counts as the whole number floor(64 * c) + 1000000; all vectors are fitted. One row for each vector and component, of at most
    ``most`` components, by falling variance; fewer where fewer have a deviation above 1e-7 of the largest, as with fewer vectors than dimensions. Equal
    variances share their components in any way. deviation is exact, and null where it is no long.

    Vectors that are null or empty, or that hold null, non-finite or larger numbers than a long holds are left out, and so are those of another length
    than most have (of equally many the longer). Repeated rows count each time; null vec_ids stay. Other columns are ignored. No vectors, or
    equal ones only, give no rows.
    """
    spark, kind = vectors.sparkSession, dict(vectors.select("vec_id").dtypes)["vec_id"]
    fine = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < 1e15)) & (F.size("embedding") > 0), F.lit(False))
    rows = vectors.select("vec_id", "embedding").where(fine)
    sizes = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).limit(1).collect()
    nothing = spark.createDataFrame([], f"vec_id {kind}, {OUT}")
    if not sizes:
        return nothing
    whole = F.transform("embedding", lambda c: F.floor(SCALE * c.cast("double")).cast("bigint") + OFFSET)
    table = written(rows.where(F.size("embedding") == sizes[0].dim).select("vec_id", whole.alias("x")), "whole")
    a = centred(table)
    parts, deviation, total = bidiagonalised(table, a, most)
    if not len(deviation):
        drop(table)
        return nothing
    turn, k = parts / deviation, len(deviation)

    def moments(x: np.ndarray) -> np.ndarray:
        z = a.rows(x) @ turn
        return np.concatenate([z.sum(0), (z.T @ z).ravel()]) / a.n

    got = np.array(_summed(table, moments, "double"))
    error = float(np.abs(got[k:].reshape(k, k) - np.outer(got[:k], got[:k]) - np.eye(k)).max())
    explained = deviation**2 / total

    def out(batches):
        for ids, every in _each(batches):
            for low in range(0, len(every), 1000):
                x = every[low : low + 1000]
                m = len(x)
                of = pa.array(np.repeat(np.arange(m), k))
                number, n = pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, a.n))
                own = pa.array(a.deviations(x), pa.int64()).take(of), pa.array((a.rows(x) @ turn).ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))
                yield pa.RecordBatch.from_arrays([ids.slice(low, m).take(of), number, n, *own], ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return table.mapInArrow(out, f"vec_id {kind}, {OUT}")
