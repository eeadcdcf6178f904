"""Embedding near-dedup by lattice hashing.

Each table projects a unit vector to 8 random orthonormal directions and decodes the result to the nearest point of
the E8 lattice, the densest packing there. A vector lies in the cell of its point, and looks into that cell and
into the neighbouring ones that it is nearest to. Cells deal vectors, as 8-bit numbers, into groups; a cell with many is
cut into blocks that meet one another, so no group is unbounded and no pair is left out. Pairs near enough by
those numbers are verified in double precision on the vectors themselves.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.graphs import components
from lumenfold.llm.shared import drop, mix, tidy, written

TABLES, PROBES = 8, 6
#: Lattice units for a distance of 1 between unit vectors.
STRETCH = 2.0
#: Rows of one side of a block.
BLOCK = 1024
#: How much 8-bit numbers may lower a cosine.
QUANTUM = 0.02


def _decode(x: np.ndarray) -> np.ndarray:
    """Twice the nearest point of E8 to each row: of D8 or of D8 moved by halves."""
    best = None
    for shift in (0.0, 0.5):
        y = np.rint(x - shift)
        gap = x - shift - y
        odd = np.flatnonzero(y.sum(1).astype(np.int64) & 1)
        worst = np.abs(gap[odd]).argmax(1)
        y[odd, worst] += np.where(gap[odd, worst] >= 0, 1, -1)
        y += shift
        far = ((x - y) ** 2).sum(1)
        best = (y, far) if best is None else (np.where((far < best[1])[:, None], y, best[0]), np.minimum(far, best[1]))
    return np.rint(2 * best[0]).astype(np.int64)


@lru_cache(1)
def _neighbours() -> np.ndarray:
    """Twice the 240 shortest vectors of E8."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((2, -2), repeat=2):
            v = [0] * 8
            v[i], v[j] = a, b
            out.append(v)
    out += [v for v in product((1, -1), repeat=8) if v.count(-1) % 2 == 0]
    return np.array(out, np.int64)


@lru_cache(64)
def _directions(dim: int, table: int) -> np.ndarray:
    rng = np.random.default_rng((97, dim, table))
    q, _ = np.linalg.qr(rng.standard_normal((dim, min(8, dim))))
    return np.pad(q, ((0, 0), (0, 8 - q.shape[1]))) * np.sqrt(dim / min(8, dim)) * STRETCH


def _key(points: np.ndarray, table: int) -> np.ndarray:
    h = np.full(points.shape[:-1], table + 1, np.uint64)
    for i in range(8):
        h = mix(h * np.uint64(0x9E3779B97F4A7C1B) + points[..., i].astype(np.uint64))
    return h.view(np.int64)


def cells(unit: np.ndarray, table: int) -> tuple[np.ndarray, np.ndarray]:
    """Each vector's own cell, and those that it looks into."""
    x = unit @ _directions(unit.shape[1], table)
    own = _decode(x)
    rest = 2 * x - own
    near = _neighbours()
    # |rest - v|^2 without the part that all v share: every v has the same length
    order = np.argpartition(-(rest @ near.T), PROBES, axis=1)[:, :PROBES]
    return _key(own, table), np.concatenate([_key(own, table)[:, None], _key(own[:, None, :] + near[order], table)], 1)


def _deal(batches):
    for batch in batches:
        embedding, label, node = (batch.column(c) for c in ("embedding", "label", "node"))
        sizes = embedding.value_lengths().to_numpy().astype(np.int64)
        for dim in np.unique(sizes):
            rows = np.flatnonzero(sizes == dim)
            for some in np.array_split(rows, max(1, len(rows) // 2000)):
                v = embedding.take(pa.array(some)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(some), -1)
                v /= np.abs(v).max(1, keepdims=True)
                v /= np.linalg.norm(v, axis=1, keepdims=True)
                small = np.rint(v * 127).astype(np.int8)
                small = pa.array([r.tobytes() for r in small], pa.binary())
                at = pa.array(some)
                for table in range(TABLES):
                    own, look = cells(v, table)
                    for column, looks in ((own[:, None], False), (look, True)):
                        for i in range(column.shape[1]):
                            n = len(some)
                            yield pa.RecordBatch.from_arrays([label.take(at), pa.array(np.full(n, dim)), pa.array(column[:, i]), pa.array(np.full(n, looks)), node.take(at), small], ["label", "dim", "cell", "looks", "node", "small"])


def _close(least: float):
    """Pairs near enough by their 8-bit numbers, from rows that come by cell and block; one pass goes through many cells."""

    def pairs(rows: pa.RecordBatch, cut: np.ndarray):
        node, looks = rows.column("node").to_numpy(), rows.column("looks").to_numpy(zero_copy_only=False)
        dims = rows.column("dim").to_numpy()
        at = np.concatenate(([0], np.cumsum(dims)))
        raw = np.frombuffer(b"".join(rows.column("small").to_pylist()), np.int8)
        out = [np.zeros((0, 2), np.int64)]
        for a, b in zip(cut[:-1], cut[1:]):
            x = raw[at[a] : at[b]].reshape(b - a, -1).astype(np.float32)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            own, other = np.flatnonzero(~looks[a:b]), np.flatnonzero(looks[a:b])
            i, j = np.nonzero(x[own] @ x[other].T >= least - QUANTUM)
            p, q = node[a + own[i]], node[a + other[j]]
            out.append(np.stack([np.minimum(p, q), np.maximum(p, q)], 1)[p != q])
        found = np.unique(np.concatenate(out), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], ["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            rows = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
            dim, group = rows.column("dim").to_numpy(), rows.column("part").to_numpy()
            cut = np.flatnonzero(np.concatenate(([True], (group[1:] != group[:-1]) | (dim[1:] != dim[:-1]))))
            held = rows.slice(cut[-1])  # the last cell may go on
            if len(cut) > 1:
                yield pairs(rows, cut)
        if held is not None:
            yield pairs(held, np.array([0, held.num_rows]))

    return run


def _verify(least: float):
    def run(batches):
        for batch in batches:
            size = batch.column("ea").value_lengths().to_numpy()
            cosine = np.zeros(len(size))
            for dim in np.unique(size):
                rows = np.flatnonzero(size == dim)
                x, y = (batch.column(c).take(pa.array(rows)).flatten().to_numpy().astype(np.float64).reshape(len(rows), -1) for c in ("ea", "eb"))
                cosine[rows] = (x * y).sum(1) / (np.sqrt((x * x).sum(1)) * np.sqrt((y * y).sum(1)))
            on = pa.array(np.flatnonzero(cosine >= least))
            yield pa.RecordBatch.from_arrays([batch.column("a").take(on), batch.column("b").take(on)], ["a", "b"])

    return run


@tidy
def near_vectors(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """One row per row of ``vectors`` (vec_id, embedding, label): vec_id, n_links, component_id, kept.

    Rows with equal, not null labels are linked where the cosine is at least ``least`` and their pair was found; none
    below it. Vectors that are null, empty, zero or hold nulls or non-finite numbers have no links, and so have vectors of
    different lengths. n_links counts other rows: equal vectors, repeated rows included, link with each other. Null
    vec_ids stay, and count as others' links. Other columns are ignored; an empty table gives no rows.
    """
    e = F.col("embedding")
    fine = F.coalesce(F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0), F.lit(False)) & F.col("label").isNotNull()
    numbers = F.transform(e, lambda x: x + F.lit(0.0).cast("float"))  # 0.0 and -0.0 are one
    # equal vectors with one label are one node
    own = [F.when(fine, F.xxhash64(*salt, "label", numbers)).alias(c) for c, salt in (("v1", []), ("v2", [F.lit("second")]))]
    rows = written(vectors.select("vec_id", "embedding", "label", *own), "vectors")
    nodes = rows.where("v1 is not null").groupBy("v1", "v2").agg(F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count("*").alias("copies"), F.min("vec_id").alias("first"))
    nodes = written(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    dealt = nodes.select("node", "label", "embedding").mapInArrow(_deal, f"label {dict(rows.dtypes)['label']}, dim bigint, cell bigint, looks boolean, node bigint, small binary")
    dealt = written(dealt, "dealt")
    place = ["label", "dim", "cell"]
    size = dealt.groupBy(*place).agg(F.count(F.when(~F.col("looks"), 1)).alias("held"), F.count(F.when(F.col("looks"), 1)).alias("looking")).where("held > 0 and looking > 1")
    size = written(size.select(*place, F.ceil(F.col("held") / BLOCK).cast("int").alias("hb"), F.ceil(F.col("looking") / BLOCK).cast("int").alias("lb")), "sizes")
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    all_blocks = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    dealt = dealt.join(size, place)
    # each of a cell's blocks of held vectors meets each of its blocks of looking ones
    h = F.explode(F.when(F.col("looks"), all_blocks("hb")).otherwise(F.array(block("hb"))))
    l = F.when(F.col("looks"), F.array(block("lb"))).otherwise(all_blocks("lb"))  # noqa: E741
    parts = dealt.withColumn("ls", l).withColumn("h", h).withColumn("l", F.explode("ls")).withColumn("part", F.xxhash64("label", "cell", "h", "l"))
    parts = parts.select("dim", "part", "looks", "node", "small").repartition("dim", "part").sortWithinPartitions("dim", "part")
    pairs = written(parts.mapInArrow(_close(least), "a bigint, b bigint").distinct(), "pairs")
    full = lambda c: nodes.select(F.col("node").alias(c), F.col("embedding").alias(f"e{c}"), F.col("label").alias(f"l{c}"))
    both = pairs.join(full("a"), "a").join(full("b"), "b").where("la = lb and size(ea) = size(eb)").select("a", "b", "ea", "eb")
    links = written(both.mapInArrow(_verify(least), "a bigint, b bigint"), "links")
    drop(dealt, size, pairs)
    ends = links.union(links.select("b", "a")).toDF("node", "other")
    degree = ends.join(nodes.select(F.col("node").alias("other"), "copies"), "other").groupBy("node").agg(F.sum("copies").alias("far"))
    of = components(links)
    member = nodes.select("node", "v1", "v2", "copies", "first").join(of, "node", "left").withColumn("component", F.coalesce("component", "node"))
    first = written(member.groupBy("component").agg(F.min("first").alias("component_id")), "first")
    known = member.join(first, "component").join(degree, "node", "left").select("v1", "v2", "component_id", (F.col("copies") - 1 + F.coalesce("far", F.lit(0))).alias("n"))
    out = rows.select("vec_id", "v1", "v2").join(written(known, "known"), ["v1", "v2"], "left")
    own_id = F.when(F.col("v1").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), own_id.alias("component_id"), F.coalesce(F.col("vec_id") == own_id, F.lit(False)).alias("kept"))
