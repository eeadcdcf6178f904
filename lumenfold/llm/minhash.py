"""MinHash near-dedup with bottom-k sketches of one hash function.

Each text's set of distinct word shingles is hashed once; the ``k`` smallest hashes are
its sketch. Inverted lists of retained values bring texts together, the sketch of the
union estimates the similarity, and full sets decide.

How the lists stay short, and no list's pairs are all emitted:

* Texts with equal sets are one node from the start.
* Two sets with similarity ``t`` share about ``t * k`` of the ``k`` smallest values of their
  union. Less than ``FLOOR * k``, 12 of 32, happens with a chance of 2.6e-8 at 0.8 and 1.2e-10 at 0.85 (binomial).
  By the prefix principle it is enough to list a node under its ``k - FLOOR * k + 1``
  rarest values: a line that a third of all texts share is hardly among them.
* Every list first links its members to one leader, the one with the most common values. After these
  links are confirmed and joined to components, only members of one list in *different*
  components are still of interest.
* What is left of a list of at most ``SHORT`` members is compared directly.
* In a longer one every member is held against one text L, the best linked one of the leader's component, by its
  symmetric difference D(X) to L's full set. Say two members are linked, but X not with L. With s(X, Y) the size of a symmetric
  difference, linked means s(X, Y) <= u * (|X| + |Y|) for u = (1 - t) / (1 + t), so that
  2 * |D(X) & D(Y)| = s(X, L) + s(Y, L) - s(X, Y) > 0 unless Y is L. So members meet in lists by the
  values of their differences, which independent edits of one text hardly share, and no link is lost. The
  prefix principle applies here too: D(X) and D(Y) differ where X and Y do, in at most u * (|X| + |X| / t) = |X| * (1 - t) / t
  values, so of each difference the first |X| * (1 - t) / t + 1 values are enough, in any one order for L, and no others become rows.
  The order only decides how many meet: values that are frequent in the differences of ``FEW`` members come last.
* Each text also has an odd sketch: ``ODD`` longs whose bits tell whether an odd number of its values fell there. As
  every value in which two sets differ flips one bit, no more bits can differ than the sets do; pairs
  above the difference that a link allows are never made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.llm.graphs import components
from lumenfold.llm.shared import identity, shingle_hashes, slices, text_bytes, unused, word_hashes, tidy, written

#: Of the values in a sketch, the share that two linked sets surely have in common.
FLOOR = 0.375
#: How far an estimate from a sketch may lie below the threshold: 12 of 32 values are enough at 0.8 (fewer: 2.6e-8), 14 at 0.85 (1.0e-8).
SLACK = 0.43
#: Lists up to this length are compared pair by pair.
SHORT = 24
ODD = 8
#: Members of a long list that the order of values is taken from, and the most values that it puts last; neither changes a result.
FEW, FREQUENT = 32, 1024


def _sets(batch: pa.RecordBatch, shingle: int) -> Iterator[np.ndarray]:
    for _, _, data, bounds in slices(batch, "text"):
        h, before = word_hashes(data, bounds)
        for a, b in zip(before[:-1], before[1:]):
            yield np.unique(shingle_hashes(h[a:b], shingle))


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes()) if len(s) else b""


def _odd(s: np.ndarray) -> np.ndarray:
    at = (s >> np.uint64(32)) * np.uint64(64 * ODD) >> np.uint64(32)
    bits = np.bincount(at.astype(np.int64), minlength=64 * ODD) & 1
    return np.packbits(bits.astype(np.uint8)).view(np.int64)


def _sketcher(shingle: int, k: int):
    def run(batches):
        for batch in batches:
            digest, size, sketch, odd = [], [], [], []
            for s in _sets(batch, shingle):
                digest.append(_digest(s))
                size.append(len(s))
                sketch.append(s[:k].view(np.int64))
                odd.append(_odd(s))
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, ("doc_id", "k", "k2")), pa.array(digest, pa.binary()), pa.array(size, pa.int64()), pa.array(sketch, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))],
                ["doc_id", "k", "k2", "digest", "n_shingles", "sketch", "odd"],
            )

    return run


def _full(shingle: int):
    def run(batches):
        for batch in batches:
            sets = list(_sets(batch, shingle))
            yield pa.RecordBatch.from_arrays([pa.array(map(_digest, sets), pa.binary()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["digest", "shingles"])

    return run


def _frequent(batches):
    """Of the values ``es`` of each row those that come more than once, the most frequent last."""
    for batch in batches:
        last = []
        for es in batch.column("es"):
            values, n = np.unique(es.values.to_numpy(), return_counts=True)
            last.append(values[np.lexsort((values, n))][np.sort(n) > 1][-FREQUENT:])
        yield pa.RecordBatch.from_arrays([batch.column("a"), pa.array(last, pa.list_(pa.int64()))], ["a", "last"])


def _estimate(k: int):
    """Of the k smallest values of the union, the share in both sketches; above k values the union's sketch is theirs."""
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, k)
    return F.size(F.array_intersect(F.array_intersect("sa", "sb"), union)) / F.size(union)


def _full_sets(digests: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int) -> DataFrame:
    wanted = digests.distinct().join(nodes.select("digest", "rep"), "digest").select("rep.k", "rep.k2")
    full = docs.join(wanted, ["k", "k2"], "left_semi").select(*text_bytes()).mapInArrow(_full(shingle), "digest binary, shingles array<bigint>")
    return written(full.groupBy("digest").agg(F.first("shingles").alias("shingles")), "full")


def _with_sets(pairs: DataFrame, full: DataFrame) -> DataFrame:
    side = lambda c: full.select(F.col("digest").alias(c), F.col("shingles").alias(f"f{c}"))
    return pairs.join(side("b"), "b").join(side("a"), "a")


def _may(percent: int, x: str, y: str) -> str:
    """Sizes and odd sketches allow the similarity."""
    apart = " + ".join(f"bit_count({x}odd[{i}] ^ {y}odd[{i}])" for i in range(ODD))
    return f"100 * least({x}n, {y}n) >= {percent} * greatest({x}n, {y}n) and {100 + percent} * ({apart}) <= {100 - percent} * ({x}n + {y}n)"


def _confirmed(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, k: int, percent: int) -> DataFrame:
    """Of the pairs (a, b) of digests, those whose full sets are similar enough."""
    side = lambda c: nodes.select(F.col("digest").alias(c), F.col("n").alias(f"{c}n"), F.col("sketch").alias(f"s{c}"), F.col("odd").alias(f"{c}odd"))
    near = pairs.join(side("a"), "a").join(side("b"), "b").where(_may(percent, "a", "b")).where(_estimate(k) >= percent / 100 - SLACK)
    near = written(near.select("a", "b", F.col("an").alias("na"), F.col("bn").alias("nb")), "near")
    full = _full_sets(near.select(F.col("a").alias("digest")).union(near.select("b")), nodes, docs, shingle)
    both = _with_sets(near, full).select("a", "b", "na", "nb", F.size(F.array_intersect("fa", "fb")).alias("i"))
    return both.where(100 * F.col("i") >= percent * (F.col("na") + F.col("nb") - F.col("i"))).select("a", "b")


def _pair(x: str, y: str):
    return [F.least(x, y).alias("b"), F.greatest(x, y).alias("a")]


def _leaders(lists: DataFrame) -> DataFrame:
    """Of each list, the member with the most common values."""
    lead = F.min(F.struct((-F.col("weight")).alias("o"), F.col("digest").alias("lead"))).alias("x")
    return written(lists.groupBy("v").agg(lead, F.count("*").alias("members")).where("members > 1").select("v", "x.lead", "members"), "leaders")


def _centres(links: DataFrame, of: DataFrame) -> DataFrame:
    """For every linked node the node of its component that has the most links so far."""
    degree = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("links"))
    best = of.join(degree, "node").groupBy("component").agg(F.max(F.struct("links", "node")).alias("x")).select("component", F.col("x.node").alias("centre"))
    return of.join(best, "component").select(F.col("node").alias("lead"), "centre")


def _rest(lists: DataFrame, links: DataFrame, of: DataFrame, nodes: DataFrame, docs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Pairs in different components of one list that may be linked."""
    with_c = nodes.select("digest", "n", "odd").join(of.select(F.col("node").alias("digest"), "component"), "digest", "left")
    with_c = written(with_c.select("digest", "n", "odd", F.coalesce("component", "digest").alias("c")), "placed")
    placed = lists.join(with_c.select("digest", "c"), "digest")
    mixed = placed.groupBy("v").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("v")
    left = written(lists.join(mixed, "v", "left_semi").select("v", "digest", "lead", "members"), "left")
    allowed = F.expr(f"x.c < y.c and {_may(percent, 'x.', 'y.')}")
    short = left.where(F.col("members") <= SHORT).select("v", "digest").join(with_c, "digest")
    pairs = short.alias("x").join(short.alias("y"), F.expr("x.v = y.v") & allowed).select(*_pair("x.digest", "y.digest"))
    # any L will do, as long as what meets in a list has the same: one for each component, whatever the list
    long = left.where(F.col("members") > SHORT).join(_centres(links, of), "lead", "left").withColumn("lead", F.coalesce("centre", "lead"))
    long = written(long.where("digest <> lead").select("lead", "digest").distinct(), "long")
    if long.isEmpty():
        return pairs.distinct()

    full = _full_sets(long.select("digest").union(long.select("lead")), nodes, docs, shingle)
    apart = _with_sets(long.select(F.col("digest").alias("b"), F.col("lead").alias("a")), full)
    apart = apart.select("a", F.col("b").alias("digest"), F.array_union(F.array_except("fa", "fb"), F.array_except("fb", "fa")).alias("es"))
    apart = written(apart.join(with_c.select("digest", "n", "c"), "digest"), "apart")
    few = long.select(F.col("lead").alias("a"), "digest", F.row_number().over(Window.partitionBy("lead").orderBy("digest")).alias("i")).where(f"i <= {FEW}")
    last = apart.join(few, ["a", "digest"], "left_semi").groupBy("a").agg(F.flatten(F.collect_list("es")).alias("es"))
    last = written(last.mapInArrow(_frequent, "a binary, last array<bigint>"), "last")
    # every member lists the first of its values; array_intersect keeps the order of ``last``
    ordered = F.concat(F.array_sort(F.array_except("es", "last")), F.array_intersect("last", "es"))
    first = F.slice(ordered, F.lit(1), F.expr(f"int(n * {100 - percent} div {percent}) + 1"))
    first = written(apart.join(last, "a").select("a", "digest", "c", F.explode(first).alias("e")), "first")
    # values of one component alone bring nobody together
    common = first.groupBy("a", "e").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("a", "e")
    met = first.join(common, ["a", "e"], "left_semi").groupBy("a", "digest").agg(F.collect_list("e").alias("es")).select("a", "digest", "es", F.explode("es").alias("e"))
    met = written(met.join(with_c, "digest"), "met")
    # two members may share several values; they meet under the least of them only
    once = F.expr("x.a = y.a and x.e = y.e and array_min(array_intersect(x.es, y.es)) = x.e")
    far = met.alias("x").join(met.alias("y"), once & allowed).select(*_pair("x.digest", "y.digest"))
    return pairs.union(far).union(long.select(*_pair("digest", "lead"))).distinct()


def _classes(docs: DataFrame, shingle: int, percent: int, k: int) -> tuple[DataFrame, DataFrame]:
    """Rows of doc_id, k, k2, digest, n_shingles, and for every digest (of not empty sets) its component, named by a digest."""
    sketched = "doc_id bigint, k bigint, k2 bigint, digest binary, n_shingles bigint, sketch array<bigint>, odd array<bigint>"
    docs = docs.select("doc_id", "text", *identity("text", "doc_id"))
    rows = written(docs.select(*text_bytes("doc_id", "text", "k", "k2")).mapInArrow(_sketcher(shingle, k), sketched), "sketches")
    nodes = written(rows.where("n_shingles > 0").groupBy("digest").agg(F.min(F.struct("k", "k2")).alias("rep"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"), F.first("odd").alias("odd")), "nodes")

    listed = nodes.select("digest", F.size("sketch").alias("kept"), F.explode("sketch").alias("v"))
    common = written(listed.groupBy("v").agg(F.count("*").alias("df")).where("df > 1"), "common")
    shared = listed.join(common, "v").groupBy("digest").agg(F.first("kept").alias("kept"), F.sum("df").alias("weight"), F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"))
    # values of no other sketch are the rarest, and their lists bring nobody together
    prefix = F.col("kept") - F.ceil(FLOOR * F.col("kept")) + 1 - (F.col("kept") - F.size("vs"))
    lists = shared.where(prefix > 0).select("digest", "weight", F.explode(F.slice("vs", 1, prefix.cast("int"))).alias("x")).select("digest", "weight", F.col("x.v").alias("v"))
    lists = written(lists, "lists")
    lists = written(lists.join(_leaders(lists), "v"), "led")

    pairs = lists.where("digest <> lead").select(*_pair("digest", "lead")).distinct()
    links = written(_confirmed(pairs, nodes, docs, shingle, k, percent), "links")
    found = _confirmed(_rest(lists, links, written(components(links), "components"), nodes, docs, shingle, percent), nodes, docs, shingle, k, percent)
    of = components(written(links.union(found), "links"))
    return rows, nodes.select("digest").join(of.select(F.col("node").alias("digest"), "component"), "digest", "left").withColumn("component", F.coalesce("component", "digest"))


@tidy
def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, k: int = 32) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a text with fewer than
    ``shingle`` words has its whole sequence as one shingle. Two texts are linked where
    100 * intersection >= percent * union, both sets of 64-bit hashes of word sequences. component_id is the smallest doc_id that links reach.

    Null, empty and blank texts have n_shingles 0 and are linked with nothing. Repeated rows and
    equal texts are in one component, and each keeps its row. Rows with a null doc_id keep
    theirs too; a component of only such rows has a null component_id. Columns beside doc_id
    and text are ignored, whatever their names. An empty table gives no rows.
    """
    docs = docs.select("doc_id", "text")
    rows, member = _classes(docs, shingle, percent, k)
    member = written(member, "member")
    first = rows.select("doc_id", "digest").join(member, "digest").groupBy("component").agg(F.min("doc_id").alias("first"))
    ids = written(member.join(first, "component").select("digest", "first"), "ids")
    out = rows.select("doc_id", "n_shingles", "digest").join(ids, "digest", "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("first")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


@tidy
def without_near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, k: int = 32) -> DataFrame:
    """``docs`` with one row of each group that ``near_duplicates`` links, and all rows of texts without words.

    The row that stays has the smallest doc_id (null last); of several texts with that id the one with the least hash, of equal
    rows any one. Decisions are on rows, never on doc_id alone: another text under an id that goes elsewhere is not touched.
    All columns stay as they are, whatever their names. An empty table gives no rows.
    """
    rows, member = _classes(docs.select("doc_id", "text"), shingle, percent, k)
    place = F.struct(F.isnull("doc_id").alias("last"), "doc_id", "k", "k2")
    placed = rows.select("doc_id", "k", "k2", "digest").join(written(member, "member"), "digest").groupBy("component", "k", "k2").agg(F.min(place).alias("place"), F.count("*").alias("n"))
    placed = written(placed, "placed")
    best = written(placed.groupBy("component").agg(F.min("place").alias("best")), "best")
    # of most groups there is one row: only those that lose rows go on
    lost = written(placed.join(best, "component").select("k", "k2", (F.col("place") == F.col("best")).alias("stays"), "n").where("not stays or n > 1"), "lost")
    a, b = (unused(docs, c) for c in ("k_of_row", "k2_of_row"))
    keyed = docs.withColumns(dict(zip((a, b), identity("text", "doc_id"))))
    names = [F.col(f"`{c}`") for c in docs.columns]
    untouched = keyed.join(lost.select(F.col("k").alias(a), F.col("k2").alias(b)), [a, b], "left_anti").select(*names)
    repeated = keyed.join(lost.where("stays").select(F.col("k").alias(a), F.col("k2").alias(b)), [a, b], "left_semi")
    return untouched.union(repeated.dropDuplicates([a, b]).select(*names))
