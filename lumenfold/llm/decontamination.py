"""Benchmark decontamination by winnowing, in DataFrame functions only.

A window is ``size`` consecutive words of a benchmark item; a shorter item is one window of its own length. Of each window of a text
the least hash of its runs of ``size // 2`` words is kept: its fingerprint. Equal windows have equal fingerprints, so every shared
span of a window's length has one in common, and neighbouring windows mostly share theirs.

Fingerprints of documents and of the benchmark are joined first. Only the texts that are met go on: each hit is
extended to the windows that have its fingerprint, and those that the benchmark has, by 128 bits of hash, mark their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.llm.shared import drop, identity, tidy, written

#: So many rows at most (16 to 40 bytes each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000

_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Characters beyond ASCII that ``lower`` changes (it knows later ones than the pattern does, which are unassigned there), among others; only texts with one of them take the slow way.
_CASED = r"[\x{80}-\x{10FFFF}&&[\p{Lu}\p{Lt}\p{IsUppercase}\p{Cn}]]"


def words(text: Column) -> Column:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text with A-Z in small letters; null: none."""
    text = F.coalesce(text, F.lit(""))
    lowered = F.when(text.rlike(_CASED), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))
    return F.array_remove(F.split(lowered, _BETWEEN), "")


def _windows(n: Column, length: int) -> Column:
    """The first words, from 0, of the windows of a text of n words."""
    return F.when(n >= length, F.sequence(F.lit(0), n - length)).otherwise(F.expr("cast(array() as array<int>)"))


def _grams(length: int) -> Column:
    """A hash of each run of words of which a window's fingerprint is chosen, from hashes ``h`` of the ``n`` words."""
    k = max(1, length // 2)
    return F.transform(_windows(F.col("n"), k), lambda i: F.xxhash64(F.lit(length), *(F.get("h", i + j) for j in range(k))))


def _fingerprints(length: int) -> Column:
    """Each window's fingerprint, from ``g<length>``."""
    grams, per = f"g{length}", length - max(1, length // 2) + 1
    picks = [lambda s, j=j: F.get(grams, s + j) for j in range(per)]
    return F.transform(_windows(F.col("n"), length), lambda s: F.least(*(p(s) for p in picks)) if per > 1 else picks[0](s))


def _marked(rows: DataFrame, lengths: list[int]) -> DataFrame:
    """``rows`` (w and others) with n and, for each length, f<length>, the fingerprints of its windows. Step by step, so that nothing is worked out twice."""
    rows = rows.withColumns({"n": F.size("w"), "h": F.transform("w", lambda x: F.xxhash64(x))})
    rows = rows.withColumns({f"g{x}": _grams(x) for x in lengths})
    return rows.withColumns({f"f{x}": _fingerprints(x) for x in lengths}).drop("h", *(f"g{x}" for x in lengths))


def _spans(rows: DataFrame, lengths: list[int], *keys: str) -> DataFrame:
    """A row for each window: ``keys``, its first word and the word behind it, its fingerprint and two hashes of its words."""
    out = None
    for x in lengths:
        # a plain explode implies a filter on the array, which would be pushed below the steps of ``_marked`` and merge them into one
        own = rows.select(*keys, "w", F.posexplode_outer(f"f{x}").alias("start", "print")).where("start is not null")
        span = F.slice("w", F.col("start") + 1, x)
        own = own.select(*keys, "start", (F.col("start") + x).alias("stop"), "print", F.xxhash64(span).alias("w1"), F.xxhash64(F.lit("second"), span).alias("w2"))
        out = own if out is None else out.union(own)
    return out


def _small(df: DataFrame, most: int) -> DataFrame:
    """To be broadcast if it has at most ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df


@tidy
def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Of every row of ``docs`` (doc_id, text), what it shares with ``benchmark`` (item_id, text): doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A word is hit if it lies in an occurrence of a window of ``size`` words of an item, or of a whole item that has fewer words. n_items
    counts the items of which a window occurs; items_sha256 is of their ids as strings, in order, joined by commas.

    Null and empty texts have no words, and such items no windows. Items of one id are one item; an item with a null id hits words but is not counted. Repeated
    rows and null doc_ids keep their rows, each judged by its text. Other columns are ignored. An empty benchmark hits nothing; no documents
    give no rows. Tables of more than ``broadcast_rows`` rows are joined by a shuffle instead of a broadcast, with the same result.
    """
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).withColumn("n", F.size("w")).where("n > 0")
    # a shorter item's only window is the whole item
    lengths = sorted(r.x for r in items.select(F.least("n", F.lit(size)).alias("x")).distinct().collect())
    known = None
    for x in lengths:
        own = _spans(_marked(items.where(F.col("n") == x if x < size else F.col("n") >= x).drop("n"), [x]), [x], "item_id")
        known = own if known is None else known.union(own)
    rows = _marked(docs.select("doc_id", *identity(), words(F.col("text")).alias("w")), lengths)
    prints = F.array_distinct(F.concat(*(f"f{x}" for x in lengths))) if lengths else F.expr("cast(array() as array<bigint>)")
    rows = written(rows.select("doc_id", "k", "k2", F.col("n").cast("bigint").alias("n_words"), prints.alias("prints")), "prints")
    out = rows.select("doc_id", "k", "k2", "n_words")
    nothing = F.lit(0).cast("bigint").alias("n_hit"), F.lit(0).cast("bigint").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(False).alias("contaminated")
    if not lengths:
        return out.select("doc_id", "n_words", *nothing)
    known = written(known.drop("start", "stop").distinct(), "windows")
    # windows that the same items have are one class, named by one of them, so that what many items share is not dealt out for each
    sets = known.groupBy("w1", "w2", "print").agg(F.count("item_id").alias("items"), F.bit_xor(F.xxhash64("item_id")).alias("x1"), F.bit_xor(F.xxhash64(F.lit("second"), "item_id")).alias("x2"))
    sets = written(sets, "sets")
    classes = sets.groupBy("items", "x1", "x2").agg(F.min(F.struct("w1", "w2")).alias("c"))
    windows = written(sets.join(classes, ["items", "x1", "x2"]).select("w1", "w2", "print", F.col("c.w1").alias("c1"), F.col("c.w2").alias("c2")), "classes")
    fingerprint = _small(written(windows.select("print").distinct(), "benchmark_prints"), broadcast_rows)

    met = rows.select("k", "k2", F.explode("prints").alias("print")).join(fingerprint, "print", "left_semi").select("k", "k2").distinct()
    met = written(met, "met")
    some = _small(met, broadcast_rows)
    texts = docs.select("text", *identity()).join(some, ["k", "k2"], "left_semi").groupBy("k", "k2").agg(F.first("text").alias("text"))
    spans = _spans(_marked(written(texts, "texts").select("k", "k2", words(F.col("text")).alias("w")), lengths), lengths, "k", "k2")
    found = spans.join(fingerprint, "print", "left_semi").join(_small(windows.drop("print"), broadcast_rows), ["w1", "w2"]).select("k", "k2", "start", "stop", "c1", "c2")
    found = written(found, "found")

    upto = F.max("stop").over(W.partitionBy("k", "k2").orderBy("start", "stop").rowsBetween(W.unboundedPreceding, -1))
    new = found.withColumn("new", F.greatest(F.lit(0), F.col("stop") - F.greatest("start", F.coalesce(upto, F.lit(0)))))
    hit = new.groupBy("k", "k2").agg(F.sum("new").alias("hit"))
    named = known.where("item_id is not null").select(F.col("w1").alias("c1"), F.col("w2").alias("c2"), F.col("item_id").cast("string").alias("item"))
    of = found.select("k", "k2", "c1", "c2").distinct().join(named, ["c1", "c2"]).groupBy("k", "k2").agg(F.array_sort(F.collect_set("item")).alias("items"))
    result = written(hit.join(of, ["k", "k2"], "left").select("k", "k2", "hit", F.coalesce(F.size("items"), F.lit(0)).alias("items"), F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("sha")), "hits")
    out = out.join(_small(result, broadcast_rows), ["k", "k2"], "left")
    n_hit = F.coalesce("hit", F.lit(0)).cast("bigint")
    drop(known, sets, windows, met, found)
    return out.select("doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("items", F.lit(0)).cast("bigint").alias("n_items"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


_SQL_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

#: The same in DuckDB, for tables with one row for each doc_id.
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_SQL_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS size FROM (SELECT item_id, {_SQL_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
known AS (SELECT DISTINCT item_id, size, array_to_string(w[s:s + size - 1], ' ') AS span FROM (SELECT *, unnest(range(1, len(w) - size + 2)) AS s FROM b)),
own AS (SELECT doc_id, size, s, array_to_string(w[s:s + size - 1], ' ') AS span FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS s FROM d, (SELECT DISTINCT size FROM b) WHERE len(w) >= size)),
found AS (SELECT doc_id, own.size, s, item_id FROM own JOIN known ON own.span = known.span AND own.size = known.size),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(s, s + size)) AS pos FROM found) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS id FROM found WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(hit.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items, sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""
