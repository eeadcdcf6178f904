"""Themes: entry vectors, clusters, their distinctive terms and shares by year."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.functions import columns as C
from lumenfold.functions.lexicons import STOPWORDS


def entry_vectors(chunks: DataFrame) -> DataFrame:
    """One unit vector for each entry: the mean of its chunks' by words (none: 1). Zero means are left out. An entry's vectors have one length.

    A task adds its chunks' vectors up before they are dealt, so a row for each entry and task moves, not one for each number.
    """
    w = F.when(F.col("word_count") > 0, F.col("word_count")).otherwise(1).cast("double")
    parts = chunks.where("vector is not null").select("entry_id", w.alias("w"), array_to_vector(F.col("vector").cast("array<double>")).alias("v"))
    mean = parts.groupBy("entry_id").agg(vector_to_array(Summarizer.mean(F.col("v"), F.col("w"))).alias("vector"))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    return mean.withColumn("norm", norm).where("norm > 0").select("entry_id", F.transform("vector", lambda x: x / F.col("norm")).alias("vector"))


def default_k(n: int) -> int:
    """Two to ten, growing with the square root of the entries."""
    return max(2, min(10, round((n / 4) ** 0.5) + 1))


def default_k_of(n):
    """``default_k`` as a column."""
    return F.greatest(F.lit(2), F.least(F.lit(10), F.rint(F.sqrt(n / 4)).cast("int") + 1))


def distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of each row to each centre."""
    return np.stack([((x - c) ** 2).sum(1) for c in centres], 1)


def numbers(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("vector").flatten().to_numpy().reshape(batch.num_rows, -1).astype(np.float64)


def farthest_first(vectors: DataFrame, k: int) -> np.ndarray:
    """Centres to begin with: the vector of the least entry_id, then always the one that is farthest from its nearest centre, the least id of equal ones.

    Fewer where there are fewer different vectors.
    """
    found = vectors.orderBy("entry_id").limit(1).collect()
    centres = [found[0].vector]
    while len(centres) < k:
        known = np.array(centres)

        def far(batches):
            for batch in batches:
                if batch.num_rows:
                    d = distances(numbers(batch), known).min(1)
                    top = pa.array(np.flatnonzero(d == d.max()))  # of equal ones the least id is chosen below
                    yield pa.RecordBatch.from_arrays([batch.column("entry_id").take(top), batch.column("vector").take(top), pa.array(d).take(top)], ["entry_id", "vector", "d"])

        best = vectors.mapInArrow(far, "entry_id string, vector array<double>, d double").orderBy(F.desc(C.rounded(F.col("d"), 12)), "entry_id").limit(1).collect()
        if best[0].d <= 0:
            break
        centres.append(best[0].vector)
    return np.array(centres)


def assigned(vectors: DataFrame, centres: np.ndarray) -> DataFrame:
    """entry_id, theme_id: the nearest centre, the first of equally near ones."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("entry_id"), pa.array(distances(numbers(batch), centres).argmin(1).astype(np.int32))], ["entry_id", "theme_id"])

    return vectors.mapInArrow(run, "entry_id string, theme_id int")


def moved(vectors: DataFrame, centres: np.ndarray) -> np.ndarray:
    """The means of what is nearest to each centre; a centre without any stays. Each task sends its sums only."""
    k, dim = centres.shape

    def run(batches):
        total = np.zeros((k, dim + 1))
        for batch in batches:
            if batch.num_rows:
                x = numbers(batch)
                np.add.at(total, distances(x, centres).argmin(1), np.column_stack([x, np.ones(len(x))]))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * (dim + 1))), pa.array(total.ravel())], ["at", "x"])

    sums = vectors.mapInArrow(run, "at bigint, x double").groupBy("at").agg(F.sum("x").alias("x")).collect()  # numbers of the centres only
    total = np.zeros(k * (dim + 1))
    total[[r.at for r in sums]] = [r.x for r in sums]
    total = total.reshape(k, dim + 1)
    return np.where(total[:, -1:] > 0, total[:, :-1] / np.maximum(total[:, -1:], 1), centres)


def clusters(vectors: DataFrame, k: int | None = None, rounds: int = 60) -> DataFrame:
    """entry_id, theme_id by k-means on (entry_id, vector), vectors of one length: at most ``rounds`` rounds, or until no centre moves.

    It begins with ``farthest_first``; of equally near centres the first counts, a centre without vectors stays where it is. So the result depends on the
    vectors alone. Centres are the driver's, sums are made in tasks.
    """
    n = vectors.count()
    if not n:
        return vectors.select("entry_id", F.lit(0).alias("theme_id"))
    centres = farthest_first(vectors, min(k or default_k(n), n))
    for _ in range(rounds):
        before, centres = centres, moved(vectors, centres)
        if np.abs(centres - before).max() < 1e-12:
            break
    return assigned(vectors, centres)


def word_counts(texts: DataFrame, *keys: str, stopwords=STOPWORDS) -> DataFrame:
    words = texts.select(*keys, F.explode(C.theme_words(F.coalesce("text", F.lit("")))).alias("term"))
    return words.where(~F.col("term").isin(*sorted(stopwords))).groupBy(*keys, "term").agg(F.count("*").alias("n"))


def theme_terms(texts: DataFrame, n: int = 4, stopwords=STOPWORDS) -> DataFrame:
    """The most distinctive words of each theme (entry_id, theme_id, text): its share of words against all texts'.

    Words that a theme has once count only where it has no other; shares are of the words that are left.
    """
    local = word_counts(texts, "theme_id", stopwords=stopwords)
    corpus = local.groupBy("term").agg(F.sum("n").alias("all_n"))
    # one row for each theme, ten unless more were asked for: what its words sum up to, those that it has once only where it has no other
    theme = local.groupBy("theme_id").agg(F.max("n").alias("most"), F.sum("n").alias("every"), F.sum(F.when(F.col("n") >= 2, F.col("n"))).alias("often"))
    theme = theme.select("theme_id", "most", F.when(F.col("most") < 2, F.col("every")).otherwise(F.col("often")).alias("own"), "every")
    total = theme.agg(F.sum("every").alias("total"))
    local = local.join(F.broadcast(theme.drop("every")), "theme_id").where("n >= 2 or most < 2").join(corpus, "term").join(F.broadcast(total))
    p, q = F.col("n") / F.col("own"), F.col("all_n") / F.col("total")
    scored = local.withColumn("score", C.rounded(p * F.log(p / (q + 1e-9) + 1e-9), 8))
    best = W.partitionBy("theme_id").orderBy(F.desc("score"), "term")
    return scored.withColumn("nth", F.row_number().over(best)).where(F.col("nth") <= n).select("theme_id", "nth", "term", "score")


def themes(members: DataFrame, terms: DataFrame) -> DataFrame:
    """theme_id, label (the first three terms, numbered where labels are equal), terms, size; largest first."""
    words = terms.groupBy("theme_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "term"))), lambda x: x["term"]).alias("terms"))
    size = members.groupBy("theme_id").agg(F.count("*").alias("size")).join(words, "theme_id", "left")
    label = F.coalesce(F.array_join(F.slice("terms", 1, 3), ", "), F.concat(F.lit("theme "), F.col("theme_id") + 1))
    named = size.withColumn("label", label).withColumn("nth", F.row_number().over(W.partitionBy("label").orderBy(F.desc("size"), "theme_id")))
    full = F.when(F.col("nth") > 1, F.concat("label", F.lit(" ("), "nth", F.lit(")"))).otherwise(F.col("label"))
    return named.select("theme_id", full.alias("label"), "terms", "size").orderBy(F.desc("size"), "theme_id")


def year_share(assigned: DataFrame) -> DataFrame:
    """The share of each label among a year's entries (year, label); labels that a year lacks are left out."""
    counts = assigned.groupBy("year", "label").agg(F.count("*").alias("n"))
    return counts.select("year", "label", C.rounded(F.col("n") / F.sum("n").over(W.partitionBy("year")), 3).alias("share"))
