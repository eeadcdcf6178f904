"""Dense, BM25 and fused retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.functions import columns as C


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def dense_topk(vectors: DataFrame, query: list[float], k: int = 40, key: str = "id") -> DataFrame:
    """The nearest vectors, with their rank from 0; exact, by one scan of all of them. Filter by date before, so that the filter reaches the scan."""
    far = vectors.where("vector is not null").select(key, C.rounded(squared_distance(F.col("vector"), F.array(*map(F.lit, query))), 6).alias("distance"))
    return _ranked(far, k, F.col("distance"), F.col(key))


def _ranked(df: DataFrame, k: int, *order: Column) -> DataFrame:
    best = df.orderBy(*order).limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(*order)) - 1)  # k rows at most


def postings(docs: DataFrame, key: str = "id") -> DataFrame:
    """term, id, tf and the text's length dl: the inverted index as a table. A text without words has one row, with a null term."""
    words = docs.select(F.col(key).alias("id"), C.tokens(F.coalesce("text", F.lit(""))).alias("words"))
    words = words.select("id", F.size("words").alias("dl"), F.explode_outer("words").alias("term"))
    return words.groupBy("term", "id", "dl").agg(F.count("term").cast("int").alias("tf"))


def lengths(docs: DataFrame, *keys: str) -> DataFrame:
    """``keys`` and dl, the tokens of each text."""
    return docs.select(*keys, F.size(C.tokens(F.coalesce("text", F.lit("")))).alias("dl"))


def collection(index: DataFrame) -> DataFrame:
    """One row: the texts of an index and their mean length. ``index``: postings, all of them."""
    return index.agg(F.countDistinct("id").alias("n"), F.sum("tf").alias("words")).select("n", (F.col("words") / F.col("n")).alias("avgdl"))


def query_terms(spark, query: str) -> list[str]:
    return sorted(set(spark.range(1).select(C.tokens(F.lit(query)).alias("t")).first().t))


def bm25_of(index: DataFrame, whole: DataFrame, query: str, k: int = 40, allowed: DataFrame | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Best matches in stored postings with their rank from 0; ``whole``: the row of ``collection``, ``allowed``: ids that may be found.

    Only the postings of the query's terms are read: the filter reaches the scan.
    """
    terms = query_terms(index.sparkSession, query)
    own = index.where(F.col("term").isin(*terms))
    df = own.groupBy("term").agg(F.count("*").alias("df"))  # as many rows as the query has terms
    hits = own.join(allowed, "id", "left_semi") if allowed is not None else own
    scored = hits.join(F.broadcast(df), "term").join(F.broadcast(whole))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return _ranked(scored.groupBy("id").agg(C.rounded(F.sum(part), 6).alias("score")), k, F.desc("score"), F.col("id"))


def bm25_topk(docs: DataFrame, query: str, k: int = 40, key: str = "id", allowed: Column | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Best matches in texts without an index, with their rank from 0. Statistics are of the whole collection; ``allowed`` limits the candidates.

    Every text is read once, and leaves a row of its length and its counts of the query's terms, from which statistics and scores come.
    """
    terms = query_terms(docs.sparkSession, query)
    if not terms:
        return docs.sparkSession.createDataFrame([], "id string, score double, rank int")
    words = docs.select(F.col(key).alias("id"), (allowed if allowed is not None else F.lit(True)).alias("allowed"), F.explode_outer(C.tokens(F.coalesce("text", F.lit("")))).alias("word"))
    counted = words.groupBy("id", "allowed").agg(F.count("word").alias("dl"), F.array(*(F.count_if(F.col("word") == t) for t in terms)).alias("tf"))
    stats = counted.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), F.array(*(F.count_if(F.get("tf", F.lit(i)) > 0) for i in range(len(terms)))).alias("df"))
    part = lambda i: F.log(1 + (F.col("n") - F.get("df", F.lit(i)) + 0.5) / (F.get("df", F.lit(i)) + 0.5)) * F.get("tf", F.lit(i)) * (k1 + 1) / (F.get("tf", F.lit(i)) + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    score = sum((part(i) for i in range(1, len(terms))), part(0))
    hits = counted.where("allowed").where(F.exists("tf", lambda x: x > 0)).join(F.broadcast(stats)).select("id", C.rounded(score, 6).alias("score"))
    return _ranked(hits, k, F.desc("score"), F.col("id"))


def fused(dense: DataFrame, sparse: DataFrame, k: int = 8, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists (id, rank)."""
    both = dense.select("id", F.col("rank").alias("dense_rank"), F.lit(None).cast("int").alias("sparse_rank")).union(sparse.select("id", F.lit(None).cast("int"), "rank"))
    ranks = both.groupBy("id").agg(F.min("dense_rank").alias("dense_rank"), F.min("sparse_rank").alias("sparse_rank"))
    part = lambda c: F.coalesce(1.0 / (constant + F.col(c)), F.lit(0.0))
    scored = ranks.withColumn("score", C.rounded(part("dense_rank") + part("sparse_rank"), 8))
    return scored.orderBy(F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), "id").limit(k)


def follow_up(question: Column, last_user: Column) -> Column:
    """A question of at most five words is searched for together with the user's one before it."""
    return F.when((C.word_count(question) <= 5) & last_user.isNotNull(), F.concat_ws(" ", last_user, question)).otherwise(question)


def context_text(hits: DataFrame) -> DataFrame:
    """The excerpts by date, each after its date, in one text."""
    parts = F.array_sort(F.collect_list(F.struct("date", "id", "text")))
    return hits.agg(F.array_join(F.transform(parts, lambda x: F.concat(F.lit("["), x["date"], F.lit("] "), x["text"])), "\n\n").alias("context"), F.array_sort(F.collect_set("date")).alias("cited"))
