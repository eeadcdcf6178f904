"""Queries over stores that change: three commits of the given tables, and what follows them from their changes alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import columns as C
from lumenfold.functions import models
from lumenfold.operators import corpus, signals
from lumenfold.plans.follow import Cells, Grams, Index, follow_rollup, follow_signals
from lumenfold.queries import _KEYS, _QUERY, BM25, FEATURES, _probe, _rolled, doc_entries, line_chunks, query, table
from lumenfold.sources.snapshots import Snapshots, scratch


def _changing(spark, rows: DataFrame, n: str, columns: list[str], stale: dict, follow, schema: str) -> Snapshots:
    """A store of ``rows`` (entry_id, n and others) by three commits, after each of which ``follow`` is called: all but every fifth entry, every seventh
    with ``stale`` columns; then those that lack or are stale as they are; then every ninth goes."""
    store = Snapshots(spark, scratch(spark, "changing"), schema)
    number = F.col(n)
    first = rows.where(number % 5 != 0)
    store.write(first.withColumns({c: F.when(number % 7 == 0, v).otherwise(F.col(c)) for c, v in stale.items()}).select(*columns), rows=rows.count())
    follow(store)
    again = rows.where((number % 5 == 0) | (number % 7 == 0))
    store.replace(again.select(*columns), again.select("entry_id"))
    follow(store)
    store.replace(None, rows.where(number % 9 == 4).select("entry_id"))
    follow(store)
    return store


_LEFT = "doc_id % 9 <> 4"


@query(BM25.replace("FROM doc_entries),", f"FROM doc_entries WHERE {_LEFT}),").replace("WHERE date >= '2016-01-01' GROUP BY id", "GROUP BY id") + "SELECT concat(id, '::0') AS id, score, rank FROM sparse")
def bm25_followed(spark, sf_dir):
    """Best matches from an index that followed a store through three commits."""
    index = Index(spark, scratch(spark, "index"))
    docs = doc_entries(spark, sf_dir, moods=False).withColumn("id", F.concat("entry_id", F.lit("::0")))
    _changing(spark, docs, "doc_id", ["id", "entry_id", "date", "text"], {"text": F.concat(F.lit(f"{_QUERY} {_QUERY} "), "text")}, index.follow, "id string, entry_id string, date string, text string")
    return index.best(_QUERY).withColumn("rank", F.col("rank").cast("bigint"))


@query(f"SELECT count(*) AS chunks, sum(n)::BIGINT AS words, count(*) AS entries FROM (SELECT len(regexp_extract_all(lower(text), '[a-z'']+')) AS n FROM doc_entries WHERE {_LEFT})")
def index_statistics_followed(spark, sf_dir):
    """What the index knows of the whole collection after three commits, from the changes."""
    index = Index(spark, scratch(spark, "index"))
    docs = doc_entries(spark, sf_dir, moods=False).withColumn("id", F.concat("entry_id", F.lit("::0")))
    _changing(spark, docs, "doc_id", ["id", "entry_id", "date", "text"], {"text": F.lit("stale")}, index.follow, "id string, entry_id string, date string, text string")
    mark = index.mark()
    return spark.createDataFrame([(mark["chunks"], mark["words"], mark["entries"])], "chunks bigint, words bigint, entries bigint")


@query("SELECT concat('v', vec_id, '::0') AS id, round_even(list_sum(list_transform(list_zip(embedding, q), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))), 6) AS distance, row_number() OVER (ORDER BY distance, id) - 1 AS rank FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 7) WHERE vec_id % 9 <> 4 ORDER BY distance, id LIMIT 40")
def dense_cells(spark, sf_dir):
    """The nearest vectors from cells that followed three commits: those around the query, and the others that may hold a nearer one."""
    cells = Cells(spark, scratch(spark, "cells"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("v"), "vec_id").alias("entry_id"), F.concat(F.lit("v"), "vec_id", F.lit("::0")).alias("id"), F.lit("2020-01-01").alias("date"), F.col("embedding").alias("vector"))
    stale = {"vector": F.transform("vector", lambda x: -x)}
    _changing(spark, vectors, "vec_id", ["id", "entry_id", "date", "vector"], stale, cells.follow, "id string, entry_id string, date string, vector array<float>")
    return cells.nearest(_probe(spark, sf_dir), probes=2, exact=True).withColumn("rank", F.col("rank").cast("bigint"))


@query(FEATURES + f"SELECT entry_id, {_rolled(_KEYS)} FROM features WHERE substr(entry_id, 5)::BIGINT % 9 <> 4 GROUP BY entry_id")
def rollup_followed(spark, sf_dir):
    """The rollup of signals, both brought up from the changes of a store of lines."""
    a_pass = signals.LexicalPass()
    kept, rollup = Snapshots(spark, scratch(spark, "signals"), corpus.SIGNALS), Snapshots(spark, scratch(spark, "rollup"), signals.ROLLUP)
    lines = line_chunks(spark, sf_dir).withColumnRenamed("chunk_id", "id").withColumn("n", F.substring("entry_id", 5, 20).cast("bigint"))

    def follow(store: Snapshots) -> None:
        follow_signals(store, kept, a_pass, "2024-02-15")
        follow_rollup(store, kept, rollup, a_pass)

    columns = ["id", "entry_id", "date", "date_int", "text", "word_count"]
    _changing(spark, lines, "n", columns, {"text": F.lit("i know we know")}, follow, "id string, entry_id string, date string, date_int bigint, text string, word_count int")
    return signals.lexical_wide(rollup.read(), ["token_count", *_KEYS]).select("entry_id", "token_count", *(C.rounded(F.col(k), 6).alias(k) for k in _KEYS))


@query("SELECT entry_id, count(*)::BIGINT AS chunks FROM line_chunks WHERE substr(entry_id, 5)::BIGINT % 9 <> 4 GROUP BY entry_id")
def store_followed(spark, sf_dir):
    """What a store holds after three commits, of its entries the chunks."""
    lines = line_chunks(spark, sf_dir).withColumnRenamed("chunk_id", "id").withColumn("n", F.substring("entry_id", 5, 20).cast("bigint"))
    store = _changing(spark, lines, "n", ["id", "entry_id", "text"], {"text": F.lit("stale")}, lambda _: None, "id string, entry_id string, text string")
    held = store.read()
    return held.where("text <> 'stale'").groupBy("entry_id").agg(F.count("*").alias("chunks"))




_PATTERN = "QUEAU[a-x]|nteres of|lichkeit"


@query(f"SELECT DISTINCT entry_id FROM line_chunks WHERE substr(entry_id, 5)::BIGINT % 9 <> 4 AND (regexp_matches(text, '{_PATTERN}', 'i') OR regexp_matches(concat(entry_id, chr(10), date, chr(10), source), '{_PATTERN}', 'i'))")
def regex_followed(spark, sf_dir):
    """Entries that match a pattern, by the index of runs of three characters that followed three commits."""
    grams = Grams(spark, scratch(spark, "grams"))
    lines = line_chunks(spark, sf_dir, moods=False).withColumnRenamed("chunk_id", "id").withColumn("n", F.substring("entry_id", 5, 20).cast("bigint"))
    columns = ["id", "entry_id", "date", "source", "text"]
    store = _changing(spark, lines, "n", columns, {"text": F.lit("queaux lichkeit")}, grams.follow, "id string, entry_id string, date string, source string, text string")
    return grams.find(store, _PATTERN)


@query()
def emotion_signals(spark, sf_dir):
    """The emotion pass with its small model over every line; tests hold it against a plain loop."""
    rows = signals.derive(line_chunks(spark, sf_dir, moods=False), corpus.empty(spark, corpus.SIGNALS), signals.default_emotions(), "2024-02-15")
    return signals.stored_scores(rows)


@query()
def tagged_tenses(spark, sf_dir):
    """How many verbs of each tense the tagger finds in each text; tests hold it against a plain Viterbi."""
    found = doc_entries(spark, sf_dir).select("entry_id", models.tenses("text").alias("t"))
    of = lambda tense: F.size(F.filter("t", lambda x: x == tense)).alias(tense)
    return found.select("entry_id", *map(of, signals.TENSES))
