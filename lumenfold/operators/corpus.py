"""Chunks and entries: schema, collapse, ingest status, and changes as joins."""

from __future__ import annotations

import re

from py4j.protocol import Py4JJavaError
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenfold.functions import columns as C
from lumenfold.functions import dates as D

# Fixed names: the fields of the data model.
CHUNKS = """id string, entry_id string, source string, date string, date_int bigint, date_source string, text string, word_count int,
content_hash string, chunk_index int, ingested_at string, vector array<float>, mood int, topics string, people string, places string, enriched boolean"""
SIGNALS = "chunk_id string, entry_id string, namespace string, key string, value_num double, value_json string, model_tag string, content_hash string, computed_at string, pass_name string, pass_version string"


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def in_range(df: DataFrame, date_from: str | None = None, date_to: str | None = None, column: str = "date") -> DataFrame:
    """Both ends included; an end that is not given is open."""
    if date_from:
        df = df.where(F.col(column) >= date_from)
    return df.where(F.col(column) <= date_to) if date_to else df


def dated(entries: DataFrame) -> DataFrame:
    """The entries with a readable date, as ``dt``."""
    return entries.withColumn("dt", F.try_to_date("date")).where(F.col("dt").isNotNull())


def enriched(entries: DataFrame) -> DataFrame:
    """Mood 0 means that no mood is known."""
    return entries.where("mood > 0")


def has_enrichment(entries: DataFrame) -> DataFrame:
    """One row: whether any entry has a mood; false for no entries."""
    return entries.agg(F.coalesce(F.bool_or(F.col("mood") > 0), F.lit(False)).alias("has_enrichment"))


def ordered_chunks(chunks: DataFrame, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """What a pass reads of a period, in the order of time: id, entry_id, date, text."""
    return in_range(chunks, date_from, date_to).orderBy("date_int", "entry_id", "chunk_index").select("id", "entry_id", "date", "text")


def corpus_totals(chunks: DataFrame) -> DataFrame:
    """One row: entries, chunks and words of the whole collection."""
    return chunks.agg(F.countDistinct("entry_id").alias("entries"), F.count("*").alias("chunks"), F.coalesce(F.sum("word_count"), F.lit(0)).cast("bigint").alias("words"))


def duplicates(entries: DataFrame, key: str) -> DataFrame:
    """Each content that several entries have: its hash, the least ``key``, and how many there are."""
    return entries.groupBy("content_hash").agg(F.min(key).alias(f"first_{key}"), F.count("*").alias("copies")).where("copies > 1")


def collapse(chunks: DataFrame, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """One row for each entry: of every column the value of the first chunk that has one, and the year."""
    columns = [c for c in chunks.columns if c != "entry_id"]
    firsts = [F.min_by(c, F.when(F.col(c).isNotNull(), F.col("chunk_index"))).alias(c) for c in columns]
    entries = in_range(chunks, date_from, date_to).where("entry_id is not null").groupBy("entry_id").agg(*firsts)
    return entries.withColumn("year", F.substring("date", 1, 4))


def full_texts(chunks: DataFrame, joint: str = "\n\n") -> DataFrame:
    """Each entry's chunks in order, joined."""
    parts = F.array_sort(F.collect_list(F.struct("chunk_index", "text")))
    return chunks.groupBy("entry_id").agg(F.array_join(F.transform(parts, lambda x: x["text"]), joint).alias("text"))


def list_entries(chunks: DataFrame) -> DataFrame:
    first = [F.min_by(c, "chunk_index").alias(c) for c in ("date", "source")]
    return chunks.groupBy("entry_id").agg(*first, F.count("*").alias("chunks")).orderBy("date", "entry_id")


def as_java(spark: SparkSession, pattern: str) -> str | None:
    """``pattern`` as Java's regular expressions have it, with named groups as Python writes them too; None where it is none."""
    own = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<"))
    try:
        spark.sparkContext._jvm.java.util.regex.Pattern.compile(own)
        return own
    except (Py4JJavaError, IllegalArgumentException):
        return None


def java_pattern(spark: SparkSession, pattern: str) -> str:
    """``pattern`` as Spark runs it, whatever the case; what is no pattern stands for itself."""
    own = as_java(spark, pattern)
    return f"(?i){own if own is not None else spark.sparkContext._jvm.java.util.regex.Pattern.quote(pattern)}"


def matches(pattern: str) -> Column:
    """A chunk whose text, or whose id, date or source, has a match of a pattern from ``java_pattern``."""
    return F.concat_ws("\n", "entry_id", "date", "source").rlike(pattern) | F.col("text").rlike(pattern)


def search_entries(chunks: DataFrame, pattern: str) -> DataFrame:
    """Entries with a match, whatever the case, in a chunk's text or in their id, date or source. What is no pattern is looked for as it stands."""
    return chunks.where(matches(java_pattern(chunks.sparkSession, pattern))).select("entry_id").distinct()


def entry_ids(chunks: DataFrame, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    return in_range(chunks, date_from, date_to).select("entry_id").distinct()


def ingest_status(records: DataFrame, existing: DataFrame) -> DataFrame:
    """Each record's content_hash and status: empty, skipped (nothing new), updated or added.

    ``existing``: chunks. Of records with one id in a batch the one with the least content_hash counts, equal ones are all one; the others are
    skipped. Records are told apart by what they hold, so a recomputed task gives the same.
    """
    known = existing.groupBy("entry_id").agg(F.max("content_hash").alias("known"))
    body = C.stripped(F.coalesce("body", F.lit("")))
    hashed = records.withColumn("body", body).withColumn("content_hash", C.content_hash(F.col("body")))
    more = [c for c, t in records.dtypes if c not in ("entry_id", "body") and not t.startswith("map")]
    nth = F.row_number().over(W.partitionBy("entry_id").orderBy("content_hash", *more))
    # the window has dealt the records by entry_id already, as the join wants them
    rows = hashed.withColumn("nth", nth).join(known, "entry_id", "left")
    status = F.when(F.col("body") == "", "empty").when((F.col("nth") > 1) | (F.col("known") == F.col("content_hash")), "skipped").when(F.col("known").isNotNull(), "updated").otherwise("added")
    return rows.withColumn("status", status).drop("nth", "known")


def to_chunks(records: DataFrame, ingested_at: str, target: int = 400, overlap: int = 1, delimiter: str = r"\n\s*\n") -> DataFrame:
    """Chunk rows, without vectors, of dated records (entry_id, body, source, content_hash, dt, date_source)."""
    rows = records.select("*", F.posexplode(C.chunks(F.col("body"), target, overlap, delimiter)).alias("chunk_index", "text"))
    blank = [F.lit("").alias(c) for c in ("topics", "people", "places")]
    return rows.select(
        F.concat_ws("::", "entry_id", "chunk_index").alias("id"), "entry_id", "source", F.col("dt").cast("string").alias("date"), D.date_int(F.col("dt")).cast("bigint").alias("date_int"), "date_source",
        "text", C.word_count(F.col("text")).alias("word_count"), "content_hash", "chunk_index", F.lit(ingested_at).alias("ingested_at"), F.lit(None).cast("array<float>").alias("vector"), F.lit(0).alias("mood"), *blank, F.lit(False).alias("enriched"),
    )


def merged(existing: DataFrame, new: DataFrame, key: str | list[str] = "entry_id") -> DataFrame:
    """``new`` in the place of what ``existing`` has under the same keys."""
    return delete(existing, new.select(*([key] if isinstance(key, str) else key)), key).unionByName(new)


def delete(existing: DataFrame, ids: DataFrame, key: str | list[str] = "entry_id") -> DataFrame:
    return existing.join(ids.distinct(), key, "left_anti")


def ingest_summary(status: DataFrame) -> DataFrame:
    """Counts of each status, of entries (without empty ones), and the share of changed entries dated by mtime."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    changed = F.col("status").isin("added", "updated")
    by_mtime = F.count_if(changed & (F.col("date_source") == "mtime")) / F.greatest(F.count_if(changed), F.lit(1))
    return status.agg(count("added"), count("updated"), count("skipped"), F.count_if(F.col("status") != "empty").alias("n_entries"), by_mtime.alias("mtime_fraction"))


def date_sources(status: DataFrame) -> DataFrame:
    """How many changed entries were dated by what, most first."""
    return status.where(F.col("status").isin("added", "updated")).groupBy("date_source").agg(F.count("*").alias("entries")).orderBy(F.desc("entries"), "date_source")


def dates_to_check(summary: DataFrame, most: float = 0.3) -> DataFrame:
    """``summary`` with ``check_dates``: more than ``most`` of the changed entries have only a file's time for a date."""
    return summary.withColumn("check_dates", F.col("mtime_fraction") > most)


def requested(ids: DataFrame) -> DataFrame:
    """One row: how many different ids are asked to go, there or not; null and empty ones are none."""
    return ids.where("entry_id <> ''").agg(F.countDistinct("entry_id").alias("requested"))


def pending(chunks: DataFrame) -> DataFrame:
    return chunks.where("not enriched").agg(F.countDistinct("entry_id").alias("pending"))


def apply_enrichment(chunks: DataFrame, answers: DataFrame) -> DataFrame:
    """Cleaned answers (entry_id, mood, topics, people, places) on every chunk of their entries."""
    own = answers.toDF("entry_id", *(f"new_{c}" for c in answers.columns[1:])).withColumn("hit", F.lit(True))
    take = lambda c: F.coalesce(f"new_{c}", c).alias(c)
    swap = {c: take(c) for c in ("mood", "topics", "people", "places")} | {"enriched": (F.col("enriched") | F.coalesce("hit", F.lit(False))).alias("enriched")}
    return chunks.join(own, "entry_id", "left").select(*(swap.get(c, F.col(c)) for c in chunks.columns))


def cleaned_answers(raw: DataFrame) -> DataFrame:
    """(entry_id, answer) of a chat model as mood and lists; what is unreadable gives mood 3 and empty lists."""
    parsed = F.from_json(C.json_object(F.col("answer")), "mood string, topics array<string>, people array<string>, places array<string>")
    lists = [F.coalesce(C.clean_list(F.col(f"x.{c}")), F.lit("")).alias(c) for c in ("topics", "people", "places")]
    return raw.select("entry_id", parsed.alias("x")).select("entry_id", C.clean_mood(F.col("x.mood")).alias("mood"), *lists)


def digest_key(entries: DataFrame, date_from: str, date_to: str, model: str) -> Column:
    """An aggregate: changes with the period, the model, and any entry's content, not with their order.

    Each entry's digest is eight numbers of 32 bits, and sums do not depend on an order: so tasks add up what they have, and nothing is gathered.
    """
    own = F.sha2(F.concat_ws(":", "entry_id", "content_hash"), 256)
    sums = [F.coalesce(F.sum(F.conv(F.substring(own, 8 * i + 1, 8), 16, 10).cast("bigint")), F.lit(0)).cast("string") for i in range(8)]
    return F.sha2(F.concat_ws("|", F.lit(date_from), F.lit(date_to), F.lit(model), F.count("*").cast("string"), *sums), 256)
