"""What a digest is made of: a sample, an overview, and a key for its cache."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import columns as C
from lumenfold.operators.corpus import enriched


def sample(entries: DataFrame, most: int = 14) -> DataFrame:
    """Evenly spaced entries by date, both ends kept, each place once.

    Places are found by range-partitioned numbering: only counts of days meet in one task, never entries.
    """
    days = entries.groupBy("date").agg(F.count("*").alias("n"))
    start = days.select("date", (F.sum("n").over(_by_date()) - F.col("n")).alias("before"))
    nth = F.expr("row_number() over (partition by date order by entry_id)") - 1
    placed = entries.withColumn("nth", nth).join(start, "date").withColumn("place", F.col("before") + F.col("nth")).drop("nth", "before")
    n = entries.count()
    keep = range(n) if n <= most else sorted({round(i * (n - 1) / (most - 1)) for i in range(most)})
    return placed if n <= most else placed.where(F.col("place").isin(*keep))


def _by_date():
    from pyspark.sql import Window as W

    return W.orderBy("date").rowsBetween(W.unboundedPreceding, 0)


def overview(entries: DataFrame) -> DataFrame:
    """One line: how many entries, their mean mood if at least three have one, and the five most frequent topics and people."""
    mood = enriched(entries).agg(F.count("*").alias("moods"), F.avg("mood").alias("mean"))
    count = entries.agg(F.count("*").alias("n"))

    def top(column: str) -> DataFrame:
        counts = entries.select(F.explode(C.listed(F.coalesce(column, F.lit("")))).alias("t")).groupBy("t").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "t").limit(5)
        names = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "t"))), lambda x: x["t"])
        return counts.agg(F.when(F.count("*") > 0, F.concat(F.lit(f"often named {column}: "), F.array_join(names, ", "))).alias(column))

    said = F.concat_ws("; ", F.format_string("entries: %d", "n"), F.when(F.col("moods") >= 3, F.format_string("mood: %.1f of 5 on average", C.rounded(F.col("mean"), 1))), "topics", "people")
    return count.join(mood).join(top("topics")).join(top("people")).select(said.alias("overview"))  # single rows
