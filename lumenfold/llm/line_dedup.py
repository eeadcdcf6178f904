"""Line dedup within one edit, in DataFrame functions only.

Two lines at Levenshtein distance 1 are equal once a character is deleted from one or the same place of
both. Emitting every line less each of its characters would copy the corpus hundreds of times, so
larger deletions come first, and only lines that meet another one go on:

1. Halves. Under base length m stand lines of m and of m + 1 characters. Whatever the edit, the part before
   or the part behind the middle of m is the same in both, and is a key.
2. Blocks. A line is cut into about sqrt(m) blocks; all but the block with the edit is a key.
3. Characters. What is left of the line is that block: the block less its j-th character, with j for lines
   of equal length, the longer block less each of its characters against the shorter one.

Lines that share a key of step 3 are one edit apart, so each key only needs its earliest line: groups are
aggregates, never pairs. The distance to the earliest is verified on the whole lines.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.shared import unused, tidy, written

#: So many candidate lines at most are broadcast (16 bytes each); more are joined by a shuffle.
BROADCAST_LINES = 500_000


def _position() -> Column:
    return F.struct(F.isnull("doc_id").alias("last"), "doc_id", "th", "th2", "no")


def _text_hashes() -> list[Column]:
    text = F.coalesce("text", F.lit(""))
    return [F.xxhash64(text).alias("th"), F.xxhash64(F.lit(1), text).alias("th2")]


def _lines(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    lines = docs.select("doc_id", *_text_hashes(), F.posexplode(F.split(text, "\n")).alias("no", "line")).where(F.trim("line") != "")
    return lines.withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(1), "line"), "n": F.length("line")})


def _behind(start: Column) -> Column:
    """The line from a position, counted from 0."""
    return F.expr("line").substr(start + 1, F.col("n"))


def _halves() -> Column:
    same, longer = F.expr("n div 2"), F.expr("(n - 1) div 2")
    head = lambda c: F.expr("line").substr(F.lit(1), c)
    return F.array(
        F.xxhash64(F.lit("head"), "n", head(same)),
        F.xxhash64(F.lit("tail"), "n", _behind(same)),
        F.xxhash64(F.lit("head"), F.col("n") - 1, head(longer)),
        F.xxhash64(F.lit("tail"), F.col("n") - 1, _behind(longer + 1)),
    )


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """The rows whose key some other line has too."""
    keys = rows.groupBy(key).agg(F.min("h1").alias("low"), F.max("h1").alias("high")).where("low <> high").select(key)
    return rows.join(keys, key, "left_semi")


_BLOCKS = """
transform(sequence(0, {m} div size), i -> named_struct(
    'longer', {longer}, 'part', substr(line, i * size + 1, least(size, {m} - i * size) + {longer}),
    'block', xxhash64({m}, i, left(line, i * size), substr(line, least((i + 1) * size, {m}) + {longer} + 1))))
"""

_CHARACTERS = """
if(longer = 0,
   array_append(transform(sequence(1, length(part)), j -> xxhash64('same', block, j, left(part, j - 1), substr(part, j + 1))), xxhash64('one', block, part)),
   transform(sequence(1, length(part)), j -> xxhash64('one', block, concat(left(part, j - 1), substr(part, j + 1)))))
"""


def near_lines(docs: DataFrame, first: DataFrame, lines: DataFrame, near_from: int) -> DataFrame:
    """h1, h2 of the distinct lines that have an earlier line one edit away."""
    halves = lines.where(F.col("n") >= near_from).select("h1", "h2", F.explode("halves").alias("half"))
    met = written(_shared(halves, "half").select("h1", "h2").distinct(), "met")
    some = F.broadcast(met) if met.count() <= BROADCAST_LINES else met
    texts = _lines(docs).where(F.col("n") >= near_from).join(some, ["h1", "h2"], "left_semi").groupBy("h1", "h2").agg(F.first("line").alias("line"))
    texts = written(texts.join(first, ["h1", "h2"]).withColumn("n", F.length("line")), "texts")

    base = lambda m, longer: _BLOCKS.format(m=m, longer=longer)
    blocks = texts.withColumn("size", F.ceil(F.sqrt("n")).cast("int")).select("h1", "h2", "first", F.explode(F.expr(base("n", 0))).alias("x"))
    # the longer line is cut as its partner, of n - 1 characters, is
    longer = texts.withColumn("size", F.ceil(F.sqrt(F.col("n") - 1)).cast("int")).select("h1", "h2", "first", F.explode(F.expr(base("(n - 1)", 1))).alias("x"))
    blocks = _shared(blocks.union(longer).select("h1", "h2", "first", "x.*"), "block")
    less = blocks.withColumn("key", F.explode(F.expr(_CHARACTERS))).select("h1", "h2", "first", "longer", "key")
    less = written(_shared(less, "key"), "less")
    whose = F.struct("first", F.col("h1").alias("g1"), F.col("h2").alias("g2"))
    # in a 'same' key all are shorter = 0; in a 'one' key lines are compared with those of the other length
    least = less.groupBy("key").agg(F.min(F.when(F.col("longer") == 0, whose)).alias("short"), F.min(F.when(F.col("longer") == 1, whose)).alias("long"))
    found = less.join(least, "key").withColumn("other", F.when(F.col("longer") == 1, F.col("short")).otherwise(F.when(F.col("long").isNull(), F.col("short")).otherwise(F.col("long"))))
    found = found.where("other is not null and other.first < first").select("h1", "h2", "other.g1", "other.g2").distinct()
    other = texts.select(F.col("h1").alias("g1"), F.col("h2").alias("g2"), F.col("line").alias("other"))
    sure = found.join(other, ["g1", "g2"]).join(texts.select("h1", "h2", "line"), ["h1", "h2"]).where(F.levenshtein("line", "other", 1) == 1)
    return sure.select("h1", "h2").distinct()


@tidy
def dedup_lines(docs: DataFrame, near_from: int = 20, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """``docs`` with every line dropped from ``text`` that an earlier line makes superfluous, and n_lines, n_dropped.

    Lines end at line feeds. Earlier: smaller doc_id (null last), then place in the text. A line goes if an equal one
    comes earlier, or, from ``near_from`` characters on (one edit is much of a shorter line), if a line at Levenshtein distance 1 comes before
    its first copy (kept itself or not). Blank lines (spaces only) stay and are not counted.

    Every row stays, with its other columns as they are, whatever their names; columns that are called ``n_lines`` or ``n_dropped`` already are
    replaced by the counts. A text may become empty. Null texts stay null, with 0 lines. Of
    rows with one doc_id and different texts, the order is that of the texts' hashes; rows equal in both are one
    document and get the same result. An empty table gives no rows.
    """
    slim = docs.select("doc_id", "text")
    lines = written(_lines(slim).withColumn("halves", F.when(F.col("n") >= near_from, _halves())).drop("line"), "lines")
    first = written(lines.groupBy("h1", "h2").agg(F.min(_position()).alias("first")), "first")
    near = near_lines(slim, first, lines, near_from).withColumn("near", F.lit(True))
    verdict = written(first.join(near, ["h1", "h2"], "left"), "verdict")
    gone = lines.join(verdict, ["h1", "h2"]).where(F.coalesce("near", F.lit(False)) | (_position() != F.col("first")))
    th, th2, id_, h, h2, out_ = (unused(docs, c) for c in ("th_of_row", "th2_of_row", "id_of_line", "th_of_line", "th2_of_line", "lines_out"))
    gone = gone.groupBy(F.col("doc_id").alias(id_), F.col("th").alias(h), F.col("th2").alias(h2)).agg(F.collect_set("no").alias(out_))
    own = docs.withColumns(dict(zip((th, th2), _text_hashes())))
    out = own.join(written(gone, "gone"), F.col("doc_id").eqNullSafe(F.col(id_)) & (F.col(th) == F.col(h)) & (F.col(th2) == F.col(h2)), "left")
    split = F.split("text", "\n")
    kept = F.array_sort(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), out_))
    cleaned = F.when(F.col(out_).isNull(), F.col("text")).otherwise(F.array_join(F.transform(kept, lambda i: F.get(split, i)), "\n"))
    counted = F.coalesce(F.size(F.filter(split, lambda x: F.trim(x) != "")), F.lit(0))
    names = [c for c in docs.columns if c.lower() not in (n_lines.lower(), n_dropped.lower())]
    counts = F.when(F.col("text").isNull(), 0).otherwise(counted).alias(n_lines), F.coalesce(F.size(out_), F.lit(0)).alias(n_dropped)
    return out.select(*(cleaned.alias(c) if c == "text" else F.col(f"`{c}`") for c in names), *counts)


def without_repeated_lines(docs: DataFrame, near_from: int = 20) -> DataFrame:
    """``docs`` with superfluous lines dropped by ``dedup_lines``, and no columns but its own."""
    n_lines = unused(docs, "n_lines")
    return dedup_lines(docs, near_from, n_lines, unused(docs.withColumn(n_lines, F.lit(0)), "n_dropped")).select(*(F.col(f"`{c}`") for c in docs.columns))


#: The same rule in DuckDB, for tables with one row for each doc_id; lines that share neither half are never close.
ORACLE_SQL = """
WITH cut AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents),
line AS (SELECT doc_id, no, line, doc_id * 10000000 + no AS pos FROM cut WHERE trim(line) <> ''),
uniq AS (SELECT line, length(line) AS n, min(pos) AS pos FROM line GROUP BY line),
half AS (SELECT line, n, pos, m, side, CASE side WHEN 0 THEN left(line, m // 2) ELSE right(line, m - m // 2) END AS part
         FROM uniq, (VALUES (0), (1)) AS s(side), (VALUES (0), (1)) AS d(less), LATERAL (SELECT n - less AS m) WHERE n >= 20),
near AS (SELECT DISTINCT a.line FROM half AS a JOIN half AS b ON a.m = b.m AND a.side = b.side AND a.part = b.part AND b.pos < a.pos
         WHERE abs(a.n - b.n) <= 1 AND levenshtein(a.line, b.line) = 1),
kept AS (SELECT l.doc_id, count(*) FILTER (WHERE l.pos <> u.pos OR x.line IS NOT NULL) AS n_dropped, count(*) AS n_lines
         FROM line AS l JOIN uniq AS u USING (line) LEFT JOIN near AS x USING (line) GROUP BY l.doc_id),
final AS (SELECT c.doc_id, string_agg(c.line, chr(10) ORDER BY c.no) AS text FROM cut AS c LEFT JOIN uniq AS u USING (line) LEFT JOIN near AS x USING (line)
          WHERE trim(c.line) = '' OR (x.line IS NULL AND u.pos = c.doc_id * 10000000 + c.no) GROUP BY c.doc_id)
SELECT d.doc_id, coalesce(k.n_lines, 0)::INTEGER AS n_lines, coalesce(k.n_dropped, 0)::INTEGER AS n_dropped, sha256(coalesce(f.text, '')) AS text_sha256
FROM documents AS d LEFT JOIN kept AS k USING (doc_id) LEFT JOIN final AS f USING (doc_id)
"""
