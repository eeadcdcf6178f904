"""The registered queries: the operators over entries that are derived from the given tables, and DuckDB SQL for the same rows.

``documents`` with ``labels`` give one entry for each document, with a synthetic date from its id and mood 0 where there is no label; their
lines are its chunks. ``events`` give one entry for each user and day, with the day's event types as topics.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions import columns as C
from lumenfold.functions import dates as D
from lumenfold.functions.lexicons import RATES, lexicon
from lumenfold.operators import corpus, digest, insights, retrieval, signals, stats, themes
from lumenfold.sources import conversations as chats
from lumenfold.sources import texts
from lumenfold.sources.snapshots import BROADCAST_KEYS, scratch, staged

TODAY = dt.date(2024, 2, 15)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Words that occur in the invented prose; one of them is in two categories.
WORDS = lexicon(
    article="the a an", linking="of to in on for with by at from", being="is was be are", joining="and as that this it", french="de la le les des et que", german="der die und", romance="de la que"
)
PAIRS = lexicon(pairing="and et und", placing="in on at sur", pointing="the le la der die")
TENSE = lexicon(past="was", present="is are", future="to")


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = PREFIX + sql
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _with_dates(df: DataFrame) -> DataFrame:
    return df.withColumns({"date": F.col("dt").cast("string"), "year": F.date_format("dt", "yyyy"), "date_int": D.date_int(F.col("dt")).cast("bigint")})


def doc_entries(spark: SparkSession, sf_dir: str, moods: bool = True) -> DataFrame:
    """Without ``moods`` the same rows, but no text is dealt out to meet its label: only documents with several labels, which come as often, are joined."""
    mood = F.when(F.col("quality").isNull(), 0).otherwise(F.greatest(F.lit(1), F.least(F.lit(5), 2 + 3 * F.col("quality") - 2 * F.col("toxic")))).cast("int")
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    if moods:
        docs = docs.join(labels, "doc_id", "left")
    else:
        several = labels.groupBy("doc_id").agg(F.count("*").cast("int").alias("times")).where("times > 1")
        if n := several.count():
            docs = docs.join(F.broadcast(several) if n <= BROADCAST_KEYS else several, "doc_id", "left")
            docs = docs.withColumn("time", F.explode(F.sequence(F.lit(1), F.coalesce("times", F.lit(1)))))
    entries = docs.select(
        "doc_id", F.concat(F.lit("doc:"), "doc_id").alias("entry_id"), F.date_add(F.lit(dt.date(2015, 1, 1)), (F.col("doc_id") * 7919 % 3287).cast("int")).alias("dt"), "text",
        C.word_count(F.col("text")).alias("word_count"), F.concat_ws(", ", "lang", "source").alias("topics"), F.col("source").alias("people"), F.col("lang").alias("places"), *([mood.alias("mood")] if moods else []), C.content_hash(F.col("text")).alias("content_hash"),
    )
    return _with_dates(entries)


def event_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").groupBy("user_id", F.col("ts").cast("date").alias("dt"))
    days = days.agg(F.count("*").alias("n"), F.avg("value").alias("v"), F.array_join(F.array_sort(F.collect_set("event_type")), ", ").alias("topics"))
    user = F.concat(F.lit("u"), "user_id")
    mood = F.when(F.col("n") < 2, 0).otherwise(1 + F.least(F.lit(4), F.floor(F.col("v") / 25).cast("int"))).cast("int")
    return _with_dates(days.select(F.concat_ws(":", user, F.col("dt").cast("string")).alias("entry_id"), "dt", user.alias("people"), "topics", mood.alias("mood"), F.col("n").cast("int").alias("word_count")))


def line_chunks(spark: SparkSession, sf_dir: str, moods: bool = True) -> DataFrame:
    lines = doc_entries(spark, sf_dir, moods).select("entry_id", "date", "year", "date_int", *(["mood"] if moods else []), F.col("people").alias("source"), F.posexplode(F.split("text", "\n")).alias("chunk_index", "text")).where(F.trim("text") != "")
    return lines.withColumns({"chunk_id": F.concat_ws("::", "entry_id", "chunk_index"), "word_count": C.word_count(F.col("text"))})


PREFIX = """
WITH doc_entries AS (
  SELECT doc_id, entry_id, dt, text, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))::INTEGER AS word_count, topics, people, places, mood,
         sha256(replace(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), chr(13) || chr(10), chr(10))) AS content_hash, CAST(dt AS VARCHAR) AS date, strftime(dt, '%Y') AS year, (year(dt) * 10000 + month(dt) * 100 + day(dt))::BIGINT AS date_int
  FROM (SELECT d.doc_id, concat('doc:', d.doc_id) AS entry_id, DATE '2015-01-01' + CAST((d.doc_id * 7919) % 3287 AS INTEGER) AS dt, d.text, concat(d.lang, ', ', d.source) AS topics, d.source AS people, d.lang AS places,
               CAST(CASE WHEN l.doc_id IS NULL THEN 0 ELSE greatest(1, least(5, 2 + 3 * l.quality - 2 * l.toxic)) END AS INTEGER) AS mood
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)),
event_entries AS (
  SELECT concat('u', user_id, ':', dt) AS entry_id, dt, concat('u', user_id) AS people, topics, n::INTEGER AS word_count, CAST(dt AS VARCHAR) AS date, strftime(dt, '%Y') AS year,
         CAST(CASE WHEN n < 2 THEN 0 ELSE 1 + least(4, CAST(floor(v / 25) AS INTEGER)) END AS INTEGER) AS mood
  FROM (SELECT user_id, CAST(ts AS DATE) AS dt, count(*) AS n, avg(value) AS v, string_agg(DISTINCT event_type, ', ' ORDER BY event_type) AS topics FROM events GROUP BY user_id, CAST(ts AS DATE))),
cut AS (SELECT entry_id, date, date_int, year, mood, people AS source, unnest(string_split(text, chr(10))) AS text, (generate_subscripts(string_split(text, chr(10)), 1) - 1)::INTEGER AS chunk_index FROM doc_entries),
line_chunks AS (SELECT *, concat(entry_id, '::', chunk_index) AS chunk_id, len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> ''))::INTEGER AS word_count FROM cut WHERE trim(text) <> ''),
topic AS (SELECT entry_id, date, year, mood, people, trim(unnest(string_split(topics, ','))) AS token FROM event_entries)
"""


def _in(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _counts(words: dict[str, tuple[str, ...]], prefix: str) -> str:
    return ", ".join(f"len(list_filter(w, lambda x: x IN {_in(v)}))::INTEGER AS {prefix}{k}" for k, v in words.items())


def _largest(names, prefix: str, none: str) -> str:
    best = f"greatest({', '.join(prefix + n for n in names)})"
    return f"CASE WHEN {best} = 0 THEN '{none}' " + " ".join(f"WHEN {prefix}{n} = {best} THEN '{n}'" for n in names) + " END"


INSIGHTS = f"""
SELECT entry_id, date, year, mood, word_count, {_largest(WORDS, 'signal_', 'unlabeled')} AS dominant_signal, {_largest(TENSE, 'tense_', 'reflective')} AS attention_lens, {', '.join('signal_' + k for k in WORDS)}, {', '.join('need_' + k for k in PAIRS)},
       {', '.join(f'round_even(signal_{k} * 100 / word_count, 2) AS signal_{k}_rate' for k in WORDS)}
FROM (SELECT entry_id, date, year, mood, greatest(1, CASE WHEN word_count <> 0 THEN word_count ELSE len(w) END)::INTEGER AS word_count, {_counts(WORDS, 'signal_')}, {_counts(PAIRS, 'need_')},
             {', '.join(f"len(list_filter(list_distinct(w), lambda x: x IN {_in(v)})) AS tense_{k}" for k, v in TENSE.items())}
      FROM (SELECT *, regexp_extract_all(lower(text), '[a-z'']+') AS w FROM doc_entries))
"""


def _insights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.insight_frame(doc_entries(spark, sf_dir), WORDS, PAIRS, TENSE)


def _sums(names, prefix: str, n: int) -> str:
    rows = " UNION ALL ".join(f"SELECT {i} AS ord, '{k}' AS name, sum({prefix}{k})::BIGINT AS total FROM ins" for i, k in enumerate(names))
    return f", ins AS ({INSIGHTS}) SELECT name, total FROM ({rows}) WHERE total > 0 ORDER BY total DESC, ord LIMIT {n}"


@query("SELECT year, round_even(avg(mood), 2) AS mean_mood FROM doc_entries WHERE mood > 0 GROUP BY year")
def mean_mood_per_year(spark, sf_dir):
    return stats.mean_mood_per_year(doc_entries(spark, sf_dir))


@query("SELECT year, count(*) AS entries FROM doc_entries GROUP BY year")
def entries_per_year(spark, sf_dir):
    return stats.entries_per_year(doc_entries(spark, sf_dir))


@query("SELECT entry_id, word_count FROM doc_entries")
def word_count(spark, sf_dir):
    return doc_entries(spark, sf_dir).select("entry_id", "word_count")


@query("SELECT entry_id, content_hash FROM doc_entries")
def content_hash(spark, sf_dir):
    return doc_entries(spark, sf_dir).select("entry_id", "content_hash")


@query("SELECT content_hash, min(doc_id) AS first_doc_id, count(*) AS copies FROM doc_entries GROUP BY content_hash HAVING count(*) > 1")
def dedup_status(spark, sf_dir):
    return corpus.duplicates(doc_entries(spark, sf_dir), "doc_id")


@query("SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z'']+')) AS token FROM doc_entries) GROUP BY token ORDER BY n DESC, token LIMIT 50")
def lex_tokens_top(spark, sf_dir):
    return stats.top_words(doc_entries(spark, sf_dir))


@query("SELECT entry_id, CASE WHEN doc_id % 6 < 4 THEN date END AS found FROM doc_entries")
def filename_date(spark, sf_dir):
    shape = lambda p, head="": F.concat(F.lit(head), F.date_format("dt", p))
    kind = F.col("doc_id") % 6
    name = F.when(kind == 0, shape("yyyyMMdd", "note_")).when(kind == 1, shape("yyyy-M-d")).when(kind == 2, shape("M.dd.yy", "day ")).when(kind == 3, shape("MM/dd/yyyy")).when(kind == 4, "draft 1024").otherwise("x20131345")
    return doc_entries(spark, sf_dir).select("entry_id", D.filename_date(name).cast("string").alias("found"))


@query("SELECT entry_id, CASE WHEN doc_id % 5 < 3 THEN date END AS found FROM doc_entries")
def header_date(spark, sf_dir):
    kind, head = F.col("doc_id") % 5, lambda p: F.date_format("dt", p)
    top = F.when(kind == 0, head("yyyy-MM-dd")).when(kind == 1, F.concat(F.lit("\n"), head("MMMM d, yyyy"))).when(kind == 2, head("d MMM yyyy")).when(kind == 3, "").otherwise(F.concat(F.lit("\n\n\n\n"), head("yyyy-MM-dd")))
    return doc_entries(spark, sf_dir).select("entry_id", D.header_date(F.concat_ws("\n", top, "text")).cast("string").alias("found"))


@query("""
, par AS (SELECT entry_id, regexp_replace(unnest(string_split(text, chr(10))), '^\\s+|\\s+$', '', 'g') AS p, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM doc_entries),
p AS (SELECT entry_id, p, row_number() OVER (PARTITION BY entry_id ORDER BY no) AS i, len(list_filter(string_split_regex(p, '\\s+'), lambda x: x <> '')) AS w FROM par WHERE p <> ''),
ranges AS (
  WITH RECURSIVE st AS (
    SELECT entry_id, i, 1::BIGINT AS a, w AS words, NULL::BIGINT AS fa, NULL::BIGINT AS fb FROM p WHERE i = 1
    UNION ALL
    SELECT st.entry_id, p.i, CASE WHEN st.words + p.w > 400 THEN st.i ELSE st.a END, CASE WHEN st.words + p.w > 400 THEN q.w ELSE st.words END + p.w, CASE WHEN st.words + p.w > 400 THEN st.a END, CASE WHEN st.words + p.w > 400 THEN st.i END
    FROM st JOIN p ON p.entry_id = st.entry_id AND p.i = st.i + 1 JOIN p AS q ON q.entry_id = st.entry_id AND q.i = st.i)
  SELECT entry_id, fa AS a, fb AS b FROM st WHERE fa IS NOT NULL UNION ALL SELECT entry_id, arg_max(a, i), max(i) FROM st GROUP BY entry_id)
SELECT entry_id, (row_number() OVER (PARTITION BY entry_id ORDER BY a, b) - 1)::INTEGER AS chunk_index, sum(w)::INTEGER AS word_count, left(sha256(string_agg(p, chr(10) || chr(10) ORDER BY i)), 16) AS chunk_hash
FROM ranges JOIN p USING (entry_id) WHERE i BETWEEN a AND b GROUP BY entry_id, a, b
""")
def chunks(spark, sf_dir):
    rows = doc_entries(spark, sf_dir).select("entry_id", F.posexplode(C.chunks(F.col("text"), 400, 1, "\n")).alias("chunk_index", "text"))
    return rows.select("entry_id", "chunk_index", C.word_count(F.col("text")).alias("word_count"), C.chunk_hash(F.col("text")).alias("chunk_hash"))


@query("SELECT token, count(*) AS n FROM topic WHERE token <> '' GROUP BY token ORDER BY n DESC, token LIMIT 12")
def top_tokens(spark, sf_dir):
    return stats.top_tokens(event_entries(spark, sf_dir), "topics")


@query(INSIGHTS)
def insight_frame(spark, sf_dir):
    return _insights(spark, sf_dir)


@query(_sums(WORDS, "signal_", 8))
def signal_totals(spark, sf_dir):
    return stats.signal_totals(_insights(spark, sf_dir))


@query(_sums(PAIRS, "need_", 6))
def needs_totals(spark, sf_dir):
    return stats.needs_totals(_insights(spark, sf_dir))


@query("SELECT token AS topic, count(DISTINCT entry_id) AS entries, round_even(avg(mood), 2) AS mean_mood FROM topic WHERE mood > 0 AND token <> '' GROUP BY token HAVING count(DISTINCT entry_id) >= 2")
def topic_mood(spark, sf_dir):
    return stats.topic_mood(event_entries(spark, sf_dir))


@query(f", ins AS ({INSIGHTS}) SELECT year, {', '.join(f'round_even(avg(signal_{k}_rate), 2) AS {k}' for k in WORDS)} FROM ins GROUP BY year")
def year_signal_matrix(spark, sf_dir):
    return stats.year_signal_matrix(_insights(spark, sf_dir))


@query(f", ins AS ({INSIGHTS}) SELECT attention_lens, count(*) AS entries FROM ins GROUP BY attention_lens")
def attention_lens(spark, sf_dir):
    return stats.attention_lens(_insights(spark, sf_dir))


def _prompts(names, prefix: str, head: str, tail: str, ord_: int) -> str:
    best = " UNION ALL ".join(f"SELECT {i} AS o, '{k}' AS name, sum({prefix}{k}) AS total FROM ins" for i, k in enumerate(names))
    return f"SELECT {ord_} AS ord, concat('{head}', name, '{tail}') AS prompt FROM (SELECT * FROM ({best}) WHERE total > 0 ORDER BY total DESC, o LIMIT 1)"


@query(f"""
, ins AS ({INSIGHTS}) {_prompts(WORDS, "signal_", "You write most about ", ": what would you like it to lead to?", 1)} UNION ALL {_prompts(PAIRS, "need_", "How could tomorrow hold a little more ", "?", 2)}
UNION ALL SELECT 3, concat('The day of ', date, ' was a low one: who or what would have helped?') FROM (SELECT date FROM doc_entries WHERE mood > 0 ORDER BY mood, date, entry_id LIMIT 1)
""")
def reflective_prompts(spark, sf_dir):
    return stats.reflective_prompts(doc_entries(spark, sf_dir), _insights(spark, sf_dir))


@query("SELECT 4 AS ord, 'Which moment of this week is worth a few lines?' AS prompt WHERE (SELECT count(*) FROM doc_entries WHERE text LIKE '%zzz no such text%') = 0")
def prompt_for_everybody(spark, sf_dir):
    """Texts without any word of the lists, and no moods."""
    blank = doc_entries(spark, sf_dir).withColumns({"text": F.regexp_replace("text", "[^\\d]+", " "), "mood": F.lit(0)})
    return stats.reflective_prompts(blank, stats.insight_frame(blank, WORDS, PAIRS, TENSE))


@query("SELECT entry_id, date, mood FROM doc_entries WHERE strftime(dt, '%m-%d') IN ('02-12', '02-13', '02-14', '02-15', '02-16', '02-17', '02-18')")
def on_this_day(spark, sf_dir):
    return insights.on_this_day(doc_entries(spark, sf_dir), TODAY, 3).select("entry_id", "date", "mood")


@query("""
, days AS (SELECT dt, date_diff('day', lag(dt) OVER (ORDER BY dt), dt) AS gap, dt - CAST(row_number() OVER (ORDER BY dt) AS INTEGER) AS island FROM (SELECT DISTINCT dt FROM doc_entries))
SELECT (SELECT count(*) FROM doc_entries) AS entries, count(*) AS distinct_days, CAST(min(dt) AS VARCHAR) AS first, CAST(max(dt) AS VARCHAR) AS last, date_diff('day', min(dt), max(dt))::INTEGER AS span_days, count(DISTINCT year(dt)) AS years,
       (SELECT max(n) FROM (SELECT count(*) AS n FROM days GROUP BY island)) AS longest_streak, coalesce(max(gap), 0)::INTEGER AS longest_gap, coalesce(median(gap), 0)::DOUBLE AS median_gap,
       date_diff('day', max(dt), DATE '2024-02-15')::INTEGER AS current_gap, (SELECT sum(word_count)::BIGINT FROM doc_entries) AS total_words FROM days
""")
def cadence(spark, sf_dir):
    return insights.cadence(doc_entries(spark, sf_dir), TODAY)


@query("SELECT year(dt)::INTEGER AS year, " + ", ".join(f"count(*) FILTER (WHERE month(dt) = {i}) AS {m}" for i, m in enumerate(D.MONTHS, 1)) + " FROM doc_entries GROUP BY year(dt)")
def writing_rhythm(spark, sf_dir):
    return insights.writing_rhythm(doc_entries(spark, sf_dir))


@query("""
, s AS (SELECT date, mood, entry_id, lag(date) OVER w AS prev_date, lag(mood) OVER w AS prev_mood, lag(entry_id) OVER w AS prev_entry_id FROM event_entries WHERE mood > 0 WINDOW w AS (ORDER BY dt, entry_id))
SELECT prev_date, prev_mood, prev_entry_id, date, mood, mood - prev_mood AS delta, entry_id FROM s WHERE prev_date IS NOT NULL ORDER BY abs(delta) DESC, date, entry_id LIMIT 5
""")
def mood_swings(spark, sf_dir):
    return insights.mood_swings(event_entries(spark, sf_dir))


_CATALOG = "SELECT people AS token, count(DISTINCT entry_id) AS mentions, min(date) AS first_seen, max(date) AS last_seen, round_even(avg(mood) FILTER (WHERE mood > 0), 2) AS mean_mood FROM event_entries GROUP BY people"


@query(_CATALOG)
def entity_catalog(spark, sf_dir):
    return insights.entity_catalog(event_entries(spark, sf_dir), "people")


@query("SELECT year, count(DISTINCT entry_id) AS mentions, round_even(avg(mood) FILTER (WHERE mood > 0), 2) AS mean_mood FROM doc_entries WHERE people = 'src3' GROUP BY year")
def entity_timeline(spark, sf_dir):
    return insights.entity_timeline(doc_entries(spark, sf_dir), "people", "src3")


@query("SELECT DISTINCT entry_id, date, mood FROM topic WHERE token = 'click'")
def entity_entries(spark, sf_dir):
    return insights.entity_entries(event_entries(spark, sf_dir), "topics", "click").select("entry_id", "date", "mood")


@query("SELECT token, count(*) AS n FROM topic WHERE token <> 'click' AND token <> '' AND entry_id IN (SELECT entry_id FROM topic WHERE token = 'click') GROUP BY token ORDER BY n DESC, token LIMIT 8")
def co_mentions(spark, sf_dir):
    return insights.co_mentions(event_entries(spark, sf_dir), "topics", "click", "topics")


@query("SELECT strftime(m, '%B %Y') AS month, entries FROM (SELECT date_trunc('month', dt) AS m, count(*) AS entries FROM doc_entries GROUP BY 1 ORDER BY entries DESC, m LIMIT 1)")
def busiest_month(spark, sf_dir):
    return insights.busiest_month(doc_entries(spark, sf_dir))


@query("""
, d AS (SELECT * FROM doc_entries), days AS (SELECT dt, date_diff('day', lag(dt) OVER (ORDER BY dt), dt) AS gap FROM (SELECT DISTINCT dt FROM d)),
cat AS (SELECT people AS token, count(DISTINCT entry_id) AS mentions, min(dt) AS first_seen, max(dt) AS last_seen FROM d GROUP BY people),
new AS (SELECT token, mentions, last_seen FROM cat WHERE first_seen >= (SELECT max(dt) - 180 FROM d) ORDER BY mentions DESC, last_seen DESC, token LIMIT 3)
SELECT 1 AS ord, concat(count(*), ' entries and ', format('{:,}', sum(word_count)::BIGINT), ' words from ', count(DISTINCT year(dt)), ' year(s), the first of ', min(dt), ', the last of ', max(dt), '.') AS line FROM d
UNION ALL SELECT 2, concat('The fullest month: ', strftime(m, '%B %Y'), ', with ', n, ' entries.') FROM (SELECT date_trunc('month', dt) AS m, count(*) AS n FROM d GROUP BY 1 ORDER BY n DESC, m LIMIT 1)
UNION ALL SELECT 3, concat('Nothing for ', gap, ' days until ', dt, ', the longest pause.') FROM (SELECT * FROM days WHERE gap >= 30 ORDER BY gap DESC, dt LIMIT 1)
UNION ALL SELECT 4, concat('The longest text is of ', date, ', with ', word_count, ' words or more.') FROM (SELECT * FROM d ORDER BY word_count DESC, entry_id LIMIT 1)
UNION ALL SELECT 5, concat('Best mood: ', b.mood, ' of 5 on ', b.date, '; lowest: ', l.mood, ' of 5 on ', l.date, '.') FROM (SELECT * FROM d WHERE mood > 0 ORDER BY mood DESC, entry_id LIMIT 1) b, (SELECT * FROM d WHERE mood > 0 ORDER BY mood, entry_id LIMIT 1) l WHERE (SELECT count(*) FROM d WHERE mood > 0) >= 3
UNION ALL SELECT 6, concat('People who came up in the last half year: ', string_agg(token, ', ' ORDER BY mentions DESC, last_seen DESC, token), '.') FROM new HAVING count(*) > 0
""")
def highlights(spark, sf_dir):
    return insights.highlights(doc_entries(spark, sf_dir), TODAY)


@query("""
, d AS (SELECT user_id, min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS b, count(*) AS n FROM events GROUP BY user_id),
e AS (SELECT concat('u', user_id, ':', day) AS entry_id, concat('u', user_id) AS people, DATE '2015-01-01' + (CASE WHEN day = 'a' THEN user_id % 40 * 45 ELSE user_id % 40 * 45 + 300 END)::INTEGER AS dt, n, (1 + n % 5)::INTEGER AS mood FROM d, (VALUES ('a'), ('b')) AS v(day)),
days AS (SELECT dt, date_diff('day', lag(dt) OVER (ORDER BY dt), dt) AS gap FROM (SELECT DISTINCT dt FROM e)),
new AS (SELECT people, count(DISTINCT entry_id) AS mentions, max(dt) AS last_seen FROM e GROUP BY people HAVING min(dt) >= (SELECT max(dt) - 180 FROM e) ORDER BY mentions DESC, last_seen DESC, people LIMIT 3)
SELECT 3 AS ord, concat('Nothing for ', gap, ' days until ', dt, ', the longest pause.') AS line FROM (SELECT * FROM days WHERE gap >= 30 ORDER BY gap DESC, dt LIMIT 1)
UNION ALL SELECT 6, concat('People who came up in the last half year: ', string_agg(people, ', ' ORDER BY mentions DESC, last_seen DESC, people), '.') FROM new HAVING count(*) > 0
""")
def pauses_and_newcomers(spark, sf_dir):
    """The two sentences that need pauses of months: two entries for each user, on days that lie 45 days apart."""
    users = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    users = users.withColumn("day", F.explode(F.array(F.lit("a"), F.lit("b"))))
    start = F.date_add(F.lit(dt.date(2015, 1, 1)), (F.col("user_id") % 40 * 45 + F.when(F.col("day") == "b", 300).otherwise(0)).cast("int"))
    rows = _with_dates(users.select(F.concat(F.lit("u"), "user_id", F.lit(":"), "day").alias("entry_id"), start.alias("dt"), F.concat(F.lit("u"), "user_id").alias("people"), F.col("n").cast("int").alias("word_count"), (1 + F.col("n") % 5).cast("int").alias("mood")))
    return insights.highlights(rows, TODAY).where("ord in (3, 6)")


@query("""
, n AS (SELECT *, row_number() OVER (ORDER BY date, entry_id) - 1 AS place, count(*) OVER () AS total FROM doc_entries)
SELECT entry_id, date, place::BIGINT AS place FROM n WHERE total <= 14 OR place IN (SELECT round_even(i * (total - 1) / 13.0, 0) FROM (SELECT DISTINCT total FROM n), range(14) AS r(i))
""")
def digest_sample(spark, sf_dir):
    return digest.sample(doc_entries(spark, sf_dir)).select("entry_id", "date", F.col("place").cast("bigint").alias("place"))


_KEYS = [signals.RATE_KEYS.get(k, k) for k in RATES]
FEATURES = f"""
, counted AS (SELECT chunk_id, entry_id, date, len(w) AS n, {', '.join(f"round_even(len(list_filter(w, lambda x: x IN {_in(v)})) / greatest(len(w), 1), 5) AS {signals.RATE_KEYS.get(k, k)}" for k, v in RATES.items())},
       len(list_filter(w, lambda x: x IN {_in(signals.FUTURE_MARKERS)})) AS f, len(list_filter(w, lambda x: x LIKE '%ed')) AS p FROM (SELECT *, regexp_extract_all(lower(text), '[a-z'']+') AS w FROM line_chunks)),
tensed AS (SELECT *, greatest(n // 20 - p - f, 0) AS q FROM counted),
features AS (SELECT *, n::DOUBLE AS token_count, round_even(p / greatest(p + q + f, 1), 4) AS past, round_even(q / greatest(p + q + f, 1), 4) AS present, round_even(f / greatest(p + q + f, 1), 4) AS future FROM tensed)
"""


def _features(spark, sf_dir):
    return signals.LexicalPass().features(line_chunks(spark, sf_dir))


_LONG = "SELECT chunk_id, entry_id, key, value_num FROM (SELECT chunk_id, entry_id, token_count, " + ", ".join(_KEYS) + ", past AS tense_past, present AS tense_present, future AS tense_future FROM features) UNPIVOT (value_num FOR key IN (token_count, " + ", ".join(_KEYS) + ", tense_past, tense_present, tense_future))"


def _with_tenses(long):
    """Signals with the stored tenses, read back, as rows of their own."""
    tense = F.from_json("value_json", "map<string,double>")
    each = F.when(F.col("key") == "temporal_focus", F.transform(F.map_entries(tense), lambda x: F.struct(F.concat(F.lit("tense_"), x["key"]).alias("key"), x["value"].alias("value_num")))).otherwise(F.array(F.struct("key", "value_num")))
    return long.withColumn("x", F.explode(each)).select("chunk_id", "entry_id", "x.key", "x.value_num")


@query(FEATURES + _LONG)
def lexical_signals(spark, sf_dir):
    return _with_tenses(signals.LexicalPass().compute(line_chunks(spark, sf_dir)))


def _rolled(columns, places: int = 6) -> str:
    total = "CASE WHEN sum(token_count) = 0 THEN 1.0 ELSE sum(token_count) END"
    return ", ".join([f"{total} AS token_count", *(f"round_even(sum({c} * token_count) / {total}, {4 if c in signals.TENSES else places}) AS {c}" for c in columns)])


@query(FEATURES + f"SELECT entry_id, {_rolled([*_KEYS, *signals.TENSES])} FROM features GROUP BY entry_id")
def lexical_rollup(spark, sf_dir):
    rolled = signals.lexical_rollup(_features(spark, sf_dir), _KEYS)
    return rolled.select("entry_id", "token_count", *(C.rounded(F.col(k), 6).alias(k) for k in _KEYS), *signals.TENSES)


@query(FEATURES + f"SELECT entry_id, any_value(date) AS date, replace(any_value(date), '-', '')::BIGINT AS date_int, {_rolled(_KEYS)} FROM features GROUP BY entry_id")
def lexical_wide(spark, sf_dir):
    """Features to signals, signals to the rollup, the rollup to columns, by date."""
    chunks = line_chunks(spark, sf_dir)
    rollup = signals.entry_signals(_stored_signals(spark, sf_dir), chunks, signals.LexicalPass())
    return signals.lexical_wide(rollup, ["token_count", *_KEYS]).select("entry_id", "date", "date_int", "token_count", *(C.rounded(F.col(k), 6).alias(k) for k in _KEYS))


def _stored_signals(spark, sf_dir):
    return signals.derive(line_chunks(spark, sf_dir), corpus.empty(spark, corpus.SIGNALS), signals.LexicalPass(), "2024-02-15")


@query(FEATURES + f"SELECT entry_id, {_rolled([*_KEYS, *signals.TENSES])} FROM features GROUP BY entry_id")
def lexical_rollup_stored(spark, sf_dir):
    rolled = signals.lexical_rollup(signals.stored_features(_stored_signals(spark, sf_dir), signals.LexicalPass()), _KEYS)
    return rolled.select("entry_id", "token_count", *(C.rounded(F.col(k), 6).alias(k) for k in _KEYS), *signals.TENSES)


def _period(period: str):
    columns = [*_KEYS, *signals.TENSES]
    # tenses have four places, so means of them often lie half between two numbers of six
    means = ", ".join(f"round_even(avg({k}), 9) AS {k}" for k in columns)
    sql = FEATURES + f", roll AS (SELECT entry_id, any_value(date) AS date, {_rolled(columns, 12)} FROM features GROUP BY entry_id) SELECT CAST(CAST(date_trunc('{period}', CAST(date AS DATE)) AS DATE) AS VARCHAR) AS period, {means}, count(*) AS entries FROM roll GROUP BY 1"

    def run(spark, sf_dir):
        rolled = signals.lexical_rollup(_features(spark, sf_dir), _KEYS).join(doc_entries(spark, sf_dir).select("entry_id", "date"), "entry_id")
        return signals.period_means(rolled, columns, period, 9)

    run.__name__ = f"period_means_{period}"
    query(sql)(run)


for _p in ("month", "quarter", "year"):
    _period(_p)


def _seen(spark, sf_dir):
    """Signals of a run that saw every third document's lines, every sixth of them with other texts."""
    lines = line_chunks(spark, sf_dir)
    number = F.substring("entry_id", 5, 20).cast("bigint")
    old = lines.where(number % 3 == 0).withColumn("content_hash", F.when(number % 6 == 0, F.lit("changed")).otherwise(C.chunk_hash(F.col("text"))))
    tags = {"namespace": "lexical", "key": "token_count", "value_json": None, "model_tag": "", "computed_at": "", "pass_name": "lexical", "pass_version": "v1"}
    return old.withColumns({k: F.lit(v).cast("string") for k, v in tags.items()} | {"value_num": F.lit(1.0)}).select(*corpus.empty(spark, corpus.SIGNALS).columns)


@query("SELECT chunk_id, left(sha256(text), 16) AS content_hash FROM line_chunks WHERE NOT (CAST(substr(entry_id, 5) AS BIGINT) % 3 = 0 AND CAST(substr(entry_id, 5) AS BIGINT) % 6 <> 0)")
def derive_pending(spark, sf_dir):
    return signals.pending(line_chunks(spark, sf_dir), _seen(spark, sf_dir), signals.LexicalPass()).select("chunk_id", "content_hash")


@query(ORACLES["derive_pending"].removeprefix(PREFIX))
def derive_pending_filtered(spark, sf_dir):
    """The same by way of a filter: what it tells to be new is not joined."""
    return signals.pending(line_chunks(spark, sf_dir), _seen(spark, sf_dir), signals.LexicalPass(), 8 << 20).select("chunk_id", "content_hash")


_OLD = "CAST(substr(entry_id, 5) AS BIGINT) % 3 = 0 AND CAST(substr(entry_id, 5) AS BIGINT) % 6 <> 0"


@query(FEATURES + f", long AS ({_LONG}) SELECT chunk_id, entry_id, key, CASE WHEN {_OLD} THEN 1.0 ELSE value_num END AS value_num, CASE WHEN {_OLD} THEN '' ELSE '2024-02-15' END AS computed_at FROM long WHERE NOT ({_OLD}) OR key = 'token_count'")
def derive_merge(spark, sf_dir):
    done = signals.derive(line_chunks(spark, sf_dir), _seen(spark, sf_dir), signals.LexicalPass(), "2024-02-15")
    return _with_tenses(done).join(done.select("chunk_id", "computed_at").distinct(), "chunk_id").select("chunk_id", "entry_id", "key", "value_num", "computed_at")


@query(FEATURES + f", long AS ({_LONG}) SELECT chunk_id, entry_id, key, value_num FROM long")
def derive_forced(spark, sf_dir):
    return _with_tenses(signals.derive(line_chunks(spark, sf_dir), _seen(spark, sf_dir), signals.LexicalPass(), "2024-02-15", force=True))


@query("SELECT count(DISTINCT entry_id) AS entries, count(DISTINCT entry_id) >= 30 AS enough FROM line_chunks")
def signal_gate(spark, sf_dir):
    return signals.signal_entries(line_chunks(spark, sf_dir))


_LABELS = signals.EMOTIONS


def _scores(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("doc:"), F.floor(F.col("vec_id") / 3)).alias("entry_id"), F.concat(F.lit("c"), "vec_id").alias("chunk_id"), "embedding", "vec_id")
    score = F.struct(*(F.abs(F.get("embedding", F.lit(i))).cast("double").alias(v) for i, v in enumerate(_LABELS))).alias("s")
    rows = vectors.select("entry_id", "chunk_id", "vec_id", score).select("entry_id", "chunk_id", "vec_id", "s.*")
    return rows.unpivot(["entry_id", "chunk_id", "vec_id"], list(_LABELS), "label", "score")


_EMOTION = f"""
, s AS (SELECT concat('doc:', vec_id // 3) AS entry_id, 1 + vec_id % 7 AS w, unnest([{', '.join(f"'{v}'" for v in _LABELS)}]) AS label, unnest([{', '.join(f'abs(embedding[{i + 1}])::DOUBLE' for i in range(len(_LABELS)))}]) AS score FROM embeddings),
emo AS (SELECT entry_id, label, round_even(sum(score * w) / sum(w), 5) AS mean, round_even(max(score), 5) AS peak FROM s GROUP BY entry_id, label)
"""


@query(_EMOTION + "SELECT * FROM emo")
def emotion_rollup(spark, sf_dir):
    scores = _scores(spark, sf_dir)
    weights = scores.select("chunk_id", (1 + F.col("vec_id") % 7).alias("word_count")).distinct()
    return signals.emotion_rollup(scores.drop("vec_id"), weights, _LABELS)


def _emotion_rollup_of_store(spark, sf_dir):
    """Scores as a classifier's pass stores them, in JSON, and the rollup of what is read back. Entries have the date of their number."""
    scores = _scores(spark, sf_dir)
    maps = scores.groupBy("chunk_id", "entry_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("label", "score")))).alias("value_json"))
    tags = {"namespace": "emotion", "key": "goemotions", "model_tag": "", "content_hash": "", "computed_at": "", "pass_name": "goemotions", "pass_version": "v1"}
    stored = maps.withColumns({k: F.lit(v) for k, v in tags.items()} | {"value_num": F.lit(None).cast("double")}).select(*corpus.empty(spark, corpus.SIGNALS).columns)
    day = F.date_add(F.lit(dt.date(2015, 1, 1)), F.floor(F.col("vec_id") / 3 % 1000).cast("int"))
    chunks = scores.select("chunk_id", "entry_id", (1 + F.col("vec_id") % 7).alias("word_count"), day.cast("string").alias("date"), D.date_int(day).cast("bigint").alias("date_int")).distinct()
    return signals.entry_signals(stored, chunks, signals.LexicalPass(), _LABELS)


_DAY = "DATE '2015-01-01' + (substr(entry_id, 5)::BIGINT % 1000)::INTEGER"


@query(_EMOTION + f"SELECT entry_id, ({_DAY})::VARCHAR AS date, strftime({_DAY}, '%Y%m%d')::BIGINT AS date_int, " + ", ".join(f"max(mean) FILTER (WHERE label = '{v}') AS {v}" for v in _LABELS) + " FROM emo GROUP BY entry_id")
def emotion_wide(spark, sf_dir):
    return signals.emotion_wide(_emotion_rollup_of_store(spark, sf_dir), _LABELS)


@query(_EMOTION + f"""
, per AS (SELECT date_trunc('quarter', {_DAY})::DATE::VARCHAR AS period, label, round_even(avg(mean), 6) AS value FROM emo GROUP BY 1, 2), best AS (SELECT label FROM per GROUP BY label ORDER BY round_even(avg(value), 9) DESC, label LIMIT 8)
SELECT period, label, value FROM per JOIN best USING (label)
""")
def top_emotions(spark, sf_dir):
    periods = signals.period_means(signals.emotion_wide(_emotion_rollup_of_store(spark, sf_dir), _LABELS), list(_LABELS), "quarter")
    return signals.top_labels(periods, list(_LABELS)).select("period", "label", "value")


def _probe(spark, sf_dir) -> list[float]:
    found = table(spark, sf_dir, "embeddings").where("vec_id = 7").select("embedding").first()
    return list(found.embedding) if found else []


@query("SELECT vec_id AS id, round_even(list_sum(list_transform(list_zip(embedding, q), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))), 6) AS distance, row_number() OVER (ORDER BY distance, vec_id) - 1 AS rank FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 7) ORDER BY distance, id LIMIT 40")
def dense_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return retrieval.dense_topk(vectors, _probe(spark, sf_dir)).withColumn("rank", F.col("rank").cast("bigint"))


_QUERY = "the thondernd of queaux schberheit was"
BM25 = """
, w AS (SELECT entry_id AS id, date, regexp_extract_all(lower(text), '[a-z'']+') AS w FROM doc_entries),
terms AS (SELECT DISTINCT unnest(['the', 'thondernd', 'of', 'queaux', 'schberheit', 'was']) AS t),
tf AS (SELECT id, date, t, len(w) AS dl, len(list_filter(w, lambda x: x = t)) AS tf FROM w, terms),
st AS (SELECT count(*) AS n, avg(len(w)) AS avgdl FROM w), df AS (SELECT t, count(*) FILTER (WHERE tf > 0) AS df FROM tf GROUP BY t),
bm AS (SELECT id, round_even(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM tf JOIN df USING (t), st WHERE date >= '2016-01-01' GROUP BY id HAVING sum(tf) > 0),
sparse AS (SELECT id, score, row_number() OVER (ORDER BY score DESC, id) - 1 AS rank FROM bm ORDER BY score DESC, id LIMIT 40)
"""


def _sparse(spark, sf_dir):
    return retrieval.bm25_topk(doc_entries(spark, sf_dir), _QUERY, key="entry_id", allowed=F.col("date") >= "2016-01-01")


@query(BM25 + "SELECT id, score, rank FROM sparse")
def bm25_topk(spark, sf_dir):
    return _sparse(spark, sf_dir).withColumn("rank", F.col("rank").cast("bigint"))


@query(BM25 + "SELECT id, score, rank FROM sparse")
def bm25_postings(spark, sf_dir):
    """The same from the inverted index: postings of all texts, of which the query's terms are read."""
    docs = doc_entries(spark, sf_dir)
    index = retrieval.postings(docs, "entry_id")
    allowed = docs.where("date >= '2016-01-01'").select(F.col("entry_id").alias("id"))
    return retrieval.bm25_of(index, retrieval.collection(index), _QUERY, allowed=allowed).withColumn("rank", F.col("rank").cast("bigint"))


@query("SELECT count(*) AS rows, sum(tf)::BIGINT AS words, count(DISTINCT term) AS terms, sum(tf * dl)::BIGINT AS weight FROM (SELECT entry_id, term, any_value(dl) AS dl, count(*) AS tf FROM (SELECT entry_id, len(w) AS dl, unnest(w) AS term FROM (SELECT entry_id, regexp_extract_all(lower(text), '[a-z'']+') AS w FROM doc_entries)) GROUP BY entry_id, term)")
def postings(spark, sf_dir):
    """What the index holds, in sums over all of it."""
    index = retrieval.postings(doc_entries(spark, sf_dir), "entry_id").where("term is not null")
    return index.agg(F.count("*").alias("rows"), F.sum("tf").alias("words"), F.countDistinct("term").alias("terms"), F.sum(F.col("tf") * F.col("dl")).alias("weight"))


@query(BM25 + """
, far AS (SELECT concat('doc:', vec_id) AS id, round_even(list_sum(list_transform(list_zip(embedding, q), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE))), 6) AS distance FROM embeddings, (SELECT embedding AS q FROM embeddings WHERE vec_id = 7)),
dense AS (SELECT id, row_number() OVER (ORDER BY distance, id) - 1 AS rank FROM far ORDER BY distance, id LIMIT 40)
SELECT id, d.rank AS dense_rank, s.rank AS sparse_rank, round_even(coalesce(1 / (60.0 + d.rank), 0) + coalesce(1 / (60.0 + s.rank), 0), 8) AS score FROM dense d FULL JOIN sparse s USING (id) ORDER BY score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, id LIMIT 8
""")
def rrf_topk(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings").select(F.concat(F.lit("doc:"), "vec_id").alias("id"), F.col("embedding").alias("vector"))
    best = retrieval.fused(retrieval.dense_topk(vectors, _probe(spark, sf_dir)), _sparse(spark, sf_dir))
    return best.select("id", F.col("dense_rank").cast("bigint").alias("dense_rank"), F.col("sparse_rank").cast("bigint").alias("sparse_rank"), "score")


@query("""
, u AS (SELECT conv_id, turn, text, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev FROM conversations WHERE role = 'user')
SELECT conv_id, turn, CASE WHEN len(list_filter(string_split_regex(text, '\\s+'), lambda x: x <> '')) <= 5 AND prev IS NOT NULL THEN concat(prev, ' ', text) ELSE text END AS query FROM u
""")
def followup_query(spark, sf_dir):
    asked = table(spark, sf_dir, "conversations").where("role = 'user'").withColumn("prev", F.expr("lag(text) over (partition by conv_id order by turn)"))
    return asked.select("conv_id", "turn", retrieval.follow_up(F.col("text"), F.col("prev")).alias("query"))


@query("SELECT entry_id, concat(least(y, z), '-01-01') AS date_from, concat(greatest(y, z), '-12-31') AS date_to FROM (SELECT entry_id, CASE doc_id % 4 WHEN 2 THEN 2023 WHEN 3 THEN 2024 ELSE year(dt) END AS y, CASE doc_id % 4 WHEN 0 THEN year(dt) WHEN 1 THEN 2019 WHEN 2 THEN 2023 ELSE 2024 END AS z FROM doc_entries)")
def question_years(spark, sf_dir):
    kind = F.col("doc_id") % 4
    other = F.when(kind == 1, "2019").otherwise(F.col("year"))
    end = F.when(kind == 2, " Was it so LAST YEAR, or this year?").when(kind == 3, " And This Year?").otherwise("")
    question = F.concat(F.lit("What was on my mind in "), "year", F.lit(" and around "), other, F.lit(", not 1066 or 20155?"), end)
    low, high = D.question_years(question, TODAY)
    return doc_entries(spark, sf_dir).select("entry_id", low.alias("date_from"), high.alias("date_to"))


def _stored(spark, sf_dir):
    """A store that lacks every fifth document, and has another text of every seventh."""
    docs = doc_entries(spark, sf_dir)
    return docs.where("doc_id % 5 <> 0").withColumn("content_hash", F.when(F.col("doc_id") % 7 == 0, F.lit("old")).otherwise(F.col("content_hash"))).select("entry_id", "date", "content_hash")


def _records(spark, sf_dir):
    return doc_entries(spark, sf_dir).select("entry_id", F.col("text").alias("body"), "date", F.when(F.col("doc_id") % 4 == 0, "mtime").otherwise("header").alias("date_source"))


_STATUS = "CASE WHEN regexp_replace(text, '^\\s+|\\s+$', '', 'g') = '' THEN 'empty' WHEN doc_id % 5 = 0 THEN 'added' WHEN doc_id % 7 = 0 THEN 'updated' ELSE 'skipped' END"


@query(f"SELECT entry_id, content_hash, {_STATUS} AS status FROM doc_entries")
def ingest_status(spark, sf_dir):
    return corpus.ingest_status(_records(spark, sf_dir), _stored(spark, sf_dir)).select("entry_id", "content_hash", "status")


@query(f"""
, st AS (SELECT *, {_STATUS} AS status FROM doc_entries)
SELECT count(*) FILTER (WHERE status = 'added') AS added, count(*) FILTER (WHERE status = 'updated') AS updated, count(*) FILTER (WHERE status = 'skipped') AS skipped, count(*) FILTER (WHERE status <> 'empty') AS n_entries,
       count(*) FILTER (WHERE status IN ('added', 'updated') AND doc_id % 4 = 0) / greatest(count(*) FILTER (WHERE status IN ('added', 'updated')), 1) AS mtime_fraction FROM st
""")
def ingest_summary(spark, sf_dir):
    return corpus.ingest_summary(corpus.ingest_status(_records(spark, sf_dir), _stored(spark, sf_dir)))


@query(f"SELECT entry_id, date, CASE WHEN {_STATUS} = 'empty' AND doc_id % 5 <> 0 AND doc_id % 7 = 0 THEN 'old' ELSE content_hash END AS content_hash FROM doc_entries WHERE NOT ({_STATUS} = 'empty' AND doc_id % 5 = 0)")
def ingest_merge(spark, sf_dir):
    status = corpus.ingest_status(_records(spark, sf_dir), _stored(spark, sf_dir)).where(F.col("status").isin("added", "updated"))
    return corpus.merged(_stored(spark, sf_dir), status.select("entry_id", "date", "content_hash"))


@query("SELECT entry_id, date FROM doc_entries WHERE NOT (date BETWEEN '2018-01-01' AND '2019-06-30')")
def delete_range(spark, sf_dir):
    docs = doc_entries(spark, sf_dir).select("entry_id", "date")
    return corpus.delete(docs, corpus.entry_ids(docs, "2018-01-01", "2019-06-30"))


@query("SELECT entry_id, arg_min(date, chunk_index) AS date, arg_min(source, chunk_index) AS source, count(*) AS chunks FROM line_chunks GROUP BY entry_id")
def list_entries(spark, sf_dir):
    return corpus.list_entries(line_chunks(spark, sf_dir))


@query("SELECT DISTINCT entry_id FROM line_chunks WHERE regexp_matches(text, 'QUEAU[a-x]|nteres of|lichkeit', 'i') OR regexp_matches(concat(entry_id, chr(10), date, chr(10), source), 'QUEAU[a-x]|nteres of|lichkeit', 'i')")
def manage_search(spark, sf_dir):
    return corpus.search_entries(line_chunks(spark, sf_dir), "QUEAU[a-x]|nteres of|lichkeit")


@query("SELECT DISTINCT entry_id FROM line_chunks WHERE regexp_matches(text, 'src[12]$|2020-02', 'i') OR regexp_matches(concat(entry_id, chr(10), date, chr(10), source), 'src[12]$|2020-02', 'i')")
def manage_search_fields(spark, sf_dir):
    """Hits in dates and sources, which texts hardly hold."""
    return corpus.search_entries(line_chunks(spark, sf_dir), "src[12]$|2020-02")


@query("SELECT entry_id, string_agg(text, chr(10) || chr(10) ORDER BY chunk_index) AS text FROM line_chunks GROUP BY entry_id")
def full_text(spark, sf_dir):
    return corpus.full_texts(line_chunks(spark, sf_dir))


@query("SELECT entry_id, arg_min(text, chunk_index) AS text, arg_min(word_count, chunk_index) AS word_count, arg_min(date, chunk_index) AS date, left(arg_min(date, chunk_index), 4) AS year FROM line_chunks WHERE date >= '2017-01-01' GROUP BY entry_id")
def load_frame(spark, sf_dir):
    lines = line_chunks(spark, sf_dir).select("entry_id", "chunk_index", "text", "word_count", "date")
    return corpus.collapse(lines, "2017-01-01").select("entry_id", "text", "word_count", "date", "year")


def _vector_chunks(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return vectors.select(F.concat(F.lit("e"), F.floor(F.col("vec_id") / 3)).alias("entry_id"), F.col("embedding").alias("vector"), (F.col("vec_id") % 3).alias("word_count"))


@query("""
, p AS (SELECT vec_id // 3 AS e, greatest(vec_id % 3, 1) AS w, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS pos FROM embeddings), m AS (SELECT e, pos, sum(v * w) / sum(w) AS m FROM p GROUP BY e, pos),
s AS (SELECT e, sqrt(sum(m * m)) AS norm FROM m GROUP BY e)
SELECT concat('e', e) AS entry_id, pos::INTEGER AS pos, round_even(m / norm, 6) AS v FROM m JOIN s USING (e) WHERE norm > 0
""")
def entry_vectors(spark, sf_dir):
    return themes.entry_vectors(_vector_chunks(spark, sf_dir)).select("entry_id", F.posexplode("vector").alias("pos", "v")).select("entry_id", "pos", C.rounded(F.col("v"), 6).alias("v"))


_FAR = "list_sum(list_transform(list_zip({}, vec), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"

#: K-means as recursive SQL: farthest-first centres, then rounds, each state one row with all centres.
_KMEANS = f"""
, p AS (SELECT concat('e', vec_id // 3) AS id, greatest(vec_id % 3, 1) AS w, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS pos FROM embeddings), m AS (SELECT id, pos, sum(v * w) / sum(w) AS m FROM p GROUP BY id, pos),
s AS (SELECT id, sqrt(sum(m * m)) AS norm FROM m GROUP BY id), v AS (SELECT id, list(m / norm ORDER BY pos) AS vec FROM m JOIN s USING (id) WHERE norm > 0 GROUP BY id),
size AS (SELECT greatest(2, least(10, round_even(sqrt(count(*) / 4), 0)::INTEGER + 1)) AS k FROM v),
seeds AS (WITH RECURSIVE st AS (
  SELECT 1 AS i, [vec] AS cs FROM (SELECT vec FROM v ORDER BY id LIMIT 1)
  UNION ALL SELECT i + 1, list_append(cs, vec) FROM (SELECT i, cs, vec, d, row_number() OVER (ORDER BY round(d, 12) DESC, id) AS rn FROM (SELECT i, cs, id, vec, list_min(list_transform(cs, lambda c: {_FAR.format('c')})) AS d FROM st, v)), size WHERE rn = 1 AND i < k AND d > 0) SELECT arg_max(cs, i) AS cs FROM st),
final AS (WITH RECURSIVE lloyd AS (
  SELECT 0 AS r, cs FROM seeds
  UNION ALL SELECT r, list_transform(range(1, len(cs) + 1), lambda j: coalesce(map_extract_value(means, j), cs[j])) FROM (
    SELECT any_value(r) + 1 AS r, any_value(cs) AS cs, map(list(j), list(mean)) AS means FROM (
      SELECT any_value(r) AS r, any_value(cs) AS cs, j, list(x ORDER BY pos) AS mean FROM (
        SELECT any_value(r) AS r, any_value(cs) AS cs, j, pos, avg(x) AS x FROM (
          SELECT r, cs, list_position(ds, list_min(ds)) AS j, unnest(vec) AS x, unnest(range(len(vec))) AS pos FROM (SELECT r, cs, vec, list_transform(cs, lambda c: {_FAR.format('c')}) AS ds FROM lloyd, v WHERE r < 60)) GROUP BY j, pos) GROUP BY j)) WHERE r IS NOT NULL) SELECT arg_max(cs, r) AS cs FROM lloyd)
SELECT id AS entry_id, (list_position(ds, list_min(ds)) - 1)::INTEGER AS theme_id FROM (SELECT id, list_transform(cs, lambda c: {_FAR.format('c')}) AS ds FROM v, final)
"""


@query(_KMEANS)
def kmeans_themes(spark, sf_dir):
    vectors = staged(themes.entry_vectors(_vector_chunks(spark, sf_dir)), scratch(spark, "vectors"))
    return themes.clusters(vectors)


@query("""
, l AS (SELECT theme_id, term, count(*) AS n FROM (SELECT doc_id % 5 AS theme_id, unnest(list_transform(regexp_extract_all(text, '[a-zA-Z'']{3,}'), lambda x: lower(x))) AS term FROM doc_entries) WHERE term NOT IN """ + _in(tuple(w.replace("'", "''") for w in sorted(themes.STOPWORDS))) + """ GROUP BY theme_id, term),
c AS (SELECT term, sum(n) AS all_n FROM l GROUP BY term), x AS (SELECT *, max(n) OVER (PARTITION BY theme_id) AS most FROM l), y AS (SELECT *, sum(n) OVER (PARTITION BY theme_id) AS own FROM x WHERE n >= 2 OR most < 2),
z AS (SELECT theme_id, term, round_even((n / own) * ln((n / own) / (all_n / (SELECT sum(all_n) FROM c) + 1e-9) + 1e-9), 8) AS score FROM y JOIN c USING (term))
SELECT theme_id, nth, term, score FROM (SELECT *, row_number() OVER (PARTITION BY theme_id ORDER BY score DESC, term)::INTEGER AS nth FROM z) WHERE nth <= 4
""")
def theme_terms(spark, sf_dir):
    return themes.theme_terms(doc_entries(spark, sf_dir).select((F.col("doc_id") % 5).alias("theme_id"), "text"))


@query("SELECT year, places AS label, round_even(count(*) / sum(count(*)) OVER (PARTITION BY year), 3) AS share FROM doc_entries GROUP BY year, places")
def theme_year_share(spark, sf_dir):
    return themes.year_share(doc_entries(spark, sf_dir).select("year", F.col("places").alias("label")))


@query("""
, t AS (SELECT string_agg(token, ', ' ORDER BY n DESC, token) AS s FROM (SELECT token, count(*) AS n FROM topic WHERE token <> '' GROUP BY token ORDER BY n DESC, token LIMIT 5)),
p AS (SELECT string_agg(people, ', ' ORDER BY n DESC, people) AS s FROM (SELECT people, count(*) AS n FROM event_entries GROUP BY people ORDER BY n DESC, people LIMIT 5))
SELECT concat('entries: ', (SELECT count(*) FROM event_entries), '; mood: ', printf('%.1f', (SELECT round_even(avg(mood), 1) FROM event_entries WHERE mood > 0)), ' of 5 on average; often named topics: ', t.s, '; often named people: ', p.s) AS overview FROM t, p
""")
def context_block(spark, sf_dir):
    return digest.overview(event_entries(spark, sf_dir))


@query(", h AS (SELECT sha256(concat(entry_id, ':', content_hash)) AS h FROM doc_entries WHERE date BETWEEN '2015-01-01' AND '2023-12-31') SELECT sha256(concat_ws('|', '2015-01-01', '2023-12-31', 'm', count(*), " + ", ".join(f"sum(('0x' || substr(h, {8 * i + 1}, 8))::BIGINT)::BIGINT" for i in range(8)) + ")) AS cache_key FROM h")
def digest_key(spark, sf_dir):
    period = corpus.in_range(doc_entries(spark, sf_dir), "2015-01-01", "2023-12-31")
    return period.agg(corpus.digest_key(period, "2015-01-01", "2023-12-31", "m").alias("cache_key"))


def _heads(talk):
    """A conversation's first text is its title, the number of its last turn the time of its last change."""
    turn = F.lpad(F.col("turn").cast("string"), 6, "0")
    return talk.groupBy(F.col("conv_id").cast("string").alias("id")).agg(F.min_by("text", "turn").alias("title"), F.lit(None).cast("string").alias("date_from"), F.lit(None).cast("string").alias("date_to"), F.count("*").cast("int").alias("k"), F.min(turn).alias("created_at"), F.max(turn).alias("updated_at"))


def _messages(talk):
    return talk.select(F.col("conv_id").cast("string").alias("conversation_id"), F.col("turn").cast("int").alias("seq"), "role", F.col("text").alias("content"), F.lit(None).cast("string").alias("excerpts_json"), F.lit("").alias("created_at"))


@query("SELECT id, title, k, updated_at, row_number() OVER (ORDER BY updated_at DESC, id) AS place FROM (SELECT conv_id::VARCHAR AS id, arg_min(text, turn) AS title, count(*)::INTEGER AS k, lpad(max(turn)::VARCHAR, 6, '0') AS updated_at FROM conversations GROUP BY conv_id) ORDER BY place LIMIT 50")
def conversation_list(spark, sf_dir):
    """The 50 that are listed first, with their places."""
    first = chats.listed(_heads(table(spark, sf_dir, "conversations"))).limit(50)
    return first.select("id", "title", "k", "updated_at", F.expr("row_number() over (order by updated_at desc, id)").cast("bigint").alias("place"))


@query("SELECT conv_id, turn, role, text FROM conversations WHERE conv_id % 3 <> 0")
def conversation_delete(spark, sf_dir):
    talk = table(spark, sf_dir, "conversations")
    heads = talk.select(F.col("conv_id").alias("id")).distinct()
    _, left = chats.deleted(heads, talk.withColumnRenamed("conv_id", "conversation_id"), heads.where("id % 3 = 0"))
    return left.withColumnRenamed("conversation_id", "conv_id").select("conv_id", "turn", "role", "text")


@query("SELECT entry_id, part, word_count FROM (SELECT entry_id, trim(unnest(string_split(concat(people, chr(10), '---', chr(10), places, chr(10), chr(10), chr(10), date), chr(10)))) AS part, 1 AS word_count FROM doc_entries) WHERE part NOT IN ('', '---')")
def batch_split(spark, sf_dir):
    blob = F.concat("people", F.lit("\n---\n"), "places", F.lit("\n\n\n"), "date")
    return doc_entries(spark, sf_dir).select("entry_id", F.explode(texts.batch_parts(blob)).alias("part")).withColumn("word_count", C.word_count(F.col("part")))


from lumenfold import queries_more, queries_stores  # noqa: E402, F401  they add their queries to these


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
