"""More registered queries: sources and dates, lists and answers, changes of stores, conversations, context and themes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from lumenfold.functions import columns as C
from lumenfold.functions import dates as D
from lumenfold.operators import corpus, insights, retrieval, themes
from lumenfold.plans import flows
from lumenfold.queries import ORACLES, TODAY, doc_entries, line_chunks, query, table
from lumenfold.queries import _heads, _messages, _records, _stored
from lumenfold.sources import conversations as chats
from lumenfold.sources import texts

_STRIP = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
_BODY = _STRIP.format("text")
_SPACE = "\\s+"


@query("SELECT entry_id, CASE doc_id % 5 WHEN 0 THEN date WHEN 1 THEN date WHEN 2 THEN (CASE WHEN day(dt) <= 12 THEN make_date(year(dt), day(dt), month(dt)) ELSE dt END)::VARCHAR WHEN 3 THEN date ELSE NULL END AS month_first, CASE doc_id % 5 WHEN 0 THEN date WHEN 1 THEN (CASE WHEN day(dt) <= 12 THEN make_date(year(dt), day(dt), month(dt)) ELSE dt END)::VARCHAR WHEN 2 THEN date WHEN 3 THEN date ELSE NULL END AS day_first FROM doc_entries")
def filename_orders(spark, sf_dir):
    """Two-digit years, month first and day first, with the other order where the first is no date."""
    kind, shape = F.col("doc_id") % 5, lambda p: F.date_format("dt", p)
    name = F.when(kind == 0, shape("yyyy_MM_dd")).when(kind == 1, shape("MM-dd-yy")).when(kind == 2, shape("dd.MM.yyyy")).when(kind == 3, shape("yyyyMMdd")).otherwise("99-98-97")
    return doc_entries(spark, sf_dir).select("entry_id", D.filename_date(name).cast("string").alias("month_first"), D.filename_date(name, True).cast("string").alias("day_first"))


@query("SELECT entry_id, CASE doc_id % 3 WHEN 2 THEN '2024-02-01' ELSE date END AS found, CASE doc_id % 3 WHEN 0 THEN 'filename' WHEN 1 THEN 'header' ELSE 'mtime' END AS source FROM doc_entries")
def file_dates(spark, sf_dir):
    """Files: the name, then the header, then the time of the last change."""
    kind = F.col("doc_id") % 3
    stem = F.when(kind == 0, F.date_format("dt", "yyyyMMdd")).otherwise("note")
    body = F.when(kind == 1, F.concat(F.date_format("dt", "MMMM d, yyyy"), F.lit("\n"), "text")).otherwise(F.concat(F.lit("\n\n\n\n\n"), "text"))
    found, source = D.file_date(stem, body, F.lit(dt.datetime(2024, 2, 1, 12)))
    return doc_entries(spark, sf_dir).select("entry_id", found.cast("string").alias("found"), source.alias("source"))


@query("SELECT entry_id, CASE doc_id % 4 WHEN 2 THEN '2024-02-15' WHEN 3 THEN '2024-02-15' ELSE date END AS found, CASE doc_id % 4 WHEN 0 THEN 'manual' WHEN 1 THEN 'header' ELSE 'today' END AS source FROM doc_entries")
def text_dates(spark, sf_dir):
    """Pastes: an explicit full date, then the header, then today; a part of a date is none."""
    kind = F.col("doc_id") % 4
    given = F.when(kind == 0, F.col("date")).when(kind == 3, F.date_format("dt", "yyyy-MM"))
    body = F.when(kind == 1, F.concat(F.date_format("dt", "d MMM yyyy"), F.lit("\n"), "text")).otherwise(F.concat(F.lit("\n\n\n\n\n"), "text"))
    found, source = D.text_date(body, given, TODAY)
    return doc_entries(spark, sf_dir).select("entry_id", found.cast("string").alias("found"), source.alias("source"))


@query(f"SELECT concat('upload:', doc_id, '_', strftime(dt, '%Y%m%d'), '.final.txt') AS entry_id, concat(doc_id, '_', strftime(dt, '%Y%m%d'), '.final') AS stem, sha256({_BODY}) AS body_sha, date AS found FROM doc_entries")
def uploads(spark, sf_dir):
    name = F.concat_ws("_", "doc_id", F.concat(F.date_format("dt", "yyyyMMdd"), F.lit(".final.txt")))
    sent = texts.uploads(doc_entries(spark, sf_dir).select(name.alias("filename"), F.col("text").alias("content")))
    return sent.select("entry_id", "stem", F.sha2("body", 256).alias("body_sha"), D.filename_date(F.col("stem")).cast("string").alias("found"))


@query("SELECT DISTINCT concat('paste:', left(content_hash, 16)) AS entry_id FROM doc_entries")
def pasted_ids(spark, sf_dir):
    return texts.pasted(doc_entries(spark, sf_dir).select(F.col("text").alias("body"))).select("entry_id").distinct()


@query("SELECT name, count(*) AS entries, min(date) AS first, max(date) AS last FROM doc_entries, (VALUES ('all', '0001-01-01', '9999-12-31'), ('year', '2024-01-01', '2024-12-31'), ('2019', '2019-01-01', '2019-12-31'), ('365 days', '2023-02-16', '2024-02-15'), ('1000 days', '2021-05-22', '2024-02-15')) AS p(name, a, b) WHERE date BETWEEN a AND b GROUP BY name")
def presets(spark, sf_dir):
    out = None
    for name in ("all", "year", "2019", "365 days", "1000 days"):
        own = corpus.in_range(doc_entries(spark, sf_dir), *D.preset_range(name, TODAY)).agg(F.count("*").alias("entries"), F.min("date").alias("first"), F.max("date").alias("last")).where("entries > 0")
        own = own.select(F.lit(name).alias("name"), "entries", "first", "last")
        out = own if out is None else out.union(own)
    return out


@query(f"SELECT entry_id, part::INTEGER AS part, sha256(p) AS sha FROM (SELECT entry_id, row_number() OVER (PARTITION BY entry_id ORDER BY i) - 1 AS part, p FROM (SELECT entry_id, generate_subscripts(ps, 1) AS i, {_STRIP.format('unnest(ps)')} AS p FROM (SELECT entry_id, string_split_regex(replace(text, chr(10), chr(10) || ' ' || chr(10)), '\\n\\s*\\n') AS ps FROM doc_entries)) WHERE p <> '')")
def paragraph_split(spark, sf_dir):
    rows = doc_entries(spark, sf_dir).select("entry_id", F.posexplode(C.paragraphs(F.regexp_replace("text", "\n", "\n \n"))).alias("part", "p"))
    return rows.select("entry_id", "part", F.sha2("p", 256).alias("sha"))


@query(f"""
, s0 AS (SELECT entry_id, string_split(regexp_replace({_BODY}, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS ss FROM doc_entries),
s AS (SELECT entry_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS i FROM s0),
ranges AS (
  WITH RECURSIVE st AS (
    SELECT entry_id, i, 1::BIGINT AS a, length(s)::BIGINT AS n, NULL::BIGINT AS fa, NULL::BIGINT AS fb FROM s WHERE i = 1
    UNION ALL
    SELECT st.entry_id, s.i, CASE WHEN st.n + length(s.s) + 1 > 1800 THEN s.i ELSE st.a END, CASE WHEN st.n + length(s.s) + 1 > 1800 THEN length(s.s) ELSE st.n + 1 + length(s.s) END, CASE WHEN st.n + length(s.s) + 1 > 1800 THEN st.a END, CASE WHEN st.n + length(s.s) + 1 > 1800 THEN st.i END
    FROM st JOIN s ON s.entry_id = st.entry_id AND s.i = st.i + 1)
  SELECT entry_id, fa AS a, fb AS b FROM st WHERE fa IS NOT NULL UNION ALL SELECT entry_id, arg_max(a, i), max(i) FROM st GROUP BY entry_id)
SELECT entry_id, (row_number() OVER (PARTITION BY entry_id ORDER BY a) - 1)::INTEGER AS part, sum(length(s) + 1)::INTEGER - 1 AS n_chars, sha256(string_agg(s, ' ' ORDER BY i)) AS sha FROM ranges JOIN s USING (entry_id) WHERE i BETWEEN a AND b GROUP BY entry_id, a, b
""")
def sentence_windows(spark, sf_dir):
    rows = doc_entries(spark, sf_dir).select("entry_id", F.posexplode(C.windows(F.col("text"))).alias("part", "p"))
    return rows.select("entry_id", "part", F.length("p").alias("n_chars"), F.sha2("p", 256).alias("sha"))


@query("""
SELECT entry_id, CASE doc_id % 5 WHEN 0 THEN 3 WHEN 1 THEN 5 WHEN 2 THEN 1 WHEN 3 THEN 3 ELSE (1 + doc_id // 5 % 5)::INTEGER END AS mood, CASE WHEN doc_id % 5 = 3 THEN '' ELSE concat_ws(', ', lower(people), lower(places)) END AS topics,
       CASE WHEN doc_id % 5 = 3 THEN '' ELSE lower(people) END AS people, '' AS places FROM doc_entries
""")
def cleaned_answers(spark, sf_dir):
    """A chat model's answers: fenced JSON, moods out of range and no numbers, lists with blanks and repetitions, no JSON at all."""
    kind = F.col("doc_id") % 5
    mood = F.when(kind == 0, '"good"').when(kind == 1, "9").when(kind == 2, "-3").otherwise((1 + F.floor(F.col("doc_id") / 5) % 5).cast("string"))
    json = F.concat(F.lit('Sure:\n```json\n{"mood": '), mood, F.lit(', "topics": [" '), "people", F.lit('", "'), F.upper("places"), F.lit('", "", "'), F.upper("people"), F.lit(' "], "people": ["'), "people", F.lit('"]}\n```\nAnything else?'))
    answers = doc_entries(spark, sf_dir).select("entry_id", F.when(kind == 3, "I cannot say.").otherwise(json).alias("answer"))
    return corpus.cleaned_answers(answers)


@query("SELECT entry_id, concat_ws('|', people, places) AS parts FROM doc_entries")
def shown_lists(spark, sf_dir):
    """Lists as they are shown: without brackets, quotes, blanks and what only says that there is nothing."""
    kind = F.col("doc_id") % 3
    text = F.when(kind == 0, F.concat(F.lit("['"), "people", F.lit("', '"), "places", F.lit("']"))).when(kind == 1, F.concat_ws(", ", F.lit("None"), "people", F.lit(" "), "places", F.lit("[]"))).otherwise(F.concat_ws(",", "people", F.lit("null"), "places"))
    return doc_entries(spark, sf_dir).select("entry_id", F.array_join(C.shown(text), "|").alias("parts"))


@query("SELECT count(DISTINCT entry_id) AS entries, count(*) AS chunks, sum(word_count)::BIGINT AS words FROM line_chunks")
def corpus_totals(spark, sf_dir):
    return corpus.corpus_totals(line_chunks(spark, sf_dir))


@query("SELECT 'all' AS name, bool_or(mood > 0) AS has_enrichment FROM doc_entries UNION ALL SELECT 'without moods', bool_or(mood > 0 AND mood < 0) FROM doc_entries UNION ALL SELECT 'no rows', false")
def enrichment_there(spark, sf_dir):
    """Of all entries, of all without their moods, and of none."""
    docs = doc_entries(spark, sf_dir)
    frames = {"all": docs, "without moods": docs.withColumn("mood", F.lit(0)), "no rows": docs.where("false")}
    parts = [corpus.has_enrichment(df).select(F.lit(name).alias("name"), "has_enrichment") for name, df in frames.items()]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT concat('upload:', name) AS entry_id, CASE doc_id % 3 WHEN 2 THEN '2024-02-15' ELSE date END AS date, CASE doc_id % 3 WHEN 0 THEN 'filename' WHEN 1 THEN 'header' ELSE 'today' END AS date_source FROM (SELECT *, CASE doc_id % 3 WHEN 0 THEN concat(doc_id, ' ', strftime(dt, '%d-%m-%Y'), '.txt') ELSE concat('n', doc_id, '.txt') END AS name FROM doc_entries)")
def upload_dates(spark, sf_dir):
    """Uploads as ingest dates them: the name, with the day first, then the header, then today."""
    kind = F.col("doc_id") % 3
    name = F.when(kind == 0, F.concat_ws(" ", "doc_id", F.concat(F.date_format("dt", "dd-MM-yyyy"), F.lit(".txt")))).otherwise(F.concat(F.lit("n"), "doc_id", F.lit(".txt")))
    body = F.when(kind == 1, F.concat(F.date_format("dt", "MMMM d, yyyy"), F.lit("\n"), "text")).otherwise(F.concat(F.lit("\n\n\n\n\nx "), "text"))
    sent = texts.uploads(doc_entries(spark, sf_dir).select(name.alias("filename"), body.alias("content")))
    # the strip takes the blank lines away, so the header of the others is the text's own first lines, which hold no dates
    return flows.dated_records(sent, TODAY, day_first=True).select("entry_id", F.col("dt").cast("string").alias("date"), "date_source")


def _flagged(spark, sf_dir):
    blank = {c: F.lit("") for c in ("topics", "places")}
    return line_chunks(spark, sf_dir).withColumns(blank | {"people": F.lit(""), "mood": F.lit(0), "enriched": F.substring("entry_id", 5, 20).cast("bigint") % 3 == 0})


@query("SELECT count(DISTINCT entry_id) AS pending FROM line_chunks WHERE CAST(substr(entry_id, 5) AS BIGINT) % 3 <> 0")
def pending_enrichment(spark, sf_dir):
    return corpus.pending(_flagged(spark, sf_dir))


@query("""
SELECT chunk_id, CASE WHEN n % 4 = 1 THEN (1 + n % 5)::INTEGER ELSE 0 END AS mood, CASE WHEN n % 4 = 1 THEN concat('topic ', n % 7) ELSE '' END AS topics, (n % 3 = 0 OR n % 4 = 1) AS enriched FROM (SELECT chunk_id, CAST(substr(entry_id, 5) AS BIGINT) AS n FROM line_chunks)
""")
def apply_enrichment(spark, sf_dir):
    n = F.col("doc_id")
    answers = doc_entries(spark, sf_dir).where(n % 4 == 1).select("entry_id", (1 + n % 5).cast("int").alias("mood"), F.concat(F.lit("topic "), n % 7).alias("topics"), F.lit("").alias("people"), F.lit("").alias("places"))
    return corpus.apply_enrichment(_flagged(spark, sf_dir), answers).select("chunk_id", "mood", "topics", "enriched")


_CHANGED = f"(doc_id % 5 = 0 OR doc_id % 7 = 0) AND {_BODY} <> ''"


@query(f"SELECT CASE WHEN doc_id % 4 = 0 THEN 'mtime' ELSE 'header' END AS date_source, count(*) AS entries FROM doc_entries WHERE {_CHANGED} GROUP BY 1")
def ingest_date_sources(spark, sf_dir):
    return corpus.date_sources(corpus.ingest_status(_records(spark, sf_dir), _stored(spark, sf_dir)))


@query(f"SELECT count(*) FILTER (WHERE doc_id % 4 = 0) / greatest(count(*), 1) > 0.2 AS check_dates FROM doc_entries WHERE {_CHANGED}")
def ingest_warning(spark, sf_dir):
    summary = corpus.ingest_summary(corpus.ingest_status(_records(spark, sf_dir), _stored(spark, sf_dir)))
    return corpus.dates_to_check(summary, 0.2).select("check_dates")


@query("SELECT count(*) AS kept, (SELECT count(*) + 1 FROM doc_entries WHERE doc_id % 9 = 4) AS requested FROM doc_entries WHERE doc_id % 9 <> 4")
def delete_requested(spark, sf_dir):
    """Ids that go, one of them twice and one that is not there; how many were asked for."""
    docs = doc_entries(spark, sf_dir)
    ids = docs.where("doc_id % 9 = 4").select("entry_id")
    odd = spark.createDataFrame([("doc:4",), ("doc:-1",), ("",), (None,)], "entry_id string")
    return corpus.delete(docs, ids.union(odd)).agg(F.count("*").alias("kept")).join(corpus.requested(ids.union(odd)))


@query("SELECT entry_id, chunk_id, sha256(text) AS sha, row_number() OVER (ORDER BY date_int, entry_id, chunk_index) AS place FROM line_chunks WHERE date BETWEEN '2018-01-01' AND '2018-03-31'")
def ordered_chunks(spark, sf_dir):
    """The chunks of a quarter, with their places in time."""
    rows = corpus.ordered_chunks(line_chunks(spark, sf_dir).withColumn("id", F.col("chunk_id")), "2018-01-01", "2018-03-31")
    number = F.split("id", "::").getItem(1).cast("int")
    return rows.withColumn("no", number).selectExpr("entry_id", "id as chunk_id", "sha2(text, 256) as sha", "row_number() over (order by date, entry_id, no) as place").withColumn("place", F.col("place").cast("bigint"))


@query("SELECT conv_id::VARCHAR AS id, CASE WHEN conv_id % 4 = 0 THEN 'new title' ELSE arg_min(text, turn) END AS title, lpad(min(turn)::VARCHAR, 6, '0') AS created_at, CASE WHEN conv_id % 4 = 0 THEN 'later' ELSE lpad(max(turn)::VARCHAR, 6, '0') END AS updated_at, CASE WHEN conv_id % 4 = 0 THEN 1 ELSE count(*) END AS messages FROM conversations GROUP BY conv_id")
def conversation_save(spark, sf_dir):
    """Every fourth conversation is saved again, with one message: it keeps its time of creation and loses its old messages."""
    talk = table(spark, sf_dir, "conversations")
    heads, said = _heads(talk), _messages(talk)
    again = heads.where("cast(id as bigint) % 4 = 0").withColumns({"title": F.lit("new title"), "created_at": F.lit("later"), "updated_at": F.lit("later")})
    heads, said = chats.saved(heads, said, again, said.where("cast(conversation_id as bigint) % 4 = 0 and seq = 0").withColumn("content", F.lit("again")))
    n = said.groupBy(F.col("conversation_id").alias("id")).agg(F.count("*").alias("messages"))
    return heads.join(n, "id").select("id", "title", "created_at", "updated_at", "messages")


@query("SELECT conv_id::VARCHAR AS id, CASE WHEN conv_id = 3 THEN 'renamed' ELSE arg_min(text, turn) END AS title, CASE WHEN conv_id = 3 THEN 'now' ELSE lpad(max(turn)::VARCHAR, 6, '0') END AS updated_at FROM conversations GROUP BY conv_id")
def conversation_rename(spark, sf_dir):
    return chats.renamed(_heads(table(spark, sf_dir, "conversations")), "3", "renamed", "now").select("id", "title", "updated_at")


@query("SELECT turn::INTEGER AS seq, role, text AS content FROM conversations WHERE conv_id = 3")
def conversation_messages(spark, sf_dir):
    return chats.messages_of(_messages(table(spark, sf_dir, "conversations")), "3").select("seq", "role", "content")


@query("SELECT content_hash AS cache_key, CASE WHEN min(doc_id) % 2 = 0 THEN 'new' ELSE 'old' END AS text FROM doc_entries GROUP BY content_hash")
def digest_put(spark, sf_dir):
    """A cache with a digest for each content, of which every second is put anew."""
    keys = doc_entries(spark, sf_dir).groupBy(F.col("content_hash").alias("cache_key")).agg(F.min("doc_id").alias("n"))
    row = lambda text: [F.lit("").alias("date_from"), F.lit("").alias("date_to"), F.lit("m").alias("model"), F.lit(text).alias("text"), F.lit("").alias("created_at")]
    return chats.put(keys.select("cache_key", *row("old")), keys.where("n % 2 = 0").select("cache_key", *row("new"))).select("cache_key", "text")


@query("""
, best AS (SELECT * FROM doc_entries ORDER BY word_count DESC, entry_id LIMIT 8)
SELECT sha256(string_agg(concat('[', date, '] ', text), chr(10) || chr(10) ORDER BY date, entry_id)) AS context_sha, (SELECT string_agg(date, ' ' ORDER BY date) FROM (SELECT DISTINCT date FROM best)) AS cited FROM best
""")
def context_excerpts(spark, sf_dir):
    """What a chat model is told of eight hits, and the dates that are cited."""
    hits = doc_entries(spark, sf_dir).orderBy(F.desc("word_count"), "entry_id").limit(8).select("date", F.col("entry_id").alias("id"), "text")
    return retrieval.context_text(hits).select(F.sha2("context", 256).alias("context_sha"), F.array_join("cited", " ").alias("cited"))


@query("SELECT people, greatest(2, least(10, round_even(sqrt(count(*) / 4), 0)::INTEGER + 1)) AS k FROM doc_entries GROUP BY people")
def themes_k(spark, sf_dir):
    return doc_entries(spark, sf_dir).groupBy("people").agg(F.count("*").alias("n")).select("people", themes.default_k_of(F.col("n")).alias("k"))


_TERMS = ORACLES["theme_terms"].replace("doc_id % 5 AS theme_id", "doc_id % 2 AS theme_id")


@query(_TERMS.split("\nWITH ", 1)[1].join([", terms AS (WITH ", ")"]) + """
, every AS (SELECT theme_id, nth, term FROM terms UNION ALL SELECT theme_id + 2, nth, term FROM terms), size AS (SELECT doc_id % 4 AS theme_id, count(*) AS size FROM doc_entries GROUP BY 1),
named AS (SELECT theme_id, size, string_agg(term, ', ' ORDER BY nth) AS terms, string_agg(term, ', ' ORDER BY nth) FILTER (WHERE nth <= 3) AS label FROM every JOIN size USING (theme_id) GROUP BY theme_id, size)
SELECT theme_id, size, terms, CASE WHEN n > 1 THEN concat(label, ' (', n, ')') ELSE label END AS label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY size DESC, theme_id) AS n FROM named)
""")
def theme_labels(spark, sf_dir):
    """Four themes of which two and two have the same terms, and so numbered labels."""
    docs = doc_entries(spark, sf_dir)
    terms = themes.theme_terms(docs.select((F.col("doc_id") % 2).alias("theme_id"), "text"))
    every = terms.union(terms.withColumn("theme_id", F.col("theme_id") + 2))
    found = themes.themes(docs.select((F.col("doc_id") % 4).alias("theme_id")), every)
    return found.select("theme_id", "size", F.array_join("terms", ", ").alias("terms"), "label")


@query("SELECT people AS token, count(DISTINCT entry_id) AS mentions, row_number() OVER (ORDER BY count(DISTINCT entry_id) DESC, max(date) DESC, people) AS place FROM event_entries GROUP BY people ORDER BY place LIMIT 20")
def entity_order(spark, sf_dir):
    """The first 20 of the catalog, with their places."""
    from lumenfold.queries import event_entries

    first = insights.entity_catalog(event_entries(spark, sf_dir), "people").limit(20)
    return first.selectExpr("token", "mentions", "cast(row_number() over (order by mentions desc, last_seen desc, token) as bigint) as place")
