"""Whole flows: ingest, enrich, derive, ask, digest, themes."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.functions import dates as D
from lumenfold.operators import corpus, digest, retrieval, signals, themes
from lumenfold.plans.follow import Cells, Index
from lumenfold.plans.providers import ChatProvider, Embedder, answers, with_vectors
from lumenfold.sources import conversations as chats
from lumenfold.sources.snapshots import Snapshots, scratch, staged

#: The largest filter of chunks that a pass has seen; beyond it they are joined.
FILTER_BYTES = 8 << 20
NO_HITS = "No entries match that question."
ENRICH = "Answer with a JSON object: mood (1 to 5), topics, people, places (lists)."


def dated_records(records: DataFrame, today: dt.date, day_first: bool = False) -> DataFrame:
    """Records with dt and date_source, by what they carry: a modification time, a name, or an explicit date."""
    body = F.col("body")
    if "modified" in records.columns:
        date, source = D.file_date(F.col("stem"), body, F.col("modified"), day_first)
    else:
        explicit = F.col("explicit_date") if "explicit_date" in records.columns else F.lit(None).cast("string")
        date, source = D.text_date(body, explicit, today)
        if "stem" in records.columns:
            name = D.filename_date(F.col("stem"), day_first)
            date, source = F.coalesce(name, date), F.when(name.isNotNull(), "filename").otherwise(source)
    return records.withColumns({"dt": date, "date_source": source})


def ingest(store: Snapshots, records: DataFrame, embedder: Embedder, today: dt.date, now: str, day_first: bool = False, **chunking) -> DataFrame:
    """New and changed entries into the store; returns each record's status. The new state is complete before it is seen.

    What is written goes with what has changed. The status is against the state before, which stays until ``vacuum``, so it may be read later. Of two
    ingests of one entry at a time the later one counts. ``day_first``: in names such as 03-04-2020 the day comes first.
    """
    existing = store.read()
    status = dated_records(corpus.ingest_status(records, existing), today, day_first)
    changed = status.where(F.col("status").isin("added", "updated"))
    store.replace(with_vectors(corpus.to_chunks(changed, now, **chunking), embedder), changed.select("entry_id"))
    return status.select("entry_id", "status", F.col("dt").cast("string").alias("date"), "date_source")


def to_remove(store: Snapshots, ids: list[str] = (), date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """The entry_ids that ``remove`` is asked for: these and those of the period, each once."""
    gone = store.spark.createDataFrame([(i,) for i in ids if i], "entry_id string")
    if date_from or date_to:
        gone = gone.union(corpus.entry_ids(store.read(), date_from, date_to))
    return gone.distinct()


def remove(store: Snapshots, ids: list[str] = (), date_from: str | None = None, date_to: str | None = None, everything: bool = False) -> int:
    """Without the entries of these ids and of the period, or without any; how many ids were asked for. Without either, nothing goes."""
    if everything:
        n = store.read().select("entry_id").distinct().count()
        store.write(store.read().where("false"))
        return n
    gone = to_remove(store, ids, date_from, date_to)
    n = corpus.requested(gone).first().requested
    store.replace(None, gone)
    return n


def derive(entries: Snapshots, store: Snapshots, a_pass: signals.Pass, now: str, since: str | None = None, rebuild: bool = False) -> DataFrame:
    """The pass over entries with chunks that it has not seen, or over all of them again. ``store`` is of this pass alone, and has entry_id as its key.

    It looks at every chunk's hash; ``follow_signals`` reads only what has changed.
    """
    chunks = corpus.in_range(entries.read(), since).select(F.col("id").alias("chunk_id"), "entry_id", "text")
    own = store.stage(signals.to_derive(chunks, store.read(), a_pass, rebuild, FILTER_BYTES).select("entry_id").distinct())
    todo = signals.to_derive(chunks.join(own, "entry_id", "left_semi"), store.read(), a_pass, True)
    return store.replace(signals.derived(todo, a_pass, now), own)


def aggregate(entries: Snapshots, store: Snapshots, rollup: Snapshots, a_pass: signals.LexicalPass) -> DataFrame:
    """The rollup of stored signals to entries, as a new state of its store."""
    chunks = entries.read().select(F.col("id").alias("chunk_id"), "entry_id", "date", "date_int", "word_count")
    return rollup.write(signals.entry_signals(store.read(), chunks, a_pass))


def enrich(store: Snapshots, chat: ChatProvider, limit: int | None = None) -> DataFrame:
    """Mood and lists for entries without them, from a chat model."""
    todo = corpus.full_texts(store.read().where("not enriched"))
    todo = todo.orderBy("entry_id").limit(limit) if limit else todo
    said = store.stage(corpus.cleaned_answers(answers(todo, chat, ENRICH)))  # asked once, even if others write meanwhile

    def with_answers(chunks: DataFrame):
        own = chunks.join(said.select("entry_id"), "entry_id", "left_semi")
        return corpus.apply_enrichment(own, said), said

    return store.update(with_answers)


def hybrid_search(chunks: DataFrame, query: str, embedder: Embedder, k: int = 8, date_from: str | None = None, date_to: str | None = None, pool: int = 40, index: Index | None = None, cells: Cells | None = None) -> DataFrame:
    """The k best chunks of the nearest and the best matching ones, of the period only; with ``index``, which must follow the chunks' store, matches come from its postings; with ``cells``, near ones from those around the query, which may miss some."""
    period = corpus.in_range(chunks, date_from, date_to)
    allowed = F.lit(True)
    for given, ok in ((date_from, F.col("date") >= (date_from or "")), (date_to, F.col("date") <= (date_to or ""))):
        allowed = allowed & ok if given else allowed
    vector = embedder.embed([query])[0]
    dense = cells.nearest(vector, pool, date_from=date_from, date_to=date_to) if cells is not None else retrieval.dense_topk(period, vector, pool)
    if index is not None:
        sparse = index.best(query, pool, period.select("id") if date_from or date_to else None)
    else:
        sparse = retrieval.bm25_topk(chunks, query, pool, allowed=allowed)
    best = retrieval.fused(dense, sparse, k)
    return chunks.join(F.broadcast(best), "id")


@dataclass
class Answer:
    text: str
    dates: list[str]
    excerpts: list[str]
    date_from: str | None = None
    date_to: str | None = None


def ask(chunks: DataFrame, question: str, embedder: Embedder, chat: ChatProvider, today: dt.date, k: int = 8, date_from: str | None = None, date_to: str | None = None, history: list[dict[str, str]] = (), auto_dates: bool = False, pool: int = 40, index: Index | None = None) -> Answer:
    """An answer from the k best chunks; an explicit period wins over years in the question."""
    spark = chunks.sparkSession
    if auto_dates and not (date_from or date_to):
        low, high = D.question_years(F.lit(question), today)
        date_from, date_to = spark.range(1).select(low, high).first()
    turns = [m for m in history if m.get("role") in ("user", "assistant") and m.get("content")][-8:]
    last = next((m["content"] for m in reversed(turns) if m["role"] == "user"), None)
    query = f"{last} {question}" if last and len(question.split()) <= 5 else question
    found = hybrid_search(chunks, query, embedder, k, date_from, date_to, pool, index)
    row = retrieval.context_text(found).first()
    if not row.cited:
        return Answer(NO_HITS, [], [], date_from, date_to)
    text = chat.chat([{"role": "system", "content": row.context}, *turns, {"role": "user", "content": question}])
    return Answer(text, row.cited, row.context.split("\n\n"), date_from, date_to)


def compose_digest(entries: DataFrame, digests: DataFrame, chat: ChatProvider, date_from: str, date_to: str, model: str, now: str, force: bool = False) -> tuple[str, bool, DataFrame]:
    """(text, whether it was cached, the cache): from the sample's excerpts of 700 characters and the overview."""
    spark = entries.sparkSession
    key = entries.agg(corpus.digest_key(entries, date_from, date_to, model).alias("k")).first().k
    hit = None if force else chats.cached(digests, key).first()
    if hit:
        return hit.text, True, digests
    excerpts = [f"[{r.date}] {r.text[:700]}" for r in digest.sample(entries).orderBy("date", "entry_id").select("date", "text").collect()]
    text = chat.chat([{"role": "system", "content": digest.overview(entries).first().overview}, {"role": "user", "content": "\n\n".join(excerpts)}])
    new = spark.createDataFrame([(key, date_from, date_to, model, text, now)], digests.schema)
    return text, False, chats.put(digests, new)


def discover_themes(chunks: DataFrame, k: int | None = None, characters: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(themes, assignment of entries with year and label); terms are of whole texts, or of their first ``characters``."""
    spark = chunks.sparkSession
    vectors = staged(themes.entry_vectors(chunks), scratch(spark, "vectors"))  # each round reads them
    assigned = staged(themes.clusters(vectors, k), scratch(spark, "themes"))
    texts = corpus.full_texts(chunks)
    members = assigned.join(texts.withColumn("text", F.substring("text", 1, characters)) if characters else texts, "entry_id")
    found = themes.themes(members, themes.theme_terms(members))
    years = corpus.collapse(chunks).select("entry_id", "date", "year")
    return found, assigned.join(years, "entry_id").join(F.broadcast(found.select("theme_id", "label")), "theme_id")


def name_themes(found: DataFrame, chat: ChatProvider) -> DataFrame:
    """Themes with titles from a chat model, of at most 60 characters; the label stays where it fails or says nothing.

    Themes are ten at most unless more were asked for, so the driver asks for each.
    """
    named = []
    for row in found.collect():
        try:
            title = chat.chat([{"role": "user", "content": f"A short title for entries about: {', '.join(row.terms or [])}"}]).strip().strip('"')[:60]
        except Exception:  # a model that cannot be reached must not lose the themes
            title = ""
        named.append((row.theme_id, title or row.label, row.terms, row.size))
    return found.sparkSession.createDataFrame(named, found.schema)
