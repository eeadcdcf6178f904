import datetime as dt

import pytest
from pyspark.sql import functions as F

from lumenfold.operators import corpus, digest, insights, retrieval, signals, stats, themes
from lumenfold.plans import flows
from lumenfold.plans.providers import EchoChat, HashEmbedder
from lumenfold.sources import conversations as chats
from lumenfold.sources import texts
from lumenfold.sources.snapshots import Snapshots
from lumenfold.streaming import drops

NOW, TODAY = "2024-12-11T00:00:00", dt.date(2024, 12, 11)


@pytest.fixture(scope="module")
def entries(spark):
    rows = [
        ("n1", "2019-03-02", 2, "lena, omar", "garden, books", 40),
        ("n2", "2019-03-03", 5, "omar", "garden", 210),
        ("n3", "2019-03-04", 4, "lena", "books", 90),
        ("n4", "2021-03-03", 1, "omar", "books, repairs", 75),
        ("n5", "2021-11-20", 0, "", "", 640),
    ]
    df = spark.createDataFrame(rows, "entry_id string, date string, mood int, people string, topics string, word_count int")
    return df.withColumns({"year": F.substring("date", 1, 4), "text": F.col("topics"), "content_hash": F.col("entry_id")})


def test_calendar(entries):
    assert [r.entry_id for r in insights.on_this_day(entries, dt.date(2024, 3, 3)).collect()] == ["n4", "n2"]
    assert {r.entry_id for r in insights.on_this_day(entries, dt.date(2024, 3, 3), 1).collect()} == {"n1", "n2", "n3", "n4"}
    c = insights.cadence(entries, TODAY).first()
    assert (c.entries, c.distinct_days, c.longest_streak, c.longest_gap, c.current_gap, c.median_gap, c.total_words) == (5, 5, 3, 730, 1117, 131.5, 1055)
    rhythm = {r.year: r for r in insights.writing_rhythm(entries).collect()}
    assert (rhythm[2019].Mar, rhythm[2021].Nov, rhythm[2021].Jan) == (3, 1, 0)
    assert insights.cadence(entries.where("false"), TODAY).count() == 0


def test_moods_and_entities(entries):
    top = insights.mood_swings(entries).first()
    assert (top.prev_date, top.date, top.delta) == ("2019-03-02", "2019-03-03", 3)
    people = {r.token: r for r in insights.entity_catalog(entries, "people").collect()}
    assert (people["omar"].mentions, people["omar"].first_seen, people["omar"].last_seen, people["omar"].mean_mood, people["lena"].mean_mood) == (3, "2019-03-02", "2021-03-03", 2.67, 3.0)
    assert {r.year: r.mentions for r in insights.entity_timeline(entries, "people", "omar").collect()} == {"2019": 2, "2021": 1}
    assert [r.entry_id for r in insights.entity_entries(entries, "people", "lena").collect()] == ["n3", "n1"]
    assert {r.token: r.n for r in insights.co_mentions(entries, "people", "omar", "topics").collect()} == {"garden": 2, "books": 2, "repairs": 1}
    assert [r.line for r in insights.highlights(entries, TODAY).collect()] == [
        "5 entries and 1,055 words from 2 year(s), the first of 2019-03-02, the last of 2021-11-20.",
        "The fullest month: March 2019, with 3 entries.",
        "Nothing for 730 days until 2021-03-03, the longest pause.",
        "The longest text is of 2021-11-20, with 640 words or more.",
        "Best mood: 5 of 5 on 2019-03-03; lowest: 1 of 5 on 2021-03-03.",
    ]
    newer = entries.withColumn("people", F.when(F.col("entry_id") == "n5", "zoe, ana, lena").otherwise(F.col("people")))
    assert insights.highlights(newer, TODAY).where("ord = 6").first().line == "People who came up in the last half year: ana, zoe."


def test_lexicons(spark):
    rows = [
        ("a", "2022-05-01", "2022", "Thankful, and lucky: we laughed, rested and felt safe.", 9, 5, "thanks, garden"),
        ("b", "2022-05-02", "2022", "Worried, stuck and unsure; was tired.", 6, 1, "worry, garden"),
        ("c", "2023-01-09", "2023", "We will decide tomorrow, soon, on a plan.", 8, 4, "worry, plans"),
        ("d", "2023-01-10", "2023", None, None, 0, ""),
    ]
    df = spark.createDataFrame(rows, "entry_id string, date string, year string, text string, word_count int, mood int, topics string")
    ins = stats.insight_frame(df)
    by = {r.entry_id: r for r in ins.collect()}
    assert (by["a"].signal_gratitude, by["a"].signal_restoration, by["a"].signal_joy, by["a"].signal_gratitude_rate, by["a"].dominant_signal) == (2, 2, 1, 22.22, "gratitude")
    assert (by["b"].dominant_signal, by["b"].attention_lens, by["b"].signal_uncertainty) == ("strain", "past", 2)
    assert (by["c"].dominant_signal, by["c"].attention_lens) == ("agency", "future")
    assert (by["d"].dominant_signal, by["d"].attention_lens, by["d"].word_count) == ("unlabeled", "reflective", 1)
    assert {r.name: r.total for r in stats.needs_totals(ins).collect()} == {"rest": 1, "clarity": 1, "safety": 1}
    topics = {r.topic: r for r in stats.topic_mood(df).collect()}
    assert topics["garden"].mean_mood == 3.0 and topics["worry"].mean_mood == 2.5 and set(topics) == {"garden", "worry"}
    assert [r.prompt for r in stats.reflective_prompts(df, ins).collect()] == ["You write most about gratitude: what would you like it to lead to?", "How could tomorrow hold a little more rest?", "The day of 2022-05-02 was a low one: who or what would have helped?"]
    nothing = df.where("entry_id = 'd'")
    assert [r.ord for r in stats.reflective_prompts(nothing, stats.insight_frame(nothing)).collect()] == [4]
    assert stats.insight_frame(df.where("false")).count() == 0


def test_collapse_takes_first_values(spark):
    rows = [("e", 1, "b", 2), ("e", 0, None, 1), ("f", 0, "x", None)]
    chunks = spark.createDataFrame(rows, "entry_id string, chunk_index int, text string, word_count int").withColumn("date", F.lit("2024-01-01"))
    assert {r.entry_id: (r.text, r.word_count, r.year) for r in corpus.collapse(chunks).collect()} == {"e": ("b", 1, "2024"), "f": ("x", None, "2024")}


def test_pass_runs_once_for_a_text_and_version(spark):
    class Once:
        name, version, model_tag = "once", "v1", "once:v1"

        def compute(self, chunks):
            return chunks.select("chunk_id", "entry_id", F.lit("t").alias("namespace"), F.lit("k").alias("key"), F.lit(1.0).alias("value_num"), F.lit(None).cast("string").alias("value_json"))

    chunks = lambda *t: spark.createDataFrame([(f"c{i}", "e", x) for i, x in enumerate(t)], "chunk_id string, entry_id string, text string")
    a_pass, store = Once(), corpus.empty(spark, corpus.SIGNALS)
    store = signals.derive(chunks("a", "b"), store, a_pass, NOW)
    assert store.count() == 2 and signals.pending(chunks("a", "b"), store, a_pass).count() == 0
    assert signals.pending(chunks("a", "c"), store, a_pass).count() == 1
    a_pass.version = "v2"
    assert signals.pending(chunks("a", "b"), store, a_pass).count() == 2
    assert signals.derive(chunks("a", "b"), store, a_pass, NOW).count() == 2


def test_lexical_rates_and_rollup(spark):
    chunks = spark.createDataFrame([("c1", "e", "I think we not know not me"), ("c2", "e", ""), ("c3", "f", "walked")], "chunk_id string, entry_id string, text string")
    lexical = signals.LexicalPass()
    f = {r.chunk_id: r for r in lexical.features(chunks).collect()}
    assert (f["c1"].token_count, f["c1"].self_focus, f["c1"].we_focus, f["c1"].negation, f["c1"].insight) == (7.0, round(2 / 7, 5), round(1 / 7, 5), round(2 / 7, 5), round(2 / 7, 5))
    assert f["c2"].token_count == 0 and f["c3"].past == 1.0
    assert lexical.compute(chunks).count() == 30
    e = {r.entry_id: r for r in signals.lexical_rollup(lexical.features(chunks), lexical.keys).collect()}
    assert e["e"].token_count == 7.0 and e["e"].self_focus == pytest.approx(2 / 7, abs=1e-5)


def test_emotion_rollup(spark):
    scores = spark.createDataFrame([("c1", "e", "joy", 0.2), ("c2", "e", "joy", 0.8), ("c2", "e", "fear", 0.4)], "chunk_id string, entry_id string, label string, score double")
    weights = spark.createDataFrame([("c1", 300), ("c2", 100)], "chunk_id string, word_count int")
    got = {r.label: (r.mean, r.peak) for r in signals.emotion_rollup(scores, weights).collect()}
    assert got["joy"] == (0.35, 0.8) and got["fear"] == (0.1, 0.4) and got["grief"] == (0.0, 0.0) and len(got) == 28


def test_ingest_enrich_search_and_ask(spark, tmp_path):
    store, embedder = Snapshots(spark, str(tmp_path / "entries"), corpus.CHUNKS), HashEmbedder(16)
    assert store.read().count() == 0

    def take(*bodies):
        df = spark.createDataFrame([(b,) for b in bodies], "body string")
        return sorted(r.status for r in flows.ingest(store, texts.pasted(df), embedder, TODAY, NOW).collect())

    assert take("2020-05-04\nA walk by the sea", "Work was heavy", "Work was heavy", "  ") == ["added", "added", "empty", "skipped"]
    assert take("Work was heavy") == ["skipped"]
    assert store.read().count() == 2 and corpus.pending(store.read()).first().pending == 2
    old = store.read().where("date = '2020-05-04'").first()
    edited = spark.createDataFrame([(old.entry_id, "2020-05-05\nA walk", "paste", None)], "entry_id string, body string, source string, explicit_date string")
    assert [r.status for r in flows.ingest(store, edited, embedder, TODAY, NOW).collect()] == ["updated"]
    assert sorted(r.date for r in store.read().collect()) == ["2020-05-05", "2024-12-11"]

    class Chat:
        def chat(self, messages, temperature=0.2):
            return 'Sure: {"mood": 9, "topics": ["Sea", "sea"], "people": [], "places": ["Rome"]}'

    done = flows.enrich(store, Chat()).first()
    assert (done.mood, done.topics, done.people, done.places, done.enriched) == (5, "sea", "", "rome", True)
    assert flows.hybrid_search(store.read(), "heavy work", embedder, 1).first().text == "Work was heavy"
    answer = flows.ask(store.read(), "What about the walk in 2020?", embedder, EchoChat(), TODAY, auto_dates=True)
    assert (answer.date_from, answer.dates) == ("2020-01-01", ["2020-05-05"])
    assert flows.ask(store.read(), "x", embedder, EchoChat(), TODAY, date_from="2030-01-01").text == flows.NO_HITS


def test_commands(spark, tmp_path, capsys, monkeypatch):
    from lumenfold.__main__ import main

    (tmp_path / "in").mkdir()
    (tmp_path / "in/2020-01-01.txt").write_text("I think we were tired")
    (tmp_path / "in/05-02-2021.txt").write_text("A quiet walk\n\nand a long rest")
    (tmp_path / "mine").write_text("LUMENFOLD_DAY_FIRST=yes\nLUMENFOLD_CHUNK_WORDS=3\nLUMENFOLD_CHUNK_OVERLAP=0\nLUMENFOLD_TREND_GATE=2\nLUMENFOLD_QUIET=0.2")
    store = str(tmp_path / "store")
    run = lambda *args: (main(["--settings", str(tmp_path / "mine"), store, *args]), capsys.readouterr().out)[1]
    said = run("ingest", str(tmp_path / "in"))
    assert "added" in said and "filename" in said
    assert "|05-02-2021.txt|2021-02-05|" in "".join(run("list").split()).replace("||", "|\n|") and "A quiet walk" in run("search", "quiet walk", "-k", "1")
    assert "'chunks': 3" in run("index", "--vectors") and "A quiet walk" in run("search", "quiet walk", "-k", "1")
    (tmp_path / "in/2022-01-01.txt").write_text("zebra zebra")
    run("watch", str(tmp_path / "in"), "--once")
    assert "zebra zebra" in run("search", "zebra", "-k", "1") and "zebra zebra" in run("search", "zebra", "-k", "1", "--approximate") and "2022-01-01.txt" in run("find", "(?P<x>ZEB)ra", "--index") and "2022-01-01.txt" not in run("search", "walk", "--period", "2021")
    assert "2021-02-05" in run("ask", "What about the walk in 2021?") and flows.NO_HITS in run("ask", "x", "--from", "2030-01-01")
    run("ask", "What about the walk?", "--conversation", "c1")
    run("ask", "And why?", "--conversation", "c1")
    talk = run("conversations", "c1").splitlines()
    assert [x.split(":")[0] for x in talk] == ["user", "assistant"] * 2 and talk[2] == "user: And why?" and "What about the walk?" in run("conversations")
    run("conversations", "c1", "--rename", "Walks")
    assert "Walks" in run("conversations")
    run("conversations", "c1", "--delete")
    assert "Walks" not in run("conversations") and run("conversations", "c1").strip() == ""
    assert "|0|" in run("enrich").replace(" ", "") and "entries: 1;" not in run("digest", "--from", "2021-01-01")
    derived = run("derive", "--aggregate", "--pass", "lexical")
    assert "self_focus" in derived and "true" in derived and "2021" in run("stats")
    assert "token_count" in run("derive", "--rebuild") and "neutral" in run("derive", "--pass", "goemotions", "--aggregate") and "token_count" in run("derive", "--pass", "lexical_tagged")
    monkeypatch.setattr("builtins.input", lambda _: "n")
    run("remove", "--from", "2021-01-01", "--to", "2021-12-31")
    assert "05-02-2021.txt" in run("list")
    assert "1 entries" in run("remove", "--period", "2021", "--yes")
    assert "05-02-2021.txt" not in run("list") and "folders went" in run("vacuum") and "zebra" in run("search", "zebra")
    assert "2 entries" in run("remove", "--all", "--yes") and ".txt" not in run("list")


STORED = "entry_id string, part string, n int"


def stored(spark, *rows):
    return spark.createDataFrame(rows, STORED)


def held(store):
    return sorted((r.entry_id, r.part, r.n) for r in store.read().collect())


def test_store(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "s"), STORED, most=20)
    assert held(store) == [] and store.vacuum() == 0
    store.write(stored(spark, *((f"e{i}", "a", i) for i in range(40))))
    assert store.state().buckets == 2 and len(held(store)) == 40
    before, n = store.read(), store.state().n
    store.replace(stored(spark, ("e3", "a", -3), ("e3", "b", 7)))
    assert [r for r in held(store) if r[0] == "e3"] == [("e3", "a", -3), ("e3", "b", 7)] and before.where("n = 3").count() == 1
    assert len(store.read(n).collect()) == 40 and [r.n for r in store.of(stored(spark, ("e5", "", 0), ("x", "", 0))).collect()] == [5]
    store.replace(None, stored(spark, ("e4", "", 0), ("nobody", "", 0)))
    store.replace(None, stored(spark))
    changes = store.changes(n)
    assert sorted((r.entry_id, r.n) for r in changes.added.collect()) == [("e3", -3), ("e3", 7)] and {r.entry_id for r in changes.gone.collect()} == {"e3", "e4", "nobody"}
    assert not changes.reset and store.changes(0).reset and store.changes(0).added.count() == 40 and store.changes(changes.upto).added.count() == 0
    assert len(held(store)) == 40 and store.vacuum(n) > 0 and store.changes(n).added.count() == 2 and len(held(store)) == 40
    for _ in range(10):  # so many that the bucket is put together
        store.replace(stored(spark, ("e5", "a", 5)))
    assert store.vacuum() > 0 and store.changes(n).reset and store.changes(n).added.count() == len(held(store)) == 40
    store.write(store.read().where("false"))
    assert held(store) == [] and store.replace(stored(spark, ("x", "a", 1))).count() == 1
    pairs = Snapshots(spark, str(tmp_path / "p"), STORED, on=["entry_id", "part"])
    pairs.write(stored(spark, ("a", "x", 1), ("a", "y", 2)))
    assert {(r.part, r.n) for r in pairs.replace(stored(spark, ("a", "y", 3))).collect()} == {("x", 1), ("y", 3)}
    (tmp_path / "bad/log").mkdir(parents=True)
    (tmp_path / "bad/log/000000000001.json").write_text("no record")
    with pytest.raises(ValueError):
        Snapshots(spark, str(tmp_path / "bad"), "entry_id string").read()


def test_store_of_several_writers(spark, tmp_path):
    """Writers lose nothing to one another, whether they put rows or change those that are there; buckets split meanwhile."""
    from concurrent.futures import ThreadPoolExecutor

    store = lambda: Snapshots(spark, str(tmp_path / "s"), STORED, most=15)
    store().write(stored(spark, ("sum", "a", 0)))

    def put(k):
        for i in range(4):
            store().replace(stored(spark, *((f"t{k}_{i}_{j}", "a", j) for j in range(5))))

    def add(_):
        for _ in range(3):
            store().update(lambda rows: (rows.where("entry_id = 'sum'").withColumn("n", F.col("n") + 1), stored(spark, ("sum", "", 0))))

    with ThreadPoolExecutor(4) as pool:
        jobs = [pool.submit(f, k) for k in range(2) for f in (put, add)]
        [j.result() for j in jobs]
    rows = held(store())
    assert len(rows) == 41 and ("sum", "a", 6) in rows and store().state().buckets > 2


def test_work_of_a_commit_is_bounded(spark, tmp_path):
    import os

    store = Snapshots(spark, str(tmp_path / "s"), STORED, most=5000)
    store.write(spark.range(100_000).select(F.concat(F.lit("e"), "id").alias("entry_id"), F.lit("a").alias("part"), F.col("id").cast("int").alias("n")))
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(tmp_path) for f in names if f.endswith(".parquet"))
    before, most = size(), 0
    for i in range(10):
        at = size()
        store.replace(stored(spark, ("e7", "b", i)))
        most = max(most, size() - at)
    assert most < before / 5 and store.read().where("entry_id = 'e7'").count() == 1 and store.read().count() == 100_000


def test_index_follows_its_store(spark, tmp_path):
    from lumenfold.plans.follow import Index

    store, embedder, index = Snapshots(spark, str(tmp_path / "entries"), corpus.CHUNKS), HashEmbedder(8), Index(spark, str(tmp_path / "index"))
    put = lambda *bodies: flows.ingest(store, spark.createDataFrame([(i, b, "s", None) for i, b in bodies], "entry_id string, body string, source string, explicit_date string"), embedder, TODAY, NOW)

    def same(query):
        want = [(r.id, r.score, r["rank"]) for r in retrieval.bm25_topk(store.read(), query).collect()]
        assert [(r.id, r.score, r["rank"]) for r in index.best(query).collect()] == want
        return [w[0] for w in want]

    put(("a", "a quiet walk by the sea"), ("b", "heavy work and a walk"), ("c", "\n\n".join(["sea words " * 150] * 3)))
    assert index.mark() is None and index.best("walk").count() == 0
    index.follow(store)
    assert set(same("walk")) == {"a::0", "b::0"}
    put(("z", "zebra zebra"), ("a", "a loud run by the lake"))
    index.follow(store)
    assert same("zebra") == ["z::0"] and same("walk") == ["b::0"] and same("lake sea walk")
    before = index.mark()
    flows.remove(store, ["c", "nobody"])
    index.follow(store)
    assert same("sea") == [] and same("zebra run a") and index.mark()["chunks"] == before["chunks"] - 3
    index.follow(store)
    index.gone.replace(None, spark.createDataFrame([("a",)], "entry_id string"), mark=before)  # as if the last round had been broken off before its end
    put(("a", "a quiet walk again"))
    index.follow(store)
    assert same("quiet walk a")
    flows.remove(store, everything=True)
    index.follow(store)
    assert same("walk") == [] and index.mark()["chunks"] == 0
    plan = index.of(["walk"])._jdf.queryExecution().toString()
    assert "PushedFilters: [In(term" in plan or "PushedFilters: [IsNotNull(term), EqualTo(term" in plan or index.postings.state().rows() == 0


def test_signals_and_rollup_follow_their_store(spark, tmp_path):
    from lumenfold.plans.follow import follow_rollup, follow_signals

    store, embedder, a_pass = Snapshots(spark, str(tmp_path / "entries"), corpus.CHUNKS), HashEmbedder(8), signals.LexicalPass()
    kept, rollup = Snapshots(spark, str(tmp_path / "signals"), corpus.SIGNALS), Snapshots(spark, str(tmp_path / "rollup"), signals.ROLLUP)
    put = lambda *bodies: flows.ingest(store, spark.createDataFrame([(i, b, "s", "2024-01-01") for i, b in bodies], "entry_id string, body string, source string, explicit_date string"), embedder, TODAY, NOW)
    plain = lambda df: sorted(map(str, df.select(*sorted(c for c in df.columns if c != "computed_at")).collect()))

    def whole():
        chunks = store.read().select(F.col("id").alias("chunk_id"), "entry_id", "text", "date", "date_int", "word_count")
        every = signals.derive(chunks, corpus.empty(spark, corpus.SIGNALS), a_pass, NOW)
        assert plain(follow_signals(store, kept, a_pass, NOW)) == plain(every)
        assert plain(follow_rollup(store, kept, rollup, a_pass)) == plain(signals.entry_signals(every, chunks, a_pass))

    put(("a", "I think we walked"), ("b", "They will know"), ("c", "nothing"))
    whole()
    put(("d", "we were there"), ("a", "I knew"))
    before = kept.state().n
    whole()
    assert {r.entry_id for r in kept.changes(before).added.collect()} == {"a", "d"}
    flows.remove(store, ["b"])
    whole()
    whole()
    assert flows.derive(store, kept, a_pass, "later").where("computed_at = 'later'").count() == 0
    assert flows.derive(store, kept, a_pass, "later", rebuild=True).where("computed_at <> 'later'").count() == 0


def test_settings():
    from lumenfold.settings import Settings

    lines = "# mine\nLUMENFOLD_K=5\nexport LUMENFOLD_QUIET='2'\nLUMENFOLD_DAY_FIRST=yes\nother=1\n\nbroken"
    got = Settings.read({"LUMENFOLD_K": "9", "PATH": "x"}, lines)
    assert (got.k, got.day_first, got.pool) == (9, True, 40)


def test_passes_of_models(spark):
    import pandas as pd
    from pyspark.sql.types import ArrayType, DoubleType, MapType, StringType

    @F.pandas_udf(MapType(StringType(), DoubleType()))
    def classify(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: {"joy": t.count("j") / max(1, len(t)), "fear": 0.25})

    @F.pandas_udf(ArrayType(StringType()))
    def tag(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: ["past" if w.endswith("ed") else "future" for w in t.split()])

    long = "jjj one. " * 300 + "end j."
    chunks = spark.createDataFrame([("c1", "e", long, 500), ("c2", "e", "jj", 100), ("c3", "f", "", None)], "chunk_id string, entry_id string, text string, word_count int")
    a_pass = signals.EmotionPass(classify)
    store = signals.derive(chunks, corpus.empty(spark, corpus.SIGNALS), a_pass, NOW)
    got = {(r.chunk_id, r.label): r.score for r in signals.stored_scores(store).collect()}
    want = {}
    for r in chunks.collect():
        sentences, windows = r.text.strip().replace(". ", ".|").split("|"), [""]
        for s in sentences:
            if windows[-1] and len(windows[-1]) + len(s) + 1 > 1800:
                windows.append("")
            windows[-1] = f"{windows[-1]} {s}".strip()
        total = max(1, sum(map(len, windows)))
        want |= {(r.chunk_id, "joy"): round(sum(w.count("j") / max(1, len(w)) * len(w) for w in windows) / total, 5), (r.chunk_id, "fear"): round(sum(0.25 * len(w) for w in windows) / total, 5)}
    assert got == pytest.approx(want) and len(want) == 6
    both = signals.derive(chunks, store, signals.LexicalPass(), NOW)
    meta = chunks.withColumns({"date": F.lit("2020-01-01"), "date_int": F.lit(20200101).cast("bigint")})
    rolled = signals.entry_signals(both, meta, signals.LexicalPass())
    wide = {r.entry_id: r for r in signals.emotion_wide(rolled).collect()}
    assert wide["e"].joy == pytest.approx((500 * want["c1", "joy"] + 100 * want["c2", "joy"]) / 600, abs=1e-5) and wide["e"].grief == 0 and wide["e"].fear == 0.25
    assert signals.emotion_wide(rolled, key="peak").where("entry_id = 'e'").first().joy == want["c2", "joy"]
    assert {r.entry_id: r.token_count for r in signals.lexical_wide(rolled, ["token_count"]).collect()} == {"e": 603.0, "f": 1.0}
    tagged = signals.TaggedTense(tag, "mine")
    assert {r.chunk_id: (r.past, r.future) for r in tagged.features(chunks.withColumn("text", F.lit("walked went talked"))).collect()}["c1"] == (0.6667, 0.3333)
    assert tagged.model_tag != signals.LexicalPass().model_tag and signals.pending(chunks, both, tagged).count() == 3
    assert signals.fingerprint({"a": ("x", "y")}) == signals.fingerprint({"a": ("y", "x")}) != signals.fingerprint({"a": ("x",)})
    again = signals.derive(chunks, both.withColumn("value_num", F.lit(-1.0)), signals.LexicalPass(), "later", force=True)
    assert again.where("pass_name = 'lexical' and value_num < 0").count() == 0 and again.where("pass_name = 'goemotions'").count() == 3


def test_searches_of_nothing(spark):
    docs = spark.createDataFrame([], "id string, text string, vector array<float>, date string")
    assert retrieval.dense_topk(docs, [0.0, 1.0]).count() == 0 and retrieval.bm25_topk(docs, "a b").count() == 0
    index = retrieval.postings(docs)
    assert retrieval.bm25_of(index, retrieval.collection(index), "a b").count() == 0
    one = spark.createDataFrame([("e", "2020", "s", "what (is it")], "entry_id string, date string, source string, text string")
    assert corpus.search_entries(one, "(IS").count() == 1 and corpus.search_entries(one, "[x").count() == 0
    assert chats.cached(corpus.empty(spark, chats.DIGESTS), "k").count() == 0


def test_theme_names_fall_back(spark):
    class Broken:
        def chat(self, messages, temperature=0.2):
            raise ConnectionError

    found = spark.createDataFrame([(0, "sea, sand", ["sea", "sand"], 3)], "theme_id int, label string, terms array<string>, size bigint")
    assert flows.name_themes(found, Broken()).first().label == "sea, sand"
    assert flows.name_themes(found, EchoChat()).first().label == "A short title for entries about: sea, sand"


def test_watched_folder(spark, tmp_path):
    import threading
    import time

    folder = tmp_path / "drop"
    folder.mkdir()
    (folder / "2020-01-01.txt").write_text("first")
    store, embedder = Snapshots(spark, str(tmp_path / "store"), corpus.CHUNKS), HashEmbedder(8)
    watch = lambda **more: drops.Watch(spark, store, str(folder), str(tmp_path / "work"), embedder, quiet=2.0, clock=lambda: dt.datetime(2024, 12, 11), **more)

    def until(done, seconds=120):
        end = time.time() + seconds
        while not done():
            assert time.time() < end
            time.sleep(0.2)

    once = watch()
    once.run(0.2, once=True)
    assert once.batches == [{"2020-01-01.txt": "added"}] and [(r.entry_id, r.date) for r in store.read().collect()] == [("2020-01-01.txt", "2020-01-01")]
    (folder / "2020-01-01.txt").write_text("first, edited")  # while nobody watches
    (folder / "odd [x]*.txt").write_text("second")
    second = watch(forget=True)
    running = threading.Thread(target=second.run, args=(0.2,))
    running.start()
    until(lambda: len({k for b in second.batches for k in b}) >= 2)
    assert {k: v for b in second.batches for k, v in b.items()} == {"2020-01-01.txt": "updated", "odd [x]*.txt": "added"}
    for i in range(5):
        (folder / "burst.txt").write_text(f"burst {'x' * i}")
        time.sleep(0.1)
    held = lambda: sorted(r.text for r in store.read().collect())
    until(lambda: "burst xxxx" in held())
    (folder / "2020-01-01.txt").unlink()
    until(lambda: "first, edited" not in held())
    # a look may fall into the burst, but the file is taken once it is complete, and is the same when it is looked at again
    assert sorted(b["burst.txt"] for b in second.batches if "burst.txt" in b and b["burst.txt"] != "skipped") == ["added"]
    second.stop()
    running.join()
    assert sorted(r.text for r in store.read().collect()) == ["burst xxxx", "second"]
    third = watch()
    third.run(0.2, once=True)
    assert third.batches == [] and third.noted == 0
    (folder / "burst.txt").write_text("burst by hand")
    assert sorted(r.status for r in drops.sweep(store, str(folder), embedder, TODAY, NOW).collect()) == ["skipped", "updated"]


def test_uploads_and_settings_reach_ingest(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "store"), corpus.CHUNKS)
    files = spark.createDataFrame([("03-04-2020.txt", "one\n\ntwo\n\nthree"), ("note.txt", "May 6, 2021\nx"), ("plain.txt", "y")], "filename string, content string")
    flows.ingest(store, texts.uploads(files), HashEmbedder(8), TODAY, NOW, day_first=True, target=1, overlap=0)
    got = {(r.entry_id, r.chunk_index): (r.date, r.date_source, r.text) for r in store.read().collect()}
    assert got["upload:03-04-2020.txt", 2] == ("2020-04-03", "filename", "three") and len(got) == 5
    assert got["upload:note.txt", 0][:2] == ("2021-05-06", "header") and got["upload:plain.txt", 0][:2] == ("2024-12-11", "today")


def test_fusion_prefers_both_lists(spark):
    ranked = lambda *ids: spark.createDataFrame([(x, i) for i, x in enumerate(ids)], "id string, rank int")
    assert [r.id for r in retrieval.fused(ranked("a", "b", "c"), ranked("c", "d"), 4).collect()] == ["c", "a", "b", "d"]


def test_themes(spark):
    import random

    rnd = random.Random(42)
    near = lambda axis: [float((i == axis) + rnd.gauss(0, 0.02)) for i in range(4)]
    rows = [(f"e{i}", near(0 if i < 6 else 2), 3, 0, "sea sea waves sand" if i < 6 else "work desk desk mail", f"20{20 + i % 3}-01-01") for i in range(12)]
    chunks = spark.createDataFrame(rows, "entry_id string, vector array<float>, word_count int, chunk_index int, text string, date string")
    found, assigned = flows.discover_themes(chunks, 2)
    groups = {frozenset(r.entry_id for r in assigned.collect() if r.label == t.label) for t in found.collect()}
    assert groups == {frozenset(f"e{i}" for i in range(6)), frozenset(f"e{i}" for i in range(6, 12))}
    shares = themes.year_share(assigned).groupBy("year").agg(F.sum("share").alias("s")).collect()
    assert all(r.s == pytest.approx(1, abs=0.01) for r in shares)
    assert [themes.default_k(n) for n in (1, 4, 1000)] == [2, 2, 10]
    weighted = spark.createDataFrame([("e", [1.0, 0.0], 3), ("e", [0.0, 1.0], 1), ("z", [0.0, 0.0], 1)], "entry_id string, vector array<float>, word_count int")
    (only,) = themes.entry_vectors(weighted).collect()
    assert only.vector == pytest.approx([3 / 10**0.5, 1 / 10**0.5])


def test_digest(spark, entries):
    many = spark.createDataFrame([(f"e{i:02}", f"2024-01-{1 + i // 2:02}") for i in range(40)], "entry_id string, date string")
    picked = [r.entry_id for r in digest.sample(many, 10).orderBy("place").collect()]
    assert len(picked) == 10 and picked[0] == "e00" and picked[-1] == "e39"
    cache = corpus.empty(spark, chats.DIGESTS)
    text, hit, cache = flows.compose_digest(entries, cache, EchoChat(), "a", "b", "m", NOW)
    assert not hit and flows.compose_digest(entries, cache, EchoChat(), "a", "b", "m", NOW)[:2] == (text, True)
    assert not flows.compose_digest(entries, cache, EchoChat(), "a", "b", "other", NOW)[1]
    assert not flows.compose_digest(entries.withColumn("content_hash", F.lit("x")), cache, EchoChat(), "a", "b", "m", NOW)[1]
    assert digest.overview(entries).first().overview == "entries: 5; mood: 3.0 of 5 on average; often named topics: books, garden, repairs; often named people: omar, lena"


def test_conversations(spark):
    talk = lambda t, c, u: spark.createDataFrame([("c", t, None, None, 8, c, u)], chats.CONVERSATIONS)
    said = lambda *xs: spark.createDataFrame([("c", i, "user", x, None, NOW) for i, x in enumerate(xs)], chats.MESSAGES)
    all_, messages = corpus.empty(spark, chats.CONVERSATIONS), corpus.empty(spark, chats.MESSAGES)
    all_, messages = chats.saved(all_, messages, talk("first", "1", "1"), said("a", "b"))
    all_, messages = chats.saved(all_, messages, talk("second", "2", "2"), said("c"))
    row = all_.first()
    assert (all_.count(), row.title, row.created_at, row.updated_at) == (1, "second", "1", "2")
    assert [r.content for r in chats.messages_of(messages, "c").collect()] == ["c"]
    assert chats.renamed(all_, "c", "third", "3").first().title == "third"
    all_, messages = chats.deleted(all_, messages, spark.createDataFrame([("c",)], "id string"))
    assert all_.count() == 0 and messages.count() == 0
