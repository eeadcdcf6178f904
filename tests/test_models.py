"""The small models, patterns and the indexes that follow a store, against plain versions."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.functions import models, patterns
from lumenfold.operators import corpus, retrieval, signals, themes
from lumenfold.plans.follow import Cells, Grams
from lumenfold.sources.snapshots import Snapshots


def test_emotions(spark):
    model = models.EmotionModel()
    assert all(model.labels[int(model.word(w).argmax())] == name for name, own in models.SEEDS.items() for w in own)
    texts = ["We were happy, and joyous!", "Thankfully, I am thankful", "", None, "qxz", "Sad news. A sad day. So sad"]
    got = [r.e for r in spark.createDataFrame([(t,) for t in texts], "t string").select(models.emotions("t").alias("e")).collect()]
    for text, scores in zip(texts, got):
        words = re.findall("[a-z']+", (text or "").lower())
        want = [sum(float(model.word(w)[i]) for w in words) / len(words) for i in range(28)] if words else [float(x == "neutral") for x in model.labels]
        assert [scores[x] for x in model.labels] == pytest.approx(want)
    best = lambda s: max((x for x in s if x != "neutral"), key=s.get)
    assert [best(got[i]) for i in (0, 1, 5)] == ["joy", "gratitude", "sadness"] and max(got[4], key=got[4].get) == "neutral"
    chunks = spark.createDataFrame([("c", "e", "We are happy. " * 200)], "chunk_id string, entry_id string, text string")
    rows = signals.derive(chunks, corpus.empty(spark, corpus.SIGNALS), signals.default_emotions(), "now")
    assert {r.label: r.score for r in signals.stored_scores(rows).collect()} == {x: round(float(s), 5) for x, s in zip(model.labels, model.scores(["we are happy"])[0])}


def plain_viterbi(tagger, words):
    score = {t: tagger.start[i] + tagger.emission(words[0])[i] for i, t in enumerate(tagger.tags)}
    paths = {t: [t] for t in tagger.tags}
    for w in words[1:]:
        new, emit = {}, tagger.emission(w)
        for j, b in enumerate(tagger.tags):
            a = max(tagger.tags, key=lambda x: (score[x] + tagger.step[tagger.tags.index(x), j], -tagger.tags.index(x)))
            new[b] = (score[a] + tagger.step[tagger.tags.index(a), j] + emit[j], [*paths[a], b])
        score, paths = {t: s for t, (s, _) in new.items()}, {t: p for t, (_, p) in new.items()}
    return paths[max(tagger.tags, key=lambda t: (score[t], -tagger.tags.index(t)))]


def test_tenses(spark):
    tagger = models.TenseTagger()
    tagged = [[x.rsplit("/", 1) for x in line.split()] for line in models.TAGGED.split("\n") if line]
    right = [a == b for s in tagged for a, b in zip(tagger.best([[w for w, _ in s]])[0], [t for _, t in s])]
    assert sum(right) / len(right) > 0.95
    texts = ["We walked home and slept. She will sing tomorrow! I think they know.", "He jumped", "", None, "no", " ".join(f"word{chr(97 + i % 26)}ed" for i in range(450))]
    for text in texts:
        for words in tagger.sentences(text):
            assert len(words) <= tagger.MOST and tagger.best([words, ["a"]])[0] == plain_viterbi(tagger, words)
    frame = spark.createDataFrame([(str(i), "e", t) for i, t in enumerate(texts)], "chunk_id string, entry_id string, text string")
    got = {int(r.chunk_id): r for r in signals.default_tagged().features(frame).collect()}
    for i, text in enumerate(texts):
        tags = [t for s in tagger.sentences(text) for t in plain_viterbi(tagger, s)]
        n = {t: tags.count(t) for t in "PSF"}
        total = max(1, sum(n.values()))
        assert (got[i].past, got[i].present, got[i].future) == pytest.approx(tuple(round(n[t] / total, 4) for t in "PSF"))
    assert got[0].past > 0 and got[0].future > 0 and got[0].present > 0 and got[1].past == 1


TEXTS = ["A zebra, and colours", "the color of Lichkeit", "queaux QUEAUX", "foofoobar", "abc(d", "Ünder abcé", "nothing", "a\nbcd", "xxyz", "src9 2020"]
PATTERNS = ["(?P<x>zeb)ra", "zebra", "colou?r", "[LQ]ICHKEIT|queau", "(?:foo)+bar", "abc(d", "abc(?P<a_b>d", "é", "bcd$", "x{2}yz", "a.b", "[[ab]c]d", "^the", "2020", "(?i)SRC", "nobody knows", "(a|b|c|d|e|f)(a|b|c|d|e|f)(c|d|e)", "oo{1,3}b", "r, and|Ünder"]


@pytest.mark.parametrize("pattern", PATTERNS)
def test_what_patterns_need(pattern):
    ways = patterns.needed(pattern)
    try:
        found = re.compile(pattern, re.I)
    except re.error:
        return
    for text in TEXTS:
        if ways is not None and found.search(text) and pattern != "[[ab]c]d":
            assert any(all(g in text.lower() for g in own) for own in ways), (pattern, text)


def test_patterns_by_index(spark, tmp_path):
    schema = "id string, entry_id string, date string, source string, text string"
    store, grams = Snapshots(spark, str(tmp_path / "s"), schema), Grams(spark, str(tmp_path / "g"))
    put = lambda rows: store.replace(spark.createDataFrame([(f"{e}::{i}", e, "2020-01-01", "src1", t) for e, *ts in rows for i, t in enumerate(ts)], schema))
    put([(f"e{i}", t) for i, t in enumerate(TEXTS)])
    grams.follow(store)
    put([("e0", "A horse"), ("new", "one", "a zebra")])
    store.replace(None, spark.createDataFrame([("e3",)], "entry_id string"))
    grams.follow(store)
    for pattern in PATTERNS:
        want = {r.entry_id for r in corpus.search_entries(store.read(), pattern).collect()}
        assert {r.entry_id for r in grams.find(store, pattern).collect()} == want, pattern
    assert {r.entry_id for r in grams.find(store, "zebra").collect()} == {"new"} and grams.candidates("zebra").count() == 1
    assert grams.candidates("a.") is None and grams.find(store, "src1|nobody").count() == 10


def test_cells(spark, tmp_path):
    rng = np.random.default_rng(3)
    middle = rng.normal(size=(12, 16))
    x = (middle[rng.integers(12, size=600)] + rng.normal(size=(600, 16)) * 0.4).astype(np.float32)
    schema = "id string, entry_id string, date string, vector array<float>"
    store, cells = Snapshots(spark, str(tmp_path / "s"), schema), Cells(spark, str(tmp_path / "c"), sample=300)
    rows = lambda some: spark.createDataFrame([(f"e{i}::0", f"e{i}", f"20{10 + i % 10}-01-01", [float(v) for v in x[i]]) for i in some], schema)
    store.replace(rows(range(500)))
    cells.follow(store)
    store.replace(rows(range(500, 600)))
    store.replace(None, spark.createDataFrame([(f"e{i}",) for i in range(0, 600, 7)], "entry_id string"))
    cells.follow(store)
    hits = total = 0
    for i in (3, 151, 450, 590):
        query = [float(v) for v in x[i] + 0.1]
        want = [(r.id, r.distance) for r in retrieval.dense_topk(store.read(), query).collect()]
        assert [(r.id, r.distance) for r in cells.nearest(query, probes=1, exact=True).collect()] == want
        hits += len({r.id for r in cells.nearest(query, probes=6).collect()} & {w[0] for w in want})
        total += len(want)
    assert hits / total >= 0.95
    assert all(r.id != "e7::0" for r in cells.nearest([float(v) for v in x[7]], probes=30).collect())
    period = cells.nearest([float(v) for v in x[3]], probes=30, date_from="2013-01-01", date_to="2013-12-31")
    assert period.count() == 40 and {int(r.id[1:].split(":")[0]) % 10 for r in period.collect()} == {3}
    plan = cells.rows.of(spark.createDataFrame([(1,)], "cell int")).where("cell in (1, 2)")._jdf.queryExecution().toString()
    assert re.search(r"PushedFilters: \[[^\]]*In\(cell|PushedFilters: \[[^\]]*EqualTo\(cell", plan)
    assert Cells(spark, str(tmp_path / "none")).nearest([0.0]).count() == 0


def test_kmeans_is_defined(spark):
    rows = [("a", [0.0, 0.0]), ("b", [1.0, 0.0]), ("c", [10.0, 0.0]), ("d", [0.0, 10.0]), ("e", [0.0, 11.0]), ("f", [0.0, 0.0])]
    vectors = spark.createDataFrame(rows, "entry_id string, vector array<double>")
    assert themes.farthest_first(vectors, 3).tolist() == [[0, 0], [0, 11], [10, 0]]
    assert {r.entry_id: r.theme_id for r in themes.clusters(vectors, 3).collect()} == {"a": 0, "b": 0, "f": 0, "d": 1, "e": 1, "c": 2}
    assert themes.moved(vectors, np.array([[0.0, 0.0], [50.0, 50.0]])).tolist() == [[pytest.approx(11 / 6), pytest.approx(3.5)], [50, 50]]  # nothing is nearest to the second
    same = vectors.withColumn("vector", F.array(F.lit(1.0), F.lit(2.0)))
    assert {r.theme_id for r in themes.clusters(same, 4).collect()} == {0} and math.isclose(len(themes.farthest_first(same, 4)), 1)
    assert themes.clusters(vectors.where("false")).count() == 0


def test_orders(spark):
    """Frames that are ordered come in their order."""
    from lumenfold import queries as Q

    small = "/root/testdata/sf0.001"
    lines = Q.line_chunks(spark, small)
    for frame, keys in ((corpus.list_entries(lines), ("date", "entry_id")), (Q.queries()["lexical_wide"](spark, small), ("date_int", "entry_id")), (Q.queries()["emotion_wide"](spark, small), ("date_int", "entry_id"))):
        rows = [tuple(r[k] for k in keys) for r in frame.collect()]
        assert len(rows) > 100 and rows == sorted(rows)


def test_filter_of_what_was_seen(spark):
    seen = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("k"))
    rows = spark.range(15_000, 45_000).select(F.concat(F.lit("k"), "id").alias("k"), "id")
    told = {r.id: r.possibly for r in signals.possibly_seen(rows, seen, ["k"], 1 << 20).collect()}
    assert len(told) == 30_000 and all(told[i] for i in range(15_000, 20_000))
    assert sum(told.values()) < 5_000 + 0.1 * 25_000  # so many go on to the join
    assert signals.possibly_seen(rows, seen, ["k"], 1000) is None and signals.possibly_seen(rows, seen.where("false"), ["k"], 1000) is None


def test_emotions_of_many_new_words():
    """What is held does not grow with the words of a batch, and a text's scores don't depend on what is beside it."""
    import itertools
    import tracemalloc

    words = ["".join(w) for w in itertools.product("abcdefghijkl", repeat=4)]  # 20,736 of them
    texts = [" ".join(words[i : i + 50]) for i in range(0, len(words), 50)] + [" ".join(words), "thththth aaaa a I'm", ""]
    model = models.EmotionModel()
    tracemalloc.start()
    got = model.scores(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6  # a row of all buckets for each word would be 340 MB
    for i in (0, 100, -2):
        own = re.findall("[a-z']+", texts[i].lower())
        assert got[i] == pytest.approx(sum(model._softmax(model._features(w) @ model.weights + model.bias) for w in own) / len(own))
    assert got[-3] == pytest.approx(np.average(got[:-3], axis=0, weights=[len(t.split()) for t in texts[:-3]]))
    small = models.EmotionModel()
    small.KEEP = small.PIECE  # is emptied again and again
    assert (small.scores(texts) == got).all() and len(small.known) <= small.PIECE


def test_emotions_deal_out_windows_only(spark):
    """One row for each window goes through a shuffle, not one for each label, and none meets signals of a pass that is new."""
    chunks = spark.createDataFrame([(f"c{i}", "e", "We are happy. " * (200 * i)) for i in range(4)], "chunk_id string, entry_id string, text string")
    a_pass, none = signals.default_emotions(), corpus.empty(spark, corpus.SIGNALS)
    plan = a_pass.compute(chunks)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in signals.pending(chunks, none, a_pass)._jdf.queryExecution().executedPlan().toString()
    once = signals.derive(chunks, none, a_pass, "now").localCheckpoint()
    assert signals.pending(chunks, once, a_pass).count() == 0 and signals.pending(chunks.withColumn("text", F.lit("x")), once, a_pass).count() == 4


def test_entries_without_moods(spark, tmp_path):
    """Documents with several labels come as often without their labels, and no text is dealt out."""
    from lumenfold import queries as Q

    text = "one\ntwo"
    spark.createDataFrame([(i, text, "en", "web", len(text)) for i in (1, 2, 3, None)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(1, 0, 0), (3, 1, 0), (3, 1, 0), (3, 0, 1), (None, 1, 1), (None, 1, 1), (9, 1, 0), (9, 1, 1)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    few = spark.createDataFrame(labels[:2], "doc_id long, quality int, toxic int")
    few.write.parquet(str(tmp_path / "few/labels.parquet"))
    spark.read.parquet(str(tmp_path / "documents.parquet")).write.parquet(str(tmp_path / "few/documents.parquet"))
    rows = lambda df: sorted(map(str, df.collect()))
    for top in (tmp_path, tmp_path / "few"):
        for of in (Q.doc_entries, Q.line_chunks):
            assert rows(of(spark, str(top), moods=False)) == rows(of(spark, str(top)).drop("mood"))
    assert Q.doc_entries(spark, str(tmp_path), moods=False).count() == 6
    assert "Join" not in Q.line_chunks(spark, str(tmp_path / "few"), moods=False)._jdf.queryExecution().executedPlan().toString()


def test_blocks():
    """Postings as bytes, against plain sets and counts; a block has so many bytes of text, or one text."""
    import pyarrow as pa

    from lumenfold.functions import blocks

    values, starts = np.array([0, 254, 255, 256, 5, 1000, 510]), np.array([0, 3, 4])
    assert [blocks.unpacked(x).tolist() for x in blocks.packed(values, starts).to_pylist()] == [[0, 254, 255], [256], [5, 1000, 510]]
    texts = ["it's a sea, a sea", "", "ünder abcé abc\tabd", "no", "sea\x01sea", "x" * 2000 + " sea sea"] * 120
    for find, plain in ((blocks.words, lambda t: re.findall("[a-z']+", t)), (blocks.grams, lambda t: re.findall(r"(?=([\x09-\x7E]{3}))", t))):
        terms, starts, spots, times = find(pa.array(["zz", *texts], pa.string()).slice(1))
        ends = [*starts[1:], len(spots)]
        got = {t: spots[a:b].tolist() for t, a, b in zip(terms.to_pylist(), starts, ends)}
        own = [plain(t) for t in texts]
        assert len(got) == len(terms) and got == {t: [i for i, x in enumerate(own) if t in x] for x in own[:6] for t in x}
        if len(times):
            assert times.tolist() == [own[i].count(t) for t, some in got.items() for i in some]
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 10, "b" * 90, "c" * 500, "d", "e"])], ["text"])
    assert [len(x) for x in blocks._blocks(batch, 100)] == [2, 1, 2]
    assert all(len(x[0]) == 0 for x in (blocks.words(pa.array([""], pa.string())), blocks.grams(pa.array(["", ""], pa.string()))))


def test_index_of_patterns_is_small(spark, tmp_path):
    """Both indexes take less than the texts, no term meets its texts as rows, and what a first round writes is not written again to be split."""
    import os

    from lumenfold.plans.follow import Index

    rng = np.random.default_rng(1)
    known = ["".join(rng.choice(list("etaoinsh"), rng.integers(2, 8))) for _ in range(3000)]
    rows = [(f"e{i}::0", f"e{i}", "2020-01-01", "s", " ".join(rng.choice(known, 300))) for i in range(1000)]
    store = Snapshots(spark, str(tmp_path / "s"), "id string, entry_id string, date string, source string, text string", most=300)
    store.write(spark.createDataFrame(rows, store.schema), rows=len(rows))
    assert store.state().buckets == 4 and store.state().n == 1 and store.state().rows() == 1000
    store.replace(spark.createDataFrame(rows[:10], store.schema))
    assert sorted(r.id for r in store.read().collect()) == sorted(r[0] for r in rows)
    size = lambda top: sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(top) for f in names)
    for kind in (Grams, Index):
        found = kind(spark, str(tmp_path / kind.__name__), most=40)
        found.follow(store)
        state = found.postings.state()
        assert state.n == 1 and state.buckets > 1  # one commit, no split
        assert size(tmp_path / kind.__name__) < 1.2 * sum(len(r[-1]) for r in rows)


def test_write_with_other_buckets_is_a_conflict(spark, tmp_path):
    """Rows dealt out for the buckets before a write that made more are dealt out again."""
    schema = "entry_id string, n int"
    rows = lambda a, b: spark.createDataFrame([(f"e{i}", i) for i in range(a, b)], schema)
    store, other = (Snapshots(spark, str(tmp_path / "s"), schema, most=10) for _ in range(2))
    store.append(rows(0, 5))
    calls = []

    def change(_):
        calls.append(1)
        if len(calls) == 1:
            other.write(rows(100, 180), rows=80)
        return rows(200, 205), rows(200, 205)

    store._change(lambda state: change(state), None)
    assert len(calls) == 2 and sorted(r.n for r in store.read().collect()) == [*range(100, 180), *range(200, 205)]
    assert sorted(r.n for r in store.of(rows(100, 180).union(rows(200, 205))).collect()) == [*range(100, 180), *range(200, 205)]
