import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from lumenfold.functions import columns as C
from lumenfold.functions import dates as D
from lumenfold.sources import texts

TODAY = dt.date(2026, 7, 14)


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first().y


def packed(body, target, overlap):
    """The chunker's rule, in plain Python."""
    paras = [p.strip() for p in body.split("\n\n") if p.strip()]
    if sum(len(p.split()) for p in paras) <= target:
        return ["\n\n".join(paras)] if paras else []
    out, now = [], []
    for p in paras:
        if now and sum(len(q.split()) for q in now) + len(p.split()) > target:
            out.append("\n\n".join(now))
            now = now[len(now) - min(overlap, len(now)) :] if overlap else []
        now.append(p)
    return [*out, "\n\n".join(now)]


@pytest.mark.parametrize("overlap", [0, 1, 2])
def test_chunks(spark, overlap):
    rnd = random.Random(overlap)
    bodies = ["", "  \n\n ", "one", *("\n\n".join(" ".join("w" * rnd.randint(1, 3) for _ in range(rnd.randint(1, 30))) for _ in range(rnd.randint(1, 12))) for _ in range(40))]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, b string").select("i", C.chunks(F.col("b"), 40, overlap).alias("c"))
    assert {r.i: r.c for r in df.collect()} == {i: packed(b, 40, overlap) for i, b in enumerate(bodies)}


def test_windows(spark):
    text = "One two. Three four! Five? " + "x" * 30 + ". End."
    got = one(spark, text, lambda c: C.windows(c, 20))
    assert got == ["One two. Three four!", "Five?", "x" * 30 + ".", "End."]
    assert one(spark, "", C.windows) == [""]


def test_lists_and_answers(spark):
    assert one(spark, [" Max", "max", "", "Anna "], C.clean_list, "array<string>") == "max, anna"
    assert [one(spark, x, C.clean_mood) for x in ("4", "9", "-1", "good", None)] == [4, 5, 1, 3, 3]
    assert one(spark, "```json\n{\"mood\": 4}\n```", C.json_object) == '{"mood": 4}'
    assert one(spark, "nothing", C.json_object) == "{}"
    assert one(spark, "Don't stop, café!", C.tokens) == ["don't", "stop", "caf"]
    assert one(spark, " a\r\nb ", C.content_hash) == one(spark, "a\nb", C.content_hash)


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("20130504", "2013-05-04"), ("x_2013-5-4_y", "2013-05-04"), ("2013_05_04", "2013-05-04"), ("1.03.25", "2025-01-03"), ("25.03.2025", "2025-03-25"), ("3-4-99", "1999-03-04"),
        ("201305041234", None), ("2013-02-30", None), ("1.3.5", None), ("99999999", None), ("draft 1024", None), ("13.13.2020", None),
    ],
)
def test_filename(spark, name, want):
    assert one(spark, name, lambda c: D.filename_date(c).cast("string")) == want


def test_filename_day_first(spark):
    assert one(spark, "03.04.25", lambda c: D.filename_date(c, True).cast("string")) == "2025-04-03"


@pytest.mark.parametrize(
    ("body", "want"),
    [
        ("2013-05-04\ntext", "2013-05-04"), ("\nMay 4, 2013", "2013-05-04"), ("4 may 2013 x", "2013-05-04"), ("Sept. 3 2019", "2019-09-03"), ("a\nb\nc\n2013/5/4", "2013-05-04"),
        ("a\nb\nc\nd\n2013-05-04", None), ("Maybe 12, 2020", None), ("2013-13-01", None), ("Sept 31 2020", None), ("plain", None), ("", None),
    ],
)
def test_header(spark, body, want):
    assert one(spark, body, lambda c: D.header_date(c).cast("string")) == want


def test_resolution(spark):
    rows = spark.createDataFrame([("x", "2020-02-02"), ("May 4, 2013", None), ("x", "soon")], "body string, explicit string")
    date, source = D.text_date(F.col("body"), F.col("explicit"), TODAY)
    assert [tuple(r) for r in rows.select(date.cast("string"), source).collect()] == [("2020-02-02", "manual"), ("2013-05-04", "header"), ("2026-07-14", "today")]


def test_question_years(spark):
    ask = lambda q: tuple(spark.createDataFrame([(q,)], "q string").select(*D.question_years(F.col("q"), TODAY)).first())
    assert ask("between 2019 and 2021?") == ("2019-01-01", "2021-12-31")
    assert ask("Last year") == ("2025-01-01", "2025-12-31")
    assert ask("this year, not 1800") == ("2026-01-01", "2026-12-31")
    assert ask("in 3019") == (None, None)


def test_batches_and_folders(spark, tmp_path):
    blob = spark.createDataFrame([("one\n---\ntwo\n\n\nthree\n\nstill three",)], "blob string")
    assert sorted(r.body for r in texts.batches(blob).collect()) == ["one", "three\n\nstill three", "two"]
    (tmp_path / "a").mkdir()
    (tmp_path / "a/2020-01-02.txt").write_bytes("grüße".encode())
    (tmp_path / "b.txt").write_bytes("grüße".encode("latin-1"))
    (tmp_path / "c.txt").write_text("  \n")
    (tmp_path / "d.md").write_text("x")
    got = {r.entry_id: (r.body, r.stem) for r in texts.from_folder(spark, str(tmp_path)).collect()}
    assert got == {"a/2020-01-02.txt": ("grüße", "2020-01-02"), "b.txt": ("grüße", "b")}
