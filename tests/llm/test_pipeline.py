"""The pipeline's stages, each on what the one before it kept, against plain Python."""

import hashlib
import os

import pytest

import corpus_pipeline as P
from lumenfold.llm.pii import base
from tests.llm.test_operators import distance, groups, sets

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no tables")


def test_stages(spark, tmp_path):
    docs, state = spark.read.parquet(f"{SMALL}/documents.parquet"), []
    columns = docs.columns
    for i, (name, stage) in enumerate(P.STAGES):
        before = docs
        stage(spark, docs, SMALL).write.parquet(str(tmp_path / str(i)))
        docs = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert docs.columns == columns, name
        state.append((name, {r.doc_id: r.text for r in before.collect()}, docs))
    assert [name for name, _ in P.STAGES] == ["toxicity", "line-dedup", "minhash-near-dedup", "pii", "packing"]

    kept = {r.doc_id for r in state[0][2].collect()}
    assert 0.8 * len(state[0][1]) < len(kept) < len(state[0][1]) + 1

    seen, positions = {}, state[1][1]
    lines = [(i, n, line) for i in sorted(positions) for n, line in enumerate(positions[i].split("\n")) if line.strip(" ")]
    for at, (_, _, line) in enumerate(lines):
        seen.setdefault(line, at)
    by_length = {}
    for line, at in seen.items():
        by_length.setdefault(len(line), []).append((line, at))
    half = lambda a, b: a[: len(a) // 2] == b[: len(a) // 2] or a[-(len(a) // 2) :] == b[-(len(a) // 2) :]
    near = {a for a, at in seen.items() if len(a) >= 20 for n in (-1, 0, 1) for b, bt in by_length.get(len(a) + n, []) if bt < at and len(b) >= 20 and half(min(a, b, key=len), max(a, b, key=len)) and distance(a, b) == 1}
    for r in state[1][2].collect():
        want = [line for n, line in enumerate(positions[r.doc_id].split("\n")) if not line.strip(" ") or (line not in near and lines[seen[line]][:2] == (r.doc_id, n))]
        assert r.text == "\n".join(want) and r.n_chars == len(r.text)

    ids = sorted(state[2][1])
    s = [sets(state[2][1][i], 5) for i in ids]
    links = [(i, j) for i in range(len(s)) for j in range(i) if s[i] and s[j] and 100 * len(s[i] & s[j]) >= 80 * len(s[i] | s[j])]
    assert {r.doc_id for r in state[2][2].collect()} == {ids[i] for i, top in enumerate(groups(links, len(s))) if top == i}

    for r in state[3][2].collect():
        text = state[3][1][r.doc_id]
        assert (r.text == text) if not base(text) else not base(r.text)

    packed = state[4][2].collect()
    assert {r.doc_id for r in packed} == set(state[4][1])
    whole = P.run(spark, SMALL).collect()
    key = lambda rows: hashlib.sha256(str(sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows)).encode()).hexdigest()
    assert key(whole) == key(packed)


def test_odd_rows_go_through_every_stage(spark, tmp_path):
    """Nulls, shared ids, repeated rows, empty and long texts, clashing names; then an empty table."""
    a, b = "alpha beta gamma delta epsilon zeta eta theta " * 4, "one two three four five six seven eight nine ten"
    rows = [(1, a), (2, a), (2, b), (None, a), (3, "mail x@example.org"), (3, "mail x@example.org"), (4, None), (None, None), (5, ""), (5, "\n \n"), (6, "w" * 30_000), (None, "unique words under no id")]
    names = ["source", "span_list", "n_lines", "k", "k2", "th_of_row", "digest", "row"]
    docs = spark.createDataFrame([(i, t, len(t or ""), *["c"] * len(names)) for i, t in rows], "doc_id bigint, text string, n_chars int, " + ", ".join(f"{n} string" for n in names))
    for table_, many in ((docs, True), (docs.where("false"), False)):
        now, kept = table_, []
        for i, (name, stage) in enumerate(P.STAGES):
            path = str(tmp_path / f"{many}{i}")
            stage(spark, now, SMALL).write.parquet(path)
            now = spark.read.parquet(path)
            if i < 4:
                assert now.columns == docs.columns, name
            kept.append(sorted(str((r.doc_id, r.text)) for r in now.collect()) if i < 4 else now.collect())
        if not many:
            assert kept == [[]] * 5
            continue
        assert len(kept[0]) == len(rows)
        # every copy of a line but the first goes; texts that are left without words all stay
        lines = sorted(str(x) for x in [(1, a), (2, ""), (2, b), (None, ""), (3, "mail x@example.org"), (3, "mail x@example.org"), (4, None), (None, None), (5, ""), (5, "\n \n"), (6, "w" * 30_000), (None, "unique words under no id")])
        assert kept[1] == lines
        lines.remove(str((3, "mail x@example.org")))
        assert kept[2] == lines
        assert kept[3] == sorted(x.replace("x@example.org", "<EMAIL>") for x in lines)
        assert len({(r.doc_id, r.piece, r.sequence_id, r.offset) for r in kept[4]}) == len(kept[4]) >= len(lines)
    near = P.without_near_copies(spark, docs, SMALL)
    left = sorted(str((r.doc_id, r.text)) for r in near.collect())
    gone = [(2, a), (None, a), (3, "mail x@example.org")]
    every = [str((i, t)) for i, t in rows]
    for x in gone:
        every.remove(str(x))
    assert left == sorted(every)


def test_entry_works_without_the_folder(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "corpus_pipeline", None)
    assert "pipeline" not in importlib.reload(entry).queries() and len(entry.oracle_sql()) > 40
    monkeypatch.undo()
    assert "pipeline" in importlib.reload(entry).queries()
