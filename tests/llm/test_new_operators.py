"""Whitening, decontamination and periodic runs against plain versions, on odd rows too."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import decontamination, periods, queries, whitening
from tests.llm.test_operators import ODD, frame, prose

VECTORS = "vec_id bigint, embedding array<float>, label int, x string, component string, n int"


def vectors(spark, rows, ids=None):
    plain = [None if r is None else [None if v is None else float(v) for v in r] for r in rows]
    return spark.createDataFrame([(i, r, 1, "x", "c", 2) for i, r in zip(ids or range(len(rows)), plain)], VECTORS)


def whole(rows):
    return np.floor(64 * np.array([[np.float32(v) for v in r] for r in rows], float)).astype(np.int64) + 1_000_000


@pytest.mark.parametrize("shape", [(60, 7), (6, 9), (40, 40)])
def test_whitening(spark, shape):
    rng = np.random.default_rng(shape)
    rows = rng.normal(size=shape) * np.linspace(0.1, 2, shape[1])
    if shape[1] > 20:
        rows[:, 3], rows[:, 5] = rows[:, 4], 1
    got = whitening.whitened(vectors(spark, rows)).toPandas()
    x = whole(rows)
    n, s = len(x), x.sum(0)
    a = x - x.mean(0)
    e, q = np.linalg.eigh(a.T @ a / n)
    e, q = e[::-1], q[:, ::-1]
    k = min(32, int((e > 1e-9 * e[0]).sum()))
    assert sorted(got.component.unique()) == list(range(1, k + 1)) and len(got) == n * k and set(got.n) == {n}
    assert got.groupby("component").explained.first().to_numpy() == pytest.approx((e / e.sum())[:k], rel=1e-9)
    assert got.identity_error.nunique() == 1 and got.identity_error.max() < 1e-10
    assert got[got.component == 1].set_index("vec_id").deviation.loc[range(n)].tolist() == ((n * x - s) ** 2).sum(1).tolist()
    z = got.pivot(index="vec_id", columns="component", values="whitened").to_numpy()
    want = a @ q[:, :k] / np.sqrt(e[:k])
    assert z * np.sign((z * want).sum(0)) == pytest.approx(want, abs=1e-7)


def test_whitening_of_equal_variances(spark):
    """The first direction leads nowhere, and others follow it."""
    rows = np.concatenate([np.eye(6), -np.eye(6)]) * 3
    got = whitening.whitened(vectors(spark, rows)).toPandas()
    assert got.component.max() == 6 and got.explained.to_numpy() == pytest.approx(1 / 6) and got.identity_error.max() < 1e-12


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [[1, 2], [2, 1], [2, 1], [4, 0], None, [], [1, None], [nan, 1], [inf, 1], [1, 2, 3], [1e30, 0]]
    got = whitening.whitened(vectors(spark, rows, [1, 1, None, 4, 5, 6, 7, 8, 9, 10, 11])).toPandas()
    assert sorted(map(str, got[got.component == 1].vec_id.tolist())) == sorted(map(str, [1.0, 1.0, float("nan"), 4.0])) and set(got.n) == {4}
    assert whitening.whitened(vectors(spark, [[1, 1]] * 3)).count() == 0
    assert whitening.whitened(vectors(spark, [])).columns == list(got.columns)


def test_deviations_that_are_no_long():
    a = whitening.Centred(4, [4 * 2**40, 8])
    assert a.deviations(np.array([[2**40, 2], [0, 0], [2**40 + 1, 1]])) == [0, None, 32]
    big = whitening.Centred(3, [10**9, 1])
    assert big.deviations(np.array([[10**9, 0]])) == [(3 * 10**9 - 10**9) ** 2 + 1]


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shared_with(texts, items, size=10):
    out = []
    cut = [(i, WORD.findall((t or "").translate(UPPER))) for i, t in items]
    for t in texts:
        w, hit, of = WORD.findall((t or "").translate(UPPER)), set(), set()
        for i, own in cut:
            n = min(size, len(own))
            windows = {tuple(own[s : s + n]) for s in range(len(own) - n + 1)} if n else set()
            for s in range(len(w) - n + 1):
                if n and tuple(w[s : s + n]) in windows:
                    hit |= set(range(s, s + n))
                    of |= {str(i)} - {"None"}
        out.append((len(w), len(hit), len(of), hashlib.sha256(",".join(sorted(of)).encode()).hexdigest(), bool(hit)))
    return out


def contaminated_rows(got):
    return [(r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got]


@pytest.mark.parametrize("broadcast", [500_000, 0])
def test_decontamination(spark, broadcast):
    common = prose(12, 7)
    items = [(i, prose(random.Random(i).randint(8, 40), i)) for i in range(20)]
    items += [(20, common), (21, f"{common} and more"), (100, f"Ünder {common}"), (30, "one two"), (31, "Solo"), (32, None), (33, ""), (None, prose(15, 400)), (3, prose(20, 500)), (3, prose(20, 500))]
    texts = list(ODD)
    for i in range(60):
        rnd, own = random.Random(i), prose(50, 1000 + i).split(" ")
        item = (items[rnd.randrange(len(items))][1] or "x").split(" ")
        a, b = sorted(rnd.randrange(len(item) + 1) for _ in range(2))
        own[20:20] = item[a:b] if i % 2 else item
        texts.append(rnd.choice([" ", "\n", ", "]).join(own))
    texts += [common.upper(), f"ünder {common}", f"Ünder {common}", f"{common} {common}", "ONE-TWO", "solo; solo", prose(20, 500), prose(15, 400), texts[12]]
    table = spark.createDataFrame([(i, t, "w", 1) for i, t in items], "item_id bigint, text string, w string, n int")
    got = decontamination.contaminated(frame(spark, texts), table, broadcast_rows=broadcast).collect()
    assert contaminated_rows(sorted(got, key=lambda r: r.doc_id)) == shared_with(texts, items)
    assert decontamination.contaminated(frame(spark, []), table).count() == 0
    alone = decontamination.contaminated(frame(spark, ["x", None], [None, 2]), table.where("text = ''"))
    assert sorted((str(r.doc_id), r.n_words, r.n_hit) for r in alone.collect()) == [("2", 0, 0), ("None", 1, 0)]


def test_decontamination_has_no_python(spark):
    table = spark.createDataFrame([(1, prose(20, 3))], "item_id bigint, text string")
    plan = decontamination.contaminated(frame(spark, [prose(50, 1)]), table)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_characters_that_lower_changes_take_the_slow_way(spark):
    chars = spark.range(128, 0x110000).where("id < 55296 or id > 57343").select(F.decode(F.expr("unhex(lpad(hex(id), 8, '0'))"), "UTF-32").alias("c"))
    assert chars.where(F.length("c") == 1).count() > 1_000_000
    assert chars.where((F.lower("c") != F.col("c")) & ~F.col("c").rlike(decontamination._CASED)).count() == 0


def plain_runs(words, least=12):
    found, n = {}, len(words)
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, 2 * q):
                found.setdefault((start, i + q), q)
            i += 1
    return sorted(((a, b - a, q) for (a, b), q in found.items()), key=lambda r: (r[0], r[2]))


def repeating(rnd):
    k, n = rnd.choice([1, 2, 3, 5, 50]), rnd.choice([0, 1, 5, 12, 30, 80, 200])
    s = [rnd.randrange(k) for _ in range(n)]
    if n > 20 and rnd.random() < 0.5:
        a, p = rnd.randrange(n - 10), rnd.randint(1, 10)
        s = s[:a] + [s[a + (i - a) % p] for i in range(a, n) if a + (i - a) % p < n]
    return s + s + s[: rnd.randrange(len(s) + 1)] if rnd.random() < 0.3 else s


def test_runs(monkeypatch):
    rnd = random.Random(5)
    own = [repeating(rnd) for _ in range(150)]
    want = [plain_runs(s) for s in own]
    assert sum(map(len, want)) > 50
    arrays = [np.array(s, np.int64) for s in own]
    got = lambda: [[tuple(r) for r in x.tolist()] for x in periods.runs(arrays)]
    assert got() == want
    monkeypatch.setattr(periods, "PLACES", 50)  # places are tried in many lots
    assert got() == want
    assert [[tuple(r) for r in periods.runs([x])[0].tolist()] for x in arrays[:30]] == want[:30]
    assert periods.runs([]) == []
    with pytest.raises(ValueError, match="12"):
        periods.runs(arrays, 11)


def test_common():
    rnd = random.Random(8)
    s = [rnd.randrange(2) for _ in range(300)] + [0] * 60 + [9]
    grammar = periods.Grammar(np.array(s))
    pairs = [(i, j) for i in range(0, 360, 7) for j in range(i + 1, 360, 5)]
    want = [next(k for k in range(len(s)) if s[i + k] != s[j + k]) for i, j in pairs]
    assert grammar.common(*np.array(pairs).T).tolist() == want


def test_periodic_texts(spark):
    rnd = random.Random(3)
    texts = [*ODD, *(" ".join(f"w{x}" for x in repeating(rnd)) for _ in range(40)), "a  b\tc\n" * 6, "x y z " * 30]
    for r in periods.periodic_runs(frame(spark, texts)).collect():
        words = re.findall("[^ \t-\r]+", texts[r.doc_id] or "")
        want = plain_runs(words) if len(words) < 2000 else [(0, len(words), 1)]
        gone = {i for a, n, q in want for i in range(a + q, a + n)}
        assert [tuple(x) for x in r.runs] == want and r.text == " ".join(w for i, w in enumerate(words) if i not in gone)
    assert periods.periodic_runs(frame(spark, [])).count() == 0


def test_query_of_periodic_runs(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    rows = queries.op13_periodic_runs(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(docs)
    for r in rows:
        w = re.findall("[^ \t-\r]+", docs[r.doc_id] or "")
        n, h = len(w), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
        want = plain_runs(w) if n < 4000 else None
        if want is None:
            continue
        best = min(want, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        gone = {i for a, m, q in want for i in range(a + q, a + m)}
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(want), *best, 1000 * best[1] // best[2] if want else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{m},{q}\n" for a, m, q in want).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in gone).encode()).hexdigest()


SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [n for n in queries.queries() if n not in ("op1_toxicity", "op7_byte_bpe", "op8_fingerprints", "op13_periodic_runs")] + ["pipeline"])
def test_only_what_a_result_reads_is_left(spark, name):
    import os

    import corpus_pipeline
    from lumenfold.llm import shared

    folder = f"{shared.shared_folder(spark)}/lumenfold"
    there = lambda: set(os.listdir(folder)) if os.path.isdir(folder) else set()
    before = there()
    out = (queries.queries() | {"pipeline": corpus_pipeline.run})[name](spark, SMALL)
    read = {n for f in out.inputFiles() for n in re.findall("/lumenfold/([^/]+)/", f)}
    assert there() - before == read - before and len(read) <= 4
    assert out.count() > 0
