"""Each operator against brute force, on odd rows too: nulls, empty and long texts, ties, repeated rows, clashing columns, no rows."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumenfold.llm import bpe, fingerprints, graphs, language_model, lattice, line_dedup, minhash, packing, pii, shared, substrings, toxicity

RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
DOCS = "doc_id bigint, text string, digest string, key int, h1 string, rank string, score string"
RND = random.Random(11)
VOCABULARY = ["".join(RND.choice("abcdefghij") for _ in range(RND.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(VOCABULARY) for _ in range(n))


def changed(text, n, seed):
    rnd, words = random.Random(seed), text.split(" ")
    for _ in range(n):
        words[rnd.randrange(len(words))] = f"x{rnd.randrange(10**6)}"
    return " ".join(words)


ODD = [None, "", "   ", "\n\n", "one", "One  two\tthree\x0b", "é 日本語 🎉 naïve", "a" * 50_000, "spam " * 4000]


def frame(spark, texts, ids=None):
    rows = [(i, t, "d", 1, "h", "r", "s") for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, DOCS)


def sets(text, k):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def groups(links, n):
    of = list(range(n))

    def top(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        of[b] = a
    return [top(i) for i in range(n)]


@pytest.mark.parametrize(("shingle", "percent"), [(3, 85), (5, 80)])
def test_near_duplicates(spark, shingle, percent):
    texts = list(ODD)
    for base in range(4):
        own = prose(120, base)
        texts += [own, own, own + "\nUPPER".lower(), *(changed(own, RND.randint(1, 9), RND.random()) for _ in range(25))]
    texts += [prose(40, 100 + i) + " " + prose(30, 99) for i in range(40)]  # a passage in common
    got = {r.doc_id: r for r in minhash.near_duplicates(frame(spark, texts), shingle, percent).collect()}
    s = [sets(t, shingle) for t in texts]
    links = [(i, j) for i in range(len(s)) for j in range(i) if s[i] and s[j] and 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j])]
    assert [got[i].component_id for i in range(len(s))] == groups(links, len(s))
    assert [got[i].n_shingles for i in range(len(s))] == [len(x) for x in s]
    assert all(r.kept == (r.doc_id == r.component_id) for r in got.values())


def test_pairs_at_the_threshold_are_linked(spark):
    """74 shingles, of which two changed words take 6: 68 of 80 in common, exactly 0.85; with three changed words 65 of 83."""
    texts = []
    for i in range(300):
        own = [f"w{i}x{j}" for j in range(76)]
        other = list(own)
        for at in RND.sample(range(3, 73, 4), 2 if i < 250 else 3):
            other[at] = "changed"
        texts += [" ".join(own), " ".join(w if w != "changed" else f"c{i}y{j}" for j, w in enumerate(other))]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, texts), 3, 85).collect()}
    assert [got[2 * i + 1] for i in range(300)] == [2 * i + (i >= 250) for i in range(300)]


def test_members_of_a_long_list_make_few_rows(spark, monkeypatch):
    """Of a member's difference to the list's centre, only as many values become rows as a link lets it differ in, and one."""
    texts = [prose(40, 300 + i) + " " + prose(80, 299) for i in range(60)]
    rows = {}

    def counted(df, name):
        table = shared.written(df, name)
        if name == "long" or "e" in df.columns:
            rows[name] = table.count()
        return table

    monkeypatch.setattr(minhash, "written", counted)
    got = {r.doc_id: r for r in minhash.near_duplicates(frame(spark, texts), 3, 85).collect()}
    assert all(r.kept for r in got.values())
    members, most = rows.pop("long"), max(r.n_shingles for r in got.values()) * 15 // 85 + 1
    assert members > minhash.SHORT and 0 < max(rows.values()) <= members * most


@pytest.mark.parametrize(("shingle", "percent", "few", "frequent"), [(3, 85, 2, 3), (5, 80, 1, 1), (3, 85, 32, 1024)])
def test_links_do_not_depend_on_the_order_of_values(spark, monkeypatch, shingle, percent, few, frequent):
    for name, value in (("SHORT", 2), ("FEW", few), ("FREQUENT", frequent)):
        monkeypatch.setattr(minhash, name, value)
    base = prose(150, 400)
    texts = [base, *(changed(base, n, 410 + 10 * n + i) for n in (2, 4, 6, 9) for i in range(8))]
    cut = " ".join(base.split()[:90])
    texts += [cut, *(changed(cut, 3, 600 + i) for i in range(12)), *(base + " " + prose(60, 620 + i) for i in range(12))]
    for i in range(6):  # pairs beside a passage that all have
        own = prose(60, 640 + i) + " " + prose(70, 699)
        texts += [own, changed(own, 2, 650 + i)]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, texts), shingle, percent).collect()}
    s = [sets(t, shingle) for t in texts]
    links = [(i, j) for i in range(len(s)) for j in range(i) if 100 * len(s[i] & s[j]) >= percent * len(s[i] | s[j])]
    assert [got[i] for i in range(len(s))] == groups(links, len(s))


def test_null_ids_are_linked_too(spark):
    t = prose(60, 3)
    got = minhash.near_duplicates(frame(spark, [t, changed(t, 1, 5), "x"], [None, None, 4]), 3, 85).collect()
    assert sorted(str(r.component_id) for r in got) == ["4", "None", "None"]


def test_one_row_of_each_group_stays(spark):
    a, b = prose(60, 1), prose(60, 2)
    near = changed(a, 1, 4)
    rows = [(1, a), (2, a), (2, b), (None, a), (3, "same"), (3, "same"), (None, near), (5, None), (5, None), (6, " "), (None, None), (None, "alone"), (7, "x y"), (7, "x y z")]
    docs = frame(spark, [t for _, t in rows], [i for i, _ in rows]).withColumnsRenamed({"rank": "k_of_row", "score": "K2_OF_ROW"})
    got = minhash.without_near_duplicates(docs)
    assert got.columns == docs.columns
    want = [(1, a), (2, b), (3, "same"), (5, None), (5, None), (6, " "), (None, None), (None, "alone"), (7, "x y"), (7, "x y z")]
    assert sorted(map(str, ((r.doc_id, r.text) for r in got.collect()))) == sorted(map(str, want))
    assert minhash.without_near_duplicates(docs.where("false")).count() == 0


def test_near_duplicates_repeated_rows_and_null_ids(spark):
    t = prose(30, 1)
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(frame(spark, [t, t, t, "other"], [7, 7, None, 8])).collect()), key=str)
    assert got == sorted([(7, 7, True), (7, 7, True), (None, 7, False), (8, 8, True)], key=str)
    assert minhash.near_duplicates(frame(spark, [])).count() == 0


@pytest.mark.parametrize("t", [0.8, 0.85])
def test_sketches_refuse_hardly_a_pair_at_the_threshold(t):
    fewer = lambda m: sum(math.comb(32, i) * t**i * (1 - t) ** (32 - i) for i in range(m))
    assert fewer(math.ceil(minhash.FLOOR * 32)) < 1e-7
    assert fewer(math.ceil((t - minhash.SLACK) * 32)) < 1e-7


def test_components(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (5, 5), (101, 100)]
    got = {r.node: r.component for r in graphs.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100}


def test_packing(spark):
    import tiktoken

    texts = [*ODD, *(prose(RND.randint(1, 900), i) for i in range(80)), prose(4000, 3), "x", "x"]
    encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={}).encode_ordinary
    rows = packing.pack(frame(spark, texts), RANKS, PATTERN).collect()
    filled = {}
    for i, t in enumerate(texts):
        ids, at = [*encode(t or ""), 0], 0
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // 2048)))
        for r in own:
            assert r.start == at and r.ids_crc32 == zlib.crc32(np.array(ids[at : at + r.length], "<u4").tobytes())
            at += r.length
            filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert at == len(ids) and all(r.length == 2048 for r in own[1:])
    for places in filled.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(filled) <= math.ceil(sum(r.length for r in rows) / 2048) + 1
    assert packing.pack(frame(spark, []), RANKS, PATTERN).count() == 0


def test_packing_of_added_tokens(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["a<|endoftext|>b", "<|endoftext|>", " <|endoftext|> <|endoftext|><|endoftext|>\n", "<|endoftext", "one <|endoftext|>\ttwo  three", "<|endoftext|>" * 3000]
    rows = packing.pack(frame(spark, texts), RANKS, PATTERN).collect()
    for i, t in enumerate(texts):
        ids = [*tokenizer.encode(t, add_special_tokens=False).ids, 0]
        own = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.ids_crc32 for r in own] == [zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes()) for r in own]
        assert sum(r.length for r in own) == len(ids)


def test_tokens_are_the_tokenizers_own():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    codec, worker, added = bpe.Codec(bpe.read_ranks(RANKS), PATTERN), packing._worker(RANKS, PATTERN), packing._added(RANKS)
    letters = " \n\t ab 　é日本語🎉123\x1c\x85 'st..,,-+A\x00́²Ⅷ"
    texts = [t or "" for t in ODD[:7]] + ["".join(RND.choice(letters) for _ in range(RND.randint(0, 30))) for _ in range(1500)] + [prose(300, 5), "don't <|endoftext|> it's"]
    for text in texts:
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(b"".join(packing._encoded(text, worker, added)), "<u4").tolist() == ids
        if "<|endoftext|>" not in text:  # an added token for packing, plain text for the codec, as for the tiktoken library
            assert codec.encode(text) == ids and codec.decode(ids) == text.encode()


def test_round_trip(spark):
    import tiktoken

    encode = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={}).encode_ordinary
    texts = [*ODD, prose(500, 1), prose(500, 1)]
    sha = lambda x: hashlib.sha256(x).hexdigest()
    for r in bpe.round_trip(frame(spark, texts), RANKS, PATTERN).collect():
        ids = encode(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()), sha((texts[r.doc_id] or "").encode()))
    assert bpe.round_trip(frame(spark, []), RANKS, PATTERN).count() == 0


def test_pii_base(spark):
    import re

    kinds = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]
    luhn = lambda d: sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    letters = ["a@b.c", "@", ".", "1.2.3.4", "256", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", "-", " ", "9", "x.y", "é", "0"]
    texts = [*ODD, *("".join(RND.choice(letters) for _ in range(RND.randint(0, 25))) for _ in range(400))]
    for r in pii.find(frame(spark, texts)).collect():
        text, spans = texts[r.doc_id] or "", []
        for k, pattern in enumerate(kinds):
            for m in re.finditer(pattern, text):
                digits = re.sub("[^0-9]", "", m.group())
                if (k == 0) or (k == 1 and all(int(p) <= 255 for p in m.group().split("."))) or (k == 2 and 12 <= len(digits) <= 19 and luhn(digits)) or (k == 3 and 9 <= len(digits) <= 15):
                    spans.append((m.start(), k, m.end()))
        joined = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest(), text
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for _, k, _ in spans) for i in range(4)]
        assert set(joined.split(",")) <= set(r.spans.split(",")) | {""}
    assert pii.find(frame(spark, [])).count() == 0


def test_pii_patterns_find_what_the_base_misses(spark):
    texts = [f"{prose(5, i)} my mobile is +1 (555) 010-{i:04} thanks" for i in range(30)] + [f"{prose(5, 50 + i)} my mobile is 555-0199-{i:03} ok" for i in range(4)]
    texts += [f"{prose(5, 90 + i)} order number was 555-0199-{i:03} ok" for i in range(6)]
    got = {r.doc_id: r for r in pii.find(frame(spark, texts)).collect()}
    assert [got[i].n_added for i in range(40)] == [0] * 30 + [1] * 4 + [0] * 6
    a = texts[30].index("555-")
    assert got[30].spans == f"phone:{a}:{a + 12}"
    masked = {r.doc_id: r.text for r in pii.mask(frame(spark, texts)).collect()}
    assert "<PHONE> thanks" in masked[0] and "<PHONE> ok" in masked[30] and masked[36] == texts[36]


def trusted(rows, rounds=3, accept=0.8, believe=0.9, seeds=3):
    """The scoring rounds on rows of kind, context, value, seed, in plain Python."""
    edges = {}
    for kind, c, value, seed in rows:
        edges[kind, c, value] = edges.get((kind, c, value), False) or seed
    by = {}
    for (kind, c, value), seed in edges.items():
        by.setdefault((kind, c), {})[value] = seed
    by = {p: vs for p, vs in by.items() if 0 < sum(vs.values()) < len(vs)}
    sure = {(p[0], v) for p, vs in by.items() for v in vs if vs[v]}
    seed = {(p, v): s for p, vs in by.items() for v, s in vs.items()}
    belief = {k: float(s) for k, s in seed.items()}
    for _ in range(rounds):
        score = {p: sum(belief[p, v] for v in vs) / (len(vs) + 1) for p, vs in by.items()}
        count = {p: sum(seed[p, v] for v in vs) for p, vs in by.items()}
        doubt = {}
        for p, vs in by.items():
            for v in vs:
                doubt[p[0], v] = doubt.get((p[0], v), 1.0) * (1 - min(0.999, score[p] if count[p] >= seeds else 0.0))
        for p, v in list(seed):
            seed[p, v] = seed[p, v] or 1 - doubt[p[0], v] >= believe
            belief[p, v] = 1.0 if seed[p, v] else 1 - doubt[p[0], v]
    assert sure
    return {p for p in by if score[p] >= accept and count[p] >= seeds}


@pytest.mark.parametrize("seed", range(4))
def test_scoring_rounds(spark, seed):
    rnd = random.Random(seed)
    quality = [rnd.random() for _ in range(25)]
    rows = []
    for _ in range(900):
        c, value = rnd.randrange(25), rnd.randrange(400)
        rows.append((rnd.randrange(2), f"c{c}", f"v{value}", value % 100 < 100 * quality[c] ** 0.25 and rnd.random() < 0.97))
    given = spark.createDataFrame(rows, "kind int, context string, value string, seed boolean")
    for options in ({}, {"accept": 0.6, "seeds": 5, "believe": 0.95, "rounds": 2}):
        got = {(r.kind, r.context) for r in pii.accepted_patterns(given, **options).collect()}
        assert got == trusted(rows, **options)
    assert len(trusted(rows, accept=0.5)) > 3


def test_spans_apart():
    rnd = random.Random(3)
    for _ in range(300):
        spans = lambda n: sorted((a, 0, a + rnd.randint(1, 9)) for a in (rnd.randrange(60) for _ in range(n)))
        own, more = spans(rnd.randint(0, 6)), spans(6)
        assert pii.apart(own, more) == [m for m in more if not any(x < m[2] and m[0] < y for x, _, y in own)]


def test_columns_of_any_name_are_kept(spark):
    names = "span_list spans_of_text k k2 n_lines n_dropped th_of_row lines_out __gone __key __th own seen row digest".split()
    rows = [(1, "call +1 (555) 010-1234 now\nsame line here", *"x" * len(names)), (None, None, *"x" * len(names)), (2, "same line here", *"x" * len(names))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, " + ", ".join(f"`{n}` string" for n in names))
    masked = pii.mask(docs)
    assert masked.columns == docs.columns and {r.doc_id: r.text for r in masked.collect()} == {1: "call <PHONE> now\nsame line here", None: None, 2: "same line here"}
    assert all(set(r[2:]) == {"x"} for r in masked.collect())
    counted = line_dedup.dedup_lines(docs)
    assert {r.doc_id: (r.n_lines, r.n_dropped) for r in counted.collect()} == {1: (2, 0), None: (0, 0), 2: (1, 1)}
    lines = line_dedup.without_repeated_lines(docs)
    assert lines.columns == docs.columns and {r.doc_id: r.text for r in lines.collect()} == {1: rows[0][1], None: None, 2: ""}
    assert pii.find(docs).count() == 3 and minhash.near_duplicates(docs).count() == 3


def test_line_lengths_for_near_lines(spark):
    texts = ["abcd", "abce", "abcdefghijklmnopqrstuvwxyz", "abcdefghijklmnopqrstuvwxyZ"]
    left = lambda n: [r.text for r in line_dedup.dedup_lines(frame(spark, texts), n).orderBy("doc_id").collect()]
    assert left(20) == ["abcd", "abce", texts[2], ""] and left(1) == ["abcd", "", texts[2], ""] and left(99) == texts


def test_substrings(spark):
    passage = prose(90, 500)
    texts = [*ODD, *(prose(200, 600 + i) for i in range(30))]
    for i in range(12, 30, 3):
        words = texts[i].split(" ")
        texts[i] = " ".join(words[: i * 3] + [passage] + words[i * 3 :])
    texts += [texts[20], texts[12] + " " + passage[:100]]
    rows = substrings.repeated_passages(frame(spark, texts)).collect()
    grams, expected = {}, set()
    for i, t in enumerate(texts):
        w = (t or "").split()
        for j in range(len(w) - 50):
            if grams.setdefault(tuple(w[j : j + 51]), i) != i:
                expected.add(i)
    assert {r.doc_id for r in rows} == expected
    for r in rows:
        part = texts[r.doc_id][r.start : r.stop]
        assert part in texts[r.first_doc_id] and r.first_doc_id < r.doc_id and r.n_words == len(part.split()) > 50
    assert substrings.repeated_passages(frame(spark, [])).count() == 0


def test_substrings_that_other_documents_have_in_parts(spark):
    part = [prose(10, 700 + i) for i in range(8)]
    texts = [" ".join(p) for p in (part[:4], part[3:], part, part)]
    assert [len(t.split()) for t in texts] == [40, 50, 80, 80]
    rows = substrings.repeated_passages(frame(spark, texts)).collect()
    assert [tuple(r) for r in rows] == [(3, 0, len(texts[3]), 80, 2)]


def test_the_shortest_and_the_periodic_substrings(spark):
    passages = [*(prose(51, 800 + i) for i in range(60)), " ".join("abcde"[i * i * i % 5] for i in range(51)), "Ha " * 50 + "Ha", "menten " * 50 + "menten", "x yz " * 30 + "x"]
    texts, at = [], []
    for i, p in enumerate(passages):
        at.append([len(texts), len(texts) + 1])
        texts += [f"{prose(RND.randint(1, 60), 900 + i)}, {p} .{i}", f"{prose(RND.randint(1, 60), 1000 + i)}; {p} !{i}"]
    rows = substrings.repeated_passages(frame(spark, texts)).collect()
    found = {(r.doc_id, r.first_doc_id) for r in rows if passages[r.doc_id // 2] in texts[r.doc_id][r.start : r.stop]}
    assert {(b, a) for a, b in at} <= found
    for r in rows:
        part = texts[r.doc_id][r.start : r.stop]
        assert part in texts[r.first_doc_id] and r.n_words == len(part.split()) > 50


def test_chunks_recover_after_an_insertion():
    words = prose(3000, 8).split()
    whole, moved = (substrings.Text(" ".join(w).encode(), 50) for w in (words, words[:500] + ["inserted"] + words[500:]))
    assert len(whole.cuts) > 200 and len(np.setdiff1d(whole.digests, moved.digests)) <= 3
    assert np.diff(whole.cuts).max() <= substrings.window(50) and len(set(np.diff(whole.cuts))) > 10


def test_near_vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 64))
    base = np.concatenate([base, base[:30] + 0.3 * rng.standard_normal((30, 64)), base[:10] + 0.42 * rng.standard_normal((10, 64)), base[:5]]).astype(np.float32)
    rows = [(i, [float(x) for x in v], int(i % 2 if i < 60 else (i - 60) % 2), "x") for i, v in enumerate(base)]
    odd = [(200, None, 0, ""), (201, [0.0] * 64, 0, ""), (202, [float("nan")] * 64, 0, ""), (203, [None] * 64, 0, ""), (204, rows[0][1], None, ""), (205, [], 0, ""), (206, [1.0, 2.0], 0, ""), (207, [2.0, 4.0], 0, "")]
    got = {r.vec_id: r for r in lattice.near_vectors(spark.createDataFrame(rows + odd, "vec_id bigint, embedding array<float>, label int, node string")).collect()}
    unit = base.astype(float) / np.linalg.norm(base.astype(float), axis=1)[:, None]
    label = np.array([r[2] for r in rows])
    near = (unit @ unit.T >= 0.93) & (label[:, None] == label) & ~np.eye(len(rows), dtype=bool)
    assert [got[i].n_links for i in range(len(rows))] == near.sum(1).tolist()
    assert [got[i].component_id for i in range(len(rows))] == groups(np.argwhere(near).tolist(), len(rows))
    assert all(got[i].n_links == 0 and got[i].component_id == i for i in range(200, 206)) and got[206].n_links == got[207].n_links == 1


def test_lattice_recall():
    rng = np.random.default_rng(0)
    a = rng.standard_normal((2000, 64))
    a /= np.linalg.norm(a, axis=1)[:, None]
    o = rng.standard_normal((2000, 64))
    o -= (o * a).sum(1)[:, None] * a
    b = 0.93 * a + math.sqrt(1 - 0.93**2) * o / np.linalg.norm(o, axis=1)[:, None]
    met = np.zeros(2000, bool)
    for t in range(lattice.TABLES):
        (x, look_x), (y, look_y) = lattice.cells(a, t), lattice.cells(b, t)
        met |= (look_x == y[:, None]).any(1) | (look_y == x[:, None]).any(1)
    assert met.mean() > 0.999


def test_fingerprints(spark):
    texts = [*ODD, *(prose(RND.randint(3, 400), i) for i in range(30)), prose(50, 1), prose(50, 1)]
    ids = RND.sample(range(1000), len(texts))
    by_id = dict(zip(ids, (t or "" for t in texts)))
    order = sorted(by_id, reverse=True)
    got = {r.doc_id: r for r in fingerprints.compare_with_edits(frame(spark, texts, ids)).collect()}
    for i, own in enumerate(order):
        text, following = by_id[own], by_id[order[(i + 1) % len(order)]]
        n = len(text) // 3
        edited = text[: len(text) - n] + following[:n]
        prints = [np.frombuffer(ordered_minhash(x), np.uint32) for x in (text, edited, following)]
        r = got[own]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == tuple(p.tobytes().hex() for p in prints[:2])
        assert (r.near_edited, r.near_next) == (fingerprints.likeness(*prints[:2]), fingerprints.likeness(prints[0], prints[2]))
    assert fingerprints.compare_with_edits(frame(spark, [])).count() == 0
    assert fingerprints.compare_with_edits(frame(spark, ["a b c"] * 2, [5, None])).count() == 2


def ordered_minhash(text):
    """The fingerprint by its definition, with Python's whole numbers."""
    m, words = (1 << 64) - 1, [hashed(w) for w in text.encode().lower().split()]
    kmers = [mixed((mixed(a) * 0x9E3779B97F4A7C15 + b & m) + 2 & m) for a, b in zip(words, words[1:])] or [mixed(w + 1 & m) for w in words]
    seen, numbered = Counter(), []
    for k in kmers:
        numbered.append(mixed(k + seen[k] * 0xD1B54A32D192ED03 & m))
        seen[k] += 1
    out = b""
    for i in range(64):
        seed = mixed((i + 1) * 0x9E3779B97F4A7C15 & m) | 1
        rank = []
        for x in numbered:
            x = x * seed & m
            rank.append((x ^ x >> 32) * 0xFF51AFD7ED558CCD & m)
        least, total = sorted(sorted(range(len(rank)), key=rank.__getitem__)[:2]), 0
        for at in least:
            total = mixed(total * 3 + numbered[at] & m)
        out += (mixed(total + seed & m) >> 32).to_bytes(4, "little") if rank else bytes(4)
    return out


@pytest.mark.parametrize("text", ["", " ", "one", "One two", "a b a b a b c", prose(200, 77), "\u00e9 \u65e5\u672c x\ty " * 20])
def test_fingerprint_is_order_minhash(text):
    assert fingerprints.fingerprints([text.encode(), b"other words here"])[0].tobytes() == ordered_minhash(text)


def test_fingerprints_see_order():
    words = prose(300, 1).split()
    moved = " ".join(words[150:] + words[:150])
    likeness = fingerprints.likeness(*fingerprints.fingerprints([" ".join(words).encode(), moved.encode()]))
    assert 0.2 < likeness < 0.8


def distance(a, b):
    now = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, now = now, [i]
        for j, y in enumerate(b, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
    return now[-1]


def test_line_dedup(spark):
    rnd, lines = random.Random(4), []
    for i in range(12):
        line = prose(rnd.randint(4, 12), i)
        for _ in range(10):
            at, kind = rnd.randrange(len(line) + 1), rnd.randrange(4)
            lines.append(line if kind == 0 else line[:at] + ("Z" if kind < 3 else "") + line[at + (kind > 1) :])
    lines += ["", " ", "ab", "ab", "ac", "x" * 3000, "x" * 2999 + "y", "x" * 2999, "日本語テキストが二十文字以上続く長い行なのです", "日本語テキストが二十文字以上続く長い行なのだ"]
    rnd.shuffle(lines)
    texts = [*ODD, *("\n".join(lines[i : i + 7]) for i in range(0, len(lines), 7))]
    seen, want = [], []
    for t in texts:
        kept = []
        for line in (t or "").split("\n"):
            if line.strip(" ") == "":
                kept.append(line)
                continue
            first = seen.index(line) if line in seen else len(seen)
            near = len(line) >= 20 and any(len(o) >= 20 and abs(len(o) - len(line)) <= 1 and distance(o, line) == 1 for o in seen[:first])
            if first == len(seen) and not near:
                kept.append(line)
            seen.append(line)
        want.append(None if t is None else "\n".join(kept))
    out = line_dedup.dedup_lines(frame(spark, texts))
    got = {r.doc_id: r for r in out.collect()}
    assert out.columns[:7] == [c.split()[0] for c in DOCS.split(", ")]
    for i, t in enumerate(want):
        assert got[i].text == t, i
    twice = line_dedup.dedup_lines(frame(spark, ["same line", "same line", None, "same line"], [3, 3, 4, None])).collect()
    assert sorted((str(r.doc_id), r.text) for r in twice if r.text is not None) == [("3", "same line"), ("3", "same line"), ("None", "")]
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


def test_line_dedup_runs_no_python(spark):
    plan = line_dedup.dedup_lines(frame(spark, ["a\nb"]))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "ArrowEval"))


def mixed(h):
    """The finaliser, with Python's whole numbers."""
    m = (1 << 64) - 1
    h ^= h >> 33
    h = h * 0xFF51AFD7ED558CCD & m
    h ^= h >> 33
    h = h * 0xC4CEB9FE1A85EC53 & m
    return h ^ h >> 33


def hashed(word):
    data = np.frombuffer(word, np.uint8)
    return int(shared.word_hashes(data, np.array([0, len(data)]))[0][0])


def bloom_scores(tokens, taught, bits):
    """Scores from counts, levels and probes, one n-gram at a time."""
    m, end, begin = (1 << 64) - 1, int(language_model.END), int(language_model.BEGIN)
    own = [[*map(hashed, ts[:-1]), end] for ts in tokens]
    both = lambda a, b: mixed(mixed(a) * 0x9E3779B97F4A7C15 + b & m) >> (24 - bits)
    grams = {1: Counter(), 2: Counter()}
    for i, ts in enumerate(own):
        if taught(i):
            grams[1].update([begin, *ts])
            grams[2].update(both(a, b) for a, b in zip([begin, *ts], ts))
    place = lambda gram, key: (gram, key >> (64 - bits if gram == 1 else 40))
    level = lambda c: 1 + int(2 * math.log2(c))
    entries, lit = Counter(), set()
    for gram, counts in grams.items():
        for key, c in counts.items():
            entries[place(gram, key)] += level(c)

    def spots(gram, key, q):
        g, size = mixed(key + 0xD1B54A32D192ED03 * q & m), 8 * max(1, 8 * entries[place(gram, key)] // 8)
        return [(place(gram, key), ((g & 0xFFFFFFFF) + i * (g >> 32) & 0xFFFFFFFF) * size >> 32) for i in range(3)]

    for gram, counts in grams.items():
        for key, c in counts.items():
            for q in range(1, level(c) + 1):
                lit.update(spots(gram, key, q))

    def count(gram, key):
        q = 0
        while entries[place(gram, key)] and lit.issuperset(spots(gram, key, q + 1)):
            q += 1
        return q if q <= 1 else 2 ** ((q - 0.5) / 2)

    n, v = sum(grams[1].values()) - grams[1][begin], len(grams[1].keys() - {begin})
    for ts in own:
        yield sum(math.log10(0.6 * (count(1, b) + 0.1) / (n + 0.1 * (v + 1)) + 0.4 * min(1, count(2, both(a, b)) / max(1, count(1, a)))) for a, b in zip([begin, *ts], ts))


@pytest.mark.parametrize("near", [1 << 30, 0])
def test_language_model(spark, monkeypatch, near):
    monkeypatch.setattr(language_model, "CHUNK", 40_000)
    texts = [*ODD, *(prose(RND.randint(1, 200), i) for i in range(40)), "Tail WORD", "Tail WORD"]
    learn = F.col("doc_id") % 5 != 0
    tokens = [[*(t or "").encode().lower().split(), b"\n"] for t in texts]
    counts = Counter(w for i, ts in enumerate(tokens) if i % 5 for w in ts)
    n, v = sum(counts.values()), len(counts)
    rows = language_model.score(frame(spark, texts), learn, broadcast_bytes=near).collect()
    want = [*bloom_scores(tokens, lambda i: i % 5 != 0, 4)]
    assert len(rows) == len(texts)
    for r in rows:
        own = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(own), sum(w in counts for w in own), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own))
        assert r.score == pytest.approx(want[r.doc_id])
    assert language_model.score(frame(spark, ["a", "a", None], [3, 3, None]), broadcast_bytes=near).count() == 3
    assert language_model.score(frame(spark, []), broadcast_bytes=near).count() == 0
    nothing = language_model.score(frame(spark, ["a b"]), F.lit(False), broadcast_bytes=near).first()
    assert nothing.train_tokens == 0 and nothing.base_score == pytest.approx(3 * math.log10(0.1 / 0.1))


def test_words_of_a_pattern_have_hashes_of_their_own(spark):
    """Thue-Morse words and their complements agree in every polynomial modulo a power of two."""
    word = "a"
    while len(word) < 1 << 16:
        word += word.translate(str.maketrans("ab", "ba"))
        if len(word) >= 64:
            assert hashed(word.encode()) != hashed(word.translate(str.maketrans("ab", "ba")).encode())
    pair = [word[:1024], word[:1024].translate(str.maketrans("ab", "ba"))]
    assert [r.component_id for r in minhash.near_duplicates(frame(spark, pair), 3, 85).orderBy("doc_id").collect()] == [0, 1]
    assert [r.n_known for r in language_model.score(frame(spark, pair), F.col("doc_id") == 0).orderBy("doc_id").collect()] == [2, 1]


def test_filter_levels_are_never_too_low():
    rng = np.random.default_rng(1)
    keys, counts = np.unique(rng.integers(0, 1 << 63, 5000, dtype=np.uint64)), rng.integers(1, 3000, 5000).astype(np.uint64)
    raw = language_model.squeezed(keys)
    assert (language_model.unsqueezed(raw) == keys).all() and len(language_model.unsqueezed(language_model.squeezed(keys[:0]))) == 0
    sent = pa.table({"gram": pa.array([1], pa.int32()), "shard": pa.array([0], pa.int32()), "once": [language_model.squeezed(keys[:0])], "more": [raw], "counts": [language_model.squeezed(counts)]})
    read = language_model.Segments(language_model._merged(sent), 1, 0)
    q = read.levels(keys)
    assert (q >= language_model.level(counts)).all() and (q == language_model.level(counts)).mean() > 0.9
    assert (read.exact(keys) == counts).all() and read.exact(keys + np.uint64(1)).max() == 0


def test_toxicity(spark):
    rnd = random.Random(2)
    bad = ["stupido", "idiotic", "moronish"]
    rows, labels = [], []
    for i in range(400):
        words = prose(rnd.randint(30, 120), i).split()
        toxic = i % 4 == 0
        for _ in range(max(2, len(words) // 25) if toxic else 0):
            words[rnd.randrange(len(words))] = rnd.choice(bad)
        rows.append(" ".join(words))
        labels.append((i, int(toxic)))
    misspelt = prose(60, 999).split()
    misspelt[5], misspelt[25], misspelt[45] = "stuupido", "idiiotic", "moroonish"
    texts = [*rows, " ".join(misspelt), *ODD]
    learn = F.col("doc_id") % 3 != 0
    marks = spark.createDataFrame([*labels, (0, None), (None, 1), (1, 0)], "doc_id bigint, toxic int")
    score = {r.doc_id: r.score for r in toxicity.score(frame(spark, texts), marks, learn).collect()}
    held = [i for i in range(0, 400, 3)]
    assert np.mean([(score[i] >= 0.3) == (i % 4 == 0) for i in held]) > 0.95
    assert score[400] > np.quantile([score[i] for i in held if i % 4], 0.9)
    assert len(score) == len(texts) and all(0 <= s <= 1 for s in score.values())
    assert toxicity.score(frame(spark, []), marks).count() == 0
    twice = frame(spark, [rows[0], rows[1], rows[1]], [3, None, 0])  # a toxic text under another id, clean ones under its own; neither id is learnt from
    clean = {i: t for i, t in enumerate(rows) if i % 4}
    kept = toxicity.without_toxic(frame(spark, texts).union(twice), marks, learn=learn).collect()
    assert score[0] >= 0.3 > score[1] and rows[0] not in {r.text for r in kept} and sum(r.text == rows[1] for r in kept) == 3
    assert {r.doc_id for r in kept} >= {i for i in clean if score[i] < 0.1} and {r.key for r in kept} == {1}
    assert {r.score for r in toxicity.score(frame(spark, ["a"]), marks.where("false")).collect()} == {0.5}


def grams_of(text):
    """Buckets of a text's n-grams of 3 to 5 bytes within its different words and their edges."""
    out, seen = [], set()
    low = bytes(32 if b in (32, *range(9, 14)) else b + 32 if 65 <= b <= 90 else b for b in text.encode())
    at = 0
    for word in low.split(b" "):
        start, end = at, at + len(word)
        at = end + 1
        if not word or word in seen:
            continue
        seen.add(word)
        part = low[max(0, start - 1) : end + 1]
        for n in (3, 4, 5):
            for j in range(len(part) - n + 1):
                key = n
                for b in part[j : j + n]:
                    key = key << 8 | b
                out.append(mixed(key) >> (64 - toxicity.BITS))
    return out


def logistic(x):
    return 1 / (1 + math.exp(-x))


def plain_leaning(has, y):
    """The root of the likelihood ratio statistic of having something, in two classes or in one."""
    total = 0.0
    for c in (0, 1):
        own = [h for h, label in zip(has, y) if label == c]
        for value in (True, False):
            n = own.count(value)
            if n:
                total += n * (math.log(n / len(own)) - math.log(has.count(value) / len(has)))
    return math.sqrt(max(0.0, 2 * total))


def plain_fit(bags, y, totals, lean, epochs=8, batch=64, rate=0.15, seed=7):
    """Bags of embeddings into a softmax, one number at a time."""
    rng, dims = np.random.default_rng(seed), range(toxicity.DIM)
    start = (rng.random((1 << toxicity.BITS, toxicity.DIM), np.float32) - 0.5) / toxicity.DIM
    emb = {k: [float(x) for x in start[k]] for k in {k for bag in bags for k in bag} if plain_leaning([k in bag for bag in bags], y) >= lean}
    sq = {k: [1e-6] * toxicity.DIM for k in emb}
    out, sq_out = [[0.0, 0.0] for _ in dims], [[1e-6, 1e-6] for _ in dims]
    bias = [math.log((totals[c] + 1) / (sum(totals.values()) + 2)) for c in (0, 1)]
    weight = [totals[c] / y.count(c) for c in y]
    weight = [w / (sum(weight) / len(weight)) for w in weight]
    for _ in range(max(epochs, -(-batch // len(y)))):
        for some in np.array_split(rng.permutation(len(y)), max(1, len(y) // batch)):
            g = {k: [toxicity.DECAY * x for x in e] for k, e in emb.items()}
            g_out, g_bias = [[0.0, 0.0] for _ in dims], [0.0, 0.0]
            for i in some:
                use = {k: toxicity.SCALE * s for k, s in bags[i].items() if k in emb}
                hidden = [sum(s * emb[k][d] for k, s in use.items()) for d in dims]
                logit = [bias[c] + sum(hidden[d] * out[d][c] for d in dims) for c in (0, 1)]
                p = [logistic(logit[0] - logit[1]), logistic(logit[1] - logit[0])]
                p[y[i]] -= 1
                p = [x * weight[i] / len(some) for x in p]
                for d in dims:
                    back = sum(p[c] * out[d][c] for c in (0, 1))
                    for k, s in use.items():
                        g[k][d] += s * back
                    for c in (0, 1):
                        g_out[d][c] += hidden[d] * p[c]
                g_bias = [g_bias[c] + p[c] for c in (0, 1)]
            for d in dims:
                for k in emb:
                    sq[k][d] += g[k][d] ** 2
                    emb[k][d] -= rate * g[k][d] / math.sqrt(sq[k][d])
                for c in (0, 1):
                    sq_out[d][c] += g_out[d][c] ** 2
                    out[d][c] -= rate * g_out[d][c] / math.sqrt(sq_out[d][c])
            bias = [bias[c] - 0.02 * g_bias[c] for c in (0, 1)]
    return {k: toxicity.SCALE * sum(e[d] * (out[d][1] - out[d][0]) for d in dims) for k, e in emb.items()}, bias[1] - bias[0]


def test_toxicity_by_plain_loops(spark):
    texts = [f"{prose(9, i)} {'Stupido' if i % 3 == 0 else 'gentle'} {prose(5, 50 + i)}" for i in range(14)] + ["", "ab", " a b\tab ", None]
    y = [int(i % 3 == 0) for i in range(14)]
    bags = [{k: n / (toxicity.NEUTRAL + sum(c.values())) for k, n in c.items()} for c in (Counter(grams_of(t)) for t in texts[:14])]
    values, bias = plain_fit(bags, y, {0: y.count(0), 1: y.count(1)}, 1.9)
    # texts are fitted in an order of their own: by class, number of n-grams, and digests
    marks = spark.createDataFrame(list(enumerate(y)), "doc_id bigint, toxic int")
    got = {r.doc_id: r.score for r in toxicity.score(frame(spark, texts), marks, lean=1.9, steps=1).collect()}
    want = []
    for t in texts:
        g = grams_of(t or "")
        want.append(logistic(bias + sum(values.get(k, 0.0) for k in g) / (toxicity.NEUTRAL + len(g))))
    assert [got[i] for i in range(len(texts))] == pytest.approx(want, abs=2e-3)
    assert min(want[i] for i in range(14) if y[i]) > max(want[i] for i in range(14) if not y[i])
