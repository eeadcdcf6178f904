"""Personal data: patterns for four kinds, and bootstrapped contextual extraction of what they miss.

Matches of the base patterns are seeds. The two words before a seed are a lexical pattern of its kind, and
everything of a looser shape after the same two words is a candidate. Spark scores the graph of patterns and
instances in rounds: a pattern by the share of its distinct instances that are believed, an instance by the patterns that
it occurs with; instances believed enough join the seeds. Candidates after patterns above ``ACCEPT`` become spans.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.shared import identity, unused, tidy, written

# The kinds in the order that spans of one start have.
KINDS = ("email", "ip", "card", "phone")

# The base patterns, each beginning where a match can begin, so that a scan is linear in the text.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){11,}")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")

# Looser shapes of the same kinds.
# A local part and each label of a domain have 64 characters at most, as mail allows no more; so a scan stays linear.
_LOOSE_EMAIL = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[(\[{<] ?at ?[)\]}>] ?[A-Za-z0-9-]{1,64}(?:(?:\.| ?[(\[{<] ?dot ?[)\]}>] ?)[A-Za-z0-9-]{1,64})+", re.IGNORECASE)
_LOOSE_AT = re.compile(r"[(\[{<] ?at ?[)\]}>]", re.IGNORECASE)
_LOOSE_DIGITS = re.compile(r"(?<![\w.+-])\(?[0-9](?:[ ().:/-]{0,2}[0-9]){6,23}(?![\w])")
_LOOSE_IP = re.compile(r"[0-9]{1,3}([.:/-])[0-9]{1,3}\1[0-9]{1,3}\1[0-9]{1,3}")


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _emails(text: str):
    done = 0
    for m in _AT.finditer(text):
        start = m.start()
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            done = m.end()


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches: leftmost and not overlapping within a kind; failing matches are dropped."""
    found = [(a, 0, b) for a, b in _emails(text)] if "@" in text else []
    if _DIGITS.search(text):
        found += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m.group().split("."))]
        for m in _CARD.finditer(text):
            digits = re.sub("[ -]", "", m.group())
            if len(digits) <= 19 and _luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            found += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGITS.findall(m.group())) <= 15]
    return sorted(found)


def loose(text: str) -> list[tuple[int, int, int]]:
    out = []
    if _LOOSE_AT.search(text):
        out += [(m.start(), 0, m.end()) for m in _LOOSE_EMAIL.finditer(text)]
    for m in _LOOSE_DIGITS.finditer(text):
        n = len(_DIGITS.findall(m.group()))
        kind = 1 if _LOOSE_IP.fullmatch(m.group()) else 2 if n >= 12 else 3
        if kind != 2 or n <= 19:
            out.append((m.start(), kind, m.end()))
    return out


def context(text: str, start: int, reach: int) -> str:
    """The two words before a place, in small letters; empty where there are not two within ``reach`` characters."""
    before = text[max(0, start - reach) : start].split()
    return " ".join(before[-2:]).lower() if len(before) > 2 or (len(before) == 2 and start <= reach) else ""


def written_as(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64())])
_SEEN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("stop", pa.int64()), ("seed", pa.bool_()), ("context", pa.string()), ("value", pa.string())])


def apart(own: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Those of ``more`` that overlap none of ``own``, both by start; in one bisection each."""
    starts, reach, far = [a for a, _, _ in own], [], 0
    for _, _, b in own:
        reach.append(far := max(far, b))
    out = []
    for a, k, b in more:
        i = bisect_right(starts, b - 1)  # those that begin before b
        if not i or reach[i - 1] <= a:
            out.append((a, k, b))
    return out


def _scan(reach: int):
    def run(batches):
        for batch in batches:
            spans, seen, digest = [], [], []
            for text in batch.column("text").to_pylist():
                own = base(text)
                spans.append([{"start": a, "kind": k, "stop": b} for a, k, b in own])
                digest.append(hashlib.sha256(written_as(own).encode()).hexdigest())
                both = [(a, k, b, True) for a, k, b in own] + [(a, k, b, False) for a, k, b in apart(own, loose(text))]
                seen.append([{"start": a, "kind": k, "stop": b, "seed": s, "context": c, "value": text[a:b].lower()} for a, k, b, s in both for c in [context(text, a, reach)] if c])
            names = ["doc_id", "row", "k", "k2"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(spans, pa.list_(_SPAN)), pa.array(seen, pa.list_(_SEEN)), pa.array(digest)], [*names, "own", "seen", "digest"])

    return run


def accepted_patterns(seen: DataFrame, rounds: int = 3, accept: float = 0.8, believe: float = 0.9, seeds: int = 3) -> DataFrame:
    """(kind, context) of the patterns that are trusted, from rows of kind, context, value, seed.

    A pattern's score is the belief in its distinct values, over their number and one more; an instance's belief is 1 for seeds, else
    1 - the product of (1 - score) over its patterns with ``seeds`` seeds. From ``believe`` on an instance is a seed in the next of ``rounds`` rounds.
    Patterns with a score of ``accept`` and ``seeds`` seeds are trusted. Rows with nulls teach nothing; no rows give none.
    """
    least = seeds
    edges = seen.groupBy("kind", "context", "value").agg(F.max("seed").alias("seed"))
    # a pattern without candidates finds nothing new, one with few seeds is never trusted
    use = edges.groupBy("kind", "context").agg(F.sum(F.col("seed").cast("int")).alias("seeds"), F.count("*").alias("all")).where((F.col("seeds") >= 1) & (F.col("all") > F.col("seeds"))).select("kind", "context")
    edges = written(edges.join(use, ["kind", "context"]).withColumn("belief", F.col("seed").cast("double")), "edges")
    scored = None
    for _ in range(rounds):
        # one more instance that is not believed keeps patterns with few instances down
        scored = written(edges.groupBy("kind", "context").agg((F.sum("belief") / (F.count("*") + 1)).alias("score"), F.sum(F.col("seed").cast("int")).alias("seeds")), "patterns")
        doubt = edges.join(scored.where(F.col("seeds") >= least).select("kind", "context", "score"), ["kind", "context"], "left").groupBy("kind", "value")
        belief = doubt.agg((1 - F.exp(F.sum(F.log(1 - F.least(F.coalesce("score", F.lit(0.0)), F.lit(0.999)))))).alias("b"))
        sure = F.col("seed") | (F.col("b") >= believe)
        edges = written(edges.join(belief, ["kind", "value"]).select("kind", "context", "value", sure.alias("seed"), F.when(sure, 1.0).otherwise(F.col("b")).alias("belief")), "edges")
    return scored.where((F.col("score") >= accept) & (F.col("seeds") >= least)).select("kind", "context")


@tidy
def find(docs: DataFrame, reach: int = 60, **scoring) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, k, k2 (hashes of the text), span_list.

    The counts and base_sha256 are of the base matches alone; spans and span_list (start, kind number, stop; code points, stop
    exclusive; sorted by start, then kind) hold the ones that context added too, n_added of them. Added spans overlap no base span. A
    context is the two words before a span, if they lie within ``reach`` characters; ``scoring`` goes to ``accepted_patterns``.

    Null and empty texts have none. Rows equal in doc_id and text get the same result; null ids keep their rows; other columns are
    ignored; an empty table gives no rows.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *identity()).withColumn("row", F.monotonically_increasing_id())
    kinds = "doc_id bigint, row bigint, k bigint, k2 bigint, own array<struct<start bigint, kind int, stop bigint>>, seen array<struct<start bigint, kind int, stop bigint, seed boolean, context string, value string>>, digest string"
    scanned = written(rows.mapInArrow(_scan(reach), kinds), "scanned")
    seen = scanned.select("row", F.explode("seen").alias("x")).select("row", "x.*")
    added = seen.where("not seed").join(accepted_patterns(seen, **scoring), ["kind", "context"], "left_semi")
    added = written(added.groupBy("row").agg(F.collect_set(F.struct("start", "kind", "stop")).alias("more")), "added")
    out = scanned.drop("seen").join(added, "row", "left").withColumn("more", F.coalesce("more", F.expr("cast(array() as array<struct<start bigint, kind int, stop bigint>>)")))
    every = F.array_sort(F.concat("own", "more"))
    names = F.array(*map(F.lit, KINDS))
    text = F.array_join(F.transform(every, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["stop"])), ",")
    counts = [F.expr(f"size(filter(own, s -> s.kind = {k}))").cast("bigint").alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return out.select("doc_id", *counts, F.col("digest").alias("base_sha256"), text.alias("spans"), F.size("more").cast("bigint").alias("n_added"), "k", "k2", every.alias("span_list"))


def _masked(column: str):
    def run(batches):
        for batch in batches:
            out = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column(column).to_pylist()):
                if text is not None and spans:
                    parts, at = [], 0
                    for s in spans:
                        if s["stop"] > at:
                            parts += [text[at : max(at, s["start"])], f"<{KINDS[s['kind']].upper()}>"] if s["start"] >= at else []
                            at = s["stop"]
                    text = "".join([*parts, text[at:]])
                out.append(text)
            names = [n for n in batch.schema.names if n != column]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()) if n == "text" else batch.column(n) for n in names], names)

    return run


@tidy
def mask(docs: DataFrame, **finding) -> DataFrame:
    """``docs`` with each span of ``text`` replaced by its kind, as in <EMAIL>; overlapping spans by the first's.

    All rows and other columns stay as they are, whatever their names; null texts stay null. Equal texts get the same result. An empty table
    gives no rows.
    """
    a, b, spans = (unused(docs, c) for c in ("k_of_text", "k2_of_text", "spans_of_text"))
    found = find(docs, **finding).where(F.size("span_list") > 0).groupBy(F.col("k").alias(a), F.col("k2").alias(b)).agg(F.first("span_list").alias(spans))
    # both sides of the join are plain, so Spark can split what equal texts make large
    joined = docs.withColumns(dict(zip((a, b), identity()))).join(written(found, "found"), [a, b], "left")
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns), spans).mapInArrow(_masked(spans), docs.schema)
