"""Column functions for text, numbers and lists; all of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

ONE_SPACE = r"\s+"


def rounded(c: Column, places: int) -> Column:
    """Half to even on the scaled value; one rule everywhere."""
    return F.rint(c * 10.0**places) / 10.0**places


def stripped(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def once(c: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is worked out once, however often ``use`` has it."""
    return F.get(F.transform(F.array(c), use), F.lit(0))


def tokens(c: Column) -> Column:
    """Runs of a-z and apostrophes in the lower-cased text."""
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z']+)"), F.lit(1))


def theme_words(c: Column) -> Column:
    """Runs of three and more letters and apostrophes, lower-cased."""
    return F.transform(F.regexp_extract_all(c, F.lit("([a-zA-Z']{3,})"), F.lit(1)), F.lower)


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, ONE_SPACE), lambda w: w != ""))


def content_hash(c: Column) -> Column:
    return F.sha2(F.regexp_replace(stripped(c), "\r\n", "\n"), 256)


def chunk_hash(c: Column) -> Column:
    return F.substring(F.sha2(c, 256), 1, 16)


def count_of(word: Column, chosen: Iterable[str]) -> Column:
    """An aggregate over words: how many are in a set; repetitions count."""
    return F.count_if(word.isin(*chosen)).cast("int")


def distinct_of(word: Column, chosen: Iterable[str]) -> Column:
    """An aggregate over words: how many different ones of a set occur. Each word of the set has a bit of its own."""
    words = list(dict.fromkeys(chosen))
    parts = []
    for i in range(0, len(words), 63):
        bit = F.lit(None).cast("bigint")
        for j, w in enumerate(words[i : i + 63]):
            bit = F.when(word == w, F.lit(1 << j).cast("bigint")).otherwise(bit)
        parts.append(F.bit_count(F.coalesce(F.bit_or(bit), F.lit(0).cast("bigint"))))
    return sum(parts[1:], parts[0]) if parts else F.lit(0)


def first_largest(counts: dict[str, Column], none: str) -> Column:
    """The name of the largest count, the first of equal ones; ``none`` where all are 0."""
    values = F.array(*counts.values())
    best = F.array_max(values)
    names = F.array(*map(F.lit, counts))
    return F.when(best == 0, none).otherwise(F.get(names, (F.array_position(values, best) - 1).cast("int")))


def listed(c: Column) -> Column:
    """The parts of a comma-joined list, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, ","), lambda x: F.trim(x)), lambda x: x != "")


def shown(c: Column) -> Column:
    """The parts of a list as people see it: ``listed``, without brackets and quotes and without what only says that there is nothing."""
    parts = F.transform(listed(F.coalesce(c, F.lit(""))), lambda x: F.regexp_replace(x, r"^[\[\s'\"]+|[\]\s'\"]+$", ""))
    return F.filter(parts, lambda x: ~F.lower(x).isin("", "none", "null"))


def clean_list(c: Column) -> Column:
    """An array of strings as a list: trimmed, lower-cased, each once in its order."""
    return F.array_join(F.array_distinct(F.filter(F.transform(c, lambda x: F.lower(stripped(x))), lambda x: x != "")), ", ")


def clean_mood(c: Column) -> Column:
    """1 to 5; 3 where it is no number."""
    return F.greatest(F.lit(1), F.least(F.lit(5), F.coalesce(c.try_cast("int"), F.lit(3))))


def json_object(c: Column) -> Column:
    """The outermost braces of a model's answer, {} where there are none."""
    found = F.regexp_extract(c, r"(?s)\{.*\}", 0)
    return F.when(found == "", "{}").otherwise(found)


def paragraphs(c: Column, delimiter: str = r"\n\s*\n") -> Column:
    return F.filter(F.transform(F.split(c, delimiter), stripped), lambda p: p != "")


def chunks(c: Column, target: int = 400, overlap: int = 1, delimiter: str = r"\n\s*\n") -> Column:
    """Paragraphs packed into chunks of about ``target`` words, the last ``overlap`` ones carried over.

    A text within the budget is one chunk; an over-long paragraph is not cut; carried words count, and the next
    paragraph is added without a second look at the budget.
    """
    parts = F.transform(paragraphs(c, delimiter), lambda p: F.struct(p.alias("p"), word_count(p).alias("w")))
    # only the paragraph's number, the open chunk's first one and words, and the finished ranges are carried
    kinds = "struct<at: int, first: int, words: int, held: array<int>, done: array<struct<a: int, b: int>>>"

    def take(state: Column, x: Column) -> Column:
        at = state["at"] + 1
        full = (state["words"] + x["w"] > target) & (state["first"] <= state["at"])
        kept = F.least(F.lit(overlap), at - state["first"])
        first = F.when(full, at - kept).otherwise(state["first"])
        carried = F.aggregate(F.slice(state["held"], F.greatest(F.lit(1), F.size(state["held"]) - kept + 1), kept), F.lit(0), lambda s, w: s + w) if overlap else F.lit(0)
        words = F.when(full, carried).otherwise(state["words"]) + x["w"]
        held = F.slice(F.array_append(state["held"], x["w"]), F.greatest(F.lit(1), F.size(state["held"]) + 2 - max(1, overlap)), max(1, overlap))
        done = F.when(full, F.array_append(state["done"], F.struct(state["first"].alias("a"), state["at"].alias("b")))).otherwise(state["done"])
        return F.struct(at.alias("at"), first.alias("first"), words.alias("words"), held.alias("held"), done.alias("done")).cast(kinds)

    start = F.expr(f"cast(named_struct('at', 0, 'first', 1, 'words', 0, 'held', array(), 'done', array()) as {kinds})")
    end = F.aggregate(parts, start, take)
    ranges = F.array_append(end["done"], F.struct(end["first"].alias("a"), end["at"].alias("b")))
    text = lambda r: F.array_join(F.transform(F.slice(parts, r["a"], r["b"] - r["a"] + 1), lambda y: y["p"]), "\n\n")
    return F.when(F.size(parts) == 0, F.expr("cast(array() as array<string>)")).otherwise(F.filter(F.transform(ranges, text), lambda t: t != ""))


def windows(c: Column, most: int = 1800) -> Column:
    """Sentences packed into windows of at most ``most`` characters; a longer sentence is a window.

    What fits into one window is not cut. Values that are used again are bound by ``once``, as Spark would work them out for each use.
    """
    gap = r"(?<=[.!?])\s+"
    # only the sentence's number, the open window's first one and length, and the finished ranges are carried
    kinds = "struct<at: int, first: int, size: int, done: array<struct<a: int, b: int>>>"

    def take(state: Column, n: Column) -> Column:
        full = (state["at"] >= state["first"]) & (state["size"] + n + 1 > most)
        first = F.when(full, state["at"] + 1).otherwise(state["first"])
        size = F.when(full | (state["at"] < state["first"]), n).otherwise(state["size"] + 1 + n)
        done = F.when(full, F.array_append(state["done"], F.struct(state["first"].alias("a"), state["at"].alias("b")))).otherwise(state["done"])
        return F.struct((state["at"] + 1).alias("at"), first.alias("first"), size.alias("size"), done.alias("done")).cast(kinds)

    def cut(sentences: Column) -> Column:
        end = F.aggregate(F.transform(sentences, F.length), F.expr(f"cast(named_struct('at', 0, 'first', 1, 'size', 0, 'done', array()) as {kinds})"), take)
        ranges = once(end, lambda e: F.array_append(e["done"], F.struct(e["first"].alias("a"), e["at"].alias("b"))))
        return F.transform(ranges, lambda r: F.array_join(F.slice(sentences, r["a"], r["b"] - r["a"] + 1), " "))

    def packed(text: Column) -> Column:
        whole = lambda joined: F.when(F.length(joined) <= most, F.array(joined)).otherwise(once(F.split(text, gap), cut))
        return F.when(text == "", F.array(c)).otherwise(once(F.regexp_replace(text, gap, " "), whole))

    ends = F.concat(F.substring(c, 1, 1), F.substring(c, -1, 1))
    return once(F.when(ends.rlike(r"(?U)\s"), stripped(c)).otherwise(c), packed)
