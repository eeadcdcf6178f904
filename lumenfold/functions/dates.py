"""Dates from file names, header lines and explicit values. ``today`` is always a parameter."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

YEARS = (1990, 2100)
HEADER_LINES = 4
MONTHS = "Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split()
_LONG = "January February March April May June July August September October November December".split()
#: Three letters, the whole name, or a beginning of it; other words that begin alike are no months.
_MONTH = "(?:" + "|".join(s + "".join(f"(?:{c}" for c in long[3:]) + ")?" * (len(long) - 3) for s, long in zip(MONTHS, _LONG)) + "|Sept)"


# Fixed formats: file names carry YYYYMMDD, year-month-day, or month-day-year, header lines a numeric date or a month's name.
_COMPACT = r"(?<!\d)(\d{4})(\d{2})(\d{2})(?!\d)"
_YEAR_FIRST = r"(?<!\d)(\d{4})[-_./](\d{1,2})[-_./](\d{1,2})(?!\d)"
_YEAR_LAST = r"(?<!\d)(\d{1,2})[-_./](\d{1,2})[-_./](\d{2,4})(?!\d)"
_HEADER = rf"(?i)\b(\d{{4}}[-/.]\d{{1,2}}[-/.]\d{{1,2}}|{_MONTH}\.?\s+\d{{1,2}},?\s+\d{{4}}|\d{{1,2}}\s+{_MONTH}\.?\s+\d{{4}})\b"


def calendar_date(year: Column, month: Column, day: Column) -> Column:
    """A date, or null where the calendar has none or the year is implausible."""
    y, m, d = (x.try_cast("int") for x in (year, month, day))
    text = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    fits = y.between(*YEARS) & m.between(1, 12) & d.between(1, 31)
    return F.when(fits, F.try_to_date(text, "yyyy-MM-dd"))


def _parts(c: Column, pattern: str) -> list[Column]:
    return [F.regexp_extract(c, pattern, i) for i in (1, 2, 3)]


def filename_date(name: Column, day_first: bool = False) -> Column:
    """YYYYMMDD, then year-month-day, then month-day-year (or day-month where that is none); of each only the first match is tried."""
    compact, ymd, (a, b, short) = (_parts(name, p) for p in (_COMPACT, _YEAR_FIRST, _YEAR_LAST))
    n = short.try_cast("int")
    year = F.when(n >= 100, n).when(n <= 69, n + 2000).otherwise(n + 1900)
    orders = [(b, a), (a, b)] if day_first else [(a, b), (b, a)]
    return F.coalesce(calendar_date(*compact), calendar_date(*ymd), *(calendar_date(year, m, d) for m, d in orders))


def header_date(body: Column) -> Column:
    """The first date in the first lines: year-month-day, month day year, or day month year with the month's name."""
    head = F.array_join(F.slice(F.split(body, r"\r\n|\n|\r"), 1, HEADER_LINES), "\n")
    found = F.regexp_extract(head, _HEADER, 1)
    number = F.array(*map(F.lit, (m.lower() for m in MONTHS)))
    month = F.array_position(number, F.lower(F.regexp_extract(found, r"(?i)([a-z]{3})[a-z]*", 1))).cast("string")
    day = F.regexp_extract(found, r"(?<!\d)(\d{1,2})(?!\d)", 1)
    year = F.regexp_extract(found, r"(\d{4})", 1)
    numeric = calendar_date(*_parts(found, r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})$"))
    return F.when(found.rlike(r"^\d{4}"), numeric).otherwise(calendar_date(year, month, day))


def file_date(stem: Column, body: Column, modified: Column, day_first: bool = False) -> tuple[Column, Column]:
    """(date, source): from the name, the header, or the time of the last change."""
    name, head = filename_date(stem, day_first), header_date(body)
    source = F.when(name.isNotNull(), "filename").when(head.isNotNull(), "header").otherwise("mtime")
    return F.coalesce(name, head, F.to_date(modified)), source


def text_date(body: Column, explicit: Column, today: dt.date) -> tuple[Column, Column]:
    """(date, source): an explicit full date, the header, or today."""
    given = calendar_date(*_parts(F.trim(explicit), r"^(\d{4})-(\d{1,2})-(\d{1,2})$"))
    head = header_date(body)
    source = F.when(given.isNotNull(), "manual").when(head.isNotNull(), "header").otherwise("today")
    return F.coalesce(given, head, F.lit(today)), source


def date_int(d: Column) -> Column:
    return F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)


def month_days(today: dt.date, window: int) -> list[str]:
    """The month-days within ``window`` days of today."""
    return sorted({(today + dt.timedelta(days=i)).strftime("%m-%d") for i in range(-window, window + 1)})


def preset_range(name: str, today: dt.date) -> tuple[str | None, str | None]:
    """(date_from, date_to) of ``all``, ``year`` (this one), a year such as ``2021``, or the last days, as in ``30 days``, today included."""
    if name == "all":
        return None, None
    if name == "year" or name.isdigit():
        year = today.year if name == "year" else int(name)
        return f"{year:04}-01-01", f"{year:04}-12-31"
    days = int(name.removesuffix("days"))
    return (today - dt.timedelta(days=days - 1)).isoformat(), today.isoformat()


def question_years(question: Column, today: dt.date) -> tuple[Column, Column]:
    """First and last day of the years that a question names; nulls where it names none."""
    found = F.transform(F.regexp_extract_all(question, F.lit(r"\b((?:19|20)\d{2})\b"), F.lit(1)), lambda y: y.cast("int"))
    years = F.filter(found, lambda y: y.between(1950, today.year + 1))
    low = F.lower(question)
    pick = lambda c: F.when(low.contains("last year"), today.year - 1).when(low.contains("this year"), today.year).otherwise(c)
    return F.concat(pick(F.array_min(years)).cast("string"), F.lit("-01-01")), F.concat(pick(F.array_max(years)).cast("string"), F.lit("-12-31"))
