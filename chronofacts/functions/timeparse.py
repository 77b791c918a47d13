"""Free text to day ranges, all as columns that Catalyst can fold and push.

Two parsers, because their callers differ: ``normalize_time`` takes more forms and keeps inverted intervals; ``normalize_time_strict``
takes fewer and rejects them. Where a caller wants an error rather than a null, ``time_error`` says which texts are one.
A parsed time is struct(raw, start, end, granularity, is_interval), null if nothing fits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Month names and short forms. Fixed values.
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7,
    "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12,
}

TIME_TYPE = "struct<raw:string,start:date,end:date,granularity:string,is_interval:boolean>"
DAY = r"\d{4}-\d{2}-\d{2}"


def strip(c: Column) -> Column:
    """Trim Unicode white space on both sides."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_ordinals(c: Column) -> Column:
    return F.regexp_replace(c, r"(?iU)(\d+)(st|nd|rd|th)", "$1")


def clean_time(c: Column) -> Column:
    """Trimmed, without ordinal endings and commas, single spaces."""
    return strip(F.regexp_replace(F.regexp_replace(strip_ordinals(strip(c)), ",", " "), r"(?U)\s+", " "))


def clean_time_strict(c: Column) -> Column:
    """Trimmed, long dashes as hyphens, single spaces; ordinals and commas stay."""
    return strip(F.regexp_replace(F.translate(strip(c), "–—", "--"), r"(?U)\s+", " "))


def month_number(c: Column) -> Column:
    """Number of an English month name or short form; null if unknown."""
    table = F.create_map(*(F.lit(x) for pair in MONTHS.items() for x in pair))
    return F.try_element_at(table, F.lower(c))


def last_day(c: Column) -> Column:
    return F.last_day(c)


def _date(year: Column, month: Column | str, day: Column | str) -> Column:
    pad = lambda x, n: F.lpad(x.cast("string") if isinstance(x, Column) else F.lit(x), n, "0")
    return F.try_to_date(F.concat(pad(year, 4), F.lit("-"), pad(month, 2), F.lit("-"), pad(day, 2)), "yyyy-MM-dd")


def _part(c: Column, pattern: str, k: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, k), F.lit(""))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is written, planned and computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_ISO = r"^(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?$"
_NAMED = r"^(?:(\d{1,2})\s+)?([A-Za-z]+)\s+(?:(\d{1,2})\s+)?(\d{4})$"
DAY_TYPE = "struct<start:date,end:date,granularity:string>"


def _single(text: Column, month_first: bool) -> Column:
    """struct(start, end, granularity) of one cleaned time text, or null."""
    before, after = _part(text, _NAMED, 1), _part(text, _NAMED, 3)
    usable = before.isNull() | after.isNull() if month_first else after.isNull()
    parts = F.struct(
        F.coalesce(_part(text, _ISO, 1), F.when(usable & month_number(_part(text, _NAMED, 2)).isNotNull(), _part(text, _NAMED, 4))).alias("y"),
        F.coalesce(_part(text, _ISO, 2), month_number(_part(text, _NAMED, 2)).cast("string")).alias("m"),
        F.coalesce(_part(text, _ISO, 3), before, after).alias("d"),
    )

    def widened(p: Column) -> Column:
        first = _date(p["y"], F.coalesce(p["m"], F.lit("1")), F.coalesce(p["d"], F.lit("1")))
        end = lambda day: F.when(p["d"].isNotNull(), day).when(p["m"].isNotNull(), F.last_day(day)).otherwise(F.last_day(F.add_months(day, 11)))
        kind = F.when(p["d"].isNotNull(), "day").when(p["m"].isNotNull(), "month").otherwise("year")
        return let(first, lambda day: F.when(day.isNotNull(), F.struct(day.alias("start"), end(day).alias("end"), kind.alias("granularity"))))

    return let(parts, widened)


def _point(raw: Column, single: Column) -> Column:
    return let(single, lambda t: F.when(t.isNotNull(), F.struct(raw.alias("raw"), t["start"].alias("start"), t["end"].alias("end"), t["granularity"].alias("granularity"), F.lit(False).alias("is_interval"))))


def _between(raw: Column, left: Column, right: Column) -> Column:
    """An interval from the beginning of one single to the end of another; null if either is."""
    none = F.lit(None).cast("string")
    return F.when(left.isNotNull() & right.isNotNull(), F.struct(raw.alias("raw"), left["start"].alias("start"), right["end"].alias("end"), none.alias("granularity"), F.lit(True).alias("is_interval")))


def parse_single_time(c: Column) -> Column:
    """One date, month or year: ISO forms, ``Apr 2011``, ``27 October 2006``, ``January 1st, 1981``."""
    return _point(c, let(clean_time(c), lambda t: _single(t, True)))


def parse_single_time_strict(c: Column) -> Column:
    """As ``parse_single_time``, without ordinals, commas and ``January 1 1981``."""
    return _point(c, let(clean_time_strict(c), lambda t: _single(t, False)))


#: The first that fits splits a text in two.
_SPLITS = (rf"^({DAY})\s*-\s*({DAY})$", r"^(\d{4})\s*-\s*(\d{4})$", r"(?i)^(.+?)\s+to\s+(.+)$", r"^(.*?) - (.*)$")
_DAYS, _YEARS, _TO, _DASH = _SPLITS
_PLAIN_DAY, _PLAIN_DAYS = rf"\A{DAY}\z", rf"\A{DAY}-{DAY}\z"


def _normalized(c: Column, clean: Callable[[Column], Column], month_first: bool) -> Column:
    def side(text: Column, k: int) -> Column:
        out = F.when(F.lit(False), F.lit(None).cast("string"))
        for pattern in _SPLITS:
            out = out.when(text.rlike(pattern), strip(_part(text, pattern, k)))
        return out.otherwise(text) if k == 1 else out

    # The two forms that facts carry are read as they stand; only other texts are cleaned and split.
    day = lambda x: F.try_to_date(x, "yyyy-MM-dd")
    kind = lambda name: F.lit(name).cast("string")
    single = let(day(c), lambda d: F.when(d.isNotNull(), F.struct(c.alias("raw"), d.alias("start"), d.alias("end"), kind("day").alias("granularity"), F.lit(False).alias("is_interval"))))
    left, right = day(F.substring(c, 1, 10)), day(F.substring(c, 12, 10))
    double = F.when(left.isNotNull() & right.isNotNull(), F.struct(c.alias("raw"), left.alias("start"), right.alias("end"), kind(None).alias("granularity"), F.lit(True).alias("is_interval")))
    # The sides as an array, parsed by one expression.
    times = let(clean(c), lambda text: F.transform(F.array(side(text, 1), side(text, 2)), lambda x: F.struct(x.isNotNull().alias("given"), _single(x, month_first).alias("t"))))
    written = let(times, lambda ts: F.when(F.get(ts, F.lit(1))["given"], _between(c, F.get(ts, F.lit(0))["t"], F.get(ts, F.lit(1))["t"])).otherwise(_point(c, F.get(ts, F.lit(0))["t"])))
    return F.when(c.rlike(_PLAIN_DAY), single).when(c.rlike(_PLAIN_DAYS), double).otherwise(written)


def normalize_time(c: Column) -> Column:
    """A point or an interval: ``A-B`` of days or years, ``A to B``, ``A - B``, or one time."""
    return _normalized(c, clean_time, True)


def time_error(c: Column) -> Column:
    """Whether ``normalize_time`` has a text that is an error for callers that raise: ``A to B`` or years of which one side is no time."""
    text = clean_time(c)
    return F.coalesce((text.rlike(_TO) | text.rlike(_YEARS)) & ~text.rlike(_DAYS) & normalize_time(c).isNull(), F.lit(False))


def normalize_time_strict(c: Column) -> Column:
    """As ``normalize_time`` with the strict single parser; intervals that end before they begin are null."""
    return let(_normalized(c, clean_time_strict, False), lambda t: F.when(t["end"] >= t["start"], t))


def explicit_interval(a: Column, b: Column) -> Column:
    """From the beginning of ``a`` to the end of ``b``; null if either is no time (an error for callers that raise)."""
    singles = F.transform(F.array(a, b), lambda x: let(clean_time(x), lambda t: _single(t, True)))
    return let(singles, lambda ts: _between(F.concat(a, F.lit(" to "), b), F.get(ts, F.lit(0)), F.get(ts, F.lit(1))))


def coarsen(start: Column, end: Column, granularity: Column) -> tuple[Column, Column]:
    """The range widened to whole days, months or years; unchanged without a granularity."""
    unit = F.when(granularity == "month", "MM").when(granularity == "year", "YYYY")
    year_end = F.last_day(F.add_months(F.trunc(end, "YYYY"), 11))
    return F.when(unit.isNull(), start).otherwise(F.when(unit == "MM", F.trunc(start, "MM")).otherwise(F.trunc(start, "YYYY"))), F.when(unit.isNull(), end).when(unit == "MM", F.last_day(end)).otherwise(year_end)


def flexible_date(c: Column) -> Column:
    """``Y``, ``Y-M`` or ``Y-M-D`` with years of any width up to 4; missing parts are 1."""
    p = r"^(\d{1,4})(?:-(\d{1,2}))?(?:-(\d{1,2}))?$"
    text = strip(c)
    return F.when(text.rlike(p), _date(_part(text, p, 1), F.coalesce(_part(text, p, 2), F.lit("1")), F.coalesce(_part(text, p, 3), F.lit("1"))))


def iso_date(c: Column) -> Column:
    """``YYYY-MM-DD`` with three or four digits of the year."""
    p = r"^(\d{3,4})-(\d{2})-(\d{2})$"
    text = strip(c)
    return F.when(text.rlike(p), _date(_part(text, p, 1), _part(text, p, 2), _part(text, p, 3)))


def sort_date(c: Column) -> Column:
    """The date to sort by: ``YYYY-MM-DD``, ``YYYY-MM`` or ``YYYY``; anything else sorts last."""
    return F.coalesce(F.when(c.rlike(rf"^{DAY}$"), F.try_to_date(c, "yyyy-MM-dd")), F.when(c.rlike(r"^\d{4}-\d{2}$"), F.try_to_date(F.concat(c, F.lit("-01")), "yyyy-MM-dd")), F.when(c.rlike(r"^\d{4}$"), F.try_to_date(F.concat(c, F.lit("-01-01")), "yyyy-MM-dd")), F.lit("9999-12-31").cast("date"))


def make_timestamp(start: Column, end: Column) -> Column:
    """One text for a point, ``start-end`` for an interval."""
    return F.when(start == end, start).otherwise(F.concat(start, F.lit("-"), end))


def duration_days(start: Column, end: Column) -> Column:
    """Whole days from start to end, 0 for a point; null if the end comes first (an error for callers that raise)."""
    return F.when(end >= start, F.datediff(end, start))


def duration_text(start: Column, end: Column) -> Column:
    return F.concat(duration_days(start, end).cast("string"), F.lit(" days"))


def interval_text(start: Column, end: Column) -> Column:
    return F.concat(start, F.lit(" to "), end)


def event_time(start: Column, end: Column) -> Column:
    """Time struct of an event; the granularity is ``day`` for points."""
    return F.struct(interval_text(start.cast("string"), end.cast("string")).alias("raw"), start.alias("start"), end.alias("end"), F.when(start == end, "day").alias("granularity"), (start != end).alias("is_interval"))


def edge_time(timestamp: Column, start: Column, end: Column) -> Column:
    """A fact's time from its timestamp text, else from its start and end texts."""
    return F.coalesce(normalize_time_strict(timestamp), normalize_time_strict(F.concat(start, F.lit(" to "), end)))


def answer_timestamps(c: Column) -> Column:
    """Forms under which a time answers: a day as ``d-d``; an interval ``A-B`` as itself and its ends as points; else the folded text; none for null and empty."""
    from .text import folded_text

    text = strip(c)
    a, b = _part(text, _DAYS, 1), _part(text, _DAYS, 2)
    twice = lambda d: F.concat(d, F.lit("-"), d)
    none = F.array().cast("array<string>")
    return F.when(c.isNull() | (c == ""), none).when(text.rlike(_DAYS), F.array_distinct(F.array(F.concat(a, F.lit("-"), b), twice(a), twice(b)))).when(text.rlike(rf"^{DAY}$"), F.array(twice(text))).otherwise(F.array(folded_text(text)))


def gold_answer(c: Column) -> Column:
    """A gold answer for matching: null for plain digits (years too) and durations; ``A to B`` as ``A-B``, days as ``d-d``; else the folded text."""
    from .text import folded_text

    text = strip(F.lower(c))
    to = rf"^({DAY})\s+to\s+({DAY})$"
    return (
        F.when(text.rlike(r"^\d+$") | text.rlike(r"^\d+\s+days?$"), F.lit(None).cast("string"))
        .when(text.rlike(to), F.concat(_part(text, to, 1), F.lit("-"), _part(text, to, 2)))
        .when(text.rlike(rf"^{DAY}$"), F.concat(text, F.lit("-"), text))
        .otherwise(folded_text(text))
    )


def dates_in(c: Column) -> Column:
    """All days and years that stand in a text, in order."""
    return F.regexp_extract_all(c, F.lit(r"(\d{4}(?:-\d{2}-\d{2})?)"), F.lit(1))
