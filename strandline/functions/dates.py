"""Dates in many notations. Nothing here fails under ANSI mode; what can't be read is NULL."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

from strandline.functions.keys import let

#: Pattern that a text must have, and the format it is then read by.
NOTATIONS = [
    (r"^\d{4}-\d{2}-\d{2}", "yyyy-MM-dd", 10),
    (r"^\d{8}(\d{6})?$", "yyyyMMdd", 8),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d", 99),
    (r"^\d{4}\.\d{1,2}\.\d{1,2}$", "yyyy.M.d", 99),
    (r"^\d{1,2}\.\d{1,2}\.\d{4}$", "d.M.yyyy", 99),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy", 99),
    (r"^\d{1,2} [A-Za-z]{4,} \d{4}$", "d MMMM yyyy", 99),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy", 99),
    (r"^[A-Za-z]{4,} \d{1,2}, \d{4}$", "MMMM d, yyyy", 99),
]


def read_date(c: Column) -> Column:
    """A date from ISO dates and timestamps, compact, slashed, dotted and English notations."""

    def of(t: Column) -> Column:
        out = F.lit(None).cast("date")
        for pattern, fmt, n in reversed(NOTATIONS):
            cut = F.substring(t, 1, n) if n < 99 else F.initcap(t) if "MMM" in fmt else t
            out = F.when(t.rlike(pattern), F.to_date(F.try_to_timestamp(cut, F.lit(fmt)))).otherwise(out)
        return out

    return let(F.regexp_replace(F.trim(c), r"\s+", " "), of)


def compact_to_iso(c: Column) -> Column:
    """``20190524`` or ``20190524.0`` as ``2019-05-24``; NULL where that is no calendar date."""
    digits = F.regexp_extract(F.trim(c.cast("string")), r"^(\d{8})\d*(?:\.0*)?$", 1)
    return F.date_format(F.to_date(F.try_to_timestamp(F.nullif(digits, F.lit("")), F.lit("yyyyMMdd"))), "yyyy-MM-dd")


def asymmetric_tolerance(own: Column, other: Column) -> Column:
    """Days two dates may differ: 1 if both are event dates, 2 if one is, 3 if both are publication dates."""
    return F.when((own == "event") & (other == "event"), 1).when((own == "event") | (other == "event"), 2).otherwise(3)


def dynamic_window(base: Column, cap: Column, hours_a: Column, hours_b: Column) -> Column:
    """min(cap, max(base, whole days of the longer duration, rounded up, plus one))."""
    longest = F.greatest(F.coalesce(hours_a, F.lit(0.0)), F.coalesce(hours_b, F.lit(0.0)))
    return F.least(cap, F.greatest(base, F.ceil(longest / 24) + 1))


def period(c: Column) -> tuple[Column, Column, Column]:
    """(year, month, rank) of ``2020M05`` (3), ``2020Q2`` (2: its first month) or ``2020`` (1: month NULL)."""
    year = F.when(c.rlike(r"^\d{4}(M\d{2}|Q[1-4])?$"), F.substring(c, 1, 4).cast("int"))
    m = F.when(c.rlike(r"^\d{4}M\d{2}$"), F.substring(c, 6, 2).cast("int")).when(c.rlike(r"^\d{4}Q[1-4]$"), F.substring(c, 6, 1).cast("int") * 3 - 2)
    return year, m, F.when(c.rlike("M"), 3).when(c.rlike("Q"), 2).when(year.isNotNull(), 1)


def month_cycle(d: Column) -> tuple[Column, Column]:
    angle = 2 * F.pi() * F.month(d) / 12
    return F.sin(angle), F.cos(angle)


#: Words that make a phrase relative to the day it was written.
RELATIVE = r"(?i)\b(last|next|this|ago|since|yesterday|today|tomorrow|earlier|recent|recently|monday|tuesday|wednesday|thursday|friday|saturday|sunday)\b"
_ABSOLUTE = [
    (r"(\d{4}-\d{2}-\d{2})", None), (r"(\d{1,2} [A-Za-z]{3,9} \d{4})", None), (r"([A-Za-z]{3,9} \d{1,2}, \d{4})", None),
    (r"\b(\d{1,2} (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*)\b", "{} {}"), (r"\b((?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2})\b", "{}, {}"),
]


def event_start(text: Column, published: Column, resolve_relative: bool = False) -> Column:
    """The date a phrase gives for an event's start; a missing year is that of publication, which must lie between 1990 and next year.

    Phrases relative to the day of writing give NULL, or with ``resolve_relative`` the date that stands in them all the same.
    """
    found = []
    for pattern, with_year in _ABSOLUTE:
        got = F.regexp_extract(text, pattern, 1)
        if with_year:
            a, b = with_year.split("{}")[1], F.year(published).cast("string")
            got = F.when(got != "", F.concat(got, F.lit(a), b))
        found.append(read_date(got))
    d = F.coalesce(*found)
    d = F.when(F.year(d).between(1990, F.year(F.current_date()) + 1), d)
    return d if resolve_relative else F.when(~F.coalesce(text.rlike(RELATIVE), F.lit(False)), d)


def parse_days(spec: str) -> list[date]:
    """Days of ``20240105``, a range ``20240105-20240110`` in either order, or a list ``20240105,20240110``; sorted, each once.

    A date that doesn't exist is an error.
    """
    day = lambda t: datetime.strptime(t.strip(), "%Y%m%d").date()
    if "," in spec:
        return sorted({day(t) for t in spec.split(",") if t.strip()})
    if "-" in spec:
        a, b = sorted(day(t) for t in spec.split("-", 1))
        return [a + timedelta(i) for i in range((b - a).days + 1)]
    return [day(spec)]


def year_windows(first: int, end: date) -> list[tuple[date, date]]:
    """Whole years from ``first`` on, the last one up to ``end``."""
    return [(date(y, 1, 1), min(date(y, 12, 31), end)) for y in range(first, end.year + 1)]


def month_windows(start: date, end: date, overlap: int = 0) -> list[tuple[date, date, date, date]]:
    """(read from, read to, first, last) per month: what is read reaches ``overlap`` days over the month's own days."""
    out, at = [], start.replace(day=1)
    while at <= end:
        after = (at.replace(day=28) + timedelta(4)).replace(day=1)
        lo, hi = max(at, start), min(after - timedelta(1), end)
        out.append((lo - timedelta(overlap), hi + timedelta(overlap), lo, hi))
        at = after
    return out


def sliding_windows(start: date, end: date, length: int, step: int) -> list[tuple[date, date]]:
    """Windows of ``length`` days, one every ``step`` days, until one reaches ``end``."""
    out, at = [], start
    while True:
        out.append((at, min(at + timedelta(length - 1), end)))
        if out[-1][1] >= end:
            return out
        at += timedelta(step)


def quarter_hours(day: date) -> list[datetime]:
    """The 96 slots of a day."""
    return [datetime(day.year, day.month, day.day) + timedelta(minutes=15 * i) for i in range(96)]


def elapsed(seconds: float) -> str:
    """Hours, minutes and seconds, as far as there are any."""
    h, rest = divmod(int(seconds), 3600)
    m, s = divmod(rest, 60)
    return f"{h}h {m:02d}m {s:02d}s" if h else f"{m}m {s:02d}s" if m else f"{seconds:.1f}s"
