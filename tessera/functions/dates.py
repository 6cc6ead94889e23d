"""Calendar functions: units from second to half-year, windows relative to an anchor, differences in boundaries crossed."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

UNITS = ("second", "minute", "hour", "day", "week", "month", "quarter", "half_year", "year")
#: Other spellings of the units.
ALIASES = {
    "second": "s sec secs seconds".split(),
    "minute": "min mins minutes mi".split(),
    "hour": "h hr hrs hours hh hourly".split(),
    "day": "d days dd daily".split(),
    "week": "w wk weeks wks weekly".split(),
    "month": "mo mos mon mons months mm mth mths monthly".split(),
    "quarter": "q qtr quarters qtrs quarterly".split(),
    "half_year": "half half-year halfyear halfyears half_years halves semester semesters semiannual semi_annual semi-annual semiannually h1 h2".split(),
    "year": "y yr yrs years yyyy yearly annual annually".split(),
}
_CANONICAL = {a: u for u, names in ALIASES.items() for a in (u, *names)}
_MONTHS = {"month": 1, "quarter": 3, "half_year": 6, "year": 12}
_SECONDS = {"second": 1, "minute": 60, "hour": 3600}


def unit(name: str) -> str:
    found = _CANONICAL.get(name.strip().lower())
    if found is None:
        raise ValueError(f"unknown calendar unit {name!r}")
    return found


def truncate(u: str, c: Column) -> Column:
    """The start of the unit, as a timestamp without time zone."""
    u = unit(u)
    if u == "half_year":
        return F.make_timestamp_ntz(F.year(c), F.when(F.month(c) <= 6, F.lit(1)).otherwise(F.lit(7)), F.lit(1), F.lit(0), F.lit(0), F.lit(0))
    return F.date_trunc(u, c).cast("timestamp_ntz")


def part(u: str, c: Column) -> Column:
    """The number of the unit within its larger one, as a bigint; seconds without their fraction."""
    u = unit(u)
    if u == "half_year":
        return F.when(F.month(c) <= 6, F.lit(1)).when(F.month(c) > 6, F.lit(2)).cast("bigint")
    return F.floor(F.extract(F.lit(u), c)).cast("bigint")


def shift(c: Column, amount: int, u: str) -> Column:
    """``c`` moved by so many units; dates stay dates for units of a day and up, months end at the month's last day."""
    u = unit(u)
    if u in _MONTHS:
        return c + F.make_interval(months=F.lit(amount * _MONTHS[u]))
    if u in ("day", "week"):
        return c + F.make_interval(days=F.lit(amount * (7 if u == "week" else 1)))
    return c + F.make_interval(secs=F.lit(amount * _SECONDS[u]))


def difference(u: str, start: Column, end: Column) -> Column:
    """Boundaries of the unit between two moments, as a bigint: two times in one month are 0 months apart. Weeks are whole ones."""
    u = unit(u)
    if u in _MONTHS:
        n = _MONTHS[u]
        index = lambda c: F.floor((F.year(c) * 12 + F.month(c) - 1) / n)
        return (index(end) - index(start)).cast("bigint")
    if u == "day":
        return F.datediff(end.cast("date"), start.cast("date")).cast("bigint")
    if u == "week":  # whole weeks between the days, towards zero
        return (F.datediff(end.cast("date"), start.cast("date")) / 7).cast("bigint")
    seconds = lambda c: F.unix_timestamp(F.date_trunc(u, c).cast("timestamp"))
    return F.floor((seconds(end) - seconds(start)) / _SECONDS[u]).cast("bigint")


def parse_iso(text: str) -> date | datetime:
    """An ISO date or timestamp; anything else is refused as ambiguous."""
    try:
        return date.fromisoformat(text) if len(text) == 10 else datetime.fromisoformat(text)
    except ValueError:
        raise ValueError(f"{text!r} is not an ISO date") from None


def literal(value: date | datetime) -> Column:
    if isinstance(value, datetime):
        return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value.isoformat()).cast("date")


def window(c: Column, is_date: bool, amount: int, u: str, now: date | datetime) -> Column:
    """The last ``amount`` units up to the anchor, both ends included; 0: since the current unit began.

    The upper end is the anchor itself: on a timestamp column, an anchor that is a date ends at its midnight.
    """
    u = unit(u)
    if is_date and u in _SECONDS:
        raise ValueError(f"a {u} window on a date column")
    anchor = literal(now)
    low = truncate(u, anchor) if amount == 0 else shift(anchor, -amount, u)
    return (c >= low) & (c <= anchor)
