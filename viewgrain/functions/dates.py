"""Date functions with boundary-counting differences and named parts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Pattern letters for the name of a date part.
_NAME_PATTERNS = {"year": "yyyy", "month": "MMMM", "weekday": "EEEE", "day": "d"}
# Seconds in the units below a day.
_SECONDS = {"hour": 3600, "minute": 60, "second": 1}

PARTS = ("year", "quarter", "month", "week", "day", "hour", "minute", "second")


def date_add(part: str, n: int | Column, d: Column) -> Column:
    """Add ``n`` of any part; months are clipped to the last day, and the type is kept."""
    count = F.lit(n) if isinstance(n, int) else n
    if part in ("quarter", "month", "year"):
        months = {"year": 12, "quarter": 3, "month": 1}[part]
        return d + F.make_interval(months=(count * months).cast("int"))
    if part == "week":
        return d + F.make_interval(weeks=count.cast("int"))
    if part == "day":
        return d + F.make_interval(days=count.cast("int"))
    return d + F.make_dt_interval(secs=count * _SECONDS[part])


def date_diff(part: str, a: Column, b: Column) -> Column:
    """How many boundaries of ``part`` lie between ``a`` and ``b``; weeks start on Monday."""
    if part == "year":
        return (F.year(b) - F.year(a)).cast("bigint")
    if part == "quarter":
        return ((F.year(b) - F.year(a)) * 4 + F.quarter(b) - F.quarter(a)).cast("bigint")
    if part == "month":
        return ((F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)).cast("bigint")
    if part == "week":
        days = F.datediff(F.date_trunc("week", b), F.date_trunc("week", a))
        return F.floor(days / 7).cast("bigint")
    if part == "day":
        return F.datediff(b, a).cast("bigint")
    whole = [F.unix_timestamp(F.date_trunc(part, x.cast("timestamp"))) for x in (a, b)]
    return ((whole[1] - whole[0]) / _SECONDS[part]).cast("bigint")


def date_name(part: str, d: Column) -> Column:
    if part == "quarter":
        return F.quarter(d).cast("string")
    if part == "week":
        return F.weekofyear(d).cast("string")
    return F.date_format(d, _NAME_PATTERNS[part])


def date_part(part: str, d: Column) -> Column:
    """Discrete part as an integer; weekdays count from Sunday = 1."""
    match part:
        case "year":
            return F.year(d)
        case "quarter":
            return F.quarter(d)
        case "month":
            return F.month(d)
        case "week" | "isoweek":
            return F.weekofyear(d)
        case "day":
            return F.dayofmonth(d)
        case "weekday":
            return F.dayofweek(d)
        case "isoyear":
            return F.extract(F.lit("YEAROFWEEK"), d)
        case "isoquarter":
            return F.least(F.lit(4), F.ceil(F.weekofyear(d) / 13)).cast("int")
        case "hour":
            return F.hour(d)
        case "minute":
            return F.minute(d)
    raise ValueError(f"unknown date part {part!r}")


def date_trunc(part: str, d: Column) -> Column:
    """Continuous date at the start of the part; a year is its number."""
    return F.year(d) if part == "year" else F.date_trunc(part, d)


def is_date(s: Column) -> Column:
    return s.try_cast("date").isNotNull()


def make_datetime(d: Column, time: Column) -> Column:
    return F.concat_ws(" ", d.cast("date").cast("string"), time).try_cast("timestamp")


def make_time(h: Column, m: Column, s: Column) -> Column:
    """Time of day as text."""
    return F.format_string("%02d:%02d:%02d", h, m, s)
