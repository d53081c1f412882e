"""Date parsing and period labels as built-in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The numeric day/month/year layouts accepted (with / or -
# separators, optional H:mm or H:mm:ss).  Day-first wins for ambiguous values
# such as 12/1/2010 (→ 12 January); month-first is the fallback when the
# day-first reading is impossible (12/25/2010 → 25 December).  Anything
# else goes through the ISO-8601 parser (yyyy-MM-dd[ HH:mm:ss], also with /).
NUMERIC_DMY = r"^\d{1,2}[/-]\d{1,2}[/-]\d{4}(\s+\d{1,2}:\d{2}(:\d{2})?)?$"


def parse_mixed_timestamp(c: Column) -> Column:
    """CLEAN-5: mixed-format, day-first timestamp parse; NULL when nothing
    fits.  Numeric d/m/y values are cut at their separators and built with one
    ``try_make_timestamp``: a second number up to 12 is the month, else the first is.
    (A day-first value whose second number is a month and yet is no date has a
    first number that is no month either.)  Other values use the ISO parser.
    """
    s = F.trim(c)
    day = F.translate(s, "-", "/")
    rest = F.substring_index(day, "/", -1)                                    # yyyy[ H:mm[:ss]]
    time = F.concat(F.substring(rest, 5, 100), F.lit(":0:0"))

    def part(text: Column, sep: str, i: int) -> Column:
        return F.substring_index(F.substring_index(text, sep, i), sep, -1).try_cast("int")

    def clock(i: int) -> Column:
        return F.when(F.length(rest) > 4, F.coalesce(part(time, ":", i), F.lit(0))).otherwise(0)

    a, b = part(day, "/", 1), part(day, "/", 2)
    numeric = F.try_make_timestamp(F.substring(rest, 1, 4).try_cast("int"), F.when(b <= 12, b).otherwise(a), F.when(b <= 12, a).otherwise(b),
                                   clock(1), clock(2), clock(3))
    return F.when(s.rlike(NUMERIC_DMY), numeric).otherwise(F.try_to_timestamp(F.translate(s, "/", "-")))


def period_label(d: Column, granularity: str) -> Column:
    """TREND-1 period labels.

    daily ``yyyy-MM-dd``; monthly ``yyyy-MM``; weekly = ISO week-year and
    week (``IYYY-IW``); weekly_w = week of year with Monday as first day and
    days before the first Monday in week 00 (``%Y-%W``).
    """
    d = F.to_date(d)
    if granularity == "daily":
        return F.date_format(d, "yyyy-MM-dd")
    if granularity == "monthly":
        return F.date_format(d, "yyyy-MM")
    if granularity == "weekly":
        return F.concat(F.extract(F.lit("YEAROFWEEK"), d).cast("string"), F.lit("-"),
                        F.lpad(F.weekofyear(d).cast("string"), 2, "0"))
    if granularity == "weekly_w":
        wk = F.floor((F.dayofyear(d) - 1 + 7 - F.weekday(d)) / 7)
        return F.concat(F.year(d).cast("string"), F.lit("-"), F.lpad(wk.cast("string"), 2, "0"))
    raise ValueError(f"unknown granularity {granularity!r}")


def days_between_floor(later: Column, earlier: Column) -> Column:
    """Whole days elapsed between two timestamps (Python timedelta.days)."""
    secs = F.unix_seconds(later.cast("timestamp")) - F.unix_seconds(earlier.cast("timestamp"))
    return F.floor(secs / 86400).cast("long")
