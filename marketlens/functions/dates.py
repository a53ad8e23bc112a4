"""Date cleaning and the calendar ranges offered by the dashboard."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from marketlens.functions.text import WHITE_SPACE, trim_text

# Day 0 of spreadsheet serial dates, and the serials of years 1 and 9999.
_SERIAL_EPOCH = dt.datetime(1899, 12, 30)
_FIRST_SERIAL = -693593
_LAST_SERIAL = 2958465

# Layouts tried on text that is not d/m/y or y/m/d, by the shape of the text.
FALLBACK_FORMATS = {
    r"^\d{8}$": ["yyyyMMdd"],
    r"^\d+\.\d+\.\d+$": ["yyyy.M.d", "M.d.yyyy"],
    r"^\d+ [A-Za-z]{3}": ["d MMM yyyy", "d MMMM yyyy", "d MMM yyyy HH:mm"],
    r"^[A-Za-z]{3,} \d": ["MMM d, yyyy", "MMMM d, yyyy", "MMM d, yyyy HH:mm"],
}
_WEEKDAY = r"^(?i)(mon|tue|wed|thu|fri|sat|sun)[a-z]*,?\s+"


def _parsed(c: Column, *formats: str) -> Column:
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz") for f in formats])


def text_to_timestamp(c: Column) -> Column:
    """Timestamp without zone from date text; NULL where it is no valid date.

    Day first, then year first, both cut to midnight; other layouts are tried
    only where the text has neither shape.
    """
    text = trim_text(c)
    # Up to the first white space or T, with either separator written as a slash.
    day_part = F.substring_index(F.translate(text, WHITE_SPACE + "T-", " " * len(WHITE_SPACE) + " /"), " ", 1)
    rest = F.regexp_replace(text, _WEEKDAY, "")
    value = F.when(day_part.rlike(r"^\d{1,2}/\d{1,2}/\d{4}$"), _parsed(day_part, "d/M/yyyy"))
    value = value.when(day_part.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$"), _parsed(day_part, "yyyy/M/d"))
    for shape, formats in FALLBACK_FORMATS.items():
        value = value.when(rest.rlike(shape), _parsed(rest, *formats))
    return value


def serial_to_timestamp(c: Column) -> Column:
    """Timestamp without zone from a spreadsheet serial number (days, fraction = time of day)."""
    serial = c.cast("double")
    usable = F.when(serial.between(_FIRST_SERIAL, _LAST_SERIAL), serial)
    days = F.floor(usable)
    seconds = F.round((usable - days) * 86400, 6).cast("decimal(18,6)")
    zero = F.lit(0)
    epoch = F.lit(_SERIAL_EPOCH.isoformat(sep=" ")).cast("timestamp_ntz")
    return epoch + F.make_dt_interval(days.cast("int"), zero, zero, seconds)


# ---------------------------------------------------------------------------
# Named ranges. Every function returns (first day, last day), both inclusive.
# ---------------------------------------------------------------------------
PRESETS = [
    "today", "yesterday", "last7", "last30",
    "this_month", "last_month", "this_quarter", "last_quarter", "this_year", "last_year",
]


def preset_range(preset: str, as_of: Column) -> tuple[Column, Column]:
    """Range of a preset seen from `as_of`: running periods end on that day, past ones are whole."""
    day = as_of.cast("date")
    if preset == "today":
        return day, day
    if preset == "yesterday":
        return F.date_sub(day, 1), F.date_sub(day, 1)
    if preset in ("last7", "last30"):
        return F.date_sub(day, int(preset[4:]) - 1), day
    span, unit = preset.split("_")
    start = F.trunc(day, unit)
    if span == "this":
        return start, day
    months = {"month": 1, "quarter": 3, "year": 12}[unit]
    return F.add_months(start, -months), F.date_sub(start, 1)


def month_range(year: Column, month: Column) -> tuple[Column, Column]:
    first = F.make_date(year, month, F.lit(1))
    return first, F.last_day(first)


def quarter_range(year: Column, quarter: Column) -> tuple[Column, Column]:
    first = F.make_date(year, ((quarter - 1) * 3 + 1).cast("int"), F.lit(1))
    return first, F.last_day(F.add_months(first, 2))


def year_range(year: Column) -> tuple[Column, Column]:
    return F.make_date(year, F.lit(1), F.lit(1)), F.make_date(year, F.lit(12), F.lit(31))
