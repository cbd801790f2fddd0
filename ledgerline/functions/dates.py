"""Dates as text and as months."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerline.config import MONTHS_SPELLED

# What counts as a numeric date.
_NUMERIC = r"^\s*(\d{1,4})[/\-.](\d{1,2})[/\-.](\d{2,4})"
_PARTS = r"^\s*(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})(?:[ T]+(\d{1,2}):(\d{2})(?::(\d{2})(?:\.\d+)?)?)?"


def is_typed(kind: T.DataType) -> bool:
    """Whether the reader already made times of a column."""
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))


def numeric_date(c: Column) -> tuple[Column, Column, Column]:
    """Whether text starts with a numeric date, its first and its second component."""
    return c.rlike(_NUMERIC), F.regexp_extract(c, _NUMERIC, 1), F.regexp_extract(c, _NUMERIC, 2)


def _built(c: Column, day: int, month: int) -> Column:
    """A time from numeric parts; null where they are no date."""
    part = lambda k: F.regexp_extract(c, _PARTS, k)
    year = F.when(F.length(part(3)) == 2, F.concat(F.lit("20"), part(3))).otherwise(part(3))
    pad = lambda x: F.lpad(F.coalesce(F.nullif(x, F.lit("")), F.lit("0")), 2, "0")
    text = F.concat(year, F.lit("-"), pad(part(month)), F.lit("-"), pad(part(day)), F.lit(" "), pad(part(4)), F.lit(":"), pad(part(5)), F.lit(":"), pad(part(6)))
    return F.when(c.rlike(_PARTS), F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz"))


def parse(c: Column, kind: T.DataType, day_first: bool) -> Column:
    """A zone-less time: as typed, or read from text.

    ISO text is read as such (an offset is dropped, the wall clock stays), other
    numeric dates in the given field order, in the other one where only that is a date.
    """
    if is_typed(kind):
        return c.cast("timestamp_ntz")
    text = c.cast("string")
    iso = F.regexp_replace(F.trim(text), r"(?:Z|[+\-]\d{2}:?\d{2})$", "")
    first, second = (1, 2) if day_first else (2, 1)
    typed = F.when(text.rlike(r"^\s*\d{4}-\d{1,2}-\d{1,2}"), F.try_to_timestamp(iso).cast("timestamp_ntz"))
    return F.coalesce(typed, _built(text, first, second), _built(text, second, first))


def month_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def month_number(ts: Column) -> Column:
    """Months since year 0, as whole number."""
    return F.year(ts) * 12 + F.month(ts) - 1


def month_key(period: str) -> int:
    year, month = period.split("-")
    return int(year) * 12 + int(month) - 1


def month_start(key: int) -> str:
    return f"{key // 12:04d}-{key % 12 + 1:02d}-01 00:00:00"


def month_runs(months: list[str]) -> list[list[int]]:
    """Months as runs of following ones: first and last of each."""
    runs: list[list[int]] = []
    for key in sorted({month_key(m) for m in months}):
        if runs and runs[-1][1] + 1 == key:
            runs[-1][1] = key
        else:
            runs.append([key, key])
    return runs


def in_months(ts: Column, start: str = "", end: str = "", months: list[str] | None = None) -> Column:
    """Rows within a range of months, or in a set of them; a set wins, an empty set has none.

    Ranges, and sets as unions of them, compare the time itself, so they reach the scan.
    """
    if months is not None:
        runs = month_runs(months)
    else:
        low, high = (month_key(m) if m else None for m in (start, end))
        if low is not None and high is not None and low > high:
            low, high = high, low
        runs = [[low, high]]
    found = F.lit(False)
    for low, high in runs:
        part = ts.isNotNull()
        if low is not None:
            part &= ts >= F.lit(month_start(low)).cast("timestamp_ntz")
        if high is not None:
            part &= ts < F.lit(month_start(high + 1)).cast("timestamp_ntz")
        found = found | part
    return found  # never null: each part asks first whether there is a time


# How months and spans of months are written.
SHORT_MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
ALL_DATES, NO_MONTHS, SPAN, BETWEEN = "all dates", "no months", "{} to {}", "{} selected months between {} and {}"


def _written(key: int) -> str:
    year, month = divmod(key, 12)
    return f"{SHORT_MONTHS[month]}-{year % 100:02d}"


def _spelled(runs: list[list[int]], most: int) -> str:
    """Runs of months in words: one run as a span, a few months by name, many by their number and ends."""
    first, last = _written(runs[0][0]), _written(runs[-1][1])
    if len(runs) == 1:
        return first if first == last else SPAN.format(first, last)
    keys = [k for low, high in runs for k in range(low, high + 1)]
    if len(keys) > most:
        return BETWEEN.format(len(keys), first, last)
    return f"{', '.join(map(_written, keys[:-1]))} and {last}"


def month_label(period: str) -> str:
    return _written(month_key(period))


def range_label(start: str, end: str) -> str:
    """``Feb-25 to Jul-26``; one month alone; no filter at all."""
    return _spelled([[month_key(start), month_key(end)]], 0) if start and end else ALL_DATES


def is_contiguous(months: list[str]) -> bool:
    return len(month_runs(months)) == 1


def months_label(months: list[str], spelled: int = MONTHS_SPELLED) -> str:
    """A set of months by name while it is short, by its span beyond that."""
    return _spelled(month_runs(months), spelled) if months else NO_MONTHS


def resolution_days(created: Column, closed: Column) -> Column:
    """Days between two times to two places; negative ones are kept."""
    micros = F.timestamp_diff("MICROSECOND", created, closed)
    return F.round(micros / 8.64e10, 2)
