"""Row predicates as Spark ``Column`` expressions.

``as_of`` stands for every "today" of the original application and is always
a literal, so Catalyst folds ``as_of + n`` and pushes the comparisons into the
Parquet scan.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SOON_DAYS = 7  # fixed value: the "expiring soon" window of the reports
DEFAULT_WITHIN_DAYS = 7  # fixed value: used when the day count is missing, unparsable or 0


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _d(as_of: dt.date | str) -> Column:
    return F.lit(dt.date.fromisoformat(as_of) if isinstance(as_of, str) else as_of)


def is_active(c: Column | str = "is_active") -> Column:
    """Visibility of soft-deleted profiles."""
    return _c(c) == F.lit(True)


def non_blank(c: Column | str) -> Column:
    """P5: text present (blank, not null, means unknown)."""
    return _c(c) != F.lit("")


def expired(date: Column | str, as_of: dt.date | str) -> Column:
    """Date present and on or before today (today counts as expired)."""
    d = _c(date)
    return d.isNotNull() & (d <= _d(as_of))


def expiring_soon(date: Column | str, as_of: dt.date | str, days: int = SOON_DAYS) -> Column:
    """Today < date <= today + days."""
    d = _c(date)
    return d.isNotNull() & (d > _d(as_of)) & (d <= F.date_add(_d(as_of), days))


def parse_days(days) -> int:
    """``parseInt(x, 10) || 7``: missing, unparsable or 0 becomes 7."""
    if days is None:
        return DEFAULT_WITHIN_DAYS
    if isinstance(days, bool):
        days = int(days)
    if isinstance(days, (int, float)):
        n = int(days)
    else:
        s = str(days).strip()
        sign = -1 if s.startswith("-") else 1
        s = s[1:] if s[:1] in "+-" else s
        digits = ""
        for ch in s:
            if not ch.isdigit():
                break
            digits += ch
        n = sign * int(digits) if digits else 0
    return n or DEFAULT_WITHIN_DAYS


def due_within(date: Column | str, as_of: dt.date | str, days) -> Column:
    """Date <= today + n, no lower bound (includes expired rows)."""
    d = _c(date)
    return d.isNotNull() & (d <= F.date_add(_d(as_of), parse_days(days)))


def positive(c: Column | str = "sale_price") -> Column:
    """P9."""
    return _c(c) > F.lit(0)


_WHEN = re.compile(r"(\d{4})-(\d{1,2})-(\d{1,2})(?:[ T](\d{1,2}):(\d{1,2})(?::(\d{1,2})(?:\.(\d{1,6}))?)?)?")


def parse_moment(value: str | dt.date | None) -> dt.datetime | None:
    """A date (padded or not) with or without a time; blank is none, anything else an error."""
    if value is None or value == "":
        return None
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    if isinstance(value, dt.date):
        return dt.datetime(value.year, value.month, value.day)
    m = _WHEN.fullmatch(str(value).strip())
    if not m:
        raise ValueError(f"not a date: {value!r}")
    *parts, fraction = m.groups()
    return dt.datetime(*(int(x or 0) for x in parts), int((fraction or "0").ljust(6, "0")))


def parse_range(date_from, date_to) -> tuple[dt.datetime | None, dt.datetime | None]:
    """P10's bounds, both inclusive: ``to`` is a date and means 'to 23:59:59' of that day."""
    low, high = parse_moment(date_from), parse_moment(date_to)
    if high is not None and (isinstance(date_to, dt.datetime) or not isinstance(date_to, dt.date) and re.search("[T:]", str(date_to))):
        raise ValueError(f"the end of a range is a date without a time: {date_to!r}")
    return low, high and high.replace(hour=23, minute=59, second=59)


def _moment(t: dt.datetime) -> Column:
    return F.lit(t.isoformat(sep=" ")).cast("timestamp_ntz")


def created_between(c: Column | str, date_from: str | None, date_to: str | None) -> Column:
    """P10: optional range. Fractions of the last second fall outside, as in the original."""
    col, cond = _c(c), F.lit(True)
    low, high = parse_range(date_from, date_to)
    if low is not None:
        cond = cond & (col >= _moment(low))
    if high is not None:
        cond = cond & (col <= _moment(high))
    return cond


def required(*cols: str) -> Column:
    """All named request fields present and not blank (falsy is invalid)."""
    cond = F.lit(True)
    for name in cols:
        c = F.col(name)
        cond = cond & c.isNotNull() & (F.trim(c.cast("string")) != F.lit(""))
    return cond
