"""Date expressions. Everything is a plain date: no time zones, no clock reads."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.numeric import round_half_away

DAYS_PER_YEAR = 365.25


def as_date(x: Column | dt.date) -> Column:
    return F.lit(x) if isinstance(x, dt.date) else x.cast("date")


def days_between(start: Column | dt.date, end: Column | dt.date) -> Column:
    """Midnights from start to end, as a long."""
    return F.date_diff(as_date(end), as_date(start)).cast("bigint")


def age_years(birth: Column, at: Column | dt.date, digits: int) -> Column:
    return round_half_away(days_between(birth, at) / F.lit(DAYS_PER_YEAR), digits)


def age_after(age: Column, days: Column) -> Column:
    return age + days / F.lit(DAYS_PER_YEAR)


def months_before(x: Column, months: int) -> Column:
    """Calendar months back, clipped to the month's last day."""
    return F.add_months(x, -months)


def days_before(x: Column, days: int) -> Column:
    return F.date_sub(x, days)


def month_label(x: Column) -> Column:
    return F.date_format(x, "MMMM yyyy")
